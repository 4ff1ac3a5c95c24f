"""Compiler logs of the graph compiler: which kernel file belongs to which compilation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.functions.text import after_glog_prefix

# Fixed value: names of these logs.
LOG_GLOB = "*dedicated_log_torch_trace_*.log"


def kernel_paths(lines: DataFrame) -> DataFrame:
    """``kernel_path`` and ``frame_id``, ``frame_compile_id``, ``attempt``,
    ``compiled_autograd_id`` from lines (``path``, ``line_no``, ``raw``). A record is a header
    and the lines behind it that start with a tab; of records that name one path the last
    counts, later files before earlier ones."""
    by = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = ~F.col("raw").startswith("\t")
    body = lines.withColumn("_record", F.sum(F.when(header, 1).otherwise(0)).over(by))
    head = body.where(header).select("path", "_record", F.try_parse_json(after_glog_prefix(F.col("raw"))).alias("v")).where("v is not null")
    one = lambda n: F.try_variant_get("v", f"$.{n}", "long").alias(n)
    head = head.where(F.array_contains(F.json_object_keys(F.to_json("v")), "inductor_output_code"))
    head = head.select("path", "_record", one("frame_id"), one("frame_compile_id"), one("attempt"), one("compiled_autograd_id"))
    found = body.where(~header).select("path", "_record", "line_no", F.regexp_extract("raw", r"^\t?# kernel path: (.+)$", 1).alias("kernel_path")).where("kernel_path <> ''")
    joined = found.join(head, ["path", "_record"])
    last = Window.partitionBy("kernel_path").orderBy(F.desc("path"), F.desc("line_no"))
    return joined.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_record", "path", "line_no")
