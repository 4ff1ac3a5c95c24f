"""Compatibility maps: CSV files with ``# key=value`` lines, a header and two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The file's header and keys.
HEADER = "triton_commit,llvm_commit_last_compatible"
KEYS = ("schema_version", "llvm_bump_commit", "old_llvm", "new_llvm", "final_bad_triton_commit", "final_bad_llvm")


def lines_of_map(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n", -1)).alias("line_no", "raw"))
    return lines.withColumn("raw", F.trim("raw"))


def metadata(lines: DataFrame) -> DataFrame:
    """One row with a column per key; a missing key is an error."""
    pairs = lines.where(F.col("raw").startswith("#")).select(F.trim(F.regexp_extract("raw", r"^#\s*([^=]+)=", 1)).alias("k"), F.trim(F.regexp_extract("raw", r"^#[^=]+=(.*)$", 1)).alias("x")).where("k <> ''")
    row = pairs.groupBy().agg(*(F.max(F.when(F.col("k") == k, F.col("x"))).alias(k) for k in KEYS))
    return row.select(*(F.coalesce(k, F.raise_error(F.lit(f"missing key {k}")).cast("string")).alias(k) for k in KEYS))


def pairs(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``idx``, ``triton`` and ``llvm`` of the data rows in order. Blank lines, comments, the
    header and rows with an empty cell are skipped; with ``strict`` a row that doesn't have two
    fields is an error."""
    rows = lines.where((F.col("raw") != "") & ~F.col("raw").startswith("#"))
    cells = F.transform(F.split("raw", ",", -1), lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', "")))
    rows = rows.withColumn("cells", cells).where(~F.lower(F.element_at("cells", 1)).contains("commit"))
    if strict:
        rows = rows.withColumn("cells", F.when(F.size("cells") == 2, F.col("cells")).otherwise(F.raise_error(F.lit("not two fields")).cast("array<string>")))
    rows = rows.select("line_no", F.try_element_at("cells", F.lit(1)).alias("triton"), F.try_element_at("cells", F.lit(2)).alias("llvm"))
    if not strict:
        rows = rows.where("coalesce(triton, '') <> '' and coalesce(llvm, '') <> ''")
    return rows.select((F.row_number().over(Window.orderBy("line_no")) - 1).alias("idx"), "triton", "llvm")


def problems(data: DataFrame, meta: DataFrame) -> DataFrame:
    """``problem`` rows: empty cells, repeated keys, and ends that don't fit the metadata."""
    empty = data.where("triton = '' or llvm = ''").select(F.format_string("empty cell in row %d", "idx").alias("problem"))
    again = data.groupBy("triton").count().where("count > 1").select(F.concat(F.lit("repeated commit "), "triton").alias("problem"))
    last = data.agg(F.max_by("llvm", "idx").alias("llvm"), F.max_by("triton", "idx").alias("triton"))
    ends = meta.crossJoin(last).where("final_bad_llvm <> new_llvm or final_bad_triton_commit <> llvm_bump_commit").select(F.lit("the last bad commits aren't those of the bump").alias("problem"))
    return empty.unionAll(again).unionAll(ends)


def in_range(data: DataFrame, good: str, bad: str) -> DataFrame:
    """Rows from the first whose ``llvm`` fits ``good`` to the last that fits ``bad``. Hashes fit
    if one begins with the other; no rows if either fits none or they come the wrong way."""
    fits = lambda h: F.col("llvm").startswith(h) | F.lit(h).startswith(F.col("llvm"))
    w = Window.partitionBy()
    return data.withColumn("_a", F.min(F.when(fits(good), F.col("idx"))).over(w)).withColumn("_b", F.max(F.when(fits(bad), F.col("idx"))).over(w)).where("idx between _a and _b").drop("_a", "_b")


def write_map(path: str, meta: dict[str, str], rows: list[tuple[str, str]]) -> None:
    text = "".join(f"# {k}={meta[k]}\n" for k in KEYS) + HEADER + "\n" + "".join(f"{a},{b}\n" for a, b in rows)
    with open(path, "w") as f:
        f.write(text)
