"""Parsed output: every compilation's events in the file of the compile that made it.

A file is a folder ``rank=<r>/output_file=<name>`` of one partitioned write, whose names are those
of single-file output: ``f<frame>_fc<compile>_a<attempt>_cai<autograd>.ndjson`` where a frame is
known, else the trace's own. A manifest is written last; without it an output isn't finished.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from tracequarry.functions.canonical import nested
from tracequarry.functions.values import field
from tracequarry.operators.ordering import islands, join_on, settled
from tracequarry.plans import source_maps
from tracequarry.plans.merge import Merged

#: Lines that share one file of the write before another is begun.
LINES_EACH = 1_000_000
#: Order of events within a hash.
SECTIONS = ("compilation", "launch", "roofline", "launch_diff", "autotune_analysis", "autotune_summary")


def output_name(info: Column, base: str) -> Column:
    """File of a compilation from a struct ``frame_id``, ``frame_compile_id``, ``attempt`` and
    ``compiled_autograd_id``; ``base`` names the file of those without a frame."""
    part = lambda name, other: F.coalesce(info[name].cast("string"), F.lit(other))
    named = F.concat(F.lit("f"), part("frame_id", "None"), F.lit("_fc"), part("frame_compile_id", "None"), F.lit("_a"), part("attempt", "0"), F.lit("_cai"), part("compiled_autograd_id", "-"), F.lit(".ndjson"))
    return F.when(info["frame_id"].isNotNull() | info["frame_compile_id"].isNotNull(), named).otherwise(F.lit(f"{base}_mapped.ndjson"))


def output_files(compilations: DataFrame, base: str, split: bool = True, known: DataFrame | None = None) -> DataFrame:
    """``rank``, ``hash`` and ``output_file`` of every compilation. A compile's numbers are those in
    the event, else those of the kernel paths in ``known`` (``sources.glog.kernel_paths``)."""
    if not split:
        return compilations.select("rank", "hash", F.lit(f"{base}_mapped.ndjson").alias("output_file"))
    told = lambda name: field(F.col("v"), f"payload.pt_info.{name}", "long")
    own = F.struct(told("frame_id").alias("frame_id"), told("frame_compile_id").alias("frame_compile_id"), told("attempt_id").alias("attempt"), told("compiled_autograd_id").alias("compiled_autograd_id"))
    out = compilations.select("rank", "hash", "ord", "raw", "stack", own.alias("_own"))
    found = F.lit(None).cast("struct<frame_id:bigint,frame_compile_id:bigint,attempt:bigint,compiled_autograd_id:bigint>")
    if known is not None:
        # Ranks have compilations of their own with equal hashes and places, so rank is part of the key.
        keyed = out.withColumn("hash", F.to_json(F.struct("rank", "hash"))).select("hash", "ord", "raw", "stack")
        info = source_maps.compile_info(keyed, known).select("hash", F.struct("frame_id", "frame_compile_id", "attempt", "compiled_autograd_id").alias("_found")).withColumnRenamed("hash", "_key")
        out = out.withColumn("_key", F.to_json(F.struct("rank", "hash"))).join(info, "_key", "left")
        found = F.col("_found")
    use = F.when(F.col("_own.frame_id").isNotNull() | F.col("_own.frame_compile_id").isNotNull(), F.col("_own")).otherwise(found)
    return out.select("rank", "hash", F.coalesce(output_name(use, base), F.lit(f"{base}_mapped.ndjson")).alias("output_file"))


def _with_fields(raw: Column, **fields: Column) -> Column:
    """A JSON object with more fields at its end; null ones are left out."""
    more = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    body = F.rtrim(raw)
    return F.when(more == "{}", body).otherwise(F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit(","), F.substr(more, F.lit(2))))


@pandas_udf(StringType())
def difference_event(head: pd.Series, rows: pd.Series) -> pd.Series:
    """One ``launch_diff`` event from its head (JSON) and the rows of ``launch_diff`` (JSON list)."""

    def one(text: str, listed: str) -> str:
        sames, diffs, by_argument = {}, {}, {}
        for r in json.loads(listed):
            if r["kind"] == "same":
                sames[r["key"]] = json.loads(r["value"])
            elif r["kind"] == "summary":
                diffs[r["key"]] = {"diff_type": "summary", "summary_text": r["summary"]}
            else:
                diffs[r["key"]] = {"diff_type": "distribution", "values": [v | {"value": json.loads(v["value"])} for v in r["values"]]}
            if r.get("argument") is not None:
                by_argument.setdefault(r["argument"], []).append((r["sub_field"], r["key"]))
        same, differ = nested(sames), nested(diffs)
        changed = set(differ.pop("extracted_args", {}))
        same_args = {k: v for k, v in same.pop("extracted_args", {}).items() if k not in changed}
        if same_args:
            same["extracted_args"] = same_args
        found = {a: {"diff_type": "argument_diff", "sames": {s: sames[k] for s, k in by_argument.get(a, ()) if k in sames}, "diffs": {s: diffs[k] for s, k in by_argument.get(a, ()) if k in diffs}} for a in sorted(changed)}
        if found := {a: d for a, d in found.items() if d["sames"] or d["diffs"]}:
            differ["extracted_args"] = found
        return json.dumps(json.loads(text) | {"diffs": differ, "sames": same}, separators=(",", ":"))

    return pd.Series([one(a, b) for a, b in zip(head, rows, strict=True)], dtype=object)


def difference_events(merged: Merged) -> DataFrame:
    """``rank``, ``hash`` and ``raw`` of each kernel's ``launch_diff`` event. What is gathered for a
    kernel grows with its distinct values and ranges, not with its launches."""
    keys = ["rank", "hash"]
    own = merged.launches.where("hash is not null")
    ranges = islands(own, keys, "launch_index").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("launch_index_map"))
    total = own.groupBy(*keys).agg(F.count("*").alias("total_launches"))
    named = merged.compilations.select(*keys, F.get_json_object("raw", "$.payload.metadata.name").alias("name"))
    row = F.struct("key", "kind", "value", "summary", "values", "argument", "sub_field")
    listed = F.array_sort(F.collect_list(F.struct("key", F.to_json(row).alias("row"))))
    rows = merged.differences.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["row"]), ","), F.lit("]")).alias("_rows"))
    out = join_on(join_on(join_on(named, total, keys, "inner"), ranges, keys), rows, keys)
    head = F.to_json(F.struct(F.lit("launch_diff").alias("event_type"), "hash", "name", "total_launches", "launch_index_map"))
    return out.select(*keys, difference_event(head, F.coalesce("_rows", F.lit("[]"))).alias("raw"))


def session_events(merged: Merged, files: DataFrame) -> DataFrame:
    """``rank``, ``output_file`` and ``raw`` of ``autotune_analysis`` events, in the file of the
    session's first configuration, else of the winner's; and one ``autotune_summary`` for each file
    that has some. Sessions without a file are left out."""
    rest = merged.session_arguments.select("rank", "session_id", "arg_order", "per_config", "sames", "varies")
    s = join_on(merged.sessions, rest, ["rank", "session_id"])
    s = s.withColumn("_of", F.coalesce(F.try_element_at("compilation_hashes", F.lit(1)), "winner_hash"))
    s = join_on(s, files.withColumnRenamed("hash", "_of"), ["rank", "_of"], "inner")
    args = F.struct(F.lit(1).alias("summary_version"), "arg_order", "per_config", F.struct("sames", "varies").alias("autotune_configs"))
    event = F.struct(
        F.lit("autotune_analysis").alias("event_type"), "session_id", "selected_hash", F.col("winner_hash").alias("winner_compilation_hash"), "possible_groups",
        F.struct("configs", "compilation_hashes").alias("compilation_analysis"), F.struct(F.col("group_hashes").alias("launch_group_hashes")).alias("launch_analysis"), "cache_usage",
        F.struct(F.col("benchmark_ranges").alias("benchmark"), F.col("winner_ranges").alias("winner")).alias("launch_ranges"),
        F.when(F.col("arg_order").isNotNull(), args).alias("autotune_args_summary"), F.col("result").alias("autotune_result"),
    )
    each = s.select("rank", "output_file", F.lit("autotune_analysis").alias("section"), F.col("session_id").alias("_key"), F.to_json(event).alias("raw"))
    counts = merged.winner_counts.groupBy("rank").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("winner_hash", "sessions")))).alias("winner_run_counts"))
    files_with = join_on(each.select("rank", "output_file").distinct(), counts, "rank", "inner")
    summary = F.to_json(F.struct(F.lit("autotune_summary").alias("event_type"), "winner_run_counts"))
    return each.unionByName(files_with.select("rank", "output_file", F.lit("autotune_summary").alias("section"), F.lit("").alias("_key"), summary.alias("raw")))


def output_lines(merged: Merged, base: str, split: bool = True, known: DataFrame | None = None) -> DataFrame:
    """All events of the parsed output: ``rank``, ``output_file``, ``section``, ``key``, ``place``
    (their order within a file) and ``raw``. Launches of kernels that were never compiled follow
    their stand-ins."""
    keys = ["rank", "hash"]
    files = settled(output_files(merged.compilations, base, split, known))
    section = lambda name: F.lit(name).alias("section")
    first = F.col("ord").alias("place")
    comps = merged.compilations.select(*keys, section("compilation"), first, _with_fields(F.col("raw"), occurrence_id=F.col("occurrence_id")).alias("raw"))
    told = _with_fields(F.col("raw"), launch_group_hash=F.col("group_hash"), occurrence_id=F.col("occurrence_id"), autotune_launch_type=F.col("launch_type"))
    runs = merged.launches.where("hash is not null").select(*keys, section("launch"), first, told.alias("raw"))
    none = F.lit(None).cast(merged.launches.schema["ord"].dataType).alias("place")
    roof = F.struct(F.lit("roofline").alias("event_type"), "hash", F.struct("launch_index", "num_ctas", "bytes_from_ir", "bytes_from_args", "bytes_moved", "flops", "arithmetic_intensity").alias("roofline"))
    roofs = merged.rooflines.select(*keys, section("roofline"), F.struct(F.lit(0).alias("file_ord"), F.col("launch_index").cast("long").alias("line_no")).cast(merged.launches.schema["ord"].dataType).alias("place"), F.to_json(roof).alias("raw"))
    diffs = difference_events(merged).select(*keys, section("launch_diff"), none, "raw")
    own = join_on(comps.unionByName(runs).unionByName(roofs).unionByName(diffs), files, keys, "inner")
    more = session_events(merged, files).withColumn("place", none)
    return own.withColumnRenamed("hash", "key").unionByName(more.withColumnRenamed("_key", "key"))


def write_outputs(lines: DataFrame, folder: str, overwrite: bool = False, compression: str = "gzip", lines_each: int = LINES_EACH) -> DataFrame:
    """Write ``output_lines`` below ``folder`` and return the manifest: ``rank``, ``output_file``
    and ``lines``. A folder with a finished output is refused unless ``overwrite`` is set.

    One partitioned write: rows are dealt by file and, within a large one, by key and pieces of its
    launches, so that no task holds a file or a hot kernel; a file's parts sort by their names.
    """
    spark = lines.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path) and not overwrite:
        raise FileExistsError(f"{folder} holds a finished output")
    store.delete(path, True)
    rank = F.coalesce(F.col("rank").cast("string"), F.lit("none"))
    order = F.element_at(F.create_map(*[x for i, s in enumerate(SECTIONS) for x in (F.lit(s), F.lit(i))]), F.col("section"))
    own = settled(lines.withColumn("_section", order))
    dealt = own.select(rank.alias("rank"), "output_file", "key", "_section", "place", F.col("raw").alias("value"))
    n = max(1, -(-own.count() // lines_each))
    ranged = dealt.repartitionByRange(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), "rank", "output_file", "key", "_section", "place")
    ranged = ranged.sortWithinPartitions("rank", "output_file", "key", "_section", "place").drop("key", "_section", "place")
    ranged.write.mode("overwrite").option("compression", compression).partitionBy("rank", "output_file").text(f"{folder}/files")
    manifest = own.groupBy(rank.alias("rank"), "output_file").agg(F.count("*").alias("lines"))
    manifest.write.mode("overwrite").json(f"{folder}/_manifest")
    return spark.read.schema("rank string, output_file string, lines long").json(f"{folder}/_manifest")
