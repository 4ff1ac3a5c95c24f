"""Comparing whole traces, and looking a kernel up."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.config import METADATA_FIELDS
from tracequarry.functions.values import parse_filters
from tracequarry.operators import compare, kernels, matching
from tracequarry.operators.ordering import global_ids, settled


def trace_stats(events: DataFrame) -> DataFrame:
    """One row: events, distinct kernels, compilations, launches, and the kernels' names."""
    c = kernels.compilations(events)
    names = c.agg(F.array_sort(F.collect_set("name")).alias("names"))
    counts = events.agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "compilation").alias("compilations"), F.count_if(F.col("event_type") == "launch").alias("launches"))
    return counts.join(names).withColumn("kernels", F.size("names"))  # one row each


def compare_pairs(pairs: DataFrame) -> DataFrame:
    """Metadata and source levels of matched compilations (``raw_a``, ``raw_b``, ``source_a``,
    ``source_b``), with ``highlights`` and ``status``."""
    fields = lambda raw: F.from_json(F.get_json_object(raw, "$.payload.metadata"), "map<string,string>")
    wanted = F.array(*map(F.lit, METADATA_FIELDS))
    df = pairs.withColumn("_a", fields("raw_a")).withColumn("_b", fields("raw_b"))
    changed = F.filter(wanted, lambda k: ~F.try_element_at("_a", k).eqNullSafe(F.try_element_at("_b", k)))
    df = df.withColumn("highlights", F.transform(changed, lambda k: compare.field_highlight(k, F.try_element_at("_a", k), F.try_element_at("_b", k))))
    for stage in compare.STAGES:
        text = lambda raw, stage=stage: F.coalesce(F.get_json_object(raw, f"$.payload.{stage}"), _stage_text(raw, stage))
        a, b = F.coalesce(text("raw_a"), F.lit("")), F.coalesce(text("raw_b"), F.lit(""))
        df = df.withColumn("_ta", a).withColumn("_tb", b)
        change = compare.line_change(F.size(compare.lines_of(F.col("_ta"))), F.size(compare.lines_of(F.col("_tb"))))
        ops = compare.op_changes(F.array_distinct(compare.operations(F.col("_ta"), stage)), F.array_distinct(compare.operations(F.col("_tb"), stage)))
        some = F.when((F.col("_ta") != "") & (F.col("_tb") != ""), compare.ir_highlights(stage, change, ops["added"])).otherwise(F.array().cast("array<string>"))
        df = df.withColumn("highlights", F.concat("highlights", some)).drop("_ta", "_tb")
    df = compare.compare_source(df).withColumnRenamed("status", "source_status").drop("_a", "_b")
    return df.withColumn("status", compare.compilation_status(F.col("highlights")))


def _stage_text(raw: str, stage: str):
    files = F.from_json(F.get_json_object(raw, "$.payload.file_content"), "map<string,string>")
    return F.try_element_at(files, F.try_element_at(F.filter(F.map_keys(files), lambda k: k.endswith("." + stage)), F.lit(1)))


def compare_traces(a: DataFrame, b: DataFrame) -> DataFrame:
    """Match the compilations of two traces and compare each pair: ``idx_a``, ``idx_b``,
    ``method``, ``confidence``, ``source_status``, ``similarity``, ``highlights``, ``status``
    (identical, similar, different). Kernels on one side only have the method ``only``."""

    def side(e: DataFrame) -> DataFrame:
        # Indices of events are by file; several files are numbered through.
        own = global_ids(e.select("path", "event_idx"), "path", "event_idx").withColumnRenamed("occurrence_id", "idx")
        found = kernels.compilations(e).join(own, ["path", "event_idx"])
        return found.select("idx", "name", "hash", "source", "num_stages", "num_warps", "shared", "raw")

    ca, cb = settled(side(a)), settled(side(b))
    found = settled(matching.match_kernels(ca.drop("raw"), cb.drop("raw")))
    x = ca.select(F.col("idx").alias("idx_a"), F.col("name").alias("name_a"), F.col("source").alias("source_a"), F.col("raw").alias("raw_a"))
    y = cb.select(F.col("idx").alias("idx_b"), F.col("name").alias("name_b"), F.col("source").alias("source_b"), F.col("raw").alias("raw_b"))
    pairs = settled(compare_pairs(found.join(x, "idx_a").join(y, "idx_b")))
    status = F.when(F.col("status") == "identical", "identical").when(F.col("status") == "minor_diff", "similar").otherwise("different")
    pairs = pairs.select("idx_a", "idx_b", "name_a", "name_b", "method", "confidence", "source_status", "similarity", "highlights", status.alias("status"))
    known = lambda c, s: c.select(F.col("name").alias(f"name_{s}")).distinct()
    only_a = known(ca, "a").join(pairs.select("name_a"), "name_a", "left_anti").withColumn("method", F.lit("only"))
    only_b = known(cb, "b").join(pairs.select("name_b"), "name_b", "left_anti").withColumn("method", F.lit("only"))
    return pairs.unionByName(only_a, allowMissingColumns=True).unionByName(only_b, allowMissingColumns=True)


def info(events: DataFrame, kernel: str | None = None, args: str | None = None) -> DataFrame:
    """Kernels with their launches; or one kernel's launches, filtered by ``k=v,...``. A trace
    that holds launch differences answers the first from those."""
    if kernel is None:
        if not events.where("event_type = 'launch_diff'").isEmpty():
            return kernels.list_kernels_from_diffs(events)
        return kernels.list_kernels(kernels.launches(events))
    own = kernels.launches(events).where(F.col("name") == kernel)
    filters: dict[str, Any] = parse_filters(args)
    return kernels.filter_launches(own, filters).select("launch_id", "event_idx", "grid").orderBy("launch_id")


def kernel_view(events: DataFrame) -> DataFrame:
    """Kernels as a viewer shows them: the last compilation of each hash with its launch
    differences, analyses, and the sessions that may have tuned it."""
    v = F.col("v")
    own = kernels.compilations(events).where("hash <> ''")
    last = own.groupBy("hash").agg(F.max_by(F.struct("name", "raw", "event_idx"), F.struct("path", "event_idx")).alias("c")).select("hash", "c.*")
    for kind in ("launch_diff", "ir_analysis", "roofline"):
        more = events.where(F.col("event_type") == kind).select(F.try_variant_get(v, "$.hash", "string").alias("hash"), F.struct("path", "event_idx").alias("o"), "raw")
        last = last.join(more.groupBy("hash").agg(F.max_by("raw", "o").alias(kind)), "hash", "left")
    groups = events.where("event_type = 'autotune_analysis'").select(F.try_variant_get(v, "$.session_id", "string").alias("session"), F.try_variant_get(v, "$.occurrence_id", "long").alias("at"), F.try_variant_get(v, "$.possible_groups", "array<array<string>>").alias("g"))
    sessions = groups.select("session", "at", F.explode(F.array_distinct(F.flatten("g"))).alias("hash"))
    sessions = sessions.groupBy("hash").agg(F.array_sort(F.collect_set(F.struct(F.col("at").isNull().alias("late"), "at", "session"))).alias("_s")).select("hash", F.transform("_s", lambda s: s["session"]).alias("sessions"))
    wins = events.where("event_type = 'autotune_summary'").select(F.struct("path", "event_idx").alias("o"), F.try_variant_get(v, "$.winner_run_counts", "map<string,bigint>").alias("m"))
    wins = wins.agg(F.min_by("m", "o").alias("m")).select(F.explode("m").alias("hash", "winner_runs"))
    return last.join(sessions, "hash", "left").join(wins, "hash", "left")


def pruned(asm, file_content):
    """Entries of a map whose value the other map doesn't hold."""
    return F.map_filter(asm, lambda k, x: ~F.array_contains(F.map_values(file_content), x))
