"""Comparing two chosen compilations on all levels, and reports of comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.values import field
from tracequarry.operators import compare, kernels, source_map, tensors
from tracequarry.operators.ordering import global_ids, settled
from tracequarry.plans import source_maps
from tracequarry.plans.traces import compare_pairs


def parse_pair(text: str) -> tuple[int, int]:
    """``N,M`` as two places from 0."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != 2 or not all(p.isdigit() for p in parts):
        raise ValueError(f"not two places like 0,1: {text!r}")
    return int(parts[0]), int(parts[1])


def numbered(events: DataFrame) -> DataFrame:
    """Compilations with ``place``, their number among all compilations in order of files and lines."""
    own = kernels.compilations(events)
    ids = global_ids(own.select("path", "event_idx"), "path", "event_idx").withColumnRenamed("occurrence_id", "place")
    return own.join(ids, ["path", "event_idx"])


def by_place(events: DataFrame, a: int, b: int) -> DataFrame:
    """The compilations at two places as one row of pairs (``raw_a``, ``raw_b``, ``source_a``, ..).
    Both may be the same one; a place beyond the last is an error that says how many there are."""
    own = numbered(events).where(F.col("place").isin(a, b)).select("place", "hash", "name", "source", "raw")
    own = settled(own)
    have = {r["place"] for r in own.select("place").collect()}  # at most two
    for place in (a, b):
        if place not in have:
            n = events.where("event_type = 'compilation'").count()
            raise ValueError(f"no compilation {place}: there are {n}, from 0")
    side = lambda place, s: own.where(F.col("place") == place).select(*[F.col(c).alias(f"{c}_{s}") for c in own.columns])
    return F.broadcast(side(a, "a")).join(side(b, "b"))  # one row each


def metadata_of(v: Column, kind: str = "map<string,string>") -> Column:
    """Metadata of an event: the payload's, over which ``compilation_metadata`` goes."""
    empty = F.create_map().cast(kind)
    low, high = (F.coalesce(field(v, p, kind), empty) for p in ("payload.metadata", "compilation_metadata"))
    return F.map_concat(F.map_filter(low, lambda k, x: ~F.map_contains_key(high, k)), high)


def ir_types(raw: Column) -> Column:
    """Stages that a compilation holds texts of, sorted."""
    files = F.from_json(F.get_json_object(raw, "$.payload.file_content"), "map<string,string>")
    return F.array_sort(F.array_distinct(F.transform(F.map_keys(F.coalesce(files, F.create_map().cast("map<string,string>"))), lambda k: F.element_at(F.split(k, r"\."), -1))))


def ir_types_of_both(raw_a: Column, raw_b: Column) -> Column:
    """Stages of either side, sorted."""
    return F.array_sort(F.array_union(ir_types(raw_a), ir_types(raw_b)))


def place_of_hash(comps: DataFrame, hash_: str) -> int:
    """Place of the first compilation of a hash (``numbered``); -1 if there is none."""
    found = comps.where(F.col("hash") == hash_).agg(F.min("place")).first()[0]
    return -1 if found is None else found


def representative(comps: DataFrame, launch_rows: DataFrame) -> DataFrame:
    """Of the compilations (``name``, ``hash``, ``place``) of each name the one whose hash was
    launched most often; among equals the first."""
    n = launch_rows.groupBy("hash").agg(F.count("*").alias("_n"))
    best = F.struct(F.coalesce("_n", F.lit(0)).alias("n"), (-F.col("place")).alias("at"))
    return comps.join(n, "hash", "left").groupBy("name").agg(F.max_by(F.struct("hash", "place"), best).alias("_c")).select("name", "_c.*")


def _line_level(pairs: DataFrame) -> DataFrame:
    """Lines by source line of the pairs whose sources are identical: ``place_a``, ``place_b``,
    ``line``, ``stage``, ``a_lines``, ``b_lines``, ``expansion``."""
    keys = ["place_a", "place_b"]
    same = pairs.where("source_status = 'identical'")

    def side(s: str) -> DataFrame:
        texts = same.select(F.concat_ws("/", *keys).alias("hash"), F.lit(0).alias("ord"), F.col(f"raw_{s}").alias("raw"))
        maps = source_maps.source_mappings(settled(source_maps.stage_texts(texts)))
        lines = source_map.by_python_line(maps, ["hash"]).groupBy("hash", "line", "stage")
        lines = lines.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ir_lines")))).alias("ir_lines"))
        return same.select(F.concat_ws("/", *keys).alias("hash"), *keys).join(lines, "hash").drop("hash")

    return compare.compare_lines(side("a"), side("b"), keys)


def compare_places(events: DataFrame, a: int, b: int, with_tensors: bool = False, blobs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Two compilations on all levels: a row with ``highlights``, ``source_status``, ``status``,
    ``tensor_status``, and the rows by source line. Source lines are compared only where the
    sources are identical. Tensors are compared if asked for, those of the first launch of each
    hash; without a launch on both sides they are skipped."""
    pairs = by_place(events, a, b)
    found = settled(compare_pairs(pairs))
    levels = found.select("place_a", "place_b", "hash_a", "hash_b", "name_a", "name_b", "source_status", "similarity", "highlights", "raw_a", "raw_b")
    lines = _line_level(levels)
    out = levels.drop("raw_a", "raw_b").withColumn("tensor_status", F.lit("skipped"))
    if with_tensors:
        args = F.from_json(F.get_json_object("raw", "$.extracted_args"), "map<string,string>")
        first = kernels.launches(events).where("hash <> ''").groupBy("hash").agg(F.min_by(args, F.struct("path", "event_idx")).alias("args"))
        side = lambda s: first.select(F.col("hash").alias(f"hash_{s}"), F.col("args").alias(f"args_{s}"))
        both = levels.select("place_a", "place_b", "hash_a", "hash_b").join(side("a"), "hash_a", "left").join(side("b"), "hash_b", "left")
        per = tensors.compare_tensors(both, ["place_a", "place_b"], blobs).withColumnsRenamed({"status": "_status", "highlights": "_more"})
        out = out.join(per, ["place_a", "place_b"]).withColumn("tensor_status", F.col("_status")).withColumn("highlights", F.concat("_more", "highlights")).drop("_status", "_more", "no_common_dtype")
    return out.withColumn("status", compare.compilation_status(F.col("highlights"))), lines


def report(row: Column | None = None) -> Column:
    """Text about a row of ``compare_places``: names and places, status, and what differs."""
    named = F.format_string("%s (%d) and %s (%d): %s", "name_a", "place_a", "name_b", "place_b", "status")
    source = F.format_string("source: %s, likeness %.2f", F.col("source_status"), F.col("similarity"))
    tensor = F.when(F.col("tensor_status") != "skipped", F.concat(F.lit("tensors: "), F.col("tensor_status")))
    differ = F.transform("highlights", lambda h: F.concat(F.lit("- "), h))
    return F.concat_ws("\n", named, source, tensor, differ)


def trace_report(matches: DataFrame) -> DataFrame:
    """Lines of a text about ``traces.compare_traces``, in order: ``section``, ``ord``, ``line``.
    Counts first, then the pairs that differ, then kernels of one side only."""
    counts = matches.groupBy(F.coalesce("status", "method").alias("_s")).agg(F.count("*").alias("_n"))
    head = counts.select(F.lit(0).alias("section"), F.col("_s").alias("ord"), F.format_string("%s: %d", "_s", "_n").alias("line"))
    order = F.format_string("%020d/%020d", F.coalesce("idx_a", F.lit(0)), F.coalesce("idx_b", F.lit(0)))
    said = F.concat_ws(", ", "highlights")
    pairs = matches.where("status is not null and status <> 'identical'")
    pairs = pairs.select(F.lit(1).alias("section"), order.alias("ord"), F.format_string("%s (%s by %s): %s", "name_a", "status", "method", said).alias("line"))
    lone = matches.where("method = 'only'")
    place = F.when(F.col("name_a").isNotNull(), F.concat(F.lit("only in the first: "), F.col("name_a"))).otherwise(F.concat(F.lit("only in the second: "), F.col("name_b")))
    return head.unionByName(pairs).unionByName(lone.select(F.lit(2).alias("section"), place.alias("ord"), place.alias("line")))
