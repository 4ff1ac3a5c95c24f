"""Listing and looking up kernels, compilations and launches."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.text import is_winner_run, sequence_ratio
from tracequarry.functions.values import field, filter_condition, stack_of, text_or_null
from tracequarry.operators.ordering import ordinal


def launches(events: DataFrame) -> DataFrame:
    """Launches with ``name``, ``hash``, ``grid`` and ``launch_id``, the place among the launches
    of the name."""
    v = F.col("v")
    name = F.coalesce(text_or_null(field(v, "compilation_metadata.name")), text_or_null(field(v, "name")), F.lit("unknown"))
    out = events.where("event_type = 'launch'")
    out = out.select("path", "event_idx", "raw", "v", name.alias("name"), F.coalesce(field(v, "compilation_metadata.hash"), F.lit("")).alias("hash"), F.try_variant_get(v, "$.grid", "array<bigint>").alias("grid"))
    return out.withColumn("launch_id", ordinal("name", ["path", "event_idx"]))


def compilations(events: DataFrame) -> DataFrame:
    """Compilations with ``name``, ``hash``, ``source`` and the fields that configurations are
    compared by."""
    v = F.col("v")
    from tracequarry.functions.values import event_source, kernel_hash, kernel_name

    numbers = [field(v, f"payload.metadata.{k}", "long").alias(k) for k in ("num_stages", "num_warps", "num_ctas", "maxnreg", "shared")]
    out = events.where("event_type = 'compilation'")
    return out.select("path", "event_idx", "raw", "v", kernel_name(v).alias("name"), kernel_hash(v).alias("hash"), event_source(v).alias("source"), *numbers)


def list_kernels(launch_rows: DataFrame) -> DataFrame:
    """Launches per name, and the hash of the last."""
    out = launch_rows.groupBy("name").agg(F.count("*").alias("launches"), F.max_by("hash", F.struct("path", "event_idx")).alias("hash"))
    return out.orderBy("name")


def list_kernels_from_diffs(events: DataFrame) -> DataFrame:
    """The same from ``launch_diff`` events, which hold sums already; the hash is the first's."""
    v = F.col("v")
    rows = events.where("event_type = 'launch_diff'").select("path", "event_idx", F.coalesce(text_or_null(field(v, "name")), F.lit("unknown")).alias("name"), field(v, "hash").alias("hash"), field(v, "total_launches", "long").alias("n"))
    return rows.groupBy("name").agg(F.sum("n").alias("launches"), F.min_by("hash", F.struct("path", "event_idx")).alias("hash")).orderBy("name")


def list_compilations(events: DataFrame) -> DataFrame:
    """Compilations with their number of launches and what the first launch holds of its
    tensors: ``blob``, ``stats`` or ``none``."""
    found = launches(events)
    args = F.coalesce(F.get_json_object("raw", "$.extracted_args"), F.lit("{}"))
    entries = F.map_values(F.from_json(args, "map<string,string>"))
    holds = lambda k: F.exists(entries, lambda a: F.get_json_object(a, f"$.{k}").isNotNull())
    data = F.when(holds("blob_path"), "blob").when(holds("mean") | holds("min"), "stats").otherwise("none")
    per = found.where("hash <> ''").groupBy("hash").agg(F.count("*").alias("launches"), F.min_by(data, F.struct("path", "event_idx")).alias("tensor_data"))
    out = compilations(events).select("path", "event_idx", "name", "hash", "num_stages", "num_warps").join(per, "hash", "left")
    return out.withColumn("launches", F.coalesce("launches", F.lit(0))).withColumn("tensor_data", F.coalesce("tensor_data", F.lit("none")))


def launch_place(events: DataFrame, name: str, launch_id: int) -> tuple[str, int]:
    """File and index within it of a kernel's n-th launch; says which there are if there is none."""
    own = launches(events).where(F.col("name") == name)
    row = own.where(F.col("launch_id") == launch_id).select("path", "event_idx").first()
    if row is None:
        n = own.count()
        raise ValueError(f"{name} has launches 0 to {n - 1}" if n else f"no kernel {name}")
    return row["path"], row["event_idx"]


def nth_launch(events: DataFrame, name: str, launch_id: int) -> int:
    """Index of a kernel's n-th launch in a trace of one file; ``launch_place`` also names the file."""
    return launch_place(events, name, launch_id)[1]


def best_tuned_place(events: DataFrame, name: str) -> tuple[str, int] | None:
    """File and index of the first launch of a kernel that the tuner itself made with its choice."""
    own = launches(events).where((F.col("name") == name) & is_winner_run(stack_of(F.col("v"))))
    first = own.agg(F.min(F.struct("path", "event_idx")).alias("p")).first()["p"]
    return None if first is None else (first["path"], first["event_idx"])


def best_tuned_launch(events: DataFrame, name: str) -> int | None:
    """The index of ``best_tuned_place``, for a trace of one file."""
    found = best_tuned_place(events, name)
    return None if found is None else found[1]


def filter_launches(launch_rows: DataFrame, filters: dict[str, Any]) -> DataFrame:
    return launch_rows.where(filter_condition(F.col("raw"), filters))


def similar_names(launch_rows: DataFrame, name: str, n: int = 3, cutoff: float = 0.6) -> list[str]:
    """Names most like ``name``: a report of at most ``n``."""
    scored = launch_rows.select("name").distinct().withColumn("_score", sequence_ratio(F.col("name"), F.lit(name)))
    return [r["name"] for r in scored.where(F.col("_score") >= cutoff).orderBy(F.desc("_score"), F.desc("name")).limit(n).collect()]


def ordinal_launch(comps: DataFrame, launch_rows: DataFrame) -> DataFrame:
    """The k-th compilation of a hash with the k-th launch of that hash."""
    from tracequarry.operators.ordering import ordinal_join

    a = comps.select("hash", F.struct("path", "event_idx").alias("o"), F.col("event_idx").alias("compilation_idx"))
    b = launch_rows.select("hash", F.struct("path", "event_idx").alias("p"), F.col("event_idx").alias("launch_idx"))
    return ordinal_join(a, b, "hash", (["o"], ["p"])).drop("o", "p")


def launch_with_compilation(events: DataFrame, event_idx: int, path: str | None = None) -> DataFrame:
    """A launch and its compilation: the first of its hash; by name only if the launch has no
    hash. Indices count within files, so ``path`` names the launch's where there are several; the
    first file that has a launch there stands in for none named."""
    one = launches(events).where(F.col("event_idx") == event_idx)
    one = one.where(F.col("path") == path) if path is not None else one.orderBy("path").limit(1)
    one = one.select("hash", "name", F.col("raw").alias("launch"))
    comps = compilations(events).select(F.col("hash").alias("_h"), F.col("name").alias("_n"), F.struct("path", "event_idx").alias("_o"), F.col("raw").alias("compilation"))
    on = F.when(F.col("hash") != "", F.col("hash") == F.col("_h")).otherwise(F.col("name") == F.col("_n"))
    joined = F.broadcast(one).join(comps, on, "left")  # one row
    return joined.groupBy("hash", "name", "launch").agg(F.min_by("compilation", "_o").alias("compilation"))
