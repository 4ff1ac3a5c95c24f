"""Comparing the tensors of two launches, argument by argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.config import ATOL
from tracequarry.operators.compare import disjoint_dtypes, overall_status, stats_status, tensor_metrics, tensor_status

# Statistics that an argument may hold in place of its tensor.
STATISTICS = ("min", "max", "mean", "std")


def described(info: Column) -> Column:
    """What describes the tensor of an argument (JSON text): a descriptor's base, else itself."""
    is_descriptor = F.get_json_object(info, "$.type") == "TensorDescriptor"
    return F.coalesce(F.when(is_descriptor, F.get_json_object(info, "$.base")), info)


def has_statistics(info: Column) -> Column:
    """Whether all four statistics are there; zero counts."""
    found = F.lit(True)
    for k in STATISTICS:
        found = found & F.get_json_object(info, f"$.{k}").isNotNull()
    return found


def tensor_args(args: Column) -> Column:
    """The tensors among a launch's arguments (map of JSON texts), described."""
    kind = lambda x: F.get_json_object(x, "$.type").isin("tensor", "TensorDescriptor")
    return F.transform_values(F.map_filter(args, lambda k, x: F.coalesce(kind(x), F.lit(False))), lambda k, x: described(x))


def dtypes(tensors: Column) -> Column:
    """Element type by name, of ``tensor_args``."""
    return F.transform_values(tensors, lambda k, x: F.get_json_object(x, "$.dtype"))


def compare_args(pairs: DataFrame, keys: list[str], blobs: DataFrame | None = None, atol: float = ATOL) -> DataFrame:
    """Compare the tensors that both launches of a pair have (``*keys``, ``args_a``, ``args_b``:
    maps of JSON texts, null for a missing launch).

    Returns ``*keys``, ``arg``, ``mode`` (blob, stats, or null), ``status`` and ``error``, which is
    the largest error of elements by blobs and the difference of means by statistics. Blobs are
    rows ``blob_path``, ``values``; they go before statistics. Status: shape_mismatch,
    dtype_mismatch, load_error (a blob is missing, or lengths differ), identical, close or
    divergent; skipped if there is nothing to compare.
    """
    both = pairs.withColumn("_a", tensor_args(F.col("args_a"))).withColumn("_b", tensor_args(F.col("args_b")))
    names = F.array_sort(F.array_intersect(F.map_keys("_a"), F.map_keys("_b")))
    rows = both.select(*keys, "_a", "_b", F.explode(names).alias("arg"))
    rows = rows.select(*keys, "arg", F.element_at("_a", F.col("arg")).alias("a"), F.element_at("_b", F.col("arg")).alias("b"))
    get = lambda side, k: F.get_json_object(side, f"$.{k}")
    blob = lambda side: F.nullif(get(side, "blob_path"), F.lit(""))
    rows = rows.withColumn("mode", F.when(blob("a").isNotNull() & blob("b").isNotNull(), "blob").when(has_statistics(F.col("a")) & has_statistics(F.col("b")), "stats"))
    for side in "ab":
        rows = rows.withColumn(f"path_{side}", blob(side))
        for k in ("shape", "dtype"):
            rows = rows.withColumn(f"{k}_{side}", F.coalesce(get(side, k), F.lit("[]" if k == "shape" else "")))

    gaps = [F.abs(get("a", k).cast("double") - get("b", k).cast("double")) for k in STATISTICS]
    status = F.when(F.col("mode").isNull(), "skipped")
    status = status.when((F.col("mode") == "blob") & (F.col("shape_a") != F.col("shape_b")), "shape_mismatch")
    status = status.when((F.col("mode") == "blob") & (F.col("dtype_a") != F.col("dtype_b")), "dtype_mismatch")
    status = status.when(F.col("mode") == "stats", stats_status(gaps, atol))
    rows = rows.withColumn("status", status).withColumn("error", F.when(F.col("mode") == "stats", gaps[2]))
    known = ["arg", "mode", "status", "error", "shape_a", "shape_b", "dtype_a", "dtype_b"]
    done = rows.where("status is not null").select(*keys, *known)
    if blobs is None:
        blobs = pairs.sparkSession.createDataFrame([], "blob_path string, values array<double>")
    left = rows.where("status is null").drop("status", "error")
    for side in "ab":
        # Blobs are named by their content: one row a path.
        own = blobs.select(F.col("blob_path").alias(f"path_{side}"), F.col("values").alias(f"v{side}"))
        left = left.join(own, f"path_{side}", "left")
    fits = F.col("va").isNotNull() & F.col("vb").isNotNull() & (F.size("va") == F.size("vb"))
    lost = left.where(~F.coalesce(fits, F.lit(False))).withColumn("status", F.lit("load_error")).withColumn("error", F.lit(None).cast("double"))
    measured = tensor_metrics(left.where(fits), [*keys, *(c for c in known if c not in ("status", "error"))], "va", "vb")
    measured = measured.withColumn("status", tensor_status(F.col("max_abs_error"), F.col("num_mismatched"))).withColumnRenamed("max_abs_error", "error")
    return done.unionByName(lost.select(*done.columns)).unionByName(measured.select(*done.columns))


def arg_highlight(overall: Column) -> Column:
    """What a row of ``compare_args`` adds to the highlights of a divergent pair; null for none."""
    name = F.concat(F.lit("Tensor '"), F.col("arg"), F.lit("': "))
    number = F.format_string("%.2e", F.col("error"))
    sides = lambda k: F.concat(F.lit(f"{k} mismatch ("), F.col(f"{k}_a"), F.lit(" vs "), F.col(f"{k}_b"), F.lit(")"))
    divergent = (F.col("status") == "divergent") & F.col("error").isNotNull()
    said = F.when(divergent & (F.col("mode") == "stats"), F.concat(name, F.lit("mean_diff="), number, F.lit(" (stats-based)")))
    said = said.when(divergent, F.concat(name, F.lit("max_abs_error="), number))
    for k in ("dtype", "shape"):
        said = said.when(F.col("status") == f"{k}_mismatch", F.concat(name, sides(k)))
    return F.when(overall == "divergent", said)


def compare_tensors(pairs: DataFrame, keys: list[str], blobs: DataFrame | None = None, atol: float = ATOL) -> DataFrame:
    """One row a pair: ``status`` over all arguments (the worst; mismatches and lost blobs count as
    divergent; skipped without any that could be compared), ``highlights``, and ``no_common_dtype``
    for pairs that share no argument name and no element type."""
    rows = compare_args(pairs, keys, blobs, atol)
    worst = F.when(F.col("status").isin("shape_mismatch", "dtype_mismatch", "load_error"), "divergent").otherwise(F.col("status"))
    args = F.array_sort(F.collect_list(F.struct("arg", "mode", "status", "error", "shape_a", "shape_b", "dtype_a", "dtype_b")))
    per = rows.groupBy(*keys).agg(F.collect_list(F.when(F.col("status") != "skipped", worst)).alias("_s"), args.alias("args"))
    per = per.select(*keys, overall_status(F.col("_s")).alias("status"), "args")
    shown = per.select(*keys, "status", F.posexplode("args").alias("_at", "_x")).select(*keys, F.col("status").alias("_all"), "_at", "_x.*")
    shown = shown.withColumn("_h", arg_highlight(F.col("_all"))).where("_h is not null")
    shown = shown.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_h"))), lambda x: x["_h"]).alias("highlights"))
    sides = [dtypes(tensor_args(F.col(c))) for c in ("args_a", "args_b")]
    apart = ~F.arrays_overlap(*(F.map_keys(s) for s in sides)) & disjoint_dtypes(*(F.map_values(s) for s in sides))
    out = pairs.select(*keys, F.coalesce(apart, F.lit(False)).alias("no_common_dtype")).join(per.drop("args"), keys, "left").join(shown, keys, "left")
    return out.select(*keys, F.coalesce("status", F.lit("skipped")).alias("status"), F.coalesce("highlights", F.array().cast("array<string>")).alias("highlights"), "no_common_dtype")
