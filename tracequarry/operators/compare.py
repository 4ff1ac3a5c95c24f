"""Comparing two compilations on five levels: metadata, source, IR, source lines, tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.config import ATOL, HIGHLIGHT_PER_CENT, METADATA_FIELDS, OPERATIONS, RTOL
from tracequarry.functions.text import lines_of, normalized_source, operations, sequence_ratio, unified_diff


def compare_fields(pairs: DataFrame, keys: list[str], fields: tuple[str, ...] = METADATA_FIELDS) -> DataFrame:
    """A row per pair and field from maps of texts ``a`` and ``b``: ``field``, ``a``, ``b`` and
    ``same`` (nulls equal each other). Fields that neither has are left out."""
    each = F.explode(F.array(*map(F.lit, fields))).alias("field")
    rows = pairs.select(*keys, "a", "b", each)
    rows = rows.select(*keys, "field", F.try_element_at("a", F.col("field")).alias("a"), F.try_element_at("b", F.col("field")).alias("b"))
    return rows.where("a is not null or b is not null").withColumn("same", F.col("a").eqNullSafe(F.col("b")))


def field_highlight(field: Column, a: Column, b: Column) -> Column:
    return F.concat(field, F.lit(": "), F.coalesce(a, F.lit("None")), F.lit(" → "), F.coalesce(b, F.lit("None")))


def compare_source(pairs: DataFrame, a: str = "source_a", b: str = "source_b") -> DataFrame:
    """Add ``status`` (identical, similar at a ratio of 0.8, else different), ``similarity`` and
    ``hunks`` of a unified diff."""
    na, nb = normalized_source(F.coalesce(F.col(a), F.lit(""))), normalized_source(F.coalesce(F.col(b), F.lit("")))
    out = pairs.withColumn("_a", na).withColumn("_b", nb)
    similarity = F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(sequence_ratio(F.col("_a"), F.col("_b")))
    out = out.withColumn("similarity", similarity)
    status = F.when(F.col("_a") == F.col("_b"), "identical").when(F.col("similarity") >= 0.8, "similar").otherwise("different")
    return out.withColumn("status", status).withColumn("hunks", unified_diff(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def ir_stats(df: DataFrame, stage: str, text: str = "text") -> DataFrame:
    """Add ``lines``, ``ops`` and ``op_counts`` of an IR text."""
    out = df.withColumn("lines", F.size(lines_of(F.col(text))).cast("long")).withColumn("_ops", F.array_sort(operations(F.col(text), stage)))
    out = out.withColumn("ops", F.size("_ops").cast("long")).withColumn("_kinds", F.array_distinct("_ops"))
    # In sorted order an operation's count is how far the next one begins behind it.
    out = out.withColumn("_at", F.transform("_kinds", lambda o: F.array_position("_ops", o)))
    behind = F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.array(F.col("ops") + 1))
    counts = F.transform(F.arrays_zip(F.col("_kinds").alias("op"), F.col("_at").alias("a"), behind.alias("b")), lambda x: F.struct(x["op"], (x["b"] - x["a"]).cast("int").alias("n")))
    counts = F.when(F.size("_kinds") > 0, counts).otherwise(F.when(F.col("_kinds").isNotNull(), F.array().cast("array<struct<op:string,n:int>>")))
    return out.withColumn("op_counts", F.map_from_entries(counts)).drop("_ops", "_kinds", "_at")


def line_change(a: Column, b: Column) -> Column:
    """Change in per cent; 0 from nothing."""
    return F.when(a > 0, (b - a) / a * 100).otherwise(F.lit(0.0))


def op_changes(a: Column, b: Column) -> Column:
    """Struct ``added`` and ``removed``: operations of one side only, sorted."""
    return F.struct(F.array_sort(F.array_except(b, a)).alias("added"), F.array_sort(F.array_except(a, b)).alias("removed"))


def ir_highlights(stage: str, change: Column, added: Column) -> Column:
    """Texts for changes of over a fifth and for new operations."""
    much = F.when(F.abs(change) > HIGHLIGHT_PER_CENT, F.format_string(f"{stage.upper()}: %s%.0f%%", F.when(change > 0, "+").otherwise(""), change))
    more = F.when(F.size(added) > 3, F.format_string(" (+%d more)", F.size(added) - 3)).otherwise("")
    new = F.when(F.size(added) > 0, F.concat(F.lit(f"New in {stage.upper()}: "), F.array_join(F.slice(added, 1, 3), ", "), more))
    return F.filter(F.array(much, new), lambda x: x.isNotNull())


def compare_lines(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of each stage by source line on both sides (``*keys``, ``line``, ``stage``,
    ``ir_lines``): ``a_lines``, ``b_lines`` and ``expansion``. Lines of one side only count as
    none on the other."""
    on = [*keys, "line", "stage"]
    empty = F.array().cast("array<int>")
    out = a.withColumnRenamed("ir_lines", "a_lines").join(b.withColumnRenamed("ir_lines", "b_lines"), on, "full")
    out = out.select(*on, F.coalesce("a_lines", empty).alias("a_lines"), F.coalesce("b_lines", empty).alias("b_lines"))
    return out.withColumn("expansion", F.size("b_lines") - F.size("a_lines"))


def line_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    per = rows.groupBy(*keys, "line").agg(F.max((F.col("expansion") != 0).cast("int")).alias("d"), F.sum("expansion").alias("e"))
    return per.groupBy(*keys).agg(F.count("*").alias("lines_compared"), F.sum("d").alias("lines_with_diff"), F.sum("e").alias("total_expansion"))


def tensor_metrics(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", atol: float = ATOL, rtol: float = RTOL) -> DataFrame:
    """Errors of ``b`` against ``a`` from arrays of one length, a row per pair.

    Relative errors and closeness are measured at ``b``. The arrays are taken apart in the row
    they are in; nothing is shuffled.
    """
    zipped = F.zip_with(F.col(a), F.col(b), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    df = pairs.withColumn("_z", zipped)
    n = F.size("_z").cast("double")
    total = lambda f: F.aggregate("_z", F.lit(0.0), lambda s, z: s + f(z))
    most = lambda f: F.array_max(F.transform("_z", f))
    error = lambda z: F.abs(z["x"] - z["y"])
    close = lambda z: (error(z) <= atol + rtol * F.abs(z["y"])) | (z["x"] == z["y"])
    count = lambda f: F.size(F.filter("_z", f)).cast("long")
    infinite = lambda v: F.abs(v) == float("inf")
    return df.select(
        *keys, most(error).alias("max_abs_error"), (total(error) / n).alias("mean_abs_error"),
        most(lambda z: error(z) / F.greatest(F.abs(z["y"]), F.lit(1e-12))).alias("max_rel_error"),
        F.sqrt(total(lambda z: (z["x"] - z["y"]) * (z["x"] - z["y"])) / n).alias("rmse"),
        (total(lambda z: z["x"] * z["y"]) / F.greatest(F.sqrt(total(lambda z: z["x"] * z["x"])) * F.sqrt(total(lambda z: z["y"] * z["y"])), F.lit(1e-8))).alias("cosine_similarity"),
        count(lambda z: ~close(z)).alias("num_mismatched"), (count(lambda z: ~close(z)) / n).alias("mismatch_ratio"),
        count(lambda z: F.isnan(z["x"])).alias("nan_a"), count(lambda z: F.isnan(z["y"])).alias("nan_b"),
        count(lambda z: infinite(z["x"])).alias("inf_a"), count(lambda z: infinite(z["y"])).alias("inf_b"),
    )


def tensor_status(max_abs_error: Column, num_mismatched: Column) -> Column:
    return F.when(max_abs_error == 0, "identical").when(num_mismatched == 0, "close").otherwise("divergent")


def stats_status(errors: list[Column], atol: float = ATOL) -> Column:
    """From the differences of inline statistics."""
    most = F.greatest(*errors)
    return F.when(most == 0, "identical").when(most <= atol, "close").otherwise("divergent")


def overall_status(statuses: Column) -> Column:
    """The worst of an array: divergent, else identical if all are, else close; skipped if none."""
    return F.when(F.size(statuses) == 0, "skipped").when(F.array_contains(statuses, "divergent"), "divergent").when(F.forall(statuses, lambda s: s == "identical"), "identical").otherwise("close")


def disjoint_dtypes(a: Column, b: Column) -> Column:
    """Whether both sides have element types and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def compilation_status(highlights: Column) -> Column:
    return F.when(F.size(highlights) == 0, "identical").when(F.size(highlights) <= 2, "minor_diff").otherwise("significant_diff")


STAGES = tuple(OPERATIONS)
