"""What stays the same between launches and what varies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.config import EXCLUDED_FIELDS, MAX_VALUE_CHARS, SUMMARY_FIELDS


def any_of(key: Column, words: tuple[str, ...]) -> Column:
    return key.rlike("|".join(words))


def value_groups(flat: DataFrame, key_columns: list[str], index: str = "i") -> DataFrame:
    """Groups of equal values from rows (``*key_columns``, ``key``, ``value``, ``index``): how
    many there are, where they start, and the ranges of their indices. Runs of indices are found
    by sorting, so that only ranges are ever gathered; all steps share one shuffle."""
    own = [*key_columns, "key", "value"]
    rows = flat.where(~any_of(F.col("key"), EXCLUDED_FIELDS)).select(*own, F.col(index).alias("_first"), F.col(index).cast("long").alias("_i"))
    run = F.col("_i") - F.dense_rank().over(Window.partitionBy(*own).orderBy("_i"))
    runs = rows.withColumn("_run", run).groupBy(*own, "_run")
    runs = runs.agg(F.count("*").alias("_n"), F.min("_first").alias("_first"), F.min("_i").alias("start"), F.max("_i").alias("end"))
    ranges = F.array_sort(F.collect_list(F.struct("start", "end")))
    return runs.groupBy(*own).agg(F.sum("_n").alias("count"), F.min("_first").alias("first"), ranges.alias("launches"))


def classify(groups: DataFrame, key_columns: list[str]) -> DataFrame:
    """Add ``n_values`` and ``kind``: ``same`` for one value (also where only some launches have
    the key), ``summary`` for fields that are expected to vary, else ``distribution``. Long
    strings become notes of their length."""
    n = F.count("*").over(Window.partitionBy(*key_columns, "key"))
    kind = F.when(F.col("n_values") == 1, "same").when(any_of(F.col("key"), SUMMARY_FIELDS), "summary").otherwise("distribution")
    # A JSON string has two quotes more than its text; escapes make it longer still.
    long = F.col("value").startswith('"') & (F.length("value") - 2 > MAX_VALUE_CHARS)
    shown = F.when(long, F.concat(F.lit('"<'), (F.length("value") - 2).cast("string"), F.lit(' chars omitted>"'))).otherwise(F.col("value"))
    return groups.withColumn("n_values", n).withColumn("kind", kind).withColumn("value", shown)


def summary_text(n_values: Column) -> Column:
    return F.concat(F.lit("Varies across "), n_values.cast("string"), F.lit(" unique values"))


def launch_diff(flat: DataFrame, key_columns: list[str], index: str = "i") -> DataFrame:
    """A row per key: ``kind``, the one ``value`` of a same, the ``summary`` of a summary, and
    the ``values`` (value, count, launches; by first launch) of a distribution. ``argument`` and
    ``sub_field`` name an argument's field, one level deep."""
    rows = classify(value_groups(flat, key_columns, index), key_columns)
    entry = F.struct("first", "value", "count", "launches")
    out = rows.groupBy(*key_columns, "key", "kind", "n_values").agg(F.array_sort(F.collect_list(entry)).alias("_v"))
    part = lambda i: F.nullif(F.regexp_extract("key", r"^extracted_args\.([^.]+)\.([^.]+)$", i), F.lit(""))
    return out.select(
        *key_columns, "key", "kind", "n_values",
        F.when(F.col("kind") == "same", F.element_at("_v", 1)["value"]).alias("value"),
        F.when(F.col("kind") == "summary", summary_text(F.col("n_values"))).alias("summary"),
        F.when(F.col("kind") == "distribution", F.transform("_v", lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count"), v["launches"].alias("launches")))).alias("values"),
        part(1).alias("argument"), part(2).alias("sub_field"),
    )
