"""Operators whose result depends on order: every one names its order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _cols(names: str | list[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def first_wins(df: DataFrame, key: str | list[str], order: str | list[str], keep_null: bool = False) -> DataFrame:
    """The first row of each key. With ``keep_null`` rows without a key all stay."""
    keys = _cols(key)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*_cols(order)))
    out = df.withColumn("_nth", nth)
    wanted = F.col("_nth") == 1
    if keep_null:
        wanted = wanted | F.col(keys[-1]).isNull()
    return out.where(wanted).drop("_nth")


def last_wins(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """The last row of each key."""
    nth = F.row_number().over(Window.partitionBy(*_cols(key)).orderBy(*[F.desc(c) for c in _cols(order)]))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


#: Rows that a task sorts at once where all rows of a key have to meet.
TASK_ROWS = 20_000


def spread(df: DataFrame, key: str | list[str]) -> DataFrame:
    """``df`` dealt out by its key into parts of about ``TASK_ROWS`` rows. Steps that need the rows of a
    key in one place then take as much memory in a task however long the table is; a fixed number of
    parts would grow with it. Rows are counted first, which reads no columns."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(parts, *_cols(key))


def ordinal(key: str | list[str], order: str | list[str]) -> Column:
    """Place of a row among the rows of its key, from 0."""
    return F.row_number().over(Window.partitionBy(*_cols(key)).orderBy(*_cols(order))).cast("long") - 1


def ordinal_join(left: DataFrame, right: DataFrame, key: str | list[str], order: str | list[str], how: str = "inner") -> DataFrame:
    """Join the k-th row of a key on the left to its k-th on the right; ``k`` is added. Columns
    of the right side other than the key must have names of their own."""
    keys = _cols(key)
    lo, ro = (_cols(order), _cols(order)) if not isinstance(order, tuple) else (_cols(order[0]), _cols(order[1]))
    a = left.withColumn("k", ordinal(keys, lo))
    b = right.withColumn("k", ordinal(keys, ro))
    return a.join(b, [*keys, "k"], how)


def join_on(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "left") -> DataFrame:
    """Join on keys of which null equals null; the left side's keys stay. ``how`` is any join that
    keeps no rows of the right side alone. Other columns must have names of their own."""
    keys = _cols(keys)
    other = right.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_on_{k}" for k in keys])


#: Integers whose runs are found in one group before runs are put together.
ISLAND_BLOCK = 1 << 16


def islands(df: DataFrame, key: str | list[str], index: str) -> DataFrame:
    """Maximal runs of consecutive integers per key: ``start`` and ``end``, both included.

    Runs are found within blocks of integers first, so that a key with many rows is many groups;
    only the runs of a key are sorted in one place."""
    keys = _cols(key)
    distinct = df.select(*keys, F.col(index).cast("long").alias("_i")).distinct().withColumn("_block", F.floor(F.col("_i") / ISLAND_BLOCK))
    run = F.col("_i") - F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("_i"))
    runs = distinct.withColumn("_run", run).groupBy(*keys, "_block", "_run").agg(F.min("_i").alias("start"), F.max("_i").alias("end"))
    w = Window.partitionBy(*keys).orderBy("start")
    fresh = F.coalesce(F.lag("end").over(w) + 1 < F.col("start"), F.lit(True))
    runs = runs.withColumn("_fresh", fresh).withColumn("_run", F.count_if("_fresh").over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def range_text(ranges: Column) -> Column:
    """``1-3, 10-12, 20``."""
    one = F.transform(ranges, lambda r: F.when(r["start"] == r["end"], r["start"].cast("string")).otherwise(F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))))
    return F.array_join(one, ", ")


def carry_forward(value: str | Column, key: str | list[str], order: str | list[str]) -> Column:
    """The last value so far that isn't null."""
    value = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*_cols(key)).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def global_ids(df: DataFrame, part: str, order: str | list[str], start: int = 0) -> DataFrame:
    """``occurrence_id``: dense numbers by part and order within it. Rows are numbered within
    their parts only; the parts' counts are summed to say where each begins."""
    counts = df.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(part).orderBy(*_cols(order)))
    numbered = df.withColumn("_nth", nth).join(counts, part)
    return numbered.withColumn("occurrence_id", F.col("_before") + F.col("_nth") - 1 + start).drop("_nth", "_before")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once for several uses: in the checkpoint folder where one is set, so that
    lost executors don't matter, else cached."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def cumulative(rows: DataFrame, order: str, value: str, name: str, ranges: int = 200) -> DataFrame:
    """Running sums over all rows in order, without all rows in one task: rows lie in ranges of the
    order, each range is summed, and the sums of those before are added to sums within. Rows that
    tie in order share their sum. The order must not be null."""
    ranged = settled(rows.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()))
    total = ranged.groupBy("_range").agg(F.sum(value).alias("_own"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    total = total.select("_range", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_range").orderBy(order))
    return ranged.join(total, "_range").withColumn(name, F.coalesce(within, F.lit(0)) + F.col("_before")).drop("_range", "_before")


def closure(edges: DataFrame, roots: DataFrame, max_steps: int = 1000) -> DataFrame:
    """All nodes that ``roots`` (column ``node``) reach over ``edges`` (``src``, ``dst``), the
    roots included, with the least number of ``steps``. Cycles end; every step joins only what
    the last one found, and is written to the checkpoint folder where one is set."""
    spark = edges.sparkSession
    keep = spark.conf.get("spark.checkpoint.dir", None)
    seen = roots.select("node").where("node is not null").distinct().withColumn("steps", F.lit(0))
    front = seen
    for i in range(1, max_steps + 1):
        found = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).where("node is not null").distinct()
        front = found.join(seen, "node", "left_anti").withColumn("steps", F.lit(i))
        if keep:
            front = front.checkpoint()
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if keep:
            seen = seen.checkpoint()
    return seen


def phase_edges(rows: DataFrame, key: str | list[str], order: str | list[str], inside: Column) -> DataFrame:
    """Rows where a condition begins to hold (``edge`` = ``enable``) or ceases to (``disable``) in
    the order of a key's rows; before the first row, and where it is null, it doesn't hold."""
    now = F.coalesce(inside, F.lit(False))
    had = F.coalesce(F.lag("_now").over(Window.partitionBy(*_cols(key)).orderBy(*_cols(order))), F.lit(False))
    out = rows.withColumn("_now", now).withColumn("_had", had).where("_now <> _had")
    return out.withColumn("edge", F.when(F.col("_now"), "enable").otherwise("disable")).drop("_now", "_had")
