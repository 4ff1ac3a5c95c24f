"""Work on tables of few files is dealt out to all cores."""

from tracequarry.plans import library_queries  # noqa: F401
from tracequarry.plans.table_queries import QUERIES


def test_tile_traffic_runs_in_many_tasks(spark):
    assert QUERIES["tile_traffic"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_letters_are_counted_in_batches(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from tracequarry.operators.matching import letter_counts

    texts = ["", None, "abca", "é\U0001f600\U0001f600 \n", "x" * 70_000 + "y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", letter_counts(F.col("t")).alias("n"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    assert all(r["n"] == (None if r["t"] is None else dict(Counter(r["t"]))) for r in df.collect())
