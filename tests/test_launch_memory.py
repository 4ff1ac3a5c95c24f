"""Launch differences deal out a table in parts that don't grow with it."""

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import ordering
from tracequarry.plans import table_queries

DATA = "/root/testdata/sf0.001"


def parts(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("name", ["launch_diff_values", "launch_diff", "summary_fields"])
def test_tasks_hold_bounded_numbers_of_rows(spark, monkeypatch, name):
    n = table_queries.table(spark, DATA, "events").count()
    query = table_queries.QUERIES[name]
    whole = sorted(map(str, query(spark, DATA).collect()))
    monkeypatch.setattr(ordering, "TASK_ROWS", max(1, n // 10), raising=False)
    assert parts(query(spark, DATA)) > 4  # shuffle partitions of the session
    assert sorted(map(str, query(spark, DATA).collect())) == whole


def test_parts_of_a_small_table_are_as_small_as_those_of_a_large_one(spark):
    for n in (100_000, 400_000):
        assert n / ordering.spread(spark.range(n), "id").rdd.getNumPartitions() <= 20_000
