"""Best configurations against all pairs."""

import random

from pyspark.sql import functions as F

from tracequarry.functions.values import config_similarity
from tracequarry.operators.matching import best_configs

FIELDS = ("num_stages", "num_warps", "shared")


def test_best_configs_are_those_of_all_pairs_without_listing_them(spark):
    r = random.Random(5)
    values = [None, 0.0, -1.0, 900.0, 900.1, 900.2, 900.2000001, 900.2000002, 1e-9, 5e8]
    rows = [(i if i % 9 else i // 2, r.choice("abcdef"), r.choice([None, 1, 2]), r.choice([1, 2, 3]), r.choice(values)) for i in range(150)]
    rows += [(1000, "alone", 1, 1, 1.0), (1001, None, 1, 1, 1.0), (1002, "two", 1, 1, 3.0), (1003, "two", 2, 2, 4.0)]
    df = spark.createDataFrame(rows, "key long, g string, num_stages int, num_warps int, shared double")
    out = best_configs(df, "key", ["g"])
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    other = df.select(F.col("key").alias("b"), "g", *(F.col(f).alias(f"{f}_b") for f in FIELDS))
    score = F.round(config_similarity({f: F.col(f) for f in FIELDS}, {f: F.col(f"{f}_b") for f in FIELDS}), 6)
    want = df.join(other, "g").where("key <> b").groupBy("key").agg(F.max(F.struct(score.alias("score"), (-F.col("b")).alias("nb"))).alias("m"))
    want = {x["key"]: (-x["m"]["nb"], x["m"]["score"]) for x in want.collect()}
    assert {x["key"]: (x["b"], x["score"]) for x in out.collect()} == want


def test_equal_values_of_a_large_group_are_no_pairs(spark):
    """5000 equal configurations would be 25 million pairs."""
    df = spark.range(5000).select(F.col("id").alias("key"), F.lit("g").alias("g"), F.lit(1).alias("num_stages"), F.lit(1).alias("num_warps"), F.lit(7.0).alias("shared"))
    got = {x["key"]: x["b"] for x in best_configs(df, "key", ["g"]).collect()}
    assert got == {k: int(k == 0) for k in range(5000)}
