"""Greedy pairs in rounds, pairs of configurations and candidates of likeness, each against the plain
way."""

from __future__ import annotations

import difflib
import os
import random

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import matching

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def sequential(edges):
    used_a, used_b, out = set(), set(), set()
    for a, b, score in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.add((a, b, score))
    return out


@pytest.mark.parametrize("n, m, levels", [(30, 150, 1000), (12, 60, 3), (8, 40, 1)])
def test_greedy_in_rounds_equals_one_pass(spark, n, m, levels):
    rng = random.Random(n)
    edges = {(f"a{rng.randrange(n)}", f"b{rng.randrange(n)}"): rng.randrange(levels) / levels for _ in range(m)}
    rows = [(a, b, s) for (a, b), s in edges.items()]
    df = spark.createDataFrame(rows, "x string, y string, score double").repartition(3)
    assert {tuple(r) for r in matching.greedy(df, "x", "y", "score").collect()} == sequential(rows)
    assert matching.greedy(df.where("score > 2"), "x", "y", "score").collect() == []


def alike(x, y):
    ratio = 0.2 * min(x[2], y[2]) / max(x[2], y[2]) if x[2] > 0 and y[2] > 0 else 0.2 * (x[2] == y[2])
    return 0.4 * (x[0] == y[0]) + 0.4 * (x[1] == y[1]) + ratio


def test_configurations_pair_as_over_all_pairs(spark):
    rng = random.Random(5)
    config = lambda: (rng.choice([1, 2, None]), rng.choice([4, 8]), rng.choice([None, 0, 100, 200, 300]))
    a = [(i, rng.choice("pq"), *config()) for i in range(60)]
    b = [(i, rng.choice("rs"), *config()) for i in range(35)]
    kind = "idx int, name string, num_stages int, num_warps int, shared int"
    groups = spark.createDataFrame([("p", "s"), ("q", "r")], "name_a string, name_b string")
    paired, counts = matching.pair_configs(groups, spark.createDataFrame(a, kind), spark.createDataFrame(b, kind))
    want = set()
    for na, nb in (("p", "s"), ("q", "r")):
        edges = [(x[0], y[0], alike((*x[2:4], x[4] or 0), (*y[2:4], y[4] or 0))) for x in a for y in b if x[1] == na and y[1] == nb]
        want |= {(na, nb, i, j, round(s, 9)) for i, j, s in sequential(edges)}
    assert {(r["name_a"], r["name_b"], r["idx_a"], r["idx_b"], round(r["config"], 9)) for r in paired.collect()} == want
    assert {r["name_a"]: r["_n"] for r in counts.collect()} == {na: sum(x[1] == na for x in a) * sum(y[1] == nb for y in b) for na, nb in (("p", "s"), ("q", "r"))}


def test_no_like_pair_is_lost(spark):
    rng = random.Random(6)
    if os.path.isdir(DATA):
        texts = [r[0][:400] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").where("text is not null").limit(60).collect()]
    else:
        texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    texts += ["", "x", "xy", "aé😀b", "aé😀c"]
    edited = []
    for t in texts:
        cut = list(t)
        for _ in range(len(cut) // rng.choice([3, 6, 30])):
            cut[rng.randrange(len(cut))] = rng.choice("xyz")
        edited.append("".join(cut))
    side = lambda xs: spark.createDataFrame(list(enumerate(xs)), "name long, text string").repartition(3)
    want = {(i, j): r for i, x in enumerate(texts) for j, y in enumerate(edited) if x and y and (r := difflib.SequenceMatcher(None, x, y).ratio()) >= 0.75}
    got = {(r["name_a"], r["name_b"]): r["score"] for r in matching.similar_pairs(side(texts), side(edited), 0.75).collect()}
    assert got == want and len(want) > 20
    found = matching.candidate_pairs(side(texts), side(edited), 0.75)
    assert found.where(F.col("bound") < 0.75).isEmpty() and found.count() < len(texts) * len(edited)
