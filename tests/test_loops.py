"""Loops of nested texts by running depth against a stack of open ones."""

from __future__ import annotations

import random

from tracequarry.operators import ir_analysis


def test_loops_equal_a_stack(spark):
    rng = random.Random(8)
    pieces = ["scf.for x {", "scf.for y", "{", "}", "}}", "text", "} else {", "scf.for z { }", "{{", "} scf.for w {", ""]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "hash int, text string").repartition(3)
    got = sorted((r["hash"], r["start"], r["end"]) for r in ir_analysis.loop_rows(df, ["hash"]).collect())
    want = sorted((i, a, b) for i, t in enumerate(texts) for a, b in ir_analysis.loop_bounds(t or ""))
    assert got == want and len(want) > 100


def test_operation_counts_are_those_of_a_counter(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from tracequarry.operators import compare

    rng = random.Random(9)
    texts = ["\n".join(f"  %{i} = {rng.choice(['add', 'mul', 'load', 'store'])} i32 %a" for i in range(rng.randint(0, 20))) for _ in range(40)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = compare.ir_stats(df, "llir").join(df.select("i", compare.operations(F.col("text"), "llir").alias("all")), "i").collect()
    assert all((r["op_counts"] or {}) == Counter(r["all"] or []) and (r["ops"] or 0) == len(r["all"] or []) for r in found if r["text"] is not None)
    assert sum(len(r["op_counts"] or {}) for r in found) > 20
