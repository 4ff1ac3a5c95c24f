"""Where recording begins and ends, in batches and in streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import ordering
from tracequarry.streaming import live

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, folder, name, out, marks, **more):
    steps = spark.readStream.schema("key string, step long, inside boolean").option("maxFilesPerTrigger", 1).json(f"file://{folder}")
    q = live.phase_edges(steps, **more).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema("key string, step long, edge string").parquet(out).collect())


def test_shuffled_batches_give_the_rows_of_a_lag(rocks, tmp_path):
    import json

    rng, rows = random.Random(5), []
    for key in "abc":
        inside = False
        for step in range(40):
            inside = rng.random() < 0.5 if rng.random() < 0.4 else inside
            rows.append({"key": key, "step": step, "inside": inside if rng.random() < 0.9 else None})
    batch = rocks.createDataFrame([(r["key"], r["step"], r["inside"]) for r in rows], "key string, step long, inside boolean")
    edges = ordering.phase_edges(batch, "key", "step", F.col("inside")).select("key", "step", "edge")
    want = sorted(tuple(r) for r in edges.collect())
    mine = []
    for key in "abc":
        had = False
        for r in (r for r in rows if r["key"] == key):
            if bool(r["inside"]) != had:
                had = bool(r["inside"])
                mine.append((key, r["step"], "enable" if had else "disable"))
    assert want == sorted(mine) and len(want) > 20
    rng.shuffle(rows)
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):  # each file is a batch; some rows come twice
        (folder / f"{n}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[n * 40 : n * 40 + 40] + rows[:3]))
    out, marks = f"file://{tmp_path}/out", f"file://{tmp_path}/marks"
    assert run(rocks, folder, "edges", out, marks) == want
    assert run(rocks, folder, "edges", out, marks) == want  # a restart adds nothing


def test_a_gap_is_given_up_after_a_while(rocks, tmp_path):
    import json
    import time

    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    write = lambda n, *rows: (folder / f"{n}.json").write_text("".join(json.dumps(dict(zip(("key", "step", "inside"), r, strict=True))) + "\n" for r in rows))
    write(0, ("a", 0, True), ("a", 2, False), ("a", 3, True), ("b", 1, True))
    steps = rocks.readStream.schema("key string, step long, inside boolean").json(f"file://{folder}")
    q = live.phase_edges(steps, patience_ms=200).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/marks").trigger(processingTime="0 seconds").start()

    def rows(n):
        for _ in range(60):
            time.sleep(0.5)
            got = sorted(tuple(r) for r in rocks.read.schema("key string, step long, edge string").parquet(out).collect()) if (tmp_path / "out").exists() else []
            if len(got) >= n:
                return got

    try:
        first = rows(4)
        assert first == [("a", 0, "enable"), ("a", 2, "disable"), ("a", 3, "enable"), ("b", 1, "enable")]
        write(1, ("a", 1, False), ("a", 4, False))  # too late, and the next
        assert rows(5) == sorted([*first, ("a", 4, "disable")])
    finally:
        q.stop()
