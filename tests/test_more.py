"""Blobs, outputs, reports and the command line."""

from __future__ import annotations

import json
from hashlib import blake2b

from pyspark.sql import functions as F

from tracequarry.functions import reports
from tracequarry.operators import blobs, outputs


def test_blobs(spark, tmp_path):
    data = b"tensor bytes"
    (tmp_path / f"{blake2b(data).hexdigest()}.bin").write_bytes(data)
    (tmp_path / "wrong.bin").write_bytes(data)
    assert sorted(r["intact"] for r in blobs.read_blobs(spark, f"file://{tmp_path}").collect()) == [False, True]
    df = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("b", 50, 3), ("c", 4, 4), ("d", 4, 5)], "digest string, size long, ord int")
    assert [r["digest"] for r in blobs.stored(df, 10, 20).collect()] == ["a", "c"]
    assert blobs.stored(df.where("ord > 9"), 10, 20).collect() == []
    made = spark.range(1).select(blobs.from_statistics(F.lit(2000), F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(2.0)).alias("x"), blobs.from_statistics(F.lit(3), F.lit(2.0), F.lit(0.0), F.lit(2.0), F.lit(2.0), whole=True).alias("y"))
    r = made.select("y", blobs.tensor_stats(F.col("x")).alias("s")).first()
    assert r["y"] == [2.0] * 3 and 0 <= r["s"]["min"] and r["s"]["max"] <= 2 and abs(r["s"]["mean"] - 1) < 0.05


def test_outputs(spark):
    raw = json.dumps({"payload": {"file_content": {"k.ttir": "T", "k.ptx": "P"}, "python_source": {"file_path": "f.py", "start_line": 3, "end_line": 4, "code": "x"}, "metadata": {"num_warps": 4}}})
    c = spark.createDataFrame([("h", "k", raw, 1), ("h", "k", "{}", 2), ("", "k", "{}", 0)], "hash string, name string, raw string, ord int")
    got = {r["file"]: r["content"] for r in outputs.artifacts(c.where("ord = 1")).collect()}
    assert got == {"k.ttir": "T", "k.ptx": "P", "k_source.py": "# f.py:3-4\nx"}
    d = spark.createDataFrame([(0, 1, float("nan")), (1, 2, 0.5)], "idx_a int, idx_b int, confidence double")
    events = outputs.comparison_events(d)
    assert sorted("confidence" in json.loads(r["raw"]) for r in events.collect()) == [False, True]
    assert [r["section"] for r in outputs.consolidated(c, events).orderBy("section", "ord").collect()] == [0, 1, 1]
    one = json.dumps({"grid": [1, 2], "extracted_args": {"x": {"type": "tensor", "shape": [1]}, "n": {"type": "int", "value": 3}, "z": {"type": "NoneType"}}})
    r = outputs.context(spark.createDataFrame([("h", "k", one, raw)], "hash string, name string, launch string, compilation string")).first()
    assert r["kwargs"] == {"n": "3", "z": None} and list(r["tensors"]) == ["x"] and r["grid"] == [1, 2]


def test_reports(spark):
    sha = "a" * 40
    df = spark.createDataFrame(
        [("Status: Build Failed\nPosition: Pair 3 of 9", 1), ("boom", 1), ("All Passed", 0), (f"TEST FAILED\nPosition: Pair 2 of 9\nTriton Commit: abc1\nLLVM Commit: def2", 101), ("?", 2)], "o string, c int"
    )
    got = [tuple(r["r"]) for r in df.select(reports.pair_result(F.col("o"), F.col("c")).alias("r")).collect()]
    assert got == [("build_failed", 2, None, None), ("error", None, None, None), ("all_passed", None, None, None), ("failing", 1, "abc1", "def2"), ("unknown", None, None, None)]
    t = spark.createDataFrame([(f"The first bad commit could be any of:\n{sha}\n{'b' * 40}\nWe cannot bisect more!", "see\n--- a\n+++ b\n@@ -1 +1 @@\n-x\n+y\n\nThat is all.")], "s string, p string")
    r = t.select(reports.skip_candidates(F.col("s")).alias("s"), reports.diff_patch(F.col("p")).alias("p")).first()
    assert r["s"] == [sha, "b" * 40] and r["p"] == "--- a\n+++ b\n@@ -1 +1 @@\n-x\n+y"


SOURCE = """
kw = {"BLOCK": 64}
configs = [triton.Config(kw, num_warps=4), triton.Config({"BLOCK": 128}, num_warps=8)]
@triton.autotune(configs=configs, key=["n"])
@triton.jit
def k(x, n, BLOCK: tl.constexpr, flag=True):
    pass
"""


def test_sources(spark):
    assert reports.kernel_configs(SOURCE, "k") == [{"BLOCK": 64, "num_warps": 4}, {"BLOCK": 128, "num_warps": 8}] and reports.kernel_configs(SOURCE, "z") is None
    assert reports.config_params(SOURCE) == ["BLOCK"] and reports.chosen_config(reports.kernel_configs(SOURCE, "k"), {"BLOCK": 128}) == {"num_warps": 8}
    df = spark.createDataFrame([(SOURCE, "k")], "s string, f string")
    r = df.select(reports.autotune_configs("s", "f").alias("c"), reports.signature("s").alias("p")).first()
    assert r["c"][1]["BLOCK"] == "128" and [tuple(p) for p in r["p"]] == [("x", False, False), ("n", False, False), ("BLOCK", True, True), ("flag", True, False)]
    paths = spark.createDataFrame([("/build/x/src/a/b.py",), ("/none.py",)], "path string")
    got = {r["path"]: r["file"] for r in reports.longest_suffix(paths, spark.createDataFrame([("a/b.py",), ("b.py",)], "file string")).collect()}
    assert got == {"/build/x/src/a/b.py": "a/b.py", "/none.py": None}
