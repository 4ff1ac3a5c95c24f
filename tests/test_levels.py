"""Source maps of whole compilations, analyses, tensors, and comparison of chosen compilations."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import tensors
from tracequarry.plans import events_diff, source_maps

IR = """#loc = loc("k.py":1:0)
module {
  scf.for %i {
    %0 = tt.load %a : tensor<8x!tt.ptr<f32>> loc(#loc7)
  }
}
#loc7 = loc("k.py":6:4)
"""
TTGIR = 'module attributes {"ttg.num-warps" = 2 : i32} {\n' + IR.replace("module {\n", "")
SOURCE = "def k(x):\n    return x\n"


def event(hash_, source=SOURCE, files=None, stack=(), **meta):
    payload = {"metadata": {"hash": hash_, "name": "k", "num_warps": 4, **meta}, "python_source": {"code": source, "start_line": 5, "file_path": f"/{hash_}.py"}, "file_content": files or {"k.ttir": IR, "k.ttgir": TTGIR, "k.json": "{}"}}
    return {"event_type": "compilation", "payload": payload, "stack": list(stack)}


def launched(hash_, **args):
    return {"event_type": "launch", "name": "k", "grid": [2], "compilation_metadata": {"hash": hash_, "name": "k"}, "extracted_args": args}


def events_of(spark, rows):
    data = [("f", i, json.dumps(r), r["event_type"]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "path string, event_idx long, raw string, event_type string").withColumn("v", F.parse_json("raw"))


def comps_of(spark, rows):
    e = events_of(spark, rows).where("event_type = 'compilation'")
    stack = F.try_variant_get("v", "$.stack", "array<struct<line:int,name:string,filename:string,loc:string>>")
    return e.select(F.get_json_object("raw", "$.payload.metadata.hash").alias("hash"), F.col("event_idx").alias("ord"), "raw", stack.alias("stack"))


def test_source_maps_and_analyses(spark):
    comps = comps_of(spark, [event("a"), event("a", files={"k.ttir": "late"}), event("b", files={"k.ttir": IR})])
    ctx = source_maps.context_of(comps)
    got = {(r["hash"], r["stage"], r["ir_line"], r["line"]) for r in ctx.maps.where("kind = 'line'").collect()}
    assert got == {("a", "ttir", 4, 6), ("a", "ttgir", 4, 6), ("b", "ttir", 4, 6)}
    linked = {(r["hash"], r["source_stage"], r["target_stage"], r["ir_line"]): r["target_lines"] for r in source_maps.linked_stages(ctx.maps).collect()}
    assert linked == {("a", "ttir", "ttgir", 4): [4], ("a", "ttgir", "ttir", 4): [4]}
    ctx.checks = tuple(source_maps.load_checks(json.dumps({"procedures": [{"name": "loads", "pattern_checks": ["CHECK: tt.load"]}]})))
    rows = {(r["hash"], r["analysis"]): json.loads(r["result"]) for r in source_maps.analyse(ctx, "compile").collect()}
    assert rows["a", "loop_schedules"]["loop_body"] == ["return x"] and rows["a", "procedures"]["detected"] is True
    assert set(rows) == {("a", "loop_schedules"), ("a", "procedures")}
    assert source_maps.analyse(ctx, "compile", "none").count() == 0
    with pytest.raises(ValueError, match="unknown analyses: nothing"):
        source_maps.chosen("compile", "nothing")
    with pytest.raises(ValueError, match="no pattern_checks"):
        source_maps.load_checks('{"procedures": [{"name": "x"}]}')
    assert source_maps.python_lines(ctx.maps, "k.py", 6, 6).count() == 3 + 3
    warps = spark.createDataFrame([('{"num_warps": 4}', TTGIR), ('{"num_warps": 4}', ""), ('{"num_warps_base": 1}', TTGIR)], "m string, t string")
    assert [r[0] for r in warps.select(source_maps.base_warps(F.col("m"), F.col("t"))).collect()] == [2, 4, 1]


def test_merged_traces_are_described(spark):
    from tracequarry.plans import merge

    rows = events_of(spark, [event("a"), launched("a"), event("a"), launched("lost")]).withColumn("file_ord", F.lit(0)).withColumn("line_no", F.col("event_idx"))
    known = spark.createDataFrame([("/a.py", 3)], "kernel_path string, frame_id long")
    got = merge.merge(rows).described(known=known)
    assert {(r["stage"], r["line"]): r["ir_lines"] for r in got["python_lines"].where("line = 6").collect()} == {("ttir", 6): [4], ("ttgir", 6): [4]}
    assert got["stage_links"].count() == 2 and [r["analysis"] for r in got["analyses"].collect()] == ["loop_schedules"]
    assert {r["hash"]: r["frame_id"] for r in got["compile_info"].collect()} == {"a": 3, "lost": None}


def test_attributes_by_rule(spark):
    wanted = [{"name": "loads", "kind": "count", "pattern": "tt.load"}, {"name": "warps", "kind": "regex", "pattern": r"num-warps\" = (\d+)"}, {"name": "n", "kind": "given"}]
    df = spark.createDataFrame([(TTGIR, 3)], "t string, n int")
    r = df.select(*[c.alias(k) for k, c in source_maps.attributes(F.col("t"), wanted, {"n": F.col("n")}).items()]).first()
    assert tuple(r) == (1, "2", 3)
    with pytest.raises(ValueError, match="unknown kind"):
        source_maps.attributes(F.col("t"), [{"name": "x", "kind": "y"}], {})


def test_compile_info(spark):
    frame = {"line": 1, "name": "f", "filename": "/tmp/torchinductor_u/x.py", "loc": ""}
    comps = comps_of(spark, [event("a"), event("b", stack=[frame]), event("c")])
    known = spark.createDataFrame([("/a.py", 1), ("/tmp/torchinductor_u/x.py", 2)], "kernel_path string, frame_id long")
    assert {r["hash"]: r["frame_id"] for r in source_maps.compile_info(comps, known).collect()} == {"a": 1, "b": 2, "c": None}


def tensor(**more):
    return json.dumps({"type": "tensor", "shape": [2], "dtype": "f32", **more})


def test_tensors(spark):
    stats = {"min": 0, "max": 1, "mean": 0.5, "std": 0}
    a = {"x": tensor(blob_path="p"), "y": tensor(**stats), "z": tensor(), "n": '{"type": "int", "value": 1}', "s": tensor(blob_path="p"), "d": json.dumps({"type": "TensorDescriptor", "base": json.loads(tensor(blob_path="p"))})}
    b = {"x": tensor(blob_path="q"), "y": tensor(**stats), "z": tensor(), "n": '{"type": "int", "value": 1}', "s": tensor(blob_path="p", shape=[3]), "d": tensor(blob_path="lost")}
    pairs = spark.createDataFrame([(1, a, b), (2, a, None), (3, {"u": tensor()}, {"w": tensor(dtype="f16")})], "id int, args_a map<string,string>, args_b map<string,string>")
    blobs = spark.createDataFrame([("p", [1.0, 2.0]), ("q", [1.0, 2.5])], "blob_path string, values array<double>")
    got = {r["arg"]: (r["mode"], r["status"], r["error"]) for r in tensors.compare_args(pairs, ["id"], blobs).collect()}
    assert got == {"x": ("blob", "divergent", 0.5), "y": ("stats", "identical", 0.0), "z": (None, "skipped", None), "s": ("blob", "shape_mismatch", None), "d": ("blob", "load_error", None)}
    rows = {r["id"]: r for r in tensors.compare_tensors(pairs, ["id"], blobs).collect()}
    assert [rows[i]["status"] for i in (1, 2, 3)] == ["divergent", "skipped", "skipped"] and [rows[i]["no_common_dtype"] for i in (1, 2, 3)] == [False, False, True]
    assert rows[1]["highlights"] == ["Tensor 's': shape mismatch ([2] vs [3])", "Tensor 'x': max_abs_error=5.00e-01"]


def test_chosen_compilations(spark):
    assert events_diff.parse_pair(" 0, 2") == (0, 2)
    with pytest.raises(ValueError):
        events_diff.parse_pair("1")
    x = {"type": "tensor", "shape": [2], "dtype": "f32", "min": 0, "max": 1, "mean": 0.5, "std": 0}
    e = events_of(spark, [launched("a", x=x), event("a"), launched("b", x={**x, "mean": 9.5}), event("b", num_stages=3, files={"k.ttir": IR}), launched("b", x=x), event("c", source="def z(): pass\n")])
    top, lines = events_diff.compare_places(e, 0, 1, with_tensors=True)
    r = top.withColumn("text", events_diff.report()).first()
    assert r["source_status"] == "identical" and r["tensor_status"] == "divergent" and "Tensor 'x': mean_diff=9.00e+00 (stats-based)" in r["highlights"]
    assert r["text"].startswith("k (0) and k (1): ") and "- num_stages: None → 3" in r["text"]
    assert {(x["stage"], x["line"]): x["expansion"] for x in lines.where("line = 6").collect()} == {("ttir", 6): 0, ("ttgir", 6): -1}
    assert events_diff.compare_places(e, 0, 2)[1].count() == 0  # other sources: lines aren't compared
    with pytest.raises(ValueError, match="there are 3"):
        events_diff.by_place(e, 0, 3)
    comps = events_diff.numbered(e)
    assert events_diff.place_of_hash(comps, "b") == 1 and events_diff.place_of_hash(comps, "zz") == -1
    launch_rows = e.where("event_type = 'launch'").select(F.get_json_object("raw", "$.compilation_metadata.hash").alias("hash"))
    assert [tuple(r) for r in events_diff.representative(comps, launch_rows).collect()] == [("k", "b", 1)]
    assert e.where("event_idx = 1").select(events_diff.ir_types_of_both(F.col("raw"), F.lit(json.dumps(event("b", files={"x.ptx": ""}))))).first()[0] == ["json", "ptx", "ttgir", "ttir"]
    meta = e.where("event_idx = 3").select(events_diff.metadata_of(F.col("v")).alias("m")).first()["m"]
    assert meta["num_stages"] == "3" and meta["hash"] == "b"
