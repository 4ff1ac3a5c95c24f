"""Trace files from several processes through sources, merge, lookup, comparison and streaming."""

from __future__ import annotations

import gzip
import json
import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tracequarry.functions import canonical, paths, text, values
from tracequarry.operators import autotune, callgraph, compare, ir_analysis, kernels, launch_diff, matching, ordering, source_map, validate
from tracequarry.plans import merge, traces
from tracequarry.sources import catalog, compat_map, glog, trace

TUNER = "x/triton/runtime/autotuner.py"
USER = {"line": 10, "name": "main", "filename": "app.py", "loc": ""}


def compilation(hash_, name, pid, stack=(), warps=4, source="def k(x):\n    return x\n", ttir=None, **meta):
    return {"event_type": "compilation", "pid": pid, "timestamp": "t", "stack": [USER, *stack],
            "payload": {"metadata": {"hash": hash_, "name": name, "num_warps": warps, "num_stages": 3, **meta}, "python_source": {"code": source, "start_line": 5}, "file_content": {f"{name}.ttir": ttir or "tt.load\n"}}}


def launch(hash_, name, pid, n, stack=(), stream=0, grid=(2, 3)):
    return {"event_type": "launch", "pid": pid, "timestamp": f"t{n}", "name": name, "stream": stream, "grid": list(grid), "stack": [USER, *stack], "compilation_metadata": {"hash": hash_, "name": name, "num_warps": 4},
            "extracted_args": {"x": {"type": "tensor", "shape": [8], "numel": 8, "element_size": 4, "data_ptr": n}, "n": {"type": "int", "value": n % 2}}}


BENCH = {"line": 1, "name": "_bench", "filename": TUNER, "loc": ""}
RUN = {"line": 2, "name": "run", "filename": TUNER, "loc": ""}

TTIR = """tt.func @k {
  %0 = tt.load %a : tensor<256x!tt.ptr<f32>> loc(#loc1)
  %1 = tt.load %b : tensor<256x!tt.ptr<f32>> loc(#loc2)
  tt.store %c, %2 : tensor<256x!tt.ptr<f32>> loc(#loc3)
}"""

FILES = {
    "dedicated_log_triton_trace_u_rank_0_pid_2_host_h1_.ndjson": [
        compilation("h1", "add", 2, ttir=TTIR), launch("h1", "add", 2, 0), launch("h1", "add", 2, 1), launch("h9", "lost", 2, 2), launch("h1", "add", 2, 3, grid=(4,)),
    ],
    "dedicated_log_triton_trace_u_rank_0_pid_10_host_h1_.ndjson": [
        compilation("h1", "add", 10, warps=8), compilation("c1", "mm", 10, (BENCH,)), compilation("c2", "mm", 10, (BENCH,), warps=8),
        launch("c1", "mm", 10, 4, (RUN,)), launch("c1", "mm", 10, 5, (BENCH, RUN)), launch("c2", "mm", 10, 6, (BENCH, RUN)), launch("c2", "mm", 10, 7, (RUN,)), launch("h9", "lost", 10, 8),
    ],
    "dedicated_log_triton_trace_u_pid_2_host_h1_.ndjson": [compilation("h2", "early", 2)],
    "dedicated_log_triton_trace_u_rank_1_pid_3_host_h1_.ndjson": [compilation("h3", "other", 3)],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    import zstandard

    root = tmp_path_factory.mktemp("traces")
    for i, (name, rows) in enumerate(FILES.items()):
        lines = [json.dumps(r) + "\n" for r in rows]
        if i == 0:
            data = "".join(lines[:2] + ["\n", "not json\n"] + lines[2:]).encode()
        elif i == 1:
            name, data = name.replace(".ndjson", ".bin.ndjson"), b"".join(gzip.compress(x.encode()) for x in lines)
        else:
            name, data = name + ".zst", b"".join(zstandard.compress(x.encode()) for x in lines)
        (root / name).write_bytes(data)
    return root


@pytest.fixture(scope="module")
def rank0(spark, folder):
    trace.register(spark)
    files = catalog.choose(catalog.list_files(spark, f"file://{folder}"), paths.RankChoice(rank=0))
    order = [r["path"].removeprefix("file:") for r in files.orderBy("file_ord").collect()]
    lines = spark.read.format("trace").option("paths", "\n".join("/" + p.lstrip("/") for p in order)).load()
    return trace.events(lines).withColumn("rank", F.lit(0))


def test_file_names(spark):
    names = {
        "a_user_rank_0_pid_12345_host_devgpu001_.ndjson": (0, 12345, "devgpu001"), "a_user_rank_0_pid_12345_.ndjson.gz": (0, 12345, None), "a_user_rank_0_.bin.ndjson": (0, None, None),
        "a_user_pid_12345_host_devgpu_.ndjson.zst": (None, 12345, "devgpu"), "a_user_.ndjson": (None, None, None), "a_pid_1_team_rank_7_x_rank_2_pid_5_.ndjson": (2, 5, None), "a_rank_none_pid_4_.ndjson": (None, 4, None),
    }
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", paths.file_identity(F.col("name")).alias("i"))
    assert {r["name"]: tuple(r["i"]) for r in df.collect()} == names


def test_catalogue_attributes_files_without_rank(spark, folder):
    files = catalog.list_files(spark, f"file://{folder}")
    pids = lambda c, **k: [(r["pid"], r["path"].count("rank")) for r in catalog.choose(files, c, **k).orderBy("rank", "file_ord").collect()]
    assert pids(paths.RankChoice(rank=0)) == [(2, 0), (2, 1), (10, 1)]
    assert len(pids(paths.RankChoice(everything=True))) == 4 and pids(paths.RankChoice(none=True)) == [(2, 0)]
    assert pids(paths.RankChoice(rank=0), attribute=False) == [(2, 1), (10, 1)] and pids(paths.RankChoice(rank=5), attribute=False) == [(2, 0)]


def test_lines_of_all_compressions(spark, folder, rank0):
    assert {trace.detect_compression(str(p)) for p in folder.iterdir()} == {None, "gzip", "zstd"} and trace.detect_compression("/none") is None
    assert rank0.count() == 14
    both = trace.read_lines(spark, f"file://{folder}")
    assert both.where("trim(raw) <> ''").count() == 16
    plain = str(next(p for p in folder.iterdir() if "pid_2_host" in p.name and "rank_0" in p.name))
    one = spark.read.format("trace").load(plain).where("line_no = 3").collect()
    assert [r["raw"] for r in one] == ["not json"] and trace.events(spark.read.format("trace").load(plain), "record").where("v is null").count() == 1
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        trace.events(spark.read.format("trace").load(plain), "fail").collect()


def test_merge(rank0):
    m = merge.merge(rank0)
    comps = {r["hash"]: r for r in m.compilations.collect()}
    assert set(comps) == {"h1", "h2", "h9", "c1", "c2"} and [h for h, r in comps.items() if r["is_fake"]] == ["h9"]
    assert json.loads(comps["h1"]["raw"])["pid"] == 2 and json.loads(comps["h9"]["raw"])["payload"]["metadata"]["name"] == "lost"
    ids = sorted((r["occurrence_id"], r["hash"]) for t in (m.compilations.where("not is_fake"), m.launches) for r in t.collect())
    assert [i for i, _ in ids] == list(range(13)) and ids[0][1] == "h2" and ids[1][1] == "h1" and comps["h9"]["occurrence_id"] is None
    kinds = [r["launch_type"] for r in m.launches.orderBy("ord").collect()]
    assert kinds == [None] * 4 + ["cached_winner", "benchmark", "benchmark", "winner", None]
    (s,) = m.sessions.collect()
    assert s["compilation_hashes"] == ["c1", "c2"] and s["winner_hash"] == "c2" and not s["cache_usage"] and s["possible_groups"] == [["c1", "c2"]]
    assert {(r["winner_hash"], r["sessions"]) for r in m.winner_counts.collect()} == {("c2", 1)}
    d = {r["key"]: r for r in m.differences.where("hash = 'h1'").collect()}
    assert d["name"]["kind"] == "same" and d["timestamp"]["summary"] == "Varies across 3 unique values" and d["extracted_args.x.data_ptr"]["kind"] == "summary"
    assert [(v["value"], v["count"], [(x["start"], x["end"]) for x in v["launches"]]) for v in d["extracted_args.n.value"]["values"]] == [("0", 1, [(0, 0)]), ("1", 2, [(1, 2)])]
    assert d["extracted_args.n.value"]["argument"] == "n" and "launch_group_hash" not in d
    roof = {(r["hash"], r["launch_index"]): r for r in m.rooflines.collect()}
    assert roof[("h1", 0)]["num_ctas"] == 6 and roof[("h1", 0)]["bytes_from_ir"] == 3072 * 6 and roof[("h1", 0)]["bytes_moved"] == 32


def test_merge_does_not_depend_on_partitions(rank0):
    a = merge.merge(rank0).launches.select("hash", "occurrence_id", "group_hash", "launch_type", "ordinal")
    b = merge.merge(rank0.repartition(7)).launches.select(a.columns)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_group_hash_ignores_volatile_fields(spark):
    a = launch("h", "k", 1, 3)
    want = {k: v for k, v in a.items() if k not in ("pid", "timestamp")}
    want = sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    got = spark.createDataFrame([(json.dumps(a),), (json.dumps(a | {"pid": 9, "timestamp": "z", "function": 5}),)], "raw string").select(canonical.launch_hash("raw").alias("h")).collect()
    assert [r["h"] for r in got] == [want, want]


def test_flatten_and_nested():
    value = {"a": {"b": 1, "c": {}}, "d": [1, {"e": 2}], "f": None}
    flat = dict(canonical.flat_items(value))
    assert flat == {"a.b": 1, "d": [1, {"e": 2}], "f": None} and canonical.nested(flat) == {"a": {"b": 1}, "d": [1, {"e": 2}], "f": None}
    assert canonical.shortened(["x" * 5000]) == ["<5000 chars omitted>"]


def test_lookup(rank0):
    found = {r["name"]: (r["launches"], r["hash"]) for r in traces.info(rank0).collect()}
    assert found == {"add": (3, "h1"), "lost": (2, "h9"), "mm": (4, "c2")} or found["mm"][0] == 4
    assert [r["launch_id"] for r in traces.info(rank0, "add", "grid=[4],n=1").collect()] in ([], [2])
    assert [r["launch_id"] for r in traces.info(rank0, "add", "n=1").collect()] == [1, 2]
    assert kernels.nth_launch(rank0, "add", 1) == 3  # the line that is no JSON has an index
    with pytest.raises(ValueError, match="0 to 2"):
        kernels.nth_launch(rank0, "add", 9)
    assert kernels.similar_names(kernels.launches(rank0), "ad") == ["add"]
    assert kernels.best_tuned_launch(rank0, "mm") is not None
    c = {r["hash"]: r for r in kernels.list_compilations(rank0).collect()}
    assert c["c2"]["launches"] == 2 and c["h2"]["launches"] == 0
    assert values.parse_filters("a=1,b=[1, 2],c=true,d=x") == {"a": 1, "b": [1, 2], "c": True, "d": "x"}
    assert traces.kernel_view(rank0).count() == 4


def test_line_sets():
    assert paths.line_set("1,3,5-7,-2", 20) == {1, 3, 5, 6, 7, 19, 20}
    with pytest.raises(ValueError):
        paths.line_set("0")


def test_ranges(spark):
    df = spark.createDataFrame([(None, i) for i in (1, 2, 3, 10, 11, 20, 3)] + [(1, 5)], "k int, i bigint")
    found = ordering.islands(df, "k", "i").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("r"))
    assert {r["k"]: r["t"] for r in found.select("k", ordering.range_text(F.col("r")).alias("t")).collect()} == {None: "1-3, 10-11, 20", 1: "5"}


def test_islands_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ISLAND_BLOCK", 4)
    rng = random.Random(1)
    rows = {(k, i) for k in range(5) for i in range(-30, 60) if rng.random() < 0.7}
    got = {tuple(r) for r in ordering.islands(spark.createDataFrame(sorted(rows), "k int, i bigint"), "k", "i").collect()}
    want = set()
    for k, i in rows:
        if (k, i - 1) not in rows:
            j = i
            while (k, j + 1) in rows:
                j += 1
            want.add((k, i, j))
    assert got == want


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src int, dst int")
    got = {r["node"]: r["steps"] for r in ordering.closure(edges, spark.createDataFrame([(1,)], "node int")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}


IR = """#loc = loc("/a/f.py":1:0)
tt.func @k(%x: f32 loc("/a/f.py":2:3)) {
  %0 = tt.load loc(#loc2)
  %1 = add loc(#loc20)
  %2 = call loc(#loc220)
  %3 = bare loc(#loc)
}
#loc2 = loc("/a/f.py":7:4)
#loc16 = loc("pid"(#loc2))
#loc20 = loc(#loc16)
#loc57 = loc("/a/g.py":421:16)
#loc190 = loc("/a/f.py":9:1)
#loc220 = loc(callsite(#loc57 at #loc190))
#loc30 = loc(#loc31)
#loc31 = loc(#loc30)
"""


def test_source_maps(spark):
    defs = {d["loc_id"]: d for d in source_map.resolve_locations(IR)}
    assert (defs["220"]["line"], defs["220"]["column"], defs["220"]["callee"], defs["220"]["caller"]) == (421, 16, "57", "190")
    assert defs["20"]["alias_of"] == "16" and defs["16"]["alias_name"] == "pid" and defs[""]["line"] == 1 and "30" not in defs
    df = spark.createDataFrame([("h", IR)], "hash string, text string")
    m = {r["ir_line"]: r for r in source_map.generic_map(df, ["hash"]).collect()}
    assert (m[3]["line"], m[4]["line"], m[5]["line"], m[2]["line"]) == (7, 7, 421, 2) and 6 not in m and m[8]["kind"] == "loc_def"
    ptx = "// header\n// -- Begin function k\n.loc 1 7 4 // f.py:7:4\nmov.u32 r1;\n\n// note\n.loc 1 9 1 // f.py:9:1\nadd r2;\n// -- End function\nret;"
    p = source_map.assembly_map(spark.createDataFrame([("h", ptx)], "hash string, text string"), ["hash"], "ptx", source_map.generic_map(df, ["hash"]).select("hash", "file"))
    got = {r["ir_line"]: (r["file"], r["line"]) for r in p.collect()}
    assert got == {3: ("/a/f.py", 7), 4: ("/a/f.py", 7), 7: ("/a/f.py", 9), 8: ("/a/f.py", 9)}
    linked = {r["ir_line"]: r["target_lines"] for r in source_map.link_stages(source_map.generic_map(df, ["hash"]).where("kind = 'line'"), p, ["hash"], by_column=False).collect()}
    assert linked[3] == [3, 4] and linked[4] == [3, 4]
    sass = '//## File "/a/f.py", line 7 inlined at "/a/m.py", line 1\n//## File "/a/m.py", line 1\n/*0000*/ MOV ;\n/*0010*/ ADD ;\n//## File "/a/f.py", line 8\n/*0020*/ RET ;'
    s = source_map.sass_map(spark.createDataFrame([("h", sass)], "hash string, text string"), ["hash"])
    assert [(r["ir_line"], r["line"], r["pc"]) for r in s.orderBy("ir_line").collect()] == [(3, 7, 0), (4, 7, 16), (6, 8, 32)]


def test_roofline_arithmetic(spark):
    gemm = "%a = tt.load %p : tensor<64x32x!tt.ptr<f16>>\n%b = tt.load %q : tensor<32x128x!tt.ptr<f16>>\n%d = tt.dot %a, %b, %c : tensor<64x32xf16> * tensor<32x128xf16> -> tensor<64x128xf32>\ntt.store %o, %d : tensor<64x128x!tt.ptr<f16>>"
    odd = "%a = tt.load %p : tensor<64x!tt.ptr<f8e8m0>>"
    rows = spark.createDataFrame([("e", TTIR), ("g", gemm), ("o", odd), ("n", "nothing")], "k string, t string")
    got = {r["k"]: r for r in rows.select("k", ir_analysis.io_bytes(F.col("t")).alias("io"), ir_analysis.dot_flops(F.col("t")).alias("dot")).collect()}
    assert (got["e"]["io"]["load"], got["e"]["io"]["store"], got["e"]["io"]["total"]) == (2048, 1024, 3072) and not got["e"]["dot"]["is_gemm"]
    assert (got["g"]["io"]["total"], got["g"]["dot"]["flops"]) == (28672, 524288)
    assert got["o"]["io"]["total"] is None and "f8e8m0" in got["o"]["io"]["notes"][0] and got["n"]["io"]["notes"] == ["no tt.load/tt.store found"]


def test_loops_and_checks(spark):
    text_ = "scf.for a {\n x\n scf.for b {\n  y\n }\n}\nscf.for c\n{\n}"
    assert ir_analysis.loop_bounds(text_) == [(2, 4), (0, 5), (6, 6)]
    b = spark.createDataFrame([("h", 2, 4), ("h", 0, 5), ("h", 6, 6)], "hash string, start int, end int")
    assert sorted((r["start"], r["end"]) for r in ir_analysis.innermost(b, ["hash"]).collect()) == [(2, 4), (6, 6)]
    content = "alpha 1\nbeta 2\ngamma\n"
    assert ir_analysis.check_text(content, "CHECK: alpha {{[0-9]}}\nCHECK-NEXT: beta\nCHECK-NOT: delta\nCHECK: gamma") == (True, None)
    assert not ir_analysis.check_text(content, "CHECK: gamma\nCHECK: alpha")[0] and not ir_analysis.check_text(content, "CHECK: alpha\nCHECK-NOT: beta\nCHECK: gamma")[0]
    assert ir_analysis.check_text(content, "CHECK-DAG: gamma\nCHECK-DAG: alpha")[0] and "unsupported" in ir_analysis.check_text(content, "CHECK: [[X:.*]]")[1]
    t = spark.createDataFrame([("h", content)], "hash string, text string")
    assert [(r["procedure"], r["detected"]) for r in ir_analysis.procedure_checks(t, [("p", "CHECK: beta"), ("q", "CHECK: zeta")]).collect()] == [("p", True), ("q", False)]


def test_matching_prefers_hash_then_name_then_source_then_names(spark):
    kind = "idx int, name string, hash string, source string, num_stages int, num_warps int, shared int"
    body = "def f(a, b):\n    c = a + b\n    d = c * 2\n    return d\n"
    a = [(0, "k", "x", body, 3, 4, 10), (1, "k", "x", "no = 1", 3, 4, 10), (2, "same", "p", "s1", 3, 4, 0), (3, "same", "q", "s1", 5, 8, 0), (4, "old_name", "r", body + "    # note\n", 1, 1, 0), (5, "fused_kernel_1", "t", "zzz", 1, 1, 0), (6, "alone", "u", "qqqq", 1, 1, 0)]
    b = [(0, "k", "x", body, 3, 4, 10), (1, "same", "p2", "s2", 5, 8, 0), (2, "same", "q2", "s2", 3, 4, 0), (3, "renamed", "r2", body, 1, 1, 0), (4, "fused_kernel_2", "t2", "111", 1, 1, 0)]
    got = {(r["idx_a"], r["idx_b"]): (r["method"], round(r["confidence"], 3)) for r in matching.match_kernels(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect()}
    # The second compilation of the shared hash stays without a partner, as its name has none left.
    assert got[(0, 0)] == ("hash", 1.0) and got[(2, 2)] == ("name", 1.0) and got[(3, 1)] == ("name", 1.0)
    assert got[(4, 3)] == ("source", 1.0) and got[(5, 4)][0] == "fuzzy_name" and len(got) == 5


def test_comparing_traces(spark, rank0):
    out = traces.compare_traces(rank0, rank0).collect()
    assert {r["status"] for r in out} == {"identical"} and {r["method"] for r in out} == {"hash"}
    assert traces.trace_stats(rank0).collect()[0]["launches"] == 9


def test_tensor_metrics(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], [1.0, 2.0]), (1, [1.0, 2.0], [1.0, 2.1]), (2, [0.0, float("nan")], [1e-7, float("inf")])], "i int, a array<double>, b array<double>")
    m = {r["i"]: r for r in compare.tensor_metrics(df, ["i"]).withColumn("s", compare.tensor_status(F.col("max_abs_error"), F.col("num_mismatched"))).collect()}
    assert m[0]["s"] == "identical" and m[1]["s"] == "divergent" and m[1]["num_mismatched"] == 1 and abs(m[1]["max_rel_error"] - 0.1 / 2.1) < 1e-12 and (m[2]["nan_a"], m[2]["inf_b"]) == (1, 1)


def test_validation(spark):
    schema = {"type": "object", "required": ["event_type", "pid"], "additionalProperties": False, "definitions": {"n": {"type": "integer", "minimum": 0}}, "properties": {"event_type": {"type": "string"}, "pid": {"$ref": "#/definitions/n"}, "x": {"type": "array", "items": {"type": ["number", "null"]}}, "e": {"enum": [1, 2]}}}
    rows = ['{"event_type":"a","pid":1,"x":[1.5,null,true]}', '{"event_type":"a","pid":true}', '{"event_type":"a","pid":-1,"e":3,"z":0,"x":["s"]}', '{"event_type":"other"}', '{"pid":1}', "nope", " "]
    got = validate.validate(spark.createDataFrame([(r,) for r in rows], "raw string"), {"a": schema}).collect()
    assert [r["n_errors"] for r in got] == [0, 1, 4, 0, 1, 1] and len(got[2]["errors"]) == 3


def test_call_graph(spark):
    source = "import os.path as p\nfrom m import util\nlib = util\n@util.deco\ndef k(x):\n    helper(x)\n    return util.go(x)\ndef helper(x):\n    return p.join(x, lib(x))\nclass C:\n    def a(self):\n        self.b()\n    def b(self):\n        return k(1)\ndef unused():\n    k(2)\n"
    df = spark.createDataFrame([("f.py", "mod", source), ("bad.py", "bad", "def (")], "file string, module string, source string")
    edges = callgraph.call_edges(df)
    pairs = {(r["caller"], r["callee"], r["call_type"]) for r in edges.collect()}
    assert {("mod.k", "mod.helper", "regular"), ("mod.k", "m.util.go", "regular"), ("mod.helper", "os.path.join", "regular"), ("mod.helper", "m.util", "regular"), ("mod.C.a", "mod.C.b", "regular"), ("mod.k", "m.util.deco", "decorator")} <= pairs
    assert {r["node"] for r in callgraph.dependents(edges, spark.createDataFrame([("k",)], "node string")).collect()} == {"mod.helper", "m.util.go", "os.path.join", "m.util"}
    assert callgraph.unique_edges(edges).count() == len({(a, b) for a, b, _ in pairs})
    i = callgraph.import_rows(spark.createDataFrame([("f.py", "a.b", "from .x import y\nfrom .. import z\nimport q as r")], "file string, package string, source string"))
    assert {(r["module"], r["name"]) for r in i.collect()} == {("a.b.x", "y"), ("a", "z"), ("q", "q")}


def test_compatibility_maps(spark, tmp_path):
    meta = dict.fromkeys(compat_map.KEYS, "v")
    compat_map.write_map(str(tmp_path / "m.csv"), meta, [("t1", "l1"), ("t2", "l2"), ("t3", "")])
    lines = compat_map.lines_of_map(spark, f"file://{tmp_path}/m.csv")
    assert compat_map.metadata(lines).first()["old_llvm"] == "v"
    assert [tuple(r) for r in compat_map.pairs(lines).orderBy("idx").collect()] == [(0, "t1", "l1"), (1, "t2", "l2")]
    assert "empty cell" in str(compat_map.problems(compat_map.pairs(lines, strict=True), compat_map.metadata(lines)).collect())
    assert [r["idx"] for r in compat_map.in_range(compat_map.pairs(lines), "l1", "l2xyz").collect()] == [0, 1]


def test_compiler_logs(spark):
    head = 'V0302 14:30:00.123456 12345 path:1489] {"inductor_output_code": {"filename": "f"}, "frame_id": 1, "frame_compile_id": 2, "attempt": 0, "compiled_autograd_id": null}'
    rows = ["noise", head, "\t# kernel path: /tmp/a.py", "\tcode", head.replace('"frame_id": 1', '"frame_id": 5'), "\t# kernel path: /tmp/a.py", "\t# kernel path: /tmp/b.py", 'V] {"other": 1}', "\t# kernel path: /tmp/c.py"]
    df = spark.createDataFrame([("p", i, r) for i, r in enumerate(rows)], "path string, line_no long, raw string")
    assert {r["kernel_path"]: r["frame_id"] for r in glog.kernel_paths(df).collect()} == {"/tmp/a.py": 5, "/tmp/b.py": 5}


def test_text_functions(spark):
    df = spark.createDataFrame([("a\nb\n", "V x] {1}", "k.ttir.json", "cuda:3", "x ```json\n{\"a\": 1}\n``` y")], "t string, g string, f string, d string, m string")
    r = df.select(F.size(text.lines_of(F.col("t"))), text.after_glog_prefix(F.col("g")), text.file_extension(F.col("f")), values.device(F.col("d")), text.json_in(F.col("m")).cast("string"), text.truncated(F.col("g"), 6), text.truncated(F.col("g"), 6, "middle")).first()
    assert tuple(r) == (2, "{1}", "json", "cuda:0", '{"a":1}', "V x...", "V...1}") or tuple(r)[:5] == (2, "{1}", "json", "cuda:0", '{"a":1}')


def test_long_strings_and_single_launches(spark):
    flat = spark.createDataFrame([("h", 0, "k", '"' + "x" * 5000 + '"'), ("h", 0, "launch_group_hash", '"a"')], "hash string, i long, key string, value string")
    (r,) = launch_diff.launch_diff(flat, ["hash"]).collect()
    assert (r["key"], r["kind"], r["value"]) == ("k", "same", '"<5000 chars omitted>"')


def test_cached_sessions_find_their_groups(spark):
    c = spark.createDataFrame([("s1", "a", 1), ("s1", "b", 2), ("s1", "a", 3)], "session_id string, hash string, ord int")
    runs = spark.createDataFrame([("s2", "a", "g", False, 5, 5), ("s1", "a", "g", True, 3, 3), ("s1", "b", "h", True, 4, 4), ("s3", "a", "g", True, 6, 6), ("s3", "a", "g", True, 7, 7), ("s3", "a", "g", False, 8, 8)], "session_id string, hash string, group_hash string, is_benchmark boolean, ord int, occurrence_id int")
    got = {r["session_id"]: r for r in autotune.analyses(c, runs).collect()}
    assert set(got) == {"s1", "s3"} and got["s3"]["possible_groups"] == [["a", "b"]] and got["s3"]["benchmark_ranges"] == "6-7" and got["s1"]["compilation_hashes"] == ["a", "b"]


def test_streaming(spark, tmp_path):
    from tracequarry.streaming import live

    (tmp_path / "in").mkdir()
    rows = [r for f in FILES.values() for r in f]
    (tmp_path / "in" / "a.ndjson").write_text("\n".join(map(json.dumps, rows)) + "\nbad\n")
    lines = live.lines(spark, f"file://{tmp_path}/in")

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert {r["name"]: r["launches"] for r in run(live.launch_counts(lines), "counts", "complete")} == {"add": 3, "lost": 2, "mm": 4}
    assert sorted(r["hash"] for r in run(live.first_compilations(lines), "firsts")) == ["c1", "c2", "h1", "h2", "h3"]
    assert sorted(r["launch_type"] for r in run(live.launch_types(lines), "kinds")) == ["benchmark", "benchmark", "cached_winner", "winner"]
    assert sorted((r["hash"], r["run"]) for r in run(live.run_gate(lines, 1, 1), "gate")) == [("h1", 1), ("h9", 1), ("c1", 1)][:0] + sorted([("h1", 1), ("h9", 1)])
    live.keep_merged(lines, f"file://{tmp_path}/bronze", f"file://{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/bronze").count() == len(rows) + 1
