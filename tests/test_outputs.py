"""Parsed output by compile, its events and manifest, and running sums in ranges."""

from __future__ import annotations

import gzip
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_traces import BENCH, RUN, TTIR, compilation, launch

from tracequarry.operators.ordering import cumulative
from tracequarry.plans import merge, outputs
from tracequarry.sources import trace


def events():
    framed = compilation("h1", "add", 1, ttir=TTIR)
    framed["payload"]["pt_info"] = {"frame_id": 3, "frame_compile_id": 1, "attempt_id": 2}
    pathed = compilation("h2", "path", 1)
    pathed["payload"]["python_source"]["file_path"] = "/tmp/k.py"
    runs = [launch("h1", "add", 1, n, grid=(n % 2 + 1,)) for n in range(4)]
    for n, r in enumerate(runs):
        r["extracted_args"]["big"] = {"type": "int", "value": 7}
    tuned = [compilation("c1", "mm", 1, (BENCH,)), compilation("c2", "mm", 1, (BENCH,), warps=8), launch("c1", "mm", 1, 4, (BENCH, RUN)), launch("c2", "mm", 1, 5, (BENCH, RUN)), launch("c2", "mm", 1, 6, (RUN,))]
    return [framed, pathed, *runs, launch("h9", "lost", 1, 9), *tuned]


@pytest.fixture(scope="module")
def merged(spark):
    rows = [(f"/t/{r}", 0, i, json.dumps(e), r) for r in (0, 1) for i, e in enumerate(events())]
    return merge.merge(trace.events(spark.createDataFrame(rows, "path string, file_ord int, line_no long, raw string, rank int")))


def test_files_events_and_manifest(spark, merged, tmp_path):
    known = spark.createDataFrame([("/tmp/k.py", 8, 0, 0, 5)], "kernel_path string, frame_id long, frame_compile_id long, attempt long, compiled_autograd_id long")
    lines = outputs.output_lines(merged, "base", True, known)
    manifest = {(r["rank"], r["output_file"]): r["lines"] for r in outputs.write_outputs(lines, f"file://{tmp_path}/o").collect()}
    names = {"f3_fc1_a2_cai-.ndjson", "f8_fc0_a0_cai5.ndjson", "base_mapped.ndjson"}
    assert set(manifest) == {(str(r), n) for r in (0, 1) for n in names}
    found = defaultdict(list)
    for part in sorted(tmp_path.glob("o/files/*/*/*.gz")):
        found[part.parent.parent.name.split("=")[1], part.parent.name.split("=")[1]] += [json.loads(x) for x in gzip.open(part, "rt")]
    assert {k: len(v) for k, v in found.items()} == manifest
    own = found["1", "f3_fc1_a2_cai-.ndjson"]
    assert [e["event_type"] for e in own] == ["compilation", *["launch"] * 4, *["roofline"] * 4, "launch_diff"] and own == found["0", "f3_fc1_a2_cai-.ndjson"]
    assert [e["timestamp"] for e in own[1:5]] == ["t0", "t1", "t2", "t3"] and own[1]["launch_group_hash"] and own[1]["occurrence_id"] == 2
    diff = own[-1]
    assert diff["total_launches"] == 4 and diff["launch_index_map"] == [{"start": 0, "end": 3}] and diff["sames"]["name"] == "add" and diff["sames"]["extracted_args"] == {"big": {"type": "int", "value": 7}}
    args = diff["diffs"]["extracted_args"]
    assert args["n"]["diff_type"] == "argument_diff" and args["n"]["sames"] == {"type": "int"} and args["n"]["diffs"]["value"]["values"][0] == {"value": 0, "count": 2, "launches": [{"start": 0, "end": 0}, {"start": 2, "end": 2}]}
    assert diff["diffs"]["grid"]["diff_type"] == "distribution" and "launch_group_hash" not in diff["sames"]
    rest = defaultdict(list)
    for e in found["0", "base_mapped.ndjson"]:
        rest[e["event_type"]].append(e)
    assert len(rest["compilation"]) == 3 and sum(e.get("is_fake", False) for e in rest["compilation"]) == 1
    (session,) = rest["autotune_analysis"]
    assert session["compilation_analysis"]["compilation_hashes"] == ["c1", "c2"] and session["winner_compilation_hash"] == "c2" and session["autotune_args_summary"]["autotune_configs"]["sames"]["num_stages"] == "3"
    assert rest["autotune_summary"] == [{"event_type": "autotune_summary", "winner_run_counts": {"c2": 1}}]
    assert {e.get("autotune_launch_type") for e in rest["launch"]} == {None, "benchmark", "winner"}
    with pytest.raises(FileExistsError):
        outputs.write_outputs(lines, f"file://{tmp_path}/o")


def test_one_file_without_splitting(merged):
    names = outputs.output_files(merged.compilations, "base", split=False).select("output_file").distinct().collect()
    assert [r[0] for r in names] == ["base_mapped.ndjson"]


def test_artifacts_are_whole_files(spark, merged, tmp_path):
    from tracequarry.operators.outputs import artifacts, write_artifacts

    named = merged.compilations.where("rank = 0").withColumn("name", F.get_json_object("raw", "$.payload.metadata.name"))
    write_artifacts(artifacts(named), f"file://{tmp_path}/ir")
    assert (tmp_path / "ir/h1/add.ttir").read_text() == TTIR and (tmp_path / "ir/h1/add_source.py").read_text().startswith("# ?:5-?")
    assert not list(tmp_path.glob("ir/*/.*"))


def test_running_sums_in_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([rng.randrange(30), rng.randrange(10_000)]), rng.choice([None, 1, 2, 50])) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, o int, v long").repartition(5)
    got = {r["i"]: r["s"] for r in cumulative(df, "o", "v", "s", 7).collect()}
    assert got == {i: sum(x or 0 for _, p, x in rows if p <= o) for i, o, _ in rows}
    assert cumulative(df.where(F.col("i") < 0), "o", "v", "s", 7).collect() == []
