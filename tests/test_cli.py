"""The command line over a folder of several ranks."""

from __future__ import annotations

import gzip
import json

from test_traces import BENCH, RUN, compilation, launch

from tracequarry import cli


def test_parse_keeps_ranks_apart(spark, tmp_path):
    folder, out = tmp_path / "logs", tmp_path / "out"
    folder.mkdir()
    for rank in (0, 1):
        rows = [compilation("h1", "add", 1), compilation("c1", "mm", 1, (BENCH,)), compilation("c2", "mm", 1, (BENCH,)), launch("h1", "add", 1, 0), launch("c1", "mm", 1, 1, (BENCH, RUN) if rank == 0 else (RUN,)), launch("c2", "mm", 1, 2, (RUN,))]
        data = b"".join(gzip.compress(json.dumps(r).encode() + b"\n") for r in rows)
        (folder / f"dedicated_log_triton_trace_u_rank_{rank}_pid_{rank + 5}_host_h1_.bin.ndjson").write_bytes(data)
    cli.main(["parse", f"{folder}", "--out", f"file://{out}", "--all-ranks", "--analyses", "none"])
    names = {p.parent.name: p.parent.parent.name for p in out.glob("parsed/files/*/*/*.gz")}
    assert set(names) == {"output_file=logs_mapped.ndjson"} and len(list(out.glob("parsed/files/*/*"))) == 2
    read = lambda name: spark.read.parquet(f"file://{out}/{name}")
    kinds = {(r["rank"], r["launch_index"]): r["launch_type"] for r in read("launches").collect()}
    assert kinds == {(0, 0): None, (0, 1): "benchmark", (0, 2): "winner", (1, 0): None, (1, 1): "cached_winner", (1, 2): "cached_winner"}
    assert {(r["rank"], r["cache_usage"], r["winner_hash"]) for r in read("sessions").collect()} == {(0, False, "c2"), (1, True, "c2")}
    assert read("rooflines").groupBy("rank", "launch_index").count().where("count > 1").isEmpty() and read("session_arguments").count() == 2
