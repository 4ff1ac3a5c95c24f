"""``python -m tracequarry.cli info|parse|diff|validate PATH ...``"""

from __future__ import annotations

import argparse
import json
import re
from pathlib import Path

from pyspark.sql import SparkSession

from tracequarry.functions.paths import RankChoice, diff_path, source_kind


def _events(spark: SparkSession, path: str, rank: str | None = None, everything: bool = False):
    from tracequarry.sources import catalog, frames, trace

    if source_kind(path) == "local":
        chosen = catalog.choose(catalog.list_files(spark, path), RankChoice.of(rank, everything)).select("path", "rank", "file_ord").persist()
        files = [r["path"] for r in chosen.collect()]
        if not files:
            raise SystemExit(f"no trace files in {path}")
        return trace.events(frames.read(frames.index(spark, files)).join(chosen, "path"))
    if source_kind(path) == "local_clp":
        raise SystemExit("archives of this kind need a reader that isn't installed")
    return trace.events(frames.ordered(frames.index(spark, path)))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tracequarry")
    sub = parser.add_subparsers(dest="what", required=True)
    for name in ("info", "parse", "diff", "validate"):
        p = sub.add_parser(name)
        p.add_argument("path")
        if name == "info":
            p.add_argument("--kernel")
            p.add_argument("--args")
        if name == "parse":
            p.add_argument("--out", required=True)
            p.add_argument("--rank")
            p.add_argument("--all-ranks", action="store_true")
            p.add_argument("--analyses", help="comma list of analyses, all by default, or none")
            p.add_argument("--no-split", action="store_true", help="one output file instead of one for each compile")
            p.add_argument("--overwrite", action="store_true")
            p.add_argument("--kernel-paths", help="compiler logs that tell which compile made a kernel")
            p.add_argument("--checks", help="JSON file of procedure checks")
        if name == "diff":
            p.add_argument("other", nargs="?", help="the other trace; none with --events")
            p.add_argument("--out")
            p.add_argument("--events", help="places of two compilations of one trace, as 0,1")
            p.add_argument("--tensor-values", action="store_true")
        if name == "validate":
            p.add_argument("--schemas", required=True, help="folder of <event type>.schema.json")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tracequarry").getOrCreate()
    if a.what == "info":
        from tracequarry.operators.kernels import launches, similar_names
        from tracequarry.plans.traces import info

        events = _events(spark, a.path)
        out = info(events, a.kernel, a.args)
        if a.kernel and out.isEmpty():
            print("no launches; like names:", ", ".join(similar_names(launches(events), a.kernel)) or "none")
        else:
            out.show(max(1, out.count()), truncate=False)
    elif a.what == "parse":
        from tracequarry.plans import merge, outputs
        from tracequarry.plans.source_maps import load_checks
        from tracequarry.sources import frames, glog

        m = merge.merge(_events(spark, a.path, a.rank, a.all_ranks))
        for name in ("compilations", "launches", "sessions", "winner_counts", "differences", "rooflines", "session_arguments", "session_differences"):
            table = getattr(m, name)
            table.drop("v").write.mode("overwrite").parquet(f"{a.out}/{name}")
        known = glog.kernel_paths(frames.read(frames.index(spark, a.kernel_paths))) if a.kernel_paths else None
        lines = outputs.output_lines(m, re.sub(r"(\.bin\.ndjson|\.ndjson|\.clp)?(\.gz|\.zst)?$", "", Path(a.path).name), not a.no_split, known)
        outputs.write_outputs(lines, f"{a.out}/parsed", a.overwrite).orderBy("rank", "output_file").show(100, truncate=False)
        checks = tuple(load_checks(Path(a.checks).read_text())) if a.checks else ()
        for name, table in m.described(checks, a.analyses).items():
            table.write.mode("overwrite").parquet(f"{a.out}/{name}")
    elif a.what == "diff" and a.events:
        from tracequarry.operators.outputs import comparison_events
        from tracequarry.plans import events_diff

        top, _ = events_diff.compare_places(_events(spark, a.path), *events_diff.parse_pair(a.events), with_tensors=a.tensor_values)
        print(top.select(events_diff.report().alias("text")).first()["text"])
        if a.out:
            comparison_events(top).write.mode("append").text(a.out)
    elif a.what == "diff":
        from tracequarry.operators.outputs import comparison_events
        from tracequarry.plans.traces import compare_traces

        out = comparison_events(compare_traces(_events(spark, a.path), _events(spark, a.other)), "trace_diff")
        out.write.mode("overwrite").text(a.out or diff_path(a.path))
    else:
        from tracequarry.operators.validate import validate
        from tracequarry.sources import frames

        schemas = {p.name.split(".")[0]: json.loads(p.read_text()) for p in Path(a.schemas).glob("*.schema.json")}
        broken = validate(frames.read(frames.index(spark, a.path)), schemas).where("n_errors > 0")
        broken.show(max(1, broken.count()), truncate=False)


if __name__ == "__main__":
    main()
