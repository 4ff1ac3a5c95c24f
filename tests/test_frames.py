"""Files of many gzip members, zstd frames or plain bytes, read in runs."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from tracequarry.sources import frames


def text_of(rng, n):
    return [("" if rng.random() < 0.1 else "x" * rng.randint(0, 60) + "é" + str(i)) for i in range(n)]


def compress(kind, parts):
    import zstandard

    one = {"gzip": gzip.compress, "zstd": zstandard.compress, None: lambda x: x}[kind]
    return b"".join(one(p) for p in parts)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Frames that end at lines, frames that end within lines, one frame, no last line end, frames
    of no bytes, a file that holds a gzip member as text, and an empty file."""
    root, rng, want = tmp_path_factory.mktemp("frames"), random.Random(3), {}
    for kind in ("gzip", "zstd", None):
        lines = text_of(rng, 200)
        data = ("\n".join(lines) + "\n").encode()
        for name, body in (("lines", data), ("open", data[:-1])):
            cuts = sorted(rng.sample(range(1, len(body)), 9)) if name == "open" else [i + 1 for i, b in enumerate(body) if b == 10][19:-1:20]
            parts = [body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)], strict=True)]
            (root / f"{kind}-{name}").write_bytes(compress(kind, [parts[0], b"", *parts[1:]]))
            want[f"{kind}-{name}"] = lines
        (root / f"{kind}-one").write_bytes(compress(kind, [data]))
        want[f"{kind}-one"] = lines
    # Stored, not deflated, so that the inner member's bytes stand in the outer one as they are.
    stored = gzip.compress(b"inner\n" * 3) + b"\nlast\n"
    (root / "nested").write_bytes(gzip.compress(b"a\nb\n") + gzip.compress(stored, compresslevel=0) + gzip.compress(b"end\n"))
    want["nested"] = [x.decode(errors="replace").rstrip("\r\n") for x in (b"a\nb\n" + stored + b"end\n").split(b"\n")[:-1]]
    (root / "empty").write_bytes(b"")
    return root, want


@pytest.mark.parametrize("piece", [600, 1 << 20])
def test_lines_and_numbers(spark, folder, piece):
    root, want = folder
    runs = frames.index(spark, f"file://{root}", piece, "*")
    got = {}
    for r in frames.read(runs).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["line_no"], r["raw"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v)) for k, v in want.items()}


@pytest.mark.parametrize("piece", [1, 97])
def test_runs_of_small_pieces(folder, piece):
    root, want = folder
    for name in want:
        if piece == 1 and not name.endswith("-lines"):
            continue
        path, size = str(root / name), (root / name).stat().st_size
        runs = [r for r in (frames.scan(path, size, s, min(size, s + piece)) for s in range(0, size, piece)) if r]
        if name == "nested":  # the inner member is taken for one, so the pieces don't cover the file
            assert sum(r["stop"] - r["start"] for r in runs) != size or len(runs) == 1
            continue
        assert runs[0]["start"] == 0 and all(a["stop"] == b["start"] for a, b in zip(runs, runs[1:], strict=False)) and runs[-1]["stop"] == size
        out, before = [], False
        for r in runs:
            r["open_start"], before = before, r["open_end"]
            with frames.open_file(path) as f:
                out += [x.decode() for x in frames.run_lines(f, r)] if r["feeds"] - r["open_start"] + r["open_end"] else []
        assert out == want[name]


def test_one_task_a_frame_and_lines_prune_runs(spark, folder):
    root, want = folder
    runs = frames.index(spark, f"file://{root}/gzip-lines", 60)
    assert runs.count() == 11 and runs.agg(F.sum("lines")).first()[0] == 200
    out = frames.ordered(runs)
    assert out.columns == ["path", "line_no", "raw", "file_ord"] and out.select(F.spark_partition_id()).distinct().count() > 1
    some = frames.read(runs, (45, 52)).collect()
    assert sorted((r["line_no"], r["raw"]) for r in some) == [(i, want["gzip-lines"][i]) for i in range(45, 53)]
    assert runs.where("first_line <= 52 and first_line + lines > 45").count() == 1


def test_broken_files_say_so(spark, tmp_path):
    (tmp_path / "cut").write_bytes(gzip.compress(b"line\n" * 100)[:-5])
    with pytest.raises(Exception, match="EOFError|without an end"):
        frames.index(spark, f"file://{tmp_path}/cut", 1 << 20).count()
