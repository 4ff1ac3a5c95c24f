"""Files that grow, read as a stream."""

from __future__ import annotations

import gzip
import random

import pytest

from tracequarry.sources import tail
from tracequarry.streaming import live


def compress(kind, data):
    import zstandard

    return {"gzip": gzip.compress, "zstd": zstandard.compress, None: lambda x: x}[kind](data)


def whole_lines(kind, parts, size):
    """Lines of the longest run of whole frames, below a size, that ends with a line."""
    at, text, best = 0, b"", b""
    for p in parts:
        at += len(compress(kind, p))
        text += p
        if at > size:
            break
        if text.endswith(b"\n"):
            best = text
    if kind is None:
        text = b"".join(parts)[:size]
        best = text[: text.rfind(b"\n") + 1]
    return best.split(b"\n")[:-1]


@pytest.mark.parametrize("kind", ["gzip", "zstd", None])
@pytest.mark.parametrize("within", [False, True])
def test_any_cuts_give_every_line_once(tmp_path, kind, within):
    """Frames that end with lines or within them, frames of no bytes, a member within another."""
    rng = random.Random(7)
    lines = [b"x" * rng.randint(0, 50) + str(i).encode() for i in range(120)]
    body = b"\n".join(lines) + b"\n"
    cuts = sorted(rng.sample(range(1, len(body)), 15)) if within else [i + 1 for i, b in enumerate(body) if b == 10][6:-1:7]
    parts = [body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)], strict=True)]
    parts.insert(3, b"")
    path = tmp_path / "f"
    path.write_bytes(b"".join(compress(kind, p) for p in parts))
    size = path.stat().st_size
    for _ in range(40):
        at = sorted(rng.sample(range(size + 1), rng.randint(1, 9)))
        got = [x for a, b in zip([0, *at], [*at, size], strict=True) for _, part in tail.lines_between(str(path), a, b) for x in part]
        assert got == lines
    for at in range(0, size + 1, 13):  # what a file of that size would have given
        assert [x for _, part in tail.lines_between(str(path), 0, at) for x in part] == whole_lines(kind, parts, at)
    if kind == "gzip":
        stored = gzip.compress(b"a\n") + gzip.compress(gzip.compress(b"inner\n") + b"\nb\n", compresslevel=0) + gzip.compress(b"c\n")
        path.write_bytes(stored)
        want = [b"a", *(gzip.compress(b"inner\n") + b"\nb").split(b"\n"), b"c"]
        for at in range(len(stored)):
            got = [x for a, b in ((0, at), (at, len(stored))) for _, part in tail.lines_between(str(path), a, b) for x in part]
            assert len(got) == len(want) and got[0] == b"a" and got[-2:] == [b"b", b"c"]


def test_stream_reads_growing_files_once_over_restarts(spark, tmp_path):
    folder, out, marks = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/marks"
    folder.mkdir()

    def run():
        stream = tail.tail(spark, str(folder), 200)
        live.keep_merged(stream, out, marks).awaitTermination()
        return sorted((r["file"], r["raw"]) for r in spark.read.parquet(out).collect())

    member = lambda a, b: gzip.compress("".join(f"g{i}\n" for i in range(a, b)).encode())
    first, second = member(0, 50), member(50, 90)
    (folder / "a").write_bytes(first + second[:10])
    (folder / "b").write_text("p0\np1\np")
    (folder / ".hidden").write_text("no\n")
    want = [("a", f"g{i}") for i in range(50)] + [("b", "p0"), ("b", "p1")]
    assert run() == sorted(want)
    assert run() == sorted(want)  # nothing new
    (folder / "a").write_bytes(first + second)
    (folder / "b").write_text("p0\np1\np2\n")
    (folder / "c").write_text("q0\n" * 100)
    want += [("a", f"g{i}") for i in range(50, 90)] + [("b", "p2")] + [("c", "q0")] * 100
    assert run() == sorted(want)
    (folder / "b").write_text("p")
    with pytest.raises(Exception, match="only grow"):
        run()


def test_order_within_a_file(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"".join(gzip.compress(f"{i}\n{i}b\n".encode()) for i in range(30)))
    reader = tail._TailReader(str(tmp_path), 100)
    pieces = reader.partitions({}, reader.latestOffset())
    rows = [r for p in pieces for b in reader.read(p) for r in b.to_pylist()]
    assert len(pieces) > 5
    assert [r["raw"] for r in sorted(rows, key=lambda r: (r["start"], r["nth"]))] == [x for i in range(30) for x in (str(i), f"{i}b")]
