"""Large trace files in many tasks: runs of gzip members, zstd frames or plain bytes.

A first pass cuts every file into pieces of so many bytes and lets a task look for the first member
or frame that begins in each: its mark alone proves nothing, so one is read to its end, where its
checksum must fit. The task follows frames to the piece's end and counts the lines that begin there.
That index has a row per piece; sums over it give each run its first line number. A second pass
reads runs, each alone, so a file of any size is read by as many tasks as it has pieces, and lines
are numbered without any task having seen those before. With an index at hand, wanted lines are
looked up in it, and only the runs that hold them are opened.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.operators.ordering import settled
from tracequarry.sources.trace import ZSTD_MAGIC, compression_of

#: A gzip member's first bytes, with the one method there is.
GZIP_MEMBER = b"\x1f\x8b\x08"
#: Bytes that are read at once, and lines in a batch.
BLOCK, LINES = 1 << 20, 10_000

INDEX = "path string, file_bytes long, kind string, start long, stop long, feeds long, open_end boolean"


def store_of(path: str):
    """(filesystem, path) in a store that pyarrow reaches; a bare path is local."""
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def open_file(path: str):
    """A file that can be read from any place."""
    store, name = store_of(path)
    return store.open_input_file(name)


def _decoder(kind: str) -> Any:
    if kind == "gzip":
        return zlib.decompressobj(31)
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


def blocks(f, kind: str | None, start: int, stop: int | None = None) -> Iterator[tuple[bytes, int | None]]:
    """Decompressed bytes from the frame at ``start`` on, with the place in the file where a frame
    ends with them, else None. Plain bytes end a frame at ``stop`` and at the file's end."""
    f.seek(start)
    if kind is None:
        at = start
        while data := f.read(BLOCK if stop is None or at >= stop else min(BLOCK, stop - at)):
            at += len(data)
            yield data, at if stop is None or at >= stop else None
        return
    decoder, held, at = _decoder(kind), b"", start
    while True:
        data = held or f.read(BLOCK)
        held = b""
        if not data:
            if at != start and decoder is None:
                return
            raise EOFError("a frame without an end")
        if decoder is None:
            decoder = _decoder(kind)
        out = decoder.decompress(data)
        at += len(data)
        if decoder.eof:
            held = decoder.unused_data
            at -= len(held)
            decoder = None
            yield out, at
        elif out:
            yield out, None


def _errors() -> tuple[type[Exception], ...]:
    import zstandard

    return (zlib.error, EOFError, zstandard.ZstdError)


def _starts_frame(f, kind: str, at: int) -> bool:
    try:
        return any(end is not None for _, end in blocks(f, kind, at))
    except _errors():
        return False


def first_frame(f, kind: str | None, start: int, stop: int) -> int | None:
    """Where the first frame begins in ``[start, stop)``, None if none does."""
    if kind is None or start == 0:
        return start
    mark = GZIP_MEMBER if kind == "gzip" else ZSTD_MAGIC
    at, tail = start, b""
    while at < stop:
        f.seek(at)
        data = tail + f.read(min(BLOCK, stop - at) + (len(mark) - 1 if at + BLOCK >= stop else 0))
        base, found = at - len(tail), -1
        while (found := data.find(mark, found + 1)) >= 0:
            if base + found < stop and _starts_frame(f, kind, base + found):
                return base + found
        at, tail = at + BLOCK, data[-(len(mark) - 1) :]
    return None


def scan(path: str, file_bytes: int, start: int, stop: int) -> dict | None:
    """The run of frames that begin in a piece: where it starts and stops, its line feeds, and
    whether its last line goes on behind it."""
    with open_file(path) as f:
        kind = compression_of(f.read(4))
        first = first_frame(f, kind, start, stop)
        if first is None:
            return None
        feeds, last, end = 0, b"\n", first
        for data, end_of_frame in blocks(f, kind, first, stop):
            feeds += data.count(b"\n")
            last = data[-1:] or last
            if end_of_frame is not None:
                end = end_of_frame
                if end >= stop:
                    break
    return {"path": path, "file_bytes": file_bytes, "kind": kind, "start": first, "stop": end, "feeds": feeds, "open_end": last != b"\n"}


def _scan_task(strict: bool):
    schema = pa.schema([("path", pa.string()), ("file_bytes", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("feeds", pa.int64()), ("open_end", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    row = scan(r["path"], r["length"], r["start"], r["stop"])
                except _errors():
                    if strict:
                        raise
                    row = None  # the pieces don't cover the file then, and it is read as one
                if row:
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def index(spark: SparkSession, path: str | list[str], piece_bytes: int = 64 << 20, glob: str | None = None) -> DataFrame:
    """Runs of all files below ``path`` or of the files that it lists: ``path``, ``kind``, ``start`` and ``stop`` in bytes,
    ``first_line`` and ``lines`` (those that begin in the run), ``open_start`` and ``open_end``.

    Runs must cover a file without gaps or overlaps. A file where they don't, since bytes within a
    frame looked like another, is followed from its start by one task instead; broken files raise
    an error there. Empty files have no runs."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "length").where("length > 0")
    pieces = files.select("path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {piece_bytes})")).alias("n"))
    pieces = pieces.select("path", "length", (F.col("n") * piece_bytes).alias("start"), F.least((F.col("n") + 1) * piece_bytes, "length").alias("stop"))
    found = settled(pieces.repartition(_tasks(pieces), "path", "start").mapInArrow(_scan_task(False), INDEX))
    covered = found.groupBy("path").agg(F.sum(F.col("stop") - F.col("start")).alias("_bytes"), F.min("start").alias("_first"))
    whole = files.join(covered, "path", "left").where("_bytes is null or _bytes <> length or _first <> 0")
    whole = settled(whole.select("path", "length", F.lit(0).cast("long").alias("start"), F.col("length").alias("stop")).mapInArrow(_scan_task(True), INDEX))
    runs = found.join(whole.select("path"), "path", "left_anti").unionByName(whole)
    w = Window.partitionBy("path").orderBy("start")  # a row per piece of a file
    runs = runs.withColumn("open_start", F.coalesce(F.lag("open_end").over(w), F.lit(False)))
    runs = runs.withColumn("lines", F.col("feeds") - F.col("open_start").cast("long") + F.col("open_end").cast("long"))
    before = F.coalesce(F.sum("lines").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return settled(runs.withColumn("first_line", before).drop("feeds", "file_bytes"))


def _tasks(pieces: DataFrame, most: int = 20_000) -> int:
    return max(1, min(most, pieces.count()))


def run_lines(f, run: dict) -> Iterator[bytes]:
    """Lines that begin in a run, the last one read to its end in the frames behind."""
    rest, skip, over = b"", run["open_start"], False
    for data, end in blocks(f, run["kind"], run["start"], run["stop"]):
        over_now = end is not None and end >= run["stop"]
        rest += data
        *lines, rest = rest.split(b"\n") if b"\n" in data else (rest,)
        if lines and skip:
            lines, skip = lines[1:], False
        if over:  # behind the run: only what ends its last line counts
            yield from lines[:1]
            if lines:
                return
        else:
            yield from lines
            if over_now and (not run["open_end"] or skip):
                return
        over = over or over_now
    if rest and not skip:
        yield rest


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(path: str, first: int, part: list[bytes]) -> pa.RecordBatch:
        texts = [x.decode(errors="replace").rstrip("\r\n") for x in part]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(first, first + len(part)), pa.int64()), pa.array(texts, pa.string())], ["path", "line_no", "raw"])

    for batch in batches:
        for run in batch.to_pylist():
            part, n = [], run["first_line"]
            with open_file(run["path"]) as f:
                for line in run_lines(f, run):
                    part.append(line)
                    if len(part) == LINES:
                        yield batch_of(run["path"], n, part)
                        n, part = n + len(part), []
            if part:
                yield batch_of(run["path"], n, part)


def read(runs: DataFrame, lines: tuple[int, int] | None = None) -> DataFrame:
    """``path``, ``line_no`` and ``raw`` of the lines of runs from ``index``; with ``lines`` those
    from the first to the last number only, of runs that hold some of them."""
    if lines is not None:
        first, last = lines
        runs = runs.where((F.col("first_line") <= last) & (F.col("first_line") + F.col("lines") > first))
    out = runs.where("lines > 0").repartition(_tasks(runs), "path", "start").mapInArrow(_read_task, "path string, line_no long, raw string")
    return out if lines is None else out.where(F.col("line_no").between(*lines))


def ordered(runs: DataFrame, lines: tuple[int, int] | None = None) -> DataFrame:
    """``read`` with ``file_ord``, the place of a line's file among all files by path."""
    place = F.row_number().over(Window.orderBy("path")) - 1  # a row per file
    files = runs.select("path").distinct().withColumn("file_ord", place)
    return read(runs, lines).join(files.withColumnRenamed("path", "_path"), F.col("path") == F.col("_path")).drop("_path")
