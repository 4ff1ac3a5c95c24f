"""Trace files that are still being written, as a stream: each line once, also over restarts.

Offsets are the sizes of files in bytes, so that planning a batch reads nothing. What two sizes
mean is found by the tasks: a batch holds the lines before the last place at or below the new size
where a gzip member or zstd frame and a line end together, from the like place of the old size on.
That place depends only on bytes below the size, which no longer change, so a batch that runs again
reads the same lines, and a frame that is half written waits for a later batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tracequarry.sources.frames import BLOCK, GZIP_MEMBER, LINES, _errors, blocks, open_file, store_of
from tracequarry.sources.trace import ZSTD_MAGIC, compression_of

SCHEMA = "file string, start long, nth long, raw string"


def _frame_may_begin(f, kind: str, at: int) -> bool:
    """Whether what is there so far behind a place is how a frame begins."""
    mark = GZIP_MEMBER if kind == "gzip" else ZSTD_MAGIC
    f.seek(at)
    return mark.startswith(f.read(len(mark)))


def _walk(f, kind: str, first: int, at: int) -> int:
    """The last end of a frame at or before ``at`` behind which a line begins, on the way from a
    frame at ``first``; 0 if there is none or no frame begins there."""
    found, last = 0, b""
    try:
        for data, end in blocks(f, kind, first):
            last = data[-1:] or last
            if end is not None and end <= at and last == b"\n":
                found = end
            if end is not None and end >= at:
                return found if end > at or _frame_may_begin(f, kind, end) else 0
            if f.tell() > at + BLOCK:
                return found
    except EOFError:  # the frame behind isn't whole yet
        return found
    except _errors():  # bytes that only look like frames
        return 0
    return found


def last_end(f, kind: str | None, at: int) -> int:
    """The last place at or before ``at`` where a frame and a line end, 0 if there is none. Plain
    files have a frame for each line. Bytes are read backwards, as far as one such place."""
    mark = b"\n" if kind is None else GZIP_MEMBER if kind == "gzip" else ZSTD_MAGIC
    stop = at
    while stop > 0:
        start = max(0, stop - BLOCK)
        f.seek(start)
        data = f.read(stop - start + len(mark) - 1)
        places = [start + m.start() for m in re.finditer(b"(?=" + re.escape(mark) + b")", data) if start + m.start() < stop]
        for place in reversed(places):
            end = place + 1 if kind is None else _walk(f, kind, place, at)
            if end:
                return end
        stop = start
    return 0


def lines_between(path: str, start: int, stop: int) -> Iterator[tuple[int, list[bytes]]]:
    """Lines of a file that grew from ``start`` to ``stop`` bytes, in lists, each with the place
    where the first frame begins. Lists of pieces next to each other neither overlap nor miss any."""
    with open_file(path) as f:
        kind = compression_of(f.read(4))
        first, last = last_end(f, kind, start), last_end(f, kind, stop)
        if first >= last:
            return
        rest = b""
        for data, end in blocks(f, kind, first, last):
            *lines, rest = (rest + data).split(b"\n")
            for k in range(0, len(lines), LINES):
                yield first, lines[k : k + LINES]
            if end is not None and end >= last:
                return


class _Piece(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


class _TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, piece_bytes: int):
        self.folder, self.piece_bytes = folder, piece_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow.fs import FileSelector

        store, top = store_of(self.folder)
        found = store.get_file_info(FileSelector(top, allow_not_found=True))
        return {x.base_name: x.size for x in sorted(found, key=lambda x: x.base_name) if x.is_file and x.base_name[0] not in "._"}

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        out = []
        for file, size in end.items():
            had = start.get(file, 0)
            if size < had:
                raise ValueError(f"{file} had {had} bytes and has {size}: files of a live trace only grow")
            cuts = [*range(had, size, self.piece_bytes), size]
            out += [_Piece(file, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        n = 0
        for first, lines in lines_between(f"{self.folder}/{partition.file}", partition.start, partition.stop):
            texts = [x.decode(errors="replace").rstrip("\r") for x in lines]
            columns = [pa.array([partition.file] * len(texts)), pa.array([first] * len(texts), pa.int64()), pa.array(range(n, n + len(texts)), pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["file", "start", "nth", "raw"])
            n += len(texts)


class TailSource(DataSource):
    """``spark.readStream.format("trace_tail").load(folder)``: the lines of all files in a folder,
    in order of ``start`` and ``nth`` within a ``file``. ``pieceBytes`` (64 MB) is what one task
    reads at most, but for frames that are longer. Files must only grow; a last line without its
    end waits for it. Names that begin with ``.`` or ``_`` are left out. An offset has an entry
    for each file of the folder, so finished files are to be moved away in the long run."""

    @classmethod
    def name(cls) -> str:
        return "trace_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _TailReader(self.options["path"].rstrip("/"), int(self.options.get("pieceBytes", 64 << 20)))


def tail(spark: SparkSession, folder: str, piece_bytes: int = 64 << 20) -> DataFrame:
    """The stream of a folder's lines, with ``seen``, the time of the batch, as ``streaming.live``
    takes it."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("trace_tail").option("pieceBytes", piece_bytes).load(folder).withColumn("seen", F.current_timestamp())
