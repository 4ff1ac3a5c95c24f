"""Trace files: newline-delimited JSON, plain, as gzip members or as zstd frames.

The compression is found by magic bytes, whatever the file's name says. ``TraceSource`` reads
files that executors can open; where only Spark reaches the store, ``read_lines`` takes the
bytes through Spark's own file source.
"""

from __future__ import annotations

import gzip
import io
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: First bytes of compressed files.
GZIP_MAGIC, ZSTD_MAGIC = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"

SCHEMA = "path string, file_ord int, line_no long, raw string"


def compression_of(head: bytes) -> str | None:
    return "gzip" if head.startswith(GZIP_MAGIC) else "zstd" if head.startswith(ZSTD_MAGIC) else None


def detect_compression(path: str) -> str | None:
    """``gzip``, ``zstd`` or None; a missing file has none."""
    try:
        with open(path, "rb") as f:
            return compression_of(f.read(4))
    except FileNotFoundError:
        return None


def text_of(stream, kind: str | None) -> io.TextIOBase:
    """Text over all members or frames of a compressed stream."""
    if kind == "gzip":
        stream = gzip.GzipFile(fileobj=stream)
    elif kind == "zstd":
        import zstandard

        stream = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
    return io.TextIOWrapper(io.BufferedReader(stream) if not isinstance(stream, io.BufferedIOBase) else stream, "utf-8", errors="replace", newline="\n")


def iter_lines(path: str) -> Iterator[str]:
    """Lines without their ends."""
    with open(path, "rb") as f:
        kind = compression_of(f.read(4))
        f.seek(0)
        for line in text_of(f, kind):
            yield line.rstrip("\r\n")


class _File(InputPartition):
    def __init__(self, path: str, order: int):
        self.path, self.order = path, order


class _TraceReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths, self.lines, self.words = paths, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Line numbers and files are chosen while reading."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("line_no",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.lines = wanted if self.lines is None else self.lines & wanted
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.words = wanted if self.words is None else self.words & wanted
            else:
                yield f

    def partitions(self):
        return [_File(p, i) for i, p in enumerate(self.paths) if self.words is None or p in self.words]

    def read(self, partition):
        last = max(self.lines) if self.lines else None
        for n, line in enumerate(iter_lines(partition.path)):
            if self.lines is None or n in self.lines:
                yield partition.path, partition.order, n, line
            if last is not None and n >= last:
                return


class TraceSource(DataSource):
    """``spark.read.format("trace").load(path)``: a file, or a folder of files. ``paths`` may
    list files separated by line feeds, in order."""

    @classmethod
    def name(cls) -> str:
        return "trace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        if self.options.get("paths"):
            return _TraceReader(self.options["paths"].split("\n"))
        path = self.options["path"].removeprefix("file://")
        if os.path.isdir(path):
            return _TraceReader(sorted(os.path.join(path, x) for x in os.listdir(path) if os.path.isfile(os.path.join(path, x))))
        return _TraceReader([path])


def register(spark: SparkSession) -> None:
    """Make the format known, and let filters reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceSource)


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The lines of all files below ``path`` through Spark's file source: a row per line with
    ``path``, ``line_no`` and ``raw``. Whole files pass through memory, one at a time."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                lines = [x.rstrip("\r\n") for x in text_of(io.BytesIO(data), compression_of(data[:4]))]
                for k in range(0, len(lines), 10_000):
                    part = lines[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(k, k + len(part)), pa.int64()), pa.array(part)], ["path", "line_no", "raw"])

    return reader.load(path).select("path", "content").mapInArrow(run, "path string, line_no long, raw string")


def events(lines: DataFrame, bad: str = "skip") -> DataFrame:
    """Parse ``raw`` into the VARIANT ``v`` and add ``event_type`` and ``event_idx``, the place
    among the lines of its file that aren't blank. Bad lines are left out (``skip``), kept with
    a null ``v`` (``record``), or stop the query (``fail``)."""
    from pyspark.sql.window import Window

    lines = lines.where(F.trim("raw") != "")
    parse = F.parse_json if bad == "fail" else F.try_parse_json
    out = lines.withColumn("v", parse(F.col("raw")))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("line_no")).cast("long") - 1
    out = out.withColumn("event_idx", nth).withColumn("event_type", F.try_variant_get("v", "$.event_type", "string"))
    return out if bad == "record" else out.where("v is not null")


def nth_line(lines: DataFrame, n: int) -> DataFrame:
    """The n-th physical line, from 0."""
    return lines.where(F.col("line_no") == n)
