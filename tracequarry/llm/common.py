"""Shared plumbing: tables in the cluster's shared folder and connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions.values import let as let

#: What separates words wherever a rule here speaks of words (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the driver and all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where the setting is
    absent in a local session, as in tests, a temporary folder takes its place; on a cluster
    that is an error, since executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("tracequarry.shared.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracequarry-")
        spark.conf.set("tracequarry.shared.dir", base)
    if "://" not in base and not base.startswith("file:"):  # as Spark reads it: on the default filesystem
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and a
    result used twice is computed once.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Within it, Spark deletes the shuffle files of a query when the query ends, on all executors.
    Otherwise they stay until the driver happens to collect its garbage. For queries that run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}
    for parent in parents:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def release_memory() -> None:
    """Give freed memory of a Python worker back to the system. Workers outlive their tasks, and
    stages of the JVM that follow need the room."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Lower the bound of the batches that go to Python workers from Spark's 64 MB, unless the
    session has another: every running task holds some of them on either side."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, most)


def text_slices(batch, column: str, most: int = 1_000_000):
    """Slices of a record batch with at most so many bytes in a text column; a longer text is a
    slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    sizes, at = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), 0
    while at < len(sizes):
        stop = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at : at + 100_000]), most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def released(task):
    """A task over batches that releases memory when it ends."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large and small stars.

    ``edges`` has columns ``a`` and ``b`` of one orderable type. Returns ``node`` and
    ``component``, the smallest node that it reaches. Nodes without edges don't appear;
    null ends and self-loops are ignored. Every round is a few aggregations with map-side
    combining and equi-joins over the edge list and is written to the shared folder; the
    number of rounds is logarithmic in the longest path. No node's neighbours are ever
    gathered in one place.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, f"{name}-0")
    mark = None
    for i in range(1, max_rounds + 1):
        sym = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = rest.unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(small, f"{name}-{i}")
        drop_table(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components: not settled")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
