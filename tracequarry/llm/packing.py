"""Best-fit packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing puts pieces in order of length, longest first, into the open sequence
with the least room that is enough. A segment tree over remaining capacities finds it in
logarithmic time. Lengths lie between 1 and the capacity, so pieces of one length are alike:
the plan is made once for the histogram of lengths (at most ``capacity`` numbers, whatever
the corpus) and gives the same sequences as placing document after document. Pieces then take
their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.llm.common import bounded_batches, materialize, released
from tracequarry.llm.tokens import encoder, with_end


class CapacityTree:
    """Segment tree over capacities 0..top; a leaf counts the open bins with just that room."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += bins
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of an open bin that is at least ``need``."""
        i = need + self.size
        if i >= 2 * self.size:
            return None
        if self.count[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for ``histogram`` (pieces by length).

    Returns runs ``(length, first, last, bin, per_bin, offset)``: the pieces of that length
    with ranks ``first`` to ``last`` (exclusive) go to bins from ``bin`` on, ``per_bin`` to
    each, one after another from ``offset``. A bin that takes a piece has less room than
    before, so it stays the tightest until another piece doesn't fit; hence ``per_bin``.
    """
    tree, open_bins, runs, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens in sequences of {capacity}")
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, bins
                per = capacity // length
                n = -(-left // per)
                bins += n
            else:
                per = room // length
                first, n = open_bins[room].pop()
                tree.add(room, -n)
                used = min(n, -(-left // per))
                if used < n:
                    open_bins[room].append((first + used, n - used))
                    tree.add(room, n - used)
                n = used
            put = min(left, n * per)
            runs.append((length, rank, rank + put, first, per, capacity - room))
            full, some = divmod(put, per)
            for at, many, filled in ((first, full, per), (first + full, 1 if some else 0, some)):
                if many:
                    open_bins.setdefault(room - filled * length, []).append((at, many))
                    tree.add(room - filled * length, many)
            left, rank = left - put, rank + put
    return runs


def _piece_task(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                ids, ends = with_end(*encode.encode(batch.column("text")), end_id)
                sizes = np.diff(ends, prepend=0)
                counts = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                short = sizes - (counts - 1) * capacity
                start = np.where(piece == 0, 0, short[owner] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[owner], capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = 4 * ((ends - sizes)[owner] + start)
                cut = [raw[a : a + n] for a, n in zip(at.tolist(), (4 * length).tolist(), strict=True)]
                columns = [
                    batch.column("doc_id").cast(pa.int64()).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)),
                    pa.array(length.astype(np.int64)), pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([bytes(c) for c in cut], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, per_task: int = 200_000) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and
    ``offset``, and the pieces' ``ids`` (little-endian uint32) if ``with_ids``. Null text is
    empty: one end id. Only documents beyond ``capacity`` are cut; their first piece may be
    shorter. Rows with equal ids and texts take places of their own. An empty table gives no
    rows. Other columns aren't read.

    Pieces of one length, which may be a third of all, are ranked in 64 parts or as many as keep
    a part at about ``per_task`` pieces; the parts' sizes are summed first.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = docs.mapInArrow(released(_piece_task(tokenizer, end_id, capacity, with_ids)), kinds)
    pieces = materialize(pieces, "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    deal = spark.createDataFrame([(n, max(64, -(-count // per_task))) for n, count in histogram.items()], "length long, salts long")
    pieces = pieces.join(F.broadcast(deal), "length")  # at most `capacity` rows
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    parts = pieces.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")), "lengths")
    kinds = "length long, first long, last long, bin long, per_bin long, base long"
    runs = spark.createDataFrame(plan(histogram, capacity), kinds)
    ranked = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1)
    ranked = ranked.join(parts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("nth") + F.col("before"))
    # Some runs for each length: bounded whatever the corpus.
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (ranked["rank"] >= runs["first"]) & (ranked["rank"] < runs["last"]))
    at = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("bin") + F.expr("(rank - first) div per_bin")).alias("sequence_id"),
        (F.col("base") + F.pmod(at, F.col("per_bin")) * ranked["length"]).alias("offset"), *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack_documents(..., with_ids=True)``: a row per
    sequence with its ``ids`` as an array, ``n_tokens``, and the ``offsets`` of its pieces."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            ids = [np.frombuffer(b"".join(p["ids"] for p in r["pieces"]), "<u4").astype(np.int64).tolist() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["sequence_id"] for r in rows], pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([[p["offset"] for p in r["pieces"]] for r in rows], pa.list_(pa.int64()))],
                ["sequence_id", "ids", "n_tokens", "offsets"],
            )

    # A sequence has at most `capacity` pieces.
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return grouped.mapInArrow(join, "sequence_id long, ids array<long>, n_tokens long, offsets array<long>")
