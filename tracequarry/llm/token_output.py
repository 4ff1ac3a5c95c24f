"""Token-ID output: shards of patched frame-of-reference blocks.

A shard holds documents in ascending order of their id::

    "PFR1"                      magic
    id blocks                   the documents' token ids in a row
    length blocks               the documents' lengths in tokens
    document ids                int64, then one byte each: 1 where the id is null
    block starts                uint64, of the id blocks and then the length blocks
    footer                      7 x uint64: documents, tokens, and where each part starts

Every block has up to ``BLOCK`` values: ``minimum`` (uint32), ``count`` (uint16), ``width``
(uint8), ``exceptions`` (uint16), then the values less the minimum, packed at a width that
covers a percentile of them, then the exceptions' positions (uint16) and high parts (uint32).
The block starts let a reader decode any range of tokens alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.llm.common import bounded_batches, materialize, released, shared_dir
from tracequarry.llm.files import read_whole, write_whole
from tracequarry.llm.tokens import encoder, with_end

BLOCK = 1024
HEAD = struct.Struct("<IHBH")
FOOT = struct.Struct("<7Q")
MAGIC = b"PFR1"


def _pack(rest: np.ndarray, width: int) -> np.ndarray:
    """Rows of values under 2**width as rows of packed bytes, high bit first."""
    size = 16 if width <= 16 else 32
    raw = rest.astype(f">u{size // 8}").view(np.uint8).reshape(len(rest), -1)
    bits = np.unpackbits(raw, axis=1).reshape(len(rest), -1, size)[:, :, size - width :]
    return np.packbits(bits.reshape(len(rest), -1), axis=1)


def _unpack(raw: np.ndarray, count: int, width: int) -> np.ndarray:
    size = 16 if width <= 16 else 32
    bits = np.unpackbits(raw, axis=1)[:, : count * width].reshape(len(raw), count, width)
    full = np.zeros((len(raw), count, size), np.uint8)
    full[:, :, size - width :] = bits
    return np.packbits(full.reshape(len(raw), -1), axis=1).view(f">u{size // 8}").astype(np.uint32)


def encode_blocks(values: np.ndarray, percentile: float = 90.0) -> list[bytes]:
    """Blocks of uint32 values; each is packed at the width of its ``percentile``."""
    out: list[bytes] = [b""] * -(-len(values) // BLOCK)
    whole = len(values) // BLOCK
    groups = [(np.arange(whole), values[: whole * BLOCK].reshape(whole, BLOCK))]
    if whole < len(out):
        groups.append((np.array([whole]), values[whole * BLOCK :].reshape(1, -1)))
    for where, rows in groups:
        if not len(rows):
            continue
        low = rows.min(axis=1)
        rest = (rows - low[:, None]).astype(np.uint32)
        k = min(rows.shape[1] - 1, int(np.ceil(rows.shape[1] * percentile / 100)) - 1)
        pivot = np.partition(rest, k, axis=1)[:, k]
        widths = np.ceil(np.log2(pivot.astype(np.float64) + 1)).astype(int)
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            part = rest[own]
            high = (part >> np.uint32(width)) if width < 32 else np.zeros_like(part)
            packed = _pack(part & np.uint32((1 << width) - 1), width) if width else np.zeros((len(own), 0), np.uint8)
            n_exc = (high != 0).sum(axis=1)
            for i, j in enumerate(own.tolist()):
                body = packed[i].tobytes()
                if n_exc[i]:
                    at = np.flatnonzero(high[i])
                    body += at.astype("<u2").tobytes() + high[i][at].astype("<u4").tobytes()
                out[where[j]] = HEAD.pack(int(low[j]), rows.shape[1], width, int(n_exc[i])) + body
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """All values of the blocks that start at ``starts``."""
    heads = [HEAD.unpack_from(data, s) for s in starts.tolist()]
    parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(heads)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (_, count, width, _) in enumerate(heads):
        kinds.setdefault((count, width), []).append(i)
    raw = np.frombuffer(data, np.uint8)
    for (count, width), own in kinds.items():
        size = -(-count * width // 8)
        at = starts[own].astype(np.int64) + HEAD.size
        rows = _unpack(raw[at[:, None] + np.arange(size)], count, width) if width else np.zeros((len(own), count), np.uint32)
        for row, i, body in zip(rows, own, at.tolist(), strict=True):
            low, _, _, n = heads[i]
            if n:
                pos = np.frombuffer(data, "<u2", n, body + size)
                row[pos] |= np.frombuffer(data, "<u4", n, body + size + 2 * n) << np.uint32(width)
            parts[i] = row + np.uint32(low)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def encode_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, percentile: float = 90.0) -> bytes:
    blocks = encode_blocks(ids, percentile)
    more = encode_blocks(lengths.astype(np.uint32), percentile)
    sizes = np.array([len(b) for b in blocks + more], np.uint64)
    starts = (len(MAGIC) + np.concatenate([[0], np.cumsum(sizes)[:-1]])).astype("<u8") if len(sizes) else np.zeros(0, "<u8")
    at_ids = len(MAGIC) + int(sizes.sum())
    at_index = at_ids + 9 * len(doc_ids)
    return b"".join([
        MAGIC, *blocks, *more,
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids),
        starts.tobytes(), FOOT.pack(len(doc_ids), len(ids), at_ids, at_index, len(blocks), len(more), BLOCK),
    ])


def decode_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths, and all token ids."""
    n, _, at_ids, at_index, n_blocks, n_more, _ = FOOT.unpack_from(data, len(data) - FOOT.size)
    if data[:4] != MAGIC:
        raise ValueError("not a shard of token ids")
    starts = np.frombuffer(data, "<u8", n_blocks + n_more, at_index)
    doc_ids = np.frombuffer(data, "<i8", n, at_ids).tolist()
    nulls = data[at_ids + 8 * n : at_ids + 9 * n]
    doc_ids = [None if null else x for x, null in zip(doc_ids, nulls, strict=True)]
    return doc_ids, decode_blocks(data, starts[n_blocks:]).astype(np.int64), decode_blocks(data, starts[:n_blocks])


def token_range(data: bytes, start: int, stop: int) -> np.ndarray:
    """Token ids ``start`` to ``stop`` of a shard, from the blocks that hold them."""
    _, n, _, at_index, n_blocks, _, block = FOOT.unpack_from(data, len(data) - FOOT.size)
    start, stop = max(0, start), min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    first, last = start // block, -(-stop // block)
    starts = np.frombuffer(data, "<u8", n_blocks, at_index)[first:last]
    return decode_blocks(data, starts)[start - first * block : stop - first * block]


def _encode_task(path: str, end_id: int, bounds: list[int], narrow: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cuts = encoder(path, keep=True), np.array(bounds, np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                ids, ends = with_end(*encode.encode(batch.column("text")), end_id)
                size = 2 if narrow else 4
                raw = ids.astype(f"<u{size}").tobytes()
                where = np.concatenate([[0], ends]).astype(np.int64) * size
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(where.tobytes()), pa.py_buffer(raw)])
                doc = batch.column("doc_id").cast(pa.int64())
                bucket = np.searchsorted(cuts, doc.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([doc, pa.array(bucket), binary.cast(pa.binary())], ["doc_id", "bucket", "ids"])

    return run


def _write_task(uri: str, narrow: bool, shard_tokens: int, percentile: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, lengths, parts, held, shards, first = [], [], [], 0, 0, None

        def flush():
            nonlocal docs, lengths, parts, held, shards
            name = f"shard-{first:06d}-{shards:06d}.pfr"
            data = encode_shard(docs, np.array(lengths, np.int64), np.concatenate(parts), percentile)
            row = {"bucket": first, "shard": shards, "path": write_whole(uri, name, data), "n_docs": len(docs), "n_tokens": held, "n_bytes": len(data)}
            docs, lengths, parts, held, shards = [], [], [], 0, shards + 1
            return pa.RecordBatch.from_pylist([row], schema=MANIFEST)

        for batch in batches:
            for doc, bucket, raw in zip(batch.column("doc_id").to_pylist(), batch.column("bucket").to_pylist(), batch.column("ids"), strict=True):
                first = bucket if first is None else first
                ids = np.frombuffer(raw.as_buffer(), "<u2" if narrow else "<u4").astype(np.uint32)
                docs.append(doc)
                lengths.append(len(ids))
                parts.append(ids)
                held += len(ids)
                if held >= shard_tokens:
                    yield flush()
        if docs:
            yield flush()

    return run


MANIFEST = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
MANIFEST_DDL = "bucket int, shard int, path string, n_docs long, n_tokens long, n_bytes long"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, uri: str | None = None, shard_tokens: int = 1_000_000,
                 docs_per_range: int = 16_384, max_ranges: int = 50_000, percentile: float = 90.0) -> DataFrame:
    """Encode every text and write shards in ascending order of ``doc_id`` (null first; rows of
    one id in the order of their token ids). Null text counts as empty and is one end id.
    Columns other than ``doc_id`` and ``text`` aren't read; no rows give no shards.

    Returns the manifest, a table with a row per shard: ``bucket`` and ``shard`` (their order),
    ``path``, ``n_docs``, ``n_tokens``, ``n_bytes`` and ``base``, the tokens of all shards before
    it. Ranges of ids come from the quantiles of ``doc_id`` alone, so texts are encoded once and
    only ids are shuffled; a worker holds one shard of ``shard_tokens`` at a time. The driver
    holds the bounds of the ranges, at most ``max_ranges``.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bounded_batches(spark)
    uri = uri or shared_dir(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = docs.count()
    ranges = max(1, min(max_ranges, -(-n // docs_per_range)))
    bounds = []
    if ranges > 1:
        share = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", share, F.lit(10_000))).first()[0] or []))
    narrow = max(end_id, Tokenizer.from_file(tokenizer).get_vocab_size() - 1) < 1 << 16
    encoded = docs.mapInArrow(released(_encode_task(tokenizer, end_id, bounds, narrow)), "doc_id long, bucket int, ids binary")
    ordered = encoded.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("doc_id", "ids")
    shards = materialize(ordered.mapInArrow(released(_write_task(uri, narrow, shard_tokens, percentile)), MANIFEST_DDL), "shards")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per range: at most max_ranges
    ahead = shards.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = shards.withColumn("own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return materialize(own.join(ahead, "bucket").withColumn("base", F.col("ahead") + F.col("own")).drop("ahead", "own"), "manifest")


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            docs, lengths, ids = decode_shard(read_whole(row["path"]))
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(row["base"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """What the files of a manifest hold, a row per document: ``doc_id``, ``start``, ``n_tokens``
    and ``ids_crc32`` of its ids as little-endian uint32. A task reads a file at a time."""
    shards = manifest.select("path", "base").repartition(max(1, min(manifest.count(), 10_000)))
    return shards.mapInArrow(released(_read_task), "doc_id long, start long, n_tokens long, ids_crc32 long")
