"""Lines, counts of their tokens and posts as packed Arrow arrays.

Line dedup itself runs on DataFrame functions only (``line_dedup``) and makes nothing of this. The
functions stay for jobs of their own over packed counts, and are tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import drop_table, materialize, released, text_slices
from tracequarry.llm.links import runs_of
from tracequarry.llm.shingles import mix, shingle_tokens, text_bytes

#: Tokens that a task counts and packs together, and posts; packing takes several times their room.
PACK, POSTS = 1_000_000, 500_000
#: A token's key is 44 bits of its hash or, above these, the rank of a frequent one.
HASH_BITS = 44
#: Bits of a key, and the bytes that hold it in a post.
KEY_BITS, KEY_BYTES = HASH_BITS + 1, 6
#: Slots by which a frequent token is found.
SLOT_BITS = 20
#: Tokens are counted by 40 bits of their hashes; two that agree there just share a rank.
COUNT_BITS = 40
_OTHER = np.uint64(0x5851F42D4C957F2D)


class Lines:
    """The lines of some texts: ``text`` (the text of each), ``number`` (from 0 within it),
    ``tokens`` (flat), ``owner`` (the line of each token), ``sizes``, and the two halves of a
    hash of each set, ``h1`` and ``h2``."""

    def __init__(self, texts: pa.Array):
        raw, bounds = text_bytes(texts)
        feeds = np.flatnonzero(raw == 10)
        of = np.searchsorted(bounds, feeds, "right") - 1
        n = len(bounds) - 1
        text, start = np.concatenate([np.arange(n), of]), np.concatenate([bounds[:-1], feeds + 1])
        order = np.lexsort((start, text))
        self.text, starts = text[order], start[order]
        self.number = np.arange(len(order)) - np.searchsorted(self.text, np.arange(n))[self.text]
        self.tokens, self.owner = shingle_tokens(raw, np.append(starts, len(raw)))
        self.sizes = np.bincount(self.owner, minlength=len(order))
        self.ends = np.cumsum(self.sizes)
        halves = []
        for salt in (np.uint64(0), _OTHER):
            sums = np.zeros(len(self.tokens) + 1, np.uint64)
            np.cumsum(mix(self.tokens ^ salt), out=sums[1:])  # whatever the order of the tokens
            halves.append(sums[self.ends] - sums[self.ends - self.sizes])
        self.h1, self.h2 = halves

    def firsts(self, order: np.ndarray) -> np.ndarray:
        """Of the lines in ``order`` the first of each class."""
        h1, h2 = self.h1[order], self.h2[order]
        by = np.lexsort((np.arange(len(order)), h2, h1))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h1[by[1:]] != h1[by[:-1]]) | (h2[by[1:]] != h2[by[:-1]])
        return order[np.sort(by[fresh])]

    def digests(self, which: np.ndarray) -> pa.Array:
        both = np.stack([self.h1[which], self.h2[which]], axis=1).astype(">u8")
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(which), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    for batch in batches:
        for some in text_slices(batch, "low"):
            yield some, Lines(some.column("low"))


def _order(key: np.ndarray, groups: int) -> np.ndarray:
    """A stable order of small whole numbers; 16 bits go by radix."""
    return np.argsort(key.astype(np.uint16) if groups <= 1 << 16 else key, kind="stable")


def _packed(bucket: np.ndarray, n_buckets: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row per bucket with the bytes of every column's values in it."""
    order = _order(bucket, n_buckets)
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    some = np.flatnonzero(np.diff(cuts))
    columns = {name: values[order] for name, values in columns.items()}
    return pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int64)), *(pa.array([v[cuts[b] : cuts[b + 1]].tobytes() for b in some.tolist()], pa.binary()) for v in columns.values())],
        ["bucket", *columns],
    )


LINES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line_no", pa.int32()), ("n_tokens", pa.int64()), ("digest", pa.binary())])
COUNTS = pa.schema([("bucket", pa.int64()), ("least", pa.int64()), ("wide", pa.int32()), ("steps", pa.binary()), ("at", pa.binary()), ("many", pa.binary())])
LINES_DDL = "doc_id long, text_hash long, line_no int, n_tokens long, digest binary, bucket long, least long, wide int, steps binary, at binary, many binary"


def _widened(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of ``LINES`` or of ``COUNTS`` with the columns of both."""
    every = [*LINES, *COUNTS]
    columns = [batch.column(f.name) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in every]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(every))


def _pack_counts(parts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Tokens by bucket: the least, then steps of three or eight bytes, and counts over one."""
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    bucket = (keys.astype(np.float64) * (buckets / (1 << COUNT_BITS))).astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        own, many = keys[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]]
        steps, more = np.diff(own), np.flatnonzero(many > 1)
        wide = 8 if len(steps) and int(steps.max()) >= 1 << 24 else 3
        raw = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
        rows.append((b, int(own[0]), wide, raw, more.astype("<u4").tobytes(), many[more].astype("<u8").tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COUNTS, strict=True)], schema=COUNTS)


def _line_task(buckets: int):
    """All lines, and between them the counts of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch, lines in _slices(batches):
            digest = pc.if_else(pa.array(lines.sizes == 0), pa.scalar(None, pa.binary()), lines.digests(np.arange(len(lines.text))))
            text = pa.array(lines.text)
            columns = [batch.column("doc_id").take(text), batch.column("text_hash").take(text), pa.array(lines.number.astype(np.int32)), pa.array(lines.sizes.astype(np.int64)), digest]
            yield _widened(pa.RecordBatch.from_arrays(columns, schema=LINES))
            if len(lines.tokens):
                parts.append(lines.tokens >> np.uint64(64 - COUNT_BITS))
                held += len(parts[-1])
            if held >= PACK:
                yield _widened(_pack_counts(parts, buckets))
                parts, held = [], 0
        if held:
            yield _widened(_pack_counts(parts, buckets))

    return run


def line_table(docs: DataFrame) -> DataFrame:
    """All lines of ``docs`` (``doc_id``, ``text_hash``, ``low``), where ``bucket`` is null, and the
    packed counts of their tokens."""
    return materialize(docs.mapInArrow(released(_line_task(_buckets(docs))), LINES_DDL), "lines")


def _buckets(df: DataFrame) -> int:
    """Parts of the tokens; they grow with the number of shuffle partitions."""
    return 1 << max(6, (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def _sum_task(least: int):
    """Counts of the tokens that at least ``least`` lines hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in runs_of(batches, "bucket"):
            keys, counts = [], []
            for row in bucket.to_pylist():
                wide = row["wide"]
                steps = np.zeros((len(row["steps"]) // wide, 8), np.uint8)
                steps[:, :wide] = np.frombuffer(row["steps"], np.uint8).reshape(-1, wide)
                own = row["least"] + np.concatenate([[0], np.cumsum(steps.reshape(-1).view("<u8"))]).astype(np.int64)
                many = np.ones(len(own), np.int64)
                many[np.frombuffer(row["at"], "<u4")] = np.frombuffer(row["many"], "<u8")
                keys.append(own)
                counts.append(many)
            own, many = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(own)
            own, many = own[order], many[order]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            total = np.add.reduceat(many, first)
            some = total >= least
            yield pa.RecordBatch.from_arrays([pa.array(own[first][some]), pa.array(total[some])], ["token", "n"])

    return run


def frequent_tokens(table: DataFrame, frequent: int, least: int = 4) -> np.ndarray:
    """The most common tokens of all lines of a ``line_table`` (their first 40 bits), rarest first:
    those that at least ``least`` lines hold, and of these at most ``frequent``, down to one count."""
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = table.where("bucket is not null").select(*COUNTS.names).repartition(n, "bucket").sortWithinPartitions("bucket")
    counted = materialize(packed.mapInArrow(released(_sum_task(least)), "token long, n long"), "token-counts")
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # at most 16 for each doubling
    total, low = 0, None
    for r in levels:
        total += r["count"]
        if total > frequent:
            break
        low = r["level"]
    if low is None:
        drop_table(counted)
        return np.zeros(0, np.int64)
    some = counted.where(level >= low).toPandas()  # at most `frequent` rows
    drop_table(counted)
    return some.sort_values(["n", "token"])["token"].to_numpy(np.int64)


def _sketch(tokens: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two halves of the sketch of each set; ``starts`` is where the tokens of each begin."""
    bit, high = np.uint64(1) << (tokens & np.uint64(63)), (tokens & np.uint64(64)) > 0
    return [np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), starts) if len(starts) else bit for side in (high, ~high)]


def _post_task(tokens: np.ndarray, ranks: np.ndarray, per_cent: int, buckets: int):
    """Posts of the prefixes of all classes, packed by bucket. ``tokens`` are the frequent ones in
    order of their hashes, ``ranks`` their ranks from 1."""

    known = np.zeros(1 << 24, bool)  # by 24 bits of the hashes: most tokens aren't frequent
    known[tokens >> (COUNT_BITS - 24)] = True
    slots = np.searchsorted(tokens, np.arange((1 << SLOT_BITS) + 1) << (COUNT_BITS - SLOT_BITS)).astype(np.int32)
    most = int(np.diff(slots).max())

    def keys(own: np.ndarray) -> np.ndarray:
        """Keys in one order: hashes of the rare tokens first, then ranks."""
        key = own >> np.uint64(64 - HASH_BITS)
        some = np.flatnonzero(known[own >> np.uint64(40)])
        short = (own[some] >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
        at = slots[short >> (COUNT_BITS - SLOT_BITS)]
        for step in range(most):
            place = np.minimum(at + step, len(tokens) - 1)
            hit = tokens[place] == short
            key[some[hit]] = ranks[place[hit]].astype(np.uint64) | np.uint64(1 << HASH_BITS)
        return key

    def posts(lines: Lines) -> tuple[np.ndarray, ...]:
        which = lines.firsts(np.flatnonzero(lines.sizes > 0))  # copies within the slice are posted once
        mine = np.zeros(len(lines.sizes), bool)
        mine[which] = True
        keep = mine[lines.owner]
        filled = np.flatnonzero(lines.sizes > 0)
        sketch = np.zeros((2, len(lines.sizes)), np.uint64)
        sketch[:, filled] = _sketch(lines.tokens, lines.ends[filled] - lines.sizes[filled])
        key, owner = keys(lines.tokens[keep]), lines.owner[keep]
        if len(lines.sizes) <= 1 << (64 - KEY_BITS):  # line and key in one number, which sorts fastest
            both = np.sort((owner.astype(np.uint64) << np.uint64(KEY_BITS)) | key)
            key, owner = both & np.uint64((1 << KEY_BITS) - 1), (both >> np.uint64(KEY_BITS)).astype(np.int64)
        else:  # a text of very many lines
            order = np.lexsort((key, owner))
            key, owner = key[order], owner[order]
        size = lines.sizes[owner]
        first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1]) if len(owner) else np.zeros(0, int)
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        front = place < size - (per_cent * size + 99) // 100 + 1
        own = owner[front]
        return key[front], lines.h1[own], size[front].astype(np.uint32), place[front].astype(np.uint32), *sketch[:, own]

    def pack(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, ident, size, place, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        raw = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
        short = np.uint16 if not len(size) or size.max() < 1 << 16 else np.uint32  # places lie below sizes
        columns = {"key": raw, "id": ident, "size": size.astype(short), "place": place.astype(short), "low": low, "high": high}
        return _packed((mix(key) & np.uint64(buckets - 1)).astype(np.int64), buckets, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, lines in _slices(batches):
            parts.append(posts(lines))
            held += len(parts[-1][0])
            if held >= POSTS:
                yield pack(parts)
                parts, held = [], 0
        if held:
            yield pack(parts)

    return run


def _unpacked(bucket: pa.Table) -> tuple[np.ndarray, ...]:
    """Posts of a bucket as packed: keys, ids, sizes and places."""
    ident = [np.frombuffer(x, np.uint64) for x in bucket.column("id").to_pylist()]
    raw = np.frombuffer(b"".join(bucket.column("key").to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
    key = np.zeros((len(raw), 8), np.uint8)
    key[:, :KEY_BYTES] = raw
    small = [
        np.concatenate([np.frombuffer(x, f"<u{len(x) // len(own)}").astype(np.uint32) for x, own in zip(bucket.column(c).to_pylist(), ident, strict=True)])
        for c in ("size", "place")
    ]
    return key.reshape(-1).view("<u8"), np.concatenate(ident), *small


def _sketches(bucket: pa.Table) -> tuple[np.ndarray, ...]:
    """Both halves of the sketches of a bucket's posts."""
    return tuple(np.frombuffer(b"".join(bucket.column(c).to_pylist()), np.uint64) for c in ("low", "high"))
