"""Near-duplicate texts by an inverted join over MinHash coordinates.

Every distinct shingle set is posted under each pair of coordinate and value of its signature.
Two sets of similarity s agree in about s of the coordinates, so sets that agree in fewer than
``matches`` of them are left out: a set with fewer coordinates that it shares with any other
has no partner at all (skip), and the rarest ``coordinates - matches + 1`` of the rest must
hold one that a partner shares (prefix). Within such a posting list the collisions of whole
signatures are counted. What hangs together by pairs at the threshold is then confirmed on the
full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import bounded_batches, components, materialize, released, text_slices
from tracequarry.llm.links import group_links
from tracequarry.llm.shingles import shingle_sets

#: A prime; texts whose id modulo it no candidate has are skipped when sets are made again.
BUCKETS = 1_048_573


def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(0, 1 << 64, coordinates, np.uint64, False), rng.integers(0, 1 << 64, coordinates, np.uint64, False) | np.uint64(1)


def signature(own: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least permuted hash at each coordinate, as uint32."""
    low = np.full(len(flips), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 4096):
        part = (own[None, k : k + 4096] ^ flips[:, None]) * factors[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _digest(own: np.ndarray) -> bytes:
    return blake2b(own.tobytes(), digest_size=16).digest()


def _sign_task(width: int, coordinates: int, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips, factors = _permutations(coordinates)
        for whole in batches:
            for batch in text_slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), width)
                signatures = [signature(s, flips, factors).view(np.int32) if len(s) else None for s in sets]
                sizes = np.array([0 if s is None else coordinates for s in signatures])
                held = [s for s in signatures if s is not None]
                flat = pa.array(np.concatenate(held) if held else np.zeros(0, np.int32))
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                columns = [
                    batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(ends, flat),
                ]
                names = ["doc_id", "n_shingles", "digest", "signature"]
                yield pa.RecordBatch.from_arrays([*columns, *([batch.column("carried")] if carry else [])], [*names, *(["carried"] if carry else [])])

    return run


def _set_task(width: int, buckets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(BUCKETS + 1, bool)
        wanted[buckets] = True
        for batch in batches:
            ids = batch.column("doc_id")
            at = np.where(ids.is_null().to_numpy(zero_copy_only=False), BUCKETS, np.mod(ids.fill_null(0).to_numpy(zero_copy_only=False), BUCKETS))
            hit = pa.array(wanted[at])
            for some in text_slices(batch.filter(hit), "text"):
                sets = shingle_sets(some.column("text"), width)
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "payload"])

    return run


def _load_signatures(payloads: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(payloads), np.uint32).reshape(len(payloads), -1)


def _agree(matches: int):
    def match(items: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
        return (items[others] == items[i]).sum(axis=1) >= matches

    return match


def _load_sets(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) // 8 for p in payloads])
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(payloads), np.uint64), ends - sizes, sizes


def _similar(per_cent: int):
    def match(items, i: int, others: np.ndarray) -> np.ndarray:
        flat, starts, sizes = items
        own, n = flat[starts[i] : starts[i] + sizes[i]], int(sizes[i])
        hit = np.zeros(len(others), bool)
        fit = np.flatnonzero(100 * np.minimum(sizes[others], n) >= per_cent * np.maximum(sizes[others], n))
        for k in range(0, len(fit), 512):
            some = others[fit[k : k + 512]]
            rows = np.concatenate([flat[starts[j] : starts[j] + sizes[j]] for j in some.tolist()])
            at = np.minimum(np.searchsorted(own, rows), n - 1)
            common = np.add.reduceat((own[at] == rows).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            hit[fit[k : k + 512]] = 100 * common >= per_cent * (n + sizes[some] - common)
        return hit

    return match


def near_duplicates(docs: DataFrame, per_cent: int = 75, width: int = 5, coordinates: int = 64, matches: int = 32, carry: str | None = None) -> DataFrame:
    """Group near-duplicate texts.

    Returns a row per row of ``docs``: ``doc_id``, ``n_shingles`` (size of the set of distinct
    shingles of ``width`` words), ``component_id`` (the least ``doc_id`` it reaches by links,
    itself included) and ``kept`` (whether it is that one). Texts link when 100 times the
    common shingles are at least ``per_cent`` times all shingles of both. Texts of fewer words
    have one shingle; null texts and texts without words have none and link with nothing. Rows
    of equal sets share a class and are compared once. Rows without a ``doc_id`` belong to the
    group of their text and are kept only where the whole group has none. Other columns aren't
    read; an empty table gives no rows. A column of longs named by ``carry`` is returned with its
    row, and with it ``group``, which is equal for the rows of one group and null without shingles.

    Of pairs at similarity 0.75, ``matches`` of 32 among 64 coordinates misses 3 in a million.
    """
    bounded_batches(docs.sparkSession)
    more = [F.col(carry).alias("carried")] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    kinds = "doc_id long, n_shingles long, digest binary, signature array<int>" + ", carried long" * len(more)
    signed = docs.mapInArrow(released(_sign_task(width, coordinates, bool(carry))), kinds)
    signed = materialize(signed, "signatures")
    classes = materialize(signed.where("digest is not null").groupBy("digest", "signature").agg(F.min("doc_id").alias("rep")), "classes")
    posts = classes.select("digest", F.posexplode("signature").alias("pos", "value"))
    posts = posts.select("digest", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)).alias("key"))
    shared = posts.groupBy("key").count().where("count > 1")
    lists = posts.join(shared, "key").groupBy("digest").agg(F.collect_list(F.struct("count", "key")).alias("own"))
    lists = lists.where(F.size("own") >= matches)
    lists = lists.select("digest", F.slice(F.sort_array("own"), 1, coordinates - matches + 1).alias("own"))
    raw = F.expr("unhex(array_join(transform(signature, x -> lpad(hex(x & 4294967295L), 8, '0')), ''))")
    lists = lists.join(classes.select("digest", raw.alias("payload")), "digest")
    lists = lists.select("digest", "payload", F.explode("own.key").alias("key"))
    lists = lists.select(F.expr("unhex(lpad(hex(key), 16, '0'))").alias("key"), F.col("digest").alias("id"), "payload")
    lists = materialize(lists, "lists")
    candidates = group_links(lists, _load_signatures, _agree(matches), "candidates")
    groups = materialize(components(candidates, "candidate-groups"), "groups")
    reps = groups.join(classes.select(F.col("digest").alias("node"), "rep"), "node")
    buckets = reps.select(F.when(F.col("rep").isNull(), BUCKETS).otherwise(F.pmod("rep", F.lit(BUCKETS))).cast("int").alias("b")).distinct()
    wanted = buckets.toPandas()["b"].to_numpy()  # at most BUCKETS + 1 numbers
    sets = docs.select("doc_id", "text").mapInArrow(released(_set_task(width, wanted)), "id binary, payload binary")
    sets = sets.join(groups.select(F.col("node").alias("id"), F.col("component").alias("key")), "id").select("key", "id", "payload")
    # Equal sets come from several rows where their ids share a bucket.
    sets = materialize(sets.groupBy("key", "id", "payload").agg(F.lit(1)).select("key", "id", "payload"), "sets")
    linked = components(group_links(sets, _load_sets, _similar(per_cent), "confirmed"), "components")
    joined = materialize(classes.join(linked.select(F.col("node").alias("digest"), "component"), "digest", "left").select("digest", "rep", F.coalesce("component", "digest").alias("component")), "joined")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = joined.join(least, "component").select("digest", "component_id", F.col("component").alias("group"))
    out = signed.drop("signature").join(ids, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    extra = [F.col("carried").alias(carry), "group"] if carry else []
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *extra)
