"""Spanning links inside groups that may be of any size.

Within a group, items match or don't. What later steps need is which items hang together, so
a group of n items gives fewer than n links however many pairs match. Groups of more than
``block`` items are dealt out over several tasks: every item is first compared with one pivot;
then only those that don't match it are compared with all others, in cells that hold about a block
of the ones and a block of the others, however many of either there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import materialize, released

#: match(payloads, i, others) -> which of the items ``others`` (int array) item i matches
Match = Callable[[object, int, np.ndarray], np.ndarray]


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each run of equal ``key`` in a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(key).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            value = batch.column(key)[a].as_py()
            if held and value != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = value
    if held:
        yield pa.Table.from_batches(held)


def spanning(n: int, match: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the match graph of n items, by breadth-first search: an item that
    is reached once is never compared as a target again."""
    out, left = [], np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = match(i, left)
            if hit.any():
                found = left[hit]
                out.extend((i, j) for j in found.tolist())
                queue.extend(found.tolist())
                left = left[~hit]
    return out


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])


def _whole_groups(load, match: Match):
    def run(batches):
        out = []
        for group in runs_of(batches, "cell"):
            if group.num_rows > 1:
                ids = group.column("id").to_pylist()
                items = load(group.column("payload").to_pylist())
                out.extend((ids[i], ids[j]) for i, j in spanning(len(ids), lambda i, o, items=items: match(items, i, o)))
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _pivot_groups(load, match: Match):
    """Marked rows (``lead``) come first in a cell; every lead is compared with the whole cell."""

    def run(batches):
        for cell in runs_of(batches, "cell"):
            lead = np.array(cell.column("lead").to_pylist(), bool)
            ids = cell.column("id").to_pylist()
            items = load(cell.column("payload").to_pylist())
            n = int(lead.sum())
            others = np.arange(n, len(ids))
            a, b = [], []
            reached = np.zeros(len(ids), bool)
            root = np.arange(len(ids))  # what hangs together in the cell so far; such pairs need no further link
            for i in range(n):
                own = others[root[others] != root[i]]
                own = own[match(items, i, own)] if len(own) else own
                reached[own] = True
                if len(own):
                    _, first = np.unique(root[own], return_index=True)  # one link for each part that is reached
                    new = [j for j in own[np.sort(first)].tolist() if ids[j] != ids[i]]
                    a.extend([ids[i]] * len(new))
                    b.extend(ids[j] for j in new)
                    root[np.isin(root, root[own])] = root[i]
            if n == 1:  # the pivot: tell what it doesn't reach
                rest = [ids[j] for j in others[~reached[others]].tolist()]
                a.extend([None] * len(rest))
                b.extend(rest)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([cell.column("key")[0].as_py()] * len(a), pa.binary())], ["a", "b", "key"])

    return run


def group_links(rows: DataFrame, load, match: Match, name: str, block: int = 2048, partitions: int | None = None) -> DataFrame:
    """Links ``a``, ``b`` (ids) that span the matches within each group of ``rows``.

    ``rows`` has binary columns ``key``, ``id`` and ``payload``, an id once a group.
    ``load(payloads)`` prepares a group's payloads for ``match``.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1")
    sizes = materialize(sizes, f"{name}-sizes")
    small = rows.join(sizes.where(F.col("n") <= block).select("key"), "key").select(F.col("key").alias("cell"), "id", "payload")
    small = small.repartition(n, "cell").sortWithinPartitions("cell", "id")
    links = small.mapInArrow(released(_whole_groups(load, match)), "a binary, b binary")
    large = sizes.where(F.col("n") > block)
    if large.isEmpty():
        return links
    parts = F.ceil(F.col("n") / block).cast("int")
    large = rows.join(large, "key").withColumn("parts", parts)
    large = materialize(large.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), f"{name}-large")

    def dealt(leads: DataFrame, body: DataFrame) -> DataFrame:
        """Leads and body have ``slot``, which of a group's blocks of leads a cell is for."""
        columns = ["key", "part", "slot", "id", "payload", "lead"]
        leads = leads.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "slot", "id", "payload", F.lit(True).alias("lead"))
        place = F.concat(F.lit(":"), F.col("part").cast("string"), F.lit(":"), F.col("slot").cast("string")).cast("binary")
        both = leads.unionByName(body.withColumn("lead", F.lit(False)).select(columns))
        both = both.select(F.concat(F.col("key"), place).alias("cell"), "key", F.struct((~F.col("lead")).alias("x"), "id").alias("o"), "lead", "id", "payload")
        ordered = both.repartition(n, "cell").sortWithinPartitions("cell", "o").drop("o")
        return ordered.mapInArrow(released(_pivot_groups(load, match)), "a binary, b binary, key binary")

    one = large.withColumn("slot", F.lit(0))
    first = materialize(dealt(one.where("id = pivot"), one), f"{name}-pivots")
    rest = first.where("a is null").select("key", F.col("b").alias("id")).distinct()
    slots = materialize(rest.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("slots")), f"{name}-slots")
    if slots.isEmpty():
        return links.unionAll(first.where("a is not null").select("a", "b"))
    split = large.join(slots, "key")
    leads = split.join(rest, ["key", "id"]).withColumn("slot", F.pmod(F.xxhash64("id", F.lit(1)), F.col("slots")).cast("int"))
    body = split.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    more = materialize(dealt(leads, body), f"{name}-rest")
    return links.unionAll(first.where("a is not null").select("a", "b")).unionAll(more.where("a is not null").select("a", "b"))
