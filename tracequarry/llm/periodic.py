"""Periodic run detection: stretches of words that repeat with some period, found by probing a
harmonic grid.

A run of period ``p`` is a stretch of consecutive words in which words ``p`` apart are equal, that
holds at least ``max(6, 4 * p)`` words, that no neighbour extends, and that has no smaller period.
Whatever its place, it covers four neighbouring multiples of ``p``. So words are compared at ``jp``
and ``(j+1)p`` only: all periods together cost ``n * ln(n)`` comparisons for ``n`` words. Where three
neighbouring comparisons hold, the words between are compared, and what is left is extended both
ways, chunk by chunk. Periods rise, so a grid place inside a run that was found tells nothing new
and is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import WORD, bounded_batches, released, text_slices

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Texts of up to so many words share one table of grid places.
TABLED = 4096
#: Words between grid places that are compared before a place is extended.
BETWEEN = 8
#: Grid places of longer texts that are probed at once.
AT_ONCE = 1 << 20


def _grid(first: int, last: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Periods ``first`` to ``last`` and their grid places ``a`` with ``a + 3p < n``."""
    periods = np.arange(first, last + 1, dtype=np.int64)
    places = np.maximum(0, (n - 1 - 3 * periods) // periods + 1)
    p = np.repeat(periods, places)
    j = np.arange(len(p)) - np.repeat(np.cumsum(places) - places, places)
    return p, j * p


_TABLE: list[np.ndarray] = []


def _tabled(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid places of a text of ``n`` words, from the table sorted by the last word compared."""
    if not _TABLE:
        p, a = _grid(1, TABLED // 3, TABLED)
        order = np.lexsort((p, a + 3 * p))
        _TABLE.extend([p[order], a[order], (a + 3 * p)[order]])
    k = int(np.searchsorted(_TABLE[2], n))
    return _TABLE[0][:k], _TABLE[1][:k]


def _survivors(w: np.ndarray, p: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid places whose word equals those one, two and three periods on, and so do the words that
    follow it, as far as a run that covers all four has them."""
    for k in range(LEAST_PERIODS - 1):
        at = a + k * p
        equal = w[at] == w[at + p]
        p, a = p[equal], a[equal]
    for k in range(1, BETWEEN + 1):
        if not len(p):
            break
        at = np.where(k <= 2 * p, a + k, a)
        equal = w[at] == w[at + p]
        p, a = p[equal], a[equal]
    order = np.lexsort((a, p))
    return p[order], a[order]


def _reach(w: np.ndarray, at: int, p: int, step: int, chunk: int = 64) -> int:
    """How many places from ``at`` on in direction ``step`` have words equal to those ``p`` later."""
    most = len(w) - p - at if step > 0 else at + 1
    done = 0
    while done < most:
        size = min(chunk, most - done)
        low = at + done if step > 0 else at - done - size + 1
        differ = np.flatnonzero(w[low : low + size] != w[low + p : low + p + size])
        if len(differ):
            return done + (int(differ[0]) if step > 0 else size - 1 - int(differ[-1]))
        done += size
        chunk = min(chunk * 4, 1 << 16)
    return most


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of an array of word numbers as ``(start, length, period)``, by start and period."""
    n, found = len(w), {}
    if n < LEAST_WORDS:
        return []
    #: By place, the furthest end of a run that starts no later; kept only once there is one.
    inside: np.ndarray | None = None
    for p, a in _probed(w):
        last = (0, -1)
        if inside is not None:
            fresh = a + 3 * p >= inside[a]
            p, a = p[fresh], a[fresh]
        for q, at in zip(p.tolist(), a.tolist(), strict=True):
            if (q == last[0] and at + 3 * q < last[1]) or (inside is not None and at + 3 * q < inside[at]):
                continue
            start = at + 1 - _reach(w, at, q, -1)
            end = at + _reach(w, at, q, 1) + q
            last = (q, end)
            if end - start < max(LEAST_WORDS, LEAST_PERIODS * q) or (start, end) in found:
                continue
            found[start, end] = q
            if inside is None:
                inside = np.zeros(n, np.int64)
            np.maximum(inside[start:end], end, out=inside[start:end])
    return sorted((start, end - start, q) for (start, end), q in found.items())


def _probed(w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving grid places in rising periods; those of a long text a bounded number at a time."""
    n = len(w)
    if n <= TABLED:
        yield _survivors(w, *_tabled(n))
        return
    first, most = 1, n // LEAST_PERIODS
    while first <= most:
        last = min(most, first + max(0, AT_ONCE * first // n))
        yield _survivors(w, *_grid(first, last, n))
        first = last + 1


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: of every run its first period stays."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return [x for x, k in zip(words, keep.tolist(), strict=True) if k]


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for whole in batches:
        for batch in text_slices(whole, "text"):
            all_runs, texts = [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().split()  # at the bytes that WORD excludes
                number: dict[bytes, int] = {}
                w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
                runs = find_runs(w)
                all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(b" ".join(collapse(words, runs) if runs else words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(all_runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of repeated words in every whole text: ``doc_id``, ``runs`` (``start``, ``length`` and
    ``period`` in words, by start and then period) and ``collapsed``, the words without repeats,
    joined by single blanks.

    Null texts and texts without words have no runs and collapse to nothing. Rows are judged one by
    one, so repeated rows give repeated results and an id may be null; columns other than ``doc_id``
    and ``text`` aren't read; no rows give no rows. Nothing is shuffled, and a task holds one text
    of any length and what belongs to it.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(released(_task), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(runs: Column) -> Column:
    """The run with the most words; of equals the first, then that of the least period."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which about a tenth, chosen by ``h = crc32(doc_id)``, repeat some of their words
    up to the end: with ``n`` words, word ``i`` from ``a = (h // 10) % n`` on becomes word
    ``a + (i - a) % p`` for ``p = 1 + (n - a) // (3 + (h // 10) % 8)``. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    # Words are columns of their own, so that every use reads them.
    cut = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words").cast("long")
    a = F.when(n > 0, F.col("g") % n)
    cut = cut.select("doc_id", "text", "words", n.alias("n"), a.alias("a"), (1 + F.floor((n - a) / (3 + F.col("g") % 8))).alias("p"))
    unit = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    tail = F.flatten(F.array_repeat(unit, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    made = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(tail, F.lit(1), (F.col("n") - F.col("a")).cast("int")))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))
