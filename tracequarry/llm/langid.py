"""Language identification by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector of its letters' bigrams and trigrams, hashed to a
fixed number of places. Each language's training vectors are clustered on the unit sphere; a
text gets the language of the centroid with the largest cosine. One that is farther from every
centroid than any training text by a margin is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.llm.common import bounded_batches, release_memory

PLACES = 8192

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def count_ngrams(texts: list[str]) -> np.ndarray:
    """Counts of hashed bigrams and trigrams, a row per text. N-grams lie within a word and the
    blank on either side of it; case and all that isn't a letter count as nothing."""
    letters = _letters()
    joined = "\n".join(texts).lower()
    if joined.count("\n") != sum(t.count("\n") for t in texts) + len(texts) - 1:
        raise AssertionError("lower-casing changed the lines")
    code = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = letters[code]
    code = np.where(letter, code, 32).astype(np.uint32)
    at = np.flatnonzero(letter)
    of = owner[at - 1]
    before, own, after = code[at - 1], code[at], code[at + 1]
    two = own * np.uint32(0x9E3779B1) ^ after * np.uint32(0x85EBCA77)
    three = two * np.uint32(0xC2B2AE3D) ^ before * np.uint32(0x27D4EB2F)
    two ^= two >> np.uint32(15)
    three ^= three >> np.uint32(13)
    slot = np.concatenate([of, of]) * PLACES + np.concatenate([(two * np.uint32(0x2C1B3C6D)) >> np.uint32(19), (three * np.uint32(0x297A2D39)) >> np.uint32(19)])
    return np.bincount(slot, minlength=len(texts) * PLACES).reshape(len(texts), PLACES)


@dataclass
class LanguageModel:
    """``centroids`` has a unit row for each entry of ``langs``; a text is rejected below
    ``least``."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: float

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts.astype(np.float32)) * self.idf
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(norm > 0, norm, 1)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        langs, scores, rejected = [], [], []
        start = 0
        while start < len(texts):  # few texts at once where they are long
            stop, held = start, 0
            while stop < len(texts) and stop - start < 128 and (stop == start or held < 500_000):
                held += len(texts[stop] or "")
                stop += 1
            counts = count_ngrams([t or "" for t in texts[start:stop]])
            some = counts.any(axis=1)
            if self.langs:
                likeness = self.vectors(counts) @ self.centroids.T
                best = likeness.argmax(axis=1)
                score = np.clip(likeness.max(axis=1), 0, 1).astype(float)
            else:
                best, score, some = np.zeros(len(counts), int), np.zeros(len(counts)), np.zeros(len(counts), bool)
            langs += [self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            scores.append(np.where(some, score, 0.0))
            rejected.append(~some | (score < self.least))
            start = stop
        empty = [np.zeros(0)]
        return pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": np.concatenate(scores or empty), "rejected": np.concatenate(rejected or empty).astype(bool)})


def _cluster(x: np.ndarray, clusters: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means; starts from rows far from one another."""
    picked = [0]
    while len(picked) < min(clusters, len(x)):
        picked.append(int((x @ x[picked].T).max(axis=1).argmin()))
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
    return c


def fit(docs: DataFrame, lang: str = "lang", sample: int = 2000, clusters: int = 4, least_each: int = 20, margin: float = 0.5) -> LanguageModel:
    """Learn from the rows of ``docs`` with a language and a text that has letters.

    The model is fitted on a bounded sample: of every language the same number of distinct texts,
    ``sample`` shared among them and at least ``least_each`` (as far as it has them), those with
    the least hashes, so runs agree. Every language is learned. Inverse document frequencies and
    centroids come from the sample. ``least`` is ``margin`` times the least similarity of a
    training text to its nearest centroid. Without usable rows the model knows no language and
    rejects everything.
    """
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text rlike '\\\\p{L}'")
    bounded_batches(docs.sparkSession)
    docs = docs.withColumn("hash", F.pmod(F.xxhash64("text"), F.lit(1 << 53)))
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"), F.min("hash").alias("first")).collect()  # a row per language
    if not counts:
        return LanguageModel(np.zeros(PLACES, np.float32), np.zeros((0, PLACES), np.float32), [], 0.0)
    each = max(least_each, sample // len(counts))
    # About four times as many rows as are needed pass by their hashes, and the first in any case.
    rows = [(r["lang"], max(r["first"], int(min(1.0, 4 * each / r["n"]) * (1 << 53)))) for r in counts]
    below = docs.sparkSession.createDataFrame(rows, "lang string, below long")
    chosen = docs.join(F.broadcast(below), "lang").where("hash <= below").groupBy("lang", "hash").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = chosen.withColumn("nth", nth).where(F.col("nth") <= each)

    @F.pandas_udf("binary")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series([np.minimum(count_ngrams([t]), 65535).astype("<u2").tobytes() for t in texts], dtype=object)
        finally:
            release_memory()

    rows = chosen.select("lang", count("text").alias("counts")).toPandas().sort_values(["lang", "counts"], kind="stable")
    names = rows["lang"].to_numpy()
    x = np.frombuffer(b"".join(rows.pop("counts")), "<u2").reshape(len(names), PLACES)
    some = x.any(axis=1)
    x, names = x[some], names[some]
    seen = np.count_nonzero(x, axis=0)
    model = LanguageModel((np.log((1 + len(x)) / (1 + seen)) + 1).astype(np.float32), np.zeros((0, PLACES), np.float32), [], 0.0)
    v = model.vectors(x)
    parts = []
    for name in sorted(set(names)):
        c = _cluster(v[names == name], clusters)
        parts.append(c)
        model.langs += [name] * len(c)
    if parts:
        model.centroids = np.concatenate(parts).astype(np.float32)
        model.least = margin * float((v @ model.centroids.T).max(axis=1).min())
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add ``lang_pred`` (a learned language, ``und`` for null texts and texts without letters),
    ``score`` (cosine to the nearest centroid, 0 to 1) and ``rejected``. Only ``text`` is read;
    columns of ``docs`` with these names are replaced; an empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: langs x clusters x PLACES

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in batches:
                yield shared.value.predict([t if isinstance(t, str) else None for t in texts])
        finally:
            release_memory()

    names = ["lang_pred", "score", "rejected"]
    out = docs.withColumn("_identified", predict(F.col("text").cast("string")))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return out.select(*rest, *(F.col(f"_identified.{c}").alias(c) for c in names))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is set aside from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Fit on the documents that aren't held out and predict all."""
    return identify(docs, fit(docs.where(~held_out() & F.col("doc_id").isNotNull())))
