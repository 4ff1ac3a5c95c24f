"""Importance resampling against a count of all n-grams in plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("tokenizers")

from tracequarry.llm import resampling


def grams(text, orders):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, orders, buckets, percent=10, least=20, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in docs for g in grams(t, orders)[1])
    t = Counter(bucket(g) for x in target for g in grams(x, orders)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for doc_id, text in docs:
        n, g = grams(text, orders)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in g)
        out.append([doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = k + 1
    return Counter(tuple(x[:5]) for x in out)


def tables(seed, n=150):
    rng = random.Random(seed)
    words = [f"Wort{i}" for i in range(30)] + ["Größe", "日本", "x9", "don't", "a-b"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    docs = [(i, text(rng.randint(0, 60))) for i in range(n)]
    docs += [docs[0], docs[0], docs[1], (7, text(30)), (7, docs[2][1]), (None, docs[3][1]), (None, docs[3][1]), (None, None), (500, None), (501, ""), (502, " -!\n"), (503, "ONE"), (504, text(20_000))]
    return docs, [text(rng.randint(0, 9)) for _ in range(40)] + [None, ""]


@pytest.mark.parametrize("orders, buckets, percent, least", [(1, 10_000, 10, 20), (1, 7, 100, 1), (2, 1000, 33, 5), (3, 10_000, 10, 20)])
def test_against_brute_force(spark, monkeypatch, orders, buckets, percent, least):
    monkeypatch.setattr(resampling, "COPIES", 2)
    docs, target = tables(orders + buckets)
    rows = [(i, t, "weight", 1, "rank") for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, weight string, score int, copy string").repartition(3)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resampling.resample(df, aim, orders, buckets, percent=percent, least_words=least)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert Counter(map(tuple, got.collect())) == brute(docs, target, orders, buckets, percent, least)


@pytest.mark.parametrize("orders", [1, 2])
def test_empty_tables(spark, orders):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs, target = tables(9, 25)
    some = spark.createDataFrame(docs, "doc_id long, text string")
    assert resampling.resample(none, some, orders).count() == 0
    assert Counter(map(tuple, resampling.resample(some, none, orders).collect())) == brute(docs, [], orders, 10_000)


def test_ties_go_to_smaller_ids_and_ranks_span_ranges(spark):
    docs = [(i % 40, "a b c d e f g h i j k l m n o p q r s t u") for i in range(400)]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([("a",)], "text string"), percent=50).collect()
    assert Counter(map(tuple, got)) == brute(docs, ["a"], 1, 10_000, 50)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 201))
