"""Periodic runs against brute force: arrays, whole documents, odd rows, and the query's digests."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")

from tracequarry.llm import periodic, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(w):
    """Every period by itself, compared word for word."""
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - start >= max(6, 4 * p):
                out.setdefault((start, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def planted(rng, n, k):
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 10:
            p, a = rng.randint(1, n // 4), rng.randrange(n)
            for i in range(a + p, min(n, a + rng.randint(3 * p, 6 * p))):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("tabled, at_once", [(4096, 1 << 20), (20, 50)])
def test_runs_of_arrays(monkeypatch, tabled, at_once):
    monkeypatch.setattr(periodic, "TABLED", tabled)
    monkeypatch.setattr(periodic, "AT_ONCE", at_once)
    monkeypatch.setattr(periodic, "_TABLE", [])
    rng = random.Random(tabled)
    for _ in range(600):
        w = planted(rng, rng.randint(0, 150), rng.choice([1, 2, 2, 3, 5, 50]))
        assert periodic.find_runs(np.array(w, np.int64)) == brute(w)


def test_a_million_equal_words_are_one_run():
    assert periodic.find_runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    w = np.tile(np.arange(250_000), 4)
    assert periodic.find_runs(w) == [(0, 1_000_000, 250_000)]


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(words) if i not in gone)


def test_documents_and_odd_rows(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{x}" for x in planted(rng, rng.randint(0, 200), 4)) for _ in range(40)]
    texts += [None, "", " \n\t ", "one", "la " * 5, "la " * 6, "a a a a a a a a a a a a", "x\ty\nx y\x0bx\x0cy x  y ", "é è " * 9 + "end", "a b " * 60_000]
    rows = [(i, t, "r", "c", i) for i, t in enumerate(texts)] + [(0, texts[0], "r", "c", 0)] * 2 + [(None, "z " * 8, "r", "c", 0), (None, None, None, None, None)]
    schema = "doc_id long, text string, runs string, collapsed string, words long"
    got = periodic.periodic_runs(spark.createDataFrame(rows, schema).repartition(3))
    assert got.columns == ["doc_id", "runs", "collapsed"]
    want = []
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        number = {x: k for k, x in enumerate(dict.fromkeys(words))}
        runs = brute([number[x] for x in words]) if len(words) < 1000 else [(0, 120_000, 2)]
        want.append((i, tuple(runs), collapsed(words, runs)))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((r["doc_id"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in got.collect()), key=key) == sorted(want, key=key)
    empty = periodic.periodic_runs(spark.createDataFrame([], schema))
    assert empty.columns == got.columns and empty.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_query_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("length(text) < 3000")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([None, "", "w", "a a a a a a", "a b " * 30] * 20)] + [(None, "a " * 9)], "doc_id long, text string")
    docs.union(odd).write.parquet(f"file://{tmp_path}/documents.parquet")
    want, changed = {}, 0
    for doc_id, text in docs.union(odd).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n > 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, changed = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], changed + 1
        number = {x: k for k, x in enumerate(dict.fromkeys(words))}
        runs = brute([number[x] for x in words])
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[doc_id] = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(collapsed(words, runs)))
    df = queries.queries()["op11_periodic_runs"](spark, f"file://{tmp_path}")
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {c: t for c, t in df.dtypes if t != "bigint"} == {"runs_sha256": "string", "collapsed_sha256": "string"}
    assert {r["doc_id"]: tuple(r)[1:] for r in df.collect()} == want
    assert changed > 10 and sum(1 for x in want.values() if x[0]) > 10
