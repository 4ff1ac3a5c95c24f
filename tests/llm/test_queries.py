"""The registered queries beside their SQL on the smallest tables, and the pipeline's stages
beside brute force."""

from __future__ import annotations

import os
import re
from collections import Counter

import pytest

pytest.importorskip("tokenizers")

import corpus_pipeline
from tracequarry.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "benchmark")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    got = Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())
    duck.execute(f"create or replace temp table o as {queries.oracle_sql()[name]}")
    columns = sorted(r[0] for r in duck.execute("describe o").fetchall())
    assert columns == sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = Counter(duck.execute(f"select {quoted} from o").fetchall())
    if name == "op6_mixing":  # targets are sums of doubles
        rounded = lambda c: Counter({tuple(round(x, 6) if isinstance(x, float) else x for x in k): n for k, n in c.items()})
        got, want = rounded(got), rounded(want)
    assert got == want


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def test_stages_match_brute_force(spark, tmp_path):
    import random

    rng = random.Random(3)
    words = ["kat", "ort", "tak", "rok", "lui", "eau", "oie", "uel", "nim", "pol"]
    line = lambda: " ".join("".join(rng.choice(words) for _ in range(2)) for _ in range(rng.randint(6, 14)))
    shared = [line() for _ in range(6)]
    texts = ["\n".join(rng.choice(shared) if rng.random() < 0.2 else line() for _ in range(rng.randint(1, 6))) for _ in range(50)]
    texts += [texts[0], texts[1] + "\n" + line(), "123 !!!", "", None, "\n".join(" ".join(line().split()) for _ in range(3))]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        now = spark.createDataFrame(out.collect(), out.schema)
        seen.append(now)
    language, lines, kept, mixed, packed = [s.collect() for s in seen]
    assert {r["doc_id"] for r in language} == {i for i, t in enumerate(texts) if re.search("[a-z]", t or "")}

    earlier, want = [], {}
    for i in sorted(r["doc_id"] for r in language):
        rest = []
        for x in texts[i].split("\n"):
            own = shingles(x)
            if not any(near(own, e) for e in earlier):
                rest.append(x)
            earlier.append(own)
        if any(shingles(x) for x in rest):
            want[i] = "\n".join(rest)
    assert {r["doc_id"]: r["text"] for r in lines} == want and all(r["n_chars"] == len(r["text"]) for r in lines)

    root = {i: i for i in want}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in want:
        for b in want:
            if a < b and near(shingles(want[a]), shingles(want[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in kept} == {i for i in want if find(i) == i}
    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) <= {r["doc_id"] for r in kept} and max(times.values()) <= 3
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == times
    assert corpus_pipeline.ORACLE_SQL is None
