"""Links as pages write them, against the standard library's resolving."""

from __future__ import annotations

from urllib.parse import urljoin

import numpy as np
from pyspark.sql import functions as F

from tracequarry.llm import url_filter
from tracequarry.llm.links import group_links

TARGETS = ["t", "./t", "../t", "../../t", "../../../../t", ".", "..", "../", "/a/../b", "/a/./b/..", "?page=2", "t?x=1", "../t?x=../y", "/", "//other.org/x", "https://other.org/a/../b", "a/b/../c", "x.y/..z", "g;x=1/../y"]
BASES = ["http://h.org/a/b/c", "http://h.org/a/b/", "http://h.org/", "http://h.org/a?q=/x/", "http://H.org/a/b#f"]


def test_resolving_agrees_with_the_standard_library(spark):
    rows = [(b, t) for b in BASES for t in TARGETS]
    got = {(r["b"], r["t"]): r["u"] for r in spark.createDataFrame(rows, "b string, t string").select("b", "t", url_filter._resolve(F.col("b"), F.col("t")).alias("u")).collect()}
    for (b, t), u in got.items():
        if "://" not in t:  # absolute links are kept as they are
            assert u == urljoin(b.replace("H.org", "h.org"), t), (b, t, u)
    assert got["http://h.org/", "https://other.org/a/../b"] == "https://other.org/a/../b"
    none = spark.createDataFrame([("http://h.org/", x) for x in ("#f", "mailto:x@y", "", None)] + [("nohost", "t")], "b string, t string")
    assert [r["u"] for r in none.select(url_filter._resolve(F.col("b"), F.col("t")).alias("u")).collect()] == [None] * 5


def test_blocks_reach_pages_by_relative_links(spark):
    link = '<html><head>{}<link rel="canonical" href="{}"></head></html>'
    bad = "http://a.example.com/en/1"
    rows = [
        (0, "http://q.org/list?page=2", link.format("", bad)), (1, "http://q.org/list", link.format("", "?page=2")),
        (2, "http://q.org/t", link.format("", bad)), (3, "http://q.org/x/y/z", link.format("", "../../t")),
        (4, "http://q.org/a?x=1&y=2", link.format("", bad)), (5, "http://q.org/b", link.format("", "a?x=1&amp;y=2")),
        (6, "http://r.org/deep/p", link.format('<base href="http://q.org/x/">', "../t")), (7, "http://r.org/deep/q", link.format('<base href="/x/">', "#top")),
        (8, "http://r.org/deep/r", link.format("", "../t")), (9, "http://r.org/deep/s", link.format("<base target=_blank>", "http://q.org/t")),
    ]
    rules = [url_filter.Rule("block", "example.com", "/en/")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert [i for i, v in got.items() if v == "block"] and {i for i, v in got.items() if v == "block"} == {0, 1, 2, 3, 4, 5, 6, 9}


def test_cells_of_chained_groups_stay_small(spark):
    """Chains that a pivot doesn't help with, in two groups: whole, and never many items at once."""
    n, block = 1500, 64
    rows = [(b"g", i.to_bytes(8, "little")) for i in range(n)] + [(b"h", (2 * i).to_bytes(8, "little")) for i in range(300)]
    df = spark.createDataFrame([(k, v, v) for k, v in rows], "key binary, id binary, payload binary")

    def load(payloads):
        assert len(payloads) < 4 * block, len(payloads)
        return np.frombuffer(b"".join(payloads), np.int64)

    links = group_links(df, load, lambda items, i, o: abs(items[o] - items[i]) <= 1, "chains", block=block).collect()
    whole = list(range(n))

    def root(x):
        while whole[x] != x:
            x = whole[x]
        return x

    for r in links:
        a, b = (int.from_bytes(x, "little") for x in (r["a"], r["b"]))
        assert abs(a - b) == 1
        whole[max(root(a), root(b))] = min(root(a), root(b))
    assert {root(i) for i in range(n)} == {0}
