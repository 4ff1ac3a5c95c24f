"""Secrets that are rare among ordinary strings, the step-up rule by brute force, and the digests."""

from __future__ import annotations

import hashlib
import os
import random
import re
import string

import pytest

pytest.importorskip("tokenizers")

from pyspark.sql import functions as F

from tracequarry.llm import queries, secret_scan

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PLAIN = ["river", "window", "market", "yellow", "number", "system", "report", "garden", "simple", "letter", "branch", "status", "Error", "Config", "handle", "update", "remote"]
BASE64 = string.ascii_letters + string.digits + "+/"


def corpus(n, every, seed, lengths=(44, 64, 88)):
    rng = random.Random(seed)
    planted, rows = {}, []
    for i in range(n):
        ordinary = rng.choice("-_/").join([*(rng.choice(PLAIN) for _ in range(rng.randint(5, 12))), str(rng.randint(1, 99999))])
        words = [rng.choice(PLAIN) for _ in range(rng.randint(30, 200))] + [ordinary]
        if i % every == 0:
            planted[i] = "".join(rng.choice(BASE64) for _ in range(rng.choice(lengths))) + "9z"
            words.append(planted[i])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    return rows, planted


# At one in 10,000 a string of 46 symbols can't be told from chance among so many; longer ones can.
@pytest.mark.parametrize("n, every, lengths", [(4000, 40, (44, 64, 88)), (10_000, 1000, (44, 64, 88)), (20_000, 10_000, (62, 88))])
def test_rare_secrets_are_found(spark, n, every, lengths):
    rows, planted = corpus(n, every, n, lengths)
    found = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    reported = [(r["doc_id"], s["body"]) for r in found for s in r["added"]]
    right = [x for x in reported if planted.get(x[0]) == x[1]]
    assert len(right) >= 0.9 * len(planted) and len(reported) - len(right) <= max(1, 0.1 * len(reported))


def test_ordinary_strings_alone_give_few_reports(spark):
    rows, _ = corpus(3000, 10**9, 5)
    found = secret_scan.scan_secrets(spark.createDataFrame(rows[1:], "doc_id long, text string").repartition(4)).collect()
    assert sum(len(r["added"]) for r in found) <= 2


def test_thresholds_are_the_step_up_rule():
    rng = random.Random(3)
    for _ in range(200):
        counts = {}
        for _ in range(rng.randint(1, 60)):
            key = rng.randint(1, 2), rng.choice([rng.randint(0, 30), rng.randint(0, 200)])
            counts[key] = counts.get(key, 0) + rng.randint(1, 5)
        got = secret_scan._thresholds([(b, x, n) for (b, x), n in counts.items()], 0.05)
        for band in (1, 2):
            p = sorted(10 ** (-x / secret_scan.PER_DECADE) for (b, x), n in counts.items() if b == band for _ in range(n))
            passed = [v for k, v in enumerate(p) if v <= 0.05 * (k + 1) / len(p)]
            reported = {x for (b, x) in counts if b == band and x >= got.get(band, 10**9)}
            assert reported == {x for (b, x) in counts if b == band and passed and 10 ** (-x / secret_scan.PER_DECADE) <= max(passed)}


def test_calibration_is_line_and_quantiles(spark):
    rng = random.Random(4)
    rows = [("base64", x, 0.5 + 0.8 * x + rng.gauss(0, 0.4)) for _ in range(5000) for x in (rng.choice([4.5, 6.3, 8.0, 11.3]),)] + [("hex", 5.0, 1.0)]
    model = secret_scan.calibrate(spark.createDataFrame(rows, "encoding string, root double, u double"))
    start, slope, spread = model["base64"]
    assert abs(start - 0.5) < 0.1 and abs(slope - 0.8) < 0.02 and abs(spread - 0.4) < 0.04 and "hex" not in model
    p = spark.createDataFrame([("x" * 40,), ("0" * 40,)], "t string").select(secret_scan.ordinary_p(F.col("t"), model).alias("p")).collect()
    assert all(r["p"] > 0.99 for r in p)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_digests_of_the_query(spark):
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = {}
    for doc_id, text in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        spans = [(m.start(), k, kind, m.end()) for k, (kind, pattern, group, least) in enumerate([("assign", assign, 1, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]) for m in pattern.finditer(text or "") if len(m[group]) >= least]
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        n = [sum(s[2] == kind for s in spans) for kind in ("assign", "access", "hex")]
        want[doc_id] = (*n, hashlib.sha256(listed.encode()).hexdigest(), set(filter(None, listed.split(","))))
    got = queries.queries()["op8_secret_scan"](spark, DATA).collect()
    assert {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got} == {k: v[:4] for k, v in want.items()}
    assert all(want[r["doc_id"]][4] <= set(filter(None, r["spans"].split(","))) for r in got) and any(v[4] for v in want.values())


def test_decoys_come_from_whole_texts(spark):
    rng = random.Random(6)
    pieces = ["".join(rng.choice(PLAIN) + " " for _ in range(400))[: secret_scan.CHUNK] for _ in range(9)]
    texts = ["".join(pieces), "short", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = secret_scan._decoys(df.where("doc_id > 0")).count()
    own = [secret_scan._decoys(spark.createDataFrame([(0, p)], "doc_id long, text string")).count() - none for p in pieces]
    assert secret_scan._decoys(df).count() - none == sum(own) > 1
