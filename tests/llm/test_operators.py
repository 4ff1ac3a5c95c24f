"""Each operator on small tables against brute force, and on odd rows: nulls, empty and long
texts, ties, repeated rows, no rows, and columns with the operators' own names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tokenizers")

from pyspark.sql import functions as F

from tracequarry.llm import itq, langid, media, minhash, mixing, packing, secret_scan, shingles, token_output, tokens, url_filter
from tracequarry.llm.common import components
from tracequarry.llm.line_dedup import dedup_lines, similar_lines
from tracequarry.llm.links import group_links
from tracequarry.llm.queries import tokenizer_path
from tracequarry.llm.tokens import PieceEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, length string, size string"
WORDS = [f"w{i}" for i in range(60)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark):
    """Copies, near copies, a null, blanks, one word, a long text, repeated rows and clashing columns."""
    rng = random.Random(5)
    base = [text(rng, rng.randint(30, 60)) for _ in range(12)]
    texts = [*base, base[0], base[0].upper(), base[1] + " more", " ".join(base[2].split()[:-1]), None, "", "  \n ", "one", "one", "ONE", "a b c d", text(rng, 4000), base[3] + "\n" + base[4], "Tab\tand odd  blanks \n\n x"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s1"][i % 4], len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base[5], "en", "s1", 3, "x", "y", "z"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_path_star_and_cycle(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, **{i: 200 for i in range(200, 203)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [16, 2048])
def test_group_links_span_the_matches(spark, block):
    rng = np.random.default_rng(1)
    value = {b"%d-%d" % (g, i): (g, int(rng.integers(0, top))) for g, (n, top) in enumerate([(3, 10), (40, 100), (150, 30), (1, 5), (90, 4000)]) for i in range(n)}
    rows = [(bytearray(b"g%d" % g), bytearray(k), bytearray(np.int64(x).tobytes())) for k, (g, x) in value.items()]
    df = spark.createDataFrame(rows, "key binary, id binary, payload binary")
    links = group_links(df, lambda p: np.frombuffer(b"".join(p), np.int64), lambda items, i, o: abs(items[o] - items[i]) <= 1, "t", block=block)
    got, want = Union(), Union()
    for r in links.collect():
        a, b = value[bytes(r["a"])], value[bytes(r["b"])]
        assert a[0] == b[0] and abs(a[1] - b[1]) <= 1
        got.join(bytes(r["a"]), bytes(r["b"]))
    keys = list(value)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if value[a][0] == value[b][0] and abs(value[a][1] - value[b][1]) <= 1:
                want.join(a, b)
    assert all((got.find(a) == got.find(b)) == (want.find(a) == want.find(b)) for a in keys for b in keys)


def test_shingles_are_sets_of_five_words():
    import pyarrow as pa

    rng = random.Random(2)
    texts = [text(rng, n) for n in (0, 1, 4, 5, 6, 300)] + [None, " A  b\tC\x0bd\re ", "é ü x a b c"]
    for t, got in zip(texts, shingles.shingle_sets(pa.array(texts)), strict=True):
        assert len(got) == len(shingle_set(t)) and (np.diff(got.astype(object)) > 0).all()
    a, b = shingles.shingle_sets(pa.array(["a b c d e f", "x\nA B C D E"]))
    assert len(np.intersect1d(a, b)) == 1


def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    near = base[:20] + 0.08 * rng.standard_normal((20, 16))
    edge = base[20:40] + 0.5 * rng.standard_normal((20, 16))
    rows = [v.astype(np.float32).tolist() for v in [*base, *near, *edge, base[0], base[0], -base[1], 3 * base[2]]]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 8, [1.0] * 8]
    return spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)] + [(0, rows[0], "x"), (None, rows[5], "x")], "vec_id long, embedding array<float>, kept string")


def test_itq_links_by_cosine(spark):
    df = vectors(spark)
    rows = df.collect()
    unit = []
    for r in rows:
        v = r["embedding"]
        good = v and None not in v and all(map(math.isfinite, v)) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if good else None)
    cc, degree, key = Union(), Counter(), lambda i: (rows[i]["vec_id"] is None, rows[i]["vec_id"] or 0, i)
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9:
                cc.join(key(i), key(j))
                degree[i] += 1
                degree[j] += 1
    least = lambda i: None if cc.find(key(i))[0] else cc.find(key(i))[1]
    want = sorted((r["vec_id"] is None, r["vec_id"] or 0, degree[i], least(i)) for i, r in enumerate(rows))
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in itq.near_vectors(df, miss=1e-6).collect())
    assert [w for w in want if w[3] is not None] == [g for g in got if g[3] is not None] and len(want) == len(got)
    # Large buckets in blocks give the same.
    again = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in itq.near_vectors(df, miss=1e-6, bucket=64, block=8).collect())
    assert [g for g in again if g[3] is not None] == [g for g in got if g[3] is not None]
    assert itq.near_vectors(df.limit(0)).count() == 0


def test_minhash_groups_by_full_sets(spark):
    rows = documents(spark).collect()
    sets = [shingle_set(r["text"]) for r in rows]
    cc = Union()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                cc.join((rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, i), (rows[j]["doc_id"] is None, rows[j]["doc_id"] or 0, j))
    want = []
    for i, r in enumerate(rows):
        root = cc.find((r["doc_id"] is None, r["doc_id"] or 0, i))
        want.append((r["doc_id"], len(sets[i]), None if root[0] else root[1]))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(documents(spark)).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert minhash.near_duplicates(no_documents(spark)).count() == 0


def test_lines_link_and_later_ones_go(spark):
    got = similar_lines(documents(spark)).collect()
    lines = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, n, line) for r in documents(spark).collect() if r["text"] is not None for n, line in enumerate(r["text"].split("\n"))})
    sets = [frozenset(shingle_set(x[3].lower())) for x in lines]
    removed, links = set(), Counter()
    for i in range(len(lines)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                removed.add(lines[i][:3])
                links[lines[i][:3]] += 1
                links[lines[j][:3]] += 1
    seen = {(r["doc_id"] is not None, r["doc_id"] or 0, r["line_no"]): r for r in got}
    assert {k for k, r in seen.items() if r["removed"]} == removed
    once = [k for k in seen if k[1] not in (0,)]
    assert all(seen[k]["removed"] == (k in removed) for k in once)
    out = dedup_lines(documents(spark))
    assert out.columns == documents(spark).columns
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert 12 not in kept and kept[11] is not None and 16 in kept and kept[16] is None and kept[17] == ""
    assert similar_lines(no_documents(spark)).count() == 0 and dedup_lines(no_documents(spark)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_whole_texts(name, monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    parts = ["a", "B", " ", "\n", "'s", "é", " ", "1", "!", "\r", "<|endoftext|>", " ", " x", "́", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)] + [None, "", "plain words, and more.", "don't it's 12 ab's"]
    latin = ["Äpfel", "naïve", "ÿes.", "Straße,", "ÇA..", "ok", "ÀÉ,x", "ª", "µm", "x" * 500, "中文", "Ωs"]
    texts += ["".join(rng.choice([" ", "\n"]) + rng.choice(latin) for _ in range(rng.randint(1, 40)))[1:] for _ in range(300)]
    monkeypatch.setattr(tokens, "SLICE", 3000)
    encoder = PieceEncoder(tokenizer_path(name), max_pieces=200)
    assert encoder.plain
    ids, ends = encoder.encode(pa.array(texts))
    whole = encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    start = 0
    for e, end in zip(whole, ends.tolist(), strict=True):
        assert ids[start:end].tolist() == e.ids
        start = end


def encoded(rows, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows]


def test_packing_places_every_piece_once(spark):
    rows = documents(spark).collect()
    capacity = 64
    got = packing.pack_documents(documents(spark), tokenizer_path("byte_bpe_50k.json"), capacity=capacity, with_ids=True, per_task=3).collect()
    want = Counter()
    for r, ids in zip(rows, encoded(rows, "byte_bpe_50k.json"), strict=True):
        n = -(-len(ids) // capacity)
        start, stop = 0, len(ids) - (n - 1) * capacity
        for p in range(n):
            want[(r["doc_id"], p, start, stop - start, zlib.crc32(ids[start:stop].tobytes()))] += 1
            start, stop = stop, stop + capacity
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    frame = spark.createDataFrame(got)
    for r in packing.sequences(frame).collect():
        assert r["n_tokens"] == len(r["ids"]) == sum(x for _, x in by[r["sequence_id"]])
    assert packing.pack_documents(no_documents(spark), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(30):
        capacity = rng.choice([10, 17, 64])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms[rooms.index(min(fits))] -= s
            else:
                rooms.append(capacity - s)
        bins = defaultdict(int)
        for length, first, last, start, per, _ in packing.plan(dict(Counter(sizes)), capacity):
            for k in range(last - first):
                bins[start + k // per] += length
        assert sorted(capacity - b for b in bins.values()) == sorted(rooms)


def test_token_files_read_back(spark, tmp_path):
    rows = documents(spark).collect()
    coded = sorted(zip(rows, encoded(rows, "word_bpe_49k.json"), strict=True), key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1].astype("<u2").tobytes()))
    manifest = token_output.write_tokens(documents(spark), tokenizer_path("word_bpe_49k.json"), uri=f"file://{tmp_path}", shard_tokens=300, docs_per_range=7)
    want, start = [], 0
    for r, ids in coded:
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_output.read_tokens(manifest).collect()), key=lambda x: x[1])
    manifest = manifest.orderBy("base").collect()
    assert len(manifest) > 3 and got == want
    data = open(manifest[0]["path"].removeprefix("file://"), "rb").read()
    whole = token_output.decode_shard(data)[2]
    assert (token_output.token_range(data, 3, 40) == whole[3:40]).all()
    assert token_output.read_tokens(token_output.write_tokens(no_documents(spark), tokenizer_path("word_bpe_49k.json"))).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for values in (np.zeros(0, np.uint32), rng.integers(0, 3, 1), rng.integers(5, 6, 5000), rng.integers(0, 1 << 32, 3000), np.where(rng.random(4000) < 0.02, 60_000, rng.integers(0, 30, 4000))):
        values = values.astype(np.uint32)
        blocks = token_output.encode_blocks(values)
        starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.uint64)
        assert (token_output.decode_blocks(b"".join(blocks), starts) == values).all()


def test_languages_are_told_apart(spark):
    rng = random.Random(6)
    stems = {"aa": ["kat", "ort", "tak", "rok"], "bb": ["lui", "eau", "oie", "uel"], "cc": ["ßer", "ung", "sch", "eit"]}
    rows = [(i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang) for i in range(400) for lang in [rng.choice(list(stems))]]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 + 34 !!", "bb"), (1003, "KAT ORT TAK kat", None), (None, "lui eau oie", None), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.identify_documents(df).withColumn("out", langid.held_out()).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["out"] == (i in set(held)) for i in range(400))
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.97
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"] and got[None]["lang_pred"] == "bb"
    assert got[1002]["rejected"] and not got[1003]["rejected"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify_documents(df.limit(0)).count() == 0
    unlabelled = langid.identify_documents(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_mix_meets_its_targets(spark):
    rng = random.Random(7)
    rows = [(i, text(rng, rng.randint(0, 80)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(600)] + [(700, None, "a"), (701, "", "d"), (702, "x", "e"), (None, "y z", "a"), (3, "p q r", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix_sizes(df).collect()
    assert len(got) == len(rows) and got == mixing.mix_sizes(df.repartition(5)).collect() or sorted(map(str, got)) == sorted(map(str, mixing.mix_sizes(df.repartition(5)).collect()))
    own = Counter()
    for _, t, s in rows:
        own[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = [*sorted(s for s in own if s is not None), *([None] if None in own else [])]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(own.values()) - sum(3 * own[s] for s in capped)
        level = left / (sum(weight[s] for s in names if s not in capped) or 1)
        more = {s for s in names if s not in capped and level * weight[s] > 3 * own[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * own[s] if s in capped else level * weight[s] for s in names}
    taken = Counter()
    for r in got:
        assert r["source_size"] == own[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 1 for s in names)
    assert mixing.mix_sizes(df.limit(0)).count() == 0


def test_secrets_match_plain_regular_expressions(spark):
    rng = random.Random(8)
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    token = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(48))
    texts = [f"é PassWord = '{token}' end", "secret: api_key: abcdefghijklmnopqrst", f"x AKIA{'Q7' * 8} {hexes}", "token=short passwd:\"longer-than.twelve\"", None, "", f"blob {token} and aaaaaaaaaaaaaaaaaaaaaaaaaaa1 tail", "AKIAAKIAAKIA", "😀 token = abcdefabcdefabcdef", "secret=" * 30 + "x" * 20, "deadbeef" * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, base string")
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = secret_scan.scan_secrets(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r["doc_id"]] or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [(s["start"], s["rank"], s["stop"]) for s in r["base"]] == sorted(want)
        assert all(t[s["start"] : s["stop"]] == s["body"] for s in r["added"])
    assert any(s["body"] == token for r in got for s in r["added"] if r["doc_id"] == 6)
    assert not any(s["body"].startswith("aaaa") for r in got for s in r["added"])
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0


def test_reported_strings_are_random_ones(spark):
    rng = random.Random(21)
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    plain = ["river", "window", "market", "yellow", "number", "system", "report", "garden", "simple", "letter", "branch", "status", "Error", "Config", "handle", "update", "remote"]
    planted, rows = {}, []
    for i in range(600):
        ordinary = rng.choice("-_/").join([*(rng.choice(plain) for _ in range(rng.randint(5, 12))), str(rng.randint(1, 99999))])
        words = [rng.choice(plain) for _ in range(rng.randint(30, 200))] + [ordinary]
        if i % 5 == 0:
            planted[i] = "".join(rng.choice(symbols) for _ in range(rng.choice([44, 64, 88]))) + "9z"
            words.append(planted[i])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    found = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    reported = [(r["doc_id"], s["body"]) for r in found for s in r["added"]]
    right = [x for x in reported if planted.get(x[0]) == x[1]]
    assert len(right) >= 0.95 * len(planted) and len(right) >= 0.9 * len(reported)


def test_running_sums_pass_blocks(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        steps = list(range(n))
        got = spark.createDataFrame([(steps,)], "s array<bigint>").select(secret_scan._running(F.col("s")).alias("r")).first()["r"]
        assert got == np.cumsum(steps).tolist()


def test_random_scores_follow_the_tests(spark):
    rng = random.Random(9)
    tokens = ["".join(rng.choice("0123456789abcdef") for _ in range(64)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in tokens] + [("0123456789abcdef" * 4,), ("ab" * 32,)], "t string")
    p = [r["p"] for r in df.select(secret_scan.random_score(F.col("t")).alias("p")).collect()]
    assert np.mean([x < 0.05 for x in p[:200]]) < 0.15 and p[200] < 1e-6 and p[201] < 1e-6


def test_block_reaches_aliases_and_allow_stands(spark):
    link = '<html><link rel="canonical" href="{}"></html>'
    rows = [
        (0, "http://a.example.com/en/1", "x"), (1, "https://b.org/p", link.format("http://a.example.com/en/1")),
        (2, "https://c.org/q", '<meta http-equiv="refresh" content="0; url=https://b.org/p#top">'), (3, "http://www.example.com/en/2", link.format("https://b.org/p")),
        (4, "http://d.org/z", "<p>none</p>"), (5, None, link.format("https://b.org/p")), (6, "no scheme", None), (7, "http://X.NET/es/1?q", link.format("/fr/9")), (8, "https://e.org/r/s", "<link href='t' rel='canonical'>"), (0, "http://a.example.com/en/1", "x"), (9, "http://ynet/es/", ""), (10, "HTTP://a.b.Net", None),
    ]
    rules = [url_filter.Rule("allow", "com"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, verdict int")
    moved = spark.createDataFrame([("https://e.org/r/t", "http://d.org/z"), (None, "x")], "from_url string, to_url string")
    got = {r["page_id"]: r for r in url_filter.judge_pages(df, rules, moved).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow", 10: "allow"}
    assert (got[7]["host"], got[7]["path"], got[7]["rule"]) == ("x.net", "/es/1", "net/es/") and got[5]["host"] == "" and (got[10]["host"], got[10]["path"]) == ("a.b.net", "")
    assert got[4]["component"] == got[8]["component"] and got[6]["component"] is None
    assert url_filter.judge_pages(df.limit(0), rules).count() == 0


def test_media_round_trip_and_features(spark):
    got = media.media_features(documents(spark)).collect()
    want = {r["doc_id"]: r["text"] or "" for r in documents(spark).collect() if r["doc_id"] is not None}
    assert len(got) == documents(spark).count()
    features = {}
    for r in got:
        if r["doc_id"] is None:
            continue
        raw = want[r["doc_id"]].encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert features.setdefault(want[r["doc_id"]], (r["feature"], r["media_sha256"])) == (r["feature"], r["media_sha256"]) and r["feature"].startswith("audio/wav;")
    assert media.media_features(no_documents(spark)).count() == 0


def png(n=3):
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", bytes(n)) + chunk(b"IEND", b"")


def test_sniffing_more_formats():
    import gzip
    import io
    import zipfile

    def archive(name, content):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, content)
        return out.getvalue()

    inner = archive("a.txt", "hello")
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    page = lambda flags, body: b"OggS\0" + bytes([flags]) + bytes(8) + b"abcd" + bytes(8) + bytes([1, len(body)]) + body
    riff = lambda form, chunks: b"RIFF" + (4 + len(chunks)).to_bytes(4, "little") + form + chunks
    chunk = lambda name, body: name + len(body).to_bytes(4, "little") + body
    flac = b"fLaC\x00\x00\x00\x22" + bytes(34) + b"\x81\x00\x00\x02xx" + b"\xff\xf8" + b"f" * 20
    items = {
        "application/zip": archive("b.zip", inner), "video/mp4": box(b"ftyp", b"isom0000") + box(b"moov", b"m" * 9) + box(b"mdat", b"d" * 30),
        "application/ogg": page(2, b"head") + page(0, b"more") + page(4, b"end"), "image/webp": riff(b"WEBP", chunk(b"VP8 ", b"1234")),
        "video/x-msvideo": riff(b"AVI ", chunk(b"LIST", b"hdrl")), "application/gzip": gzip.compress(bytes(5_000_000)), "audio/wav": media.to_wav(b"12345"),
    }
    for kind, b in items.items():
        assert media.corrected_type("text/plain", media.sniff(b), len(b)) == kind
        within = b"junk" + b + b"tail"
        assert (kind, 4, b) in media.carve(within, media.sniff(within))
        short = b[:-3]
        assert kind == "video/mp4" or not any(f.start == 0 and f.kind == kind for f in media.sniff(short))
    both = b"x" + flac + png()
    assert [(k, s) for k, s, _ in media.carve(both, media.sniff(both))] == [("audio/flac", 1), ("image/png", 1 + len(flac))]
    assert media.sniff(b"ftyp" + b"OggS" + b"fLaC\x00\x00\x00\x22") == []
    # Starts without ends are not searched to the end each.
    assert media.sniff(b"%PDF-1." * 200_000) == [] and media.sniff(b"PK\x03\x04" * 200_000) == []


def test_sniffing_confirms_corrects_and_carves(spark):
    import gzip
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "hello")
    items = {"image/png": png(), "audio/wav": media.to_wav(b"12345"), "application/gzip": gzip.compress(b"x" * 50), "application/zip": buffer.getvalue(), "application/pdf": b"%PDF-1.4 ... startxref\n9\n%%EOF"}
    rows = [(i, "text/plain", bytearray(b)) for i, b in enumerate(items.values())]
    rows += [(10, "image/gif", bytearray(b"junk" + png() + b"GIF89a fake" + items["audio/wav"])), (11, "image/png", bytearray(png()[:-3])), (12, None, None), (13, "text/plain", bytearray(b"BM and PK and RIFF"))]
    got = {r["id"]: r for r in media.inspect(spark.createDataFrame([(*r, "x") for r in rows], "id int, declared string, media binary, carved string")).collect()}
    assert [got[i]["detected"] for i in range(5)] == list(items) and all(got[i]["corrected"] for i in range(5))
    assert [(c["kind"], c["start"]) for c in got[10]["carved"]] == [("image/png", 4), ("audio/wav", 4 + len(png()) + 11)] and bytes(got[10]["carved"][0]["bytes"]) == png()
    assert got[11]["detected"] == "application/octet-stream" and got[12]["carved"] == [] and got[13]["detected"] == "text/plain" and got[13]["carved"] == []
