"""Cases in which the operators once did less than the whole job."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tokenizers")

import corpus_pipeline
from tracequarry.llm import itq, langid, line_dedup, mixing, shingles
from tracequarry.llm.line_dedup import dedup_lines, similar_lines
from tracequarry.llm.queries import url_rules
from tracequarry.llm.url_filter import judge_pages


def test_itq_finds_pairs_of_vectors_with_a_common_component(spark):
    rng, n, d, common, cosine = np.random.default_rng(11), 3000, 64, 0.8, 0.901
    first = rng.standard_normal((n, d - 1))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    turn = rng.standard_normal((n, d - 1))
    turn -= (turn * first).sum(axis=1, keepdims=True) * first
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    near = 1 - (1 - cosine) / (1 - common**2)
    second = near * first + np.sqrt(1 - near**2) * turn
    rest = np.concatenate([first, second]) * np.sqrt(1 - common**2)
    unit = np.concatenate([np.full((2 * n, 1), common), rest], axis=1)
    at = unit @ unit.T >= 0.9
    want = at.sum(axis=1) - 1
    assert want.sum() >= 2 * n
    df = spark.createDataFrame([(i, v) for i, v in enumerate(unit.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in itq.near_vectors(df).collect()}
    assert all(got[i] <= want[i] for i in range(2 * n))
    assert sum(got.values()) >= 0.995 * want.sum()


def test_lines_whose_32_bit_hashes_collide_stay_apart(spark):
    # Spark's hash(array(xxhash64(word)), 1) is the same for both words of a pair.
    texts = ["w48504", "w95020", "w47065\nw332571", "w47065"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): (r["n_links"], r["removed"], r["class_doc_id"]) for r in similar_lines(df).collect()}
    assert got == {(0, 0): (0, False, 0), (1, 0): (0, False, 1), (2, 0): (1, False, 2), (2, 1): (0, False, 2), (3, 0): (1, True, 2)}
    assert {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()} == dict(enumerate(texts[:3]))


@pytest.mark.parametrize("frequent, block", [(1 << 18, 512), (64, 3), (0, 2)])
def test_lines_in_large_groups_match_brute_force(spark, monkeypatch, frequent, block):
    rng = random.Random(frequent + block)
    word = lambda: rng.choice(["kat", "ort", "tak", "rok"]) + str(rng.randrange(30))
    core = [word() for _ in range(40)]
    texts = []
    for _ in range(80):  # near copies of one line, lines with its first half, and others, some twice
        near = list(core)
        near[rng.randrange(40)] = word()
        half = core[:20] + [word() for _ in range(rng.randint(3, 25))]
        texts.append("\n".join(" ".join(x) for x in rng.sample([near, half, [word() for _ in range(rng.randint(1, 30))], core[: rng.randint(1, 40)]], 3)))
    texts += texts[:9]
    ids = rng.sample(range(1000), len(texts))
    monkeypatch.setattr(line_dedup, "PACK", 500)
    monkeypatch.setattr(line_dedup.text_slices, "__defaults__", (2000,))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["line_no"]): r for r in similar_lines(df, frequent=frequent, block=block).collect()}
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        for k, x in enumerate(t.split("\n")):
            w = x.split()
            sets[i, k] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or frozenset([tuple(w)])
    assert set(got) == set(sets)
    for a in sets:
        near = [b for b in sets if b != a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
        same = min(b for b in sets if sets[b] == sets[a])
        r = got[a]
        assert (r["n_tokens"], r["n_links"], r["removed"]) == (len(sets[a]), len(near), any(b < a for b in near))
        assert (r["class_doc_id"], r["class_line_no"]) == same


def test_frequent_tokens_go_by_exact_counts(spark):
    texts = ["a b c d e f"] * 9 + ["x y"] * 5 + ["b c d e f q"] * 3 + ["m n", "o p"]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, text_hash long, low string").repartition(3)
    tokens, owner = shingles.shingle_tokens(*shingles.text_bytes(pa.array(["x y", "a b c d e", "b c d e f"])))
    want = [int(t) >> 24 for t in tokens.tolist()]
    assert owner.tolist() == [0, 1, 2] and line_dedup.frequent_tokens(line_dedup.line_table(df), 100).tolist() == want
    assert line_dedup.frequent_tokens(line_dedup.line_table(df), 2).tolist() == want[1:]


CORPUS = "doc_id long, text string, lang string, source string, n_chars long"


def words(first, n):
    return " ".join(f"v{first}x{i}" for i in range(n))


def test_mixing_takes_every_row_by_itself(spark):
    rows = [(i if i % 3 else None, words(i, 5 + i), "en", f"s{i % 3}", i) for i in range(60)]
    rows += [(7, words(100 + i, 20), None, f"s{i % 3}", i) for i in range(9)] + [rows[0]] * 3 + [rows[1]] * 2 + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, CORPUS)
    want = Counter()
    for r in mixing.mix_sizes(df.withColumn("_row", corpus_pipeline.row_key(df)), carry="_row").collect():
        want[r["doc_id"], r["source"], r["size"]] += int(r["taken"] / r["size"] + 0.5) if r["size"] else 0
    got = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in corpus_pipeline.mixing(spark, df, "").collect())
    assert got == +want
    assert any(k[0] is None for k in got) and sum(n for k, n in got.items() if k[0] == 7 and k[2] == 20) > 0


def test_near_dedup_keeps_one_row_of_each_group(spark):
    text, other = words(1, 40), words(2, 40)
    rows = [(3, text, "en", "a", 1), (3, text, "en", "b", 1), (3, text, "en", "b", 1), (3, other, None, "a", 1), (9, text + " more", "en", "a", 1)]
    rows += [(None, text, "en", "c", 1), (None, words(5, 40), None, None, 1), (None, words(5, 40), None, None, 1), (4, None, None, None, 0), (5, " ", None, None, 0)]
    df = spark.createDataFrame(rows, CORPUS)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.minhash(spark, df, "").collect())
    assert got == Counter([(3, text), (3, other), (None, words(5, 40)), (4, None), (5, " ")])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables_and_clashing_columns(spark, name, stage):
    df = spark.createDataFrame([(None, None, None, None, None, "x", 1)] + [(i % 3, words(i, 30), "en", None, 1, "x", 1) for i in range(4)], CORPUS + ", component_id string, length int")
    out = stage(spark, df, "")
    assert out.count() >= 3 and stage(spark, df.limit(0), "").count() == 0
    assert name == "packing" or out.columns == df.columns


def test_every_language_is_learned_from_distinct_texts(spark):
    rows = [(i, "kat ort tak rok", "aa") for i in range(3000)] + [(3000 + i, f"lui eau oie uel n{i}", "bb") for i in range(50)]
    rows += [(4000 + i, "".join(chr(0x430 + (i * 7 + j * j) % 32) for j in range(12)), f"r{i}") for i in range(30)] + [(5000, "123", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, sample=60)
    assert set(model.langs) == {r[2] for r in rows} - {"none"}
    again = langid.fit(df.repartition(5), sample=60)
    assert again.langs == model.langs and np.array_equal(again.centroids, model.centroids)


def test_predictions_match_a_plain_nearest_centroid(spark):
    rng = random.Random(8)
    stems = {"aa": ["kat", "ort", "tak"], "bb": ["lui", "eau", "oie"]}
    rows = [(i, " ".join(rng.choice(stems[x]) for _ in range(rng.randint(1, 9))), x) for i in range(90) for x in [rng.choice(list(stems))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    idf, centroids = model.idf.astype(float), model.centroids.astype(float)
    for r in langid.identify(df, model).collect():
        v = np.log1p(langid.count_ngrams([r["text"]])[0].astype(float)) * idf
        cosines = [float(v @ c) / np.sqrt(v @ v) / np.sqrt(c @ c) for c in centroids]
        assert abs(r["score"] - min(1.0, max(cosines))) < 1e-5
        best = [lang for lang, c in zip(model.langs, cosines, strict=True) if c > max(cosines) - 1e-6]
        assert r["lang_pred"] in best and r["rejected"] == (max(cosines) < model.least)


def test_all_tags_of_a_page_make_aliases(spark):
    tag = '<link rel="alternate canonical" href="http://a.net/es/x"><meta http-equiv=refresh content="0; url=http://b.org/1">'
    rows = [(1, "http://c.org/1", '<link rel=canonical href=http://c.org/2><LINK href="http://d.org/" rel="canonical">' + tag), (2, "http://d.org/", None), (3, "http://b.org/1", ""), (4, "http://e.org/", "<link rel=noncanonical2 href=http://d.org/>")]
    got = judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), url_rules()).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "block", 3: "block", 4: "allow"}
