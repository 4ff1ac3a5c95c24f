"""Piece encoding and decoding against the sentencepiece library itself."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest

spm = pytest.importorskip("sentencepiece")
pytest.importorskip("tokenizers")

from pyspark.sql import functions as F

from tracequarry.llm import pieces, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PATH = queries.tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", "hello world", "\n", "a\n\n b", "▁x", "x▁▁y", " lead", "trail ", "<s>", "</s> <unk> <0x0A>", "\0a", "日本語のテキスト", "émoji 😀😀", "a" * 1000, "\r\n\t x y", "é"]
ODD += [x for n in (15, 16, 17, 30, 31, 32, 33, 48, 49, 100, 1000) for x in (" " * n, " " * n + "x", "a" + " " * n + "the", " " * n + "\n" + " " * n)]
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ab ", "   a\n", "aeiou tnsr", "0123456789abcdef", "éèüß€日本語中文字母한글мирЖ😀 \t", "etaoin  ▁", "ABCDEFGHabcdefgh+/="]


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH)


def compare(library, encoder, texts):
    ids, ends = encoder.encode(texts)
    want = library.encode([t or "" for t in texts], add_bos=True, add_eos=True, num_threads=1)
    starts = [0, *ends.tolist()]
    assert [ids[a:b].tolist() for a, b in zip(starts, ends.tolist(), strict=False)] == want
    assert encoder.model.decode(ids.astype(np.int64), ends) == [library.decode(w) for w in want]


def test_odd_and_random_texts(library, model):
    rng = random.Random(0)
    compare(library, pieces.WordIds(model), ODD)
    encoder = pieces.WordIds(model, most=500)  # forgets again and again
    for _ in range(60):
        texts = []
        for _ in range(40):
            letters = rng.choice(ALPHABETS)
            texts.append("".join(rng.choice(rng.choice(ALPHABETS) if rng.random() < 0.1 else letters) for _ in range(rng.randint(0, 200))))
        compare(library, encoder, texts)


def test_long_words(library, model):
    rng = random.Random(1)
    sets = ("a", " ", "ab", "".join(map(chr, range(0x4E00, 0x5000))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    for letters in sets:
        compare(library, pieces.WordIds(model), ["".join(rng.choice(letters) for _ in range(50_000))])
    compare(library, pieces.WordIds(model), ["a" * 1_000_000, " " * 1_000_000])


def test_merges_follow_the_librarys_order_whatever_the_scores(model, monkeypatch):
    """Scores that favour late merges and ties, against merging one pair at a time."""
    rng = np.random.default_rng(3)
    for levels in (5, 300, 40_000):
        table = rng.integers(0, levels, model.n).astype(np.int32)
        monkeypatch.setattr(model, "ranks", table[model.merged])
        known = dict(zip(model.pairs.tolist(), zip(model.ranks.tolist(), model.merged.tolist(), strict=True), strict=True))
        for _ in range(150):
            letters = rng.choice(list("aeotnsrih"), rng.integers(1, 40))
            symbols = [int(model.letter_symbols[np.searchsorted(model.letters, ord(c))]) for c in letters]
            got, _ = model.merge(np.array(symbols, np.int64), np.zeros(len(symbols), np.int64))
            while True:
                pairs = [(known[a * model.base + b][0], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a * model.base + b in known]
                if not pairs:
                    break
                i = min(pairs)[1]
                symbols[i : i + 2] = [known[symbols[i] * model.base + symbols[i + 1]][1]]
            assert got.tolist() == symbols


def test_any_ids_decode_as_the_library_does(library, model):
    rng = random.Random(4)
    lists = [[rng.choice([rng.randrange(32_000), rng.randrange(3, 259), 0, 1, 2, 29871]) for _ in range(rng.randint(0, 12))] for _ in range(2000)]
    flat, ends = np.array([i for x in lists for i in x], np.int64), np.cumsum([len(x) for x in lists])
    assert model.decode(flat, ends) == [library.decode(x) for x in lists]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    for change in (lambda m: setattr(m.trainer_spec, "model_type", proto.TrainerSpec.UNIGRAM), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.pieces[300], "type", proto.ModelProto.SentencePiece.USER_DEFINED)):
        m = proto.ModelProto()
        with open(PATH, "rb") as f:
            m.ParseFromString(f.read())
        change(m)
        (tmp_path / "m").write_bytes(m.SerializeToString())
        with pytest.raises(ValueError):
            pieces.PieceModel(str(tmp_path / "m"))


def test_odd_rows(spark, library):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate([*ODD, None])] + [(3, ODD[3], "x", "y", "z")] * 2 + [(None, "two", "x", "y", "z"), (None, None, None, None, None)]
    schema = "doc_id long, text string, ids string, n_tokens string, decoded string"
    got = pieces.encode_pieces(spark.createDataFrame(rows, schema).repartition(3), PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    back = pieces.decode_pieces(got.withColumn("decoded", F.lit(1)), PATH)
    assert back.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    want = [(i, library.encode(t or "", add_bos=True, add_eos=True)) for i, t, *_ in rows]
    want = [(i, len(w), np.array(w, "<u4").tobytes(), library.decode(w)) for i, w in want]
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in back.collect()), key=key) == sorted(want, key=key)
    assert pieces.decode_pieces(spark.createDataFrame([(None,)], "ids binary"), PATH).first()["decoded"] is None
    empty = pieces.decode_pieces(pieces.encode_pieces(spark.createDataFrame([], schema), PATH), PATH)
    assert empty.columns == back.columns and empty.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_query_against_the_library(spark, library):
    df = queries.queries()["op12_sentencepiece"](spark, DATA)
    assert dict(df.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    want = {}
    for doc_id, text in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want[doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in df.collect()} == want
