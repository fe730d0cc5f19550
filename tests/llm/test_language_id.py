"""The forward algorithm against all segmentations, and held-out accuracy."""

import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from turnsift.llm import language_id as L

PATH = public_tokenizers.path(L.PIECE_FILE)
SMALL = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    return L.Model(PATH, ["aa", "bb"], rng.integers(0, 50, (len(L.pieces(PATH).number) + 1, 2)).astype(float))


def brute(model, word):
    known = L.pieces(PATH).number
    total = np.zeros(len(model.languages))
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        p = np.ones(len(model.languages))
        for a, b in zip(edges, edges[1:]):
            at = known.get(word[a:b], 0 if b - a == 1 else None)
            p = p * (model.share[at] if at is not None else 0)
        total += p
    return np.log(total)


def test_forward_sums_all_segmentations(model):
    plain = ["the", "einheit", "a", "préavis", "ночь", "中文", "xyz", "heit", "quququx"]
    words = L.Words([" 1".join(plain)])
    assert words.strings(np.arange(len(plain))) == plain
    got = model.word_scores(words, np.arange(len(plain)))
    for row, word in zip(got, plain):
        assert row == pytest.approx(brute(model, "▁" + word))


def test_words():
    texts = ["The café, l'été!", None, "", "x\0y 12 a1b", "İz ½ ²", "a" * 95, "日本語テスト"]
    words = L.Words(texts)
    found = words.strings(np.arange(len(words.starts)))
    per_text = [found[a:b] for a, b in zip(words.rows, words.rows[1:])]
    assert per_text == [
        ["the", "café", "l", "été"], [], [], ["x", "y", "a", "b"], ["i", "z"], ["a" * 95], ["日本語テスト"]
    ]
    assert len(set(words.hashes.tolist())) == len(set(found))


def test_pieces_are_found_by_hash():
    known = L.pieces(PATH)
    value = []
    for piece in [*known.number, "qzxqzx", "▁qqqqqq"]:
        h = np.zeros(1, np.uint64)
        for letter in piece:
            h = known.longer(h, np.array([ord(letter)], np.uint64))
        value.append(h[0])
    assert known.find(np.array(value)).tolist() == [*known.number.values(), 0, 0]
    start = known.longer(np.zeros(1, np.uint64), np.array([ord("▁")], np.uint64))
    assert known.find(known.longer(start, np.array([ord("\u0378")], np.uint64))).tolist() == [0]


def test_tokens_are_remembered_without_effect(model, monkeypatch):
    texts = ["The einheit, die einheit!", "la préavis 12x", None, "", "123 ... ½ _", "x" * 500, "the the"]
    want = L.Scorer(model).predict(texts)
    monkeypatch.setattr(L, "CACHED_WORDS", 1)
    scorer = L.Scorer(model)
    got = [scorer.predict([t]) for t in texts]
    assert [g[0][0] for g in got] == want[0]
    assert [g[1][0] for g in got] == pytest.approx(want[1])
    assert want[0][2:5] == ["und"] * 3 and want[1][2:5] == [0.0] * 3
    assert all(0 <= s <= 1 for s in want[1]) and all(math.isfinite(s) for s in want[1])


def test_counts_of_training(spark):
    rows = [(1, "Einheit einheit, und", "de"), (2, "und", "de"), (3, None, "de"), (4, "the", None), (5, "", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs)
    known = L.pieces(PATH).number
    assert model.languages == ["de"]
    cut = L.tokenizer(PATH).encode(["einheit", "und"], out_type=str)
    share = {p: model.share[known[p], 0] for p in [*cut[0], *cut[1]]}
    assert len({round(v, 12) for v in share.values()}) == 1 and min(share.values()) > model.share.min()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SMALL)
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    tested = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang_pred == r.lang for r in tested) >= 0.97 * len(tested)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(SMALL).limit(200)
    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))).withColumn(
        "source", F.lit("changed")
    )
    assert sorted(map(tuple, L.identify(docs).collect())) == sorted(map(tuple, L.identify(other).collect()))


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred string, held_out string"
    rows = [(None, "the the", "en"), (2, None, "en"), (3, "", None), (4, "1 2 3", "en"), (7, "hello", "en"), (7, "hello", "en")]
    docs = spark.createDataFrame([(*r, "s", "p", "h") for r in rows], schema)
    got = L.identify(docs).collect()
    assert len(got) == 6 and {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"}
    assert not [r for r in got if r.doc_id is None][0].held_out
    kept = L.accepted(docs)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["hello", "hello", "the the"]
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in L.identify(unlabelled).collect()} == {("und", 0.0)}
    assert L.identify(docs.limit(0)).count() == 0 and L.accepted(docs.limit(0)).count() == 0


def test_rare_letters_do_not_underflow(model):
    known = L.pieces(PATH).number
    rare = next(c for c in map(chr, range(0xAC00, 0xD7A4)) if c not in known)
    counts = np.zeros((len(known) + 1, 2))
    for piece, number in known.items():
        counts[number] = [1e9, 1.0] if piece in ("▁the", "▁and") else [1.0, 1e9] if piece in ("▁und", "▁die") else 0.0
    big = L.Model(PATH, ["aa", "bb"], counts)
    got = big.word_scores(L.Words([rare * 40]), np.arange(1))
    single = np.log(big.share[[known["▁"], 0]])
    assert got[0] == pytest.approx(single[0] + 40 * single[1])
    texts = [rare * 400, "the and the", "", "die und " + rare * 40, "und die"]
    languages, scores = L.Scorer(big).predict(texts)
    assert languages[1:] == ["aa", "und", "bb", "bb"]
    assert all(math.isfinite(s) for s in scores) and min(scores[1], scores[3], scores[4]) > 0.99


def test_rescaling_changes_no_score(model, monkeypatch):
    words = L.Words(["the einheit préavis " + "quxz" * 10])
    want = model.word_scores(words, np.arange(4))
    monkeypatch.setattr(L, "LEAST_FORWARD", 2.0**-20)
    assert model.word_scores(words, np.arange(4)) == pytest.approx(want, rel=1e-13)


def by_recursion(model, word):
    """Log probability in exact fractions of logs: one forward step per letter, summed in logs."""
    known = L.pieces(PATH).number
    word = "▁" + word
    logs = [np.zeros(2)]
    for b in range(1, len(word) + 1):
        terms = []
        for a in range(max(0, b - L.pieces(PATH).longest), b):
            at = known.get(word[a:b], 0 if b - a == 1 else None)
            if at is not None:
                terms.append(logs[a] + np.log(model.share[at]))
        logs.append(np.logaddexp.reduce(terms, axis=0))
    return logs[-1]


@pytest.mark.parametrize("word", ["donau" * 8 + "s", "rechtsschutz" * 6, "日本語テスト中文" * 700, "q\u0378" * 50, "the" * 2000])
def test_long_words_are_one_word(model, word, monkeypatch):
    """Just above the length scored side by side, and far above the stretch looked up at once."""
    words = L.Words([word])
    assert len(words.starts) == 1 or "\u0378" in word
    whole = word.replace("\u0378", "")
    got = model.word_scores(L.Words([whole]), np.arange(1))[0]
    assert got == pytest.approx(by_recursion(model, whole), rel=1e-11)
    monkeypatch.setattr(L, "LOOKED_UP", 7)
    assert model.word_scores(L.Words([whole]), np.arange(1))[0] == pytest.approx(got, rel=1e-12)


def test_both_ways_agree(model, monkeypatch):
    texts = ["einheitlichkeit préavis the", "xyzzyq ночь", "ununununununun"]
    words = L.Words(texts)
    want = model.word_scores(words, np.arange(len(words.starts)))
    monkeypatch.setattr(L, "ABREAST", 0)
    assert model.word_scores(words, np.arange(len(words.starts))) == pytest.approx(want, rel=1e-12)
