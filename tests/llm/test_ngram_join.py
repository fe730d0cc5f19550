"""Shingle sets and components against brute force."""

import random
import re

import pyarrow as pa
import pytest

from turnsift.llm import linking, ngram_join as J, texts

SCHEMA = "doc_id long, text string, gid string, n string, token string, label string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "g", "n", "t", "l") for i, t in rows], SCHEMA)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def model(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[root(i)] = min(doc_id, lowest.get(root(i), doc_id))
    return [
        (doc_id, len(s), lowest.get(root(i)) if s else doc_id)
        for i, ((doc_id, _), s) in enumerate(zip(rows, sets))
    ]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choice(vocabulary) for _ in range(12))
    out = []
    for k in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 30, 80]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words.append(rng.choice(vocabulary))
            text = " ".join(words)
            out.append(text + " " + common if k % 4 == 0 else rng.choice(["", " \n"]) + text.upper())
    out += [common, common + " x", None, "", " \t ", "one", "ONE", "one two three four", "é É", "a\xa0b c d e f", "hot copy of a text here"]
    out += ["hot copy of a text here"] * 60
    rng.shuffle(out)
    rows = [(i * 3 % 1009, t) for i, t in enumerate(out)]
    return rows + [(None, "only null id"), (None, "ONE"), (5, "same id"), (5, "another text altogether")]


@pytest.mark.parametrize("gain", [J.LEAST_GAIN, 2.0])
def test_components(spark, rows, gain):
    """Also with a single leader round, which leaves the rest to the last step."""
    got = J.near_copies(frame(spark, rows).repartition(5), least_gain=gain).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(model(rows), key=repr)


def test_without_frequency_order(spark, rows):
    got = J.near_copies(frame(spark, rows), order_bits=8).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(model(rows), key=repr)


def test_same_prefix_and_size(spark):
    """Members of one group: equal rare part and size, different frequent tail."""
    tails = [[f"t{i}"] * 4 for i in range(4)]
    start = [f"s{i}" for i in range(30)]
    rows = [(i, " ".join(start + tails[i % 4])) for i in range(12)]
    got = J.near_copies(frame(spark, rows), order_bits=8).collect()
    assert sorted(map(tuple, got)) == sorted(model(rows))


def test_keep_first(spark, rows):
    docs = frame(spark, rows)
    kept = J.keep_first(docs)
    assert kept.columns == docs.columns
    want = sorted(i for i, _, c in model(rows) if i is not None and i == c)
    gone = {i for i, _, c in model(rows) if i is not None and i != c}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [i for i in want if i not in gone]


def test_empty(spark, rows):
    assert J.near_copies(frame(spark, rows).limit(0)).count() == 0
    assert J.near_copies(frame(spark, [(1, None), (2, "")])).count() == 2


def test_word_hashes_match_words(monkeypatch):
    monkeypatch.setattr(texts, "SLICE_BYTES", 16)
    rng = random.Random(2)
    column = ["".join(rng.choice("aB \t\né") for _ in range(rng.randrange(90))) for _ in range(200)] + [None, ""]
    hashes, at = texts.word_hashes(pa.array(column))
    seen = {}
    for i, text in enumerate(column):
        words = [w.lower() if w.isascii() else re.sub("B", "b", w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        own = hashes[at[i] : at[i + 1]].tolist()
        assert len(own) == len(words)
        for word, value in zip(words, own):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    first, _ = texts.word_hashes(pa.array(column).slice(3, 50))
    assert first.tolist() == hashes[at[3] : at[53]].tolist()


def test_merge_in_steps(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    labels = None
    for part in (edges[:100], edges[100:]):
        labels = linking.merge(labels, spark.createDataFrame(part, "a long, b long"))
    parent = {v: v for e in edges for v in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {r.vertex: r.label for r in labels.collect()} == {v: root(v) for v in parent}
