"""Fingerprints and followers against a list in memory."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from turnsift.llm import imatch as I

SCHEMA = "doc_id long, text string, body string, part string, h string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", "p", "h") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    out = [(i * 7 % 997, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(80)))) for i in range(300)]
    return out + [(2000, None), (2001, ""), (2002, "é🙂x"), (None, "no id here"), (None, "other"), (7, "same id"), (7, "same id"), (2003, "W1  w2\nW3" * 30)]


def test_lexicon_is_the_band(spark, rows):
    df = Counter(t for _, text in rows for t in I.terms(text or ""))
    words = I.lexicon(frame(spark, rows), (0.05, 0.11))
    assert set(words.hashes.tolist()) == {
        xxhash.xxh3_64_intdigest(t.encode()) for t, n in df.items() if 0.05 * len(rows) <= n <= 0.11 * len(rows)
    }
    long = [(i, "x" * 5000 + f" w{i}") for i in range(4)]
    assert len(I.lexicon(frame(spark, long), (0.5, 1.0)).hashes) == 1


def test_rows(spark, rows):
    words = I.lexicon(frame(spark, rows), (0.01, 0.5))
    got = I.with_next(frame(spark, rows).repartition(6), words).collect()
    order = sorted(
        ((i, t or "") for i, t in rows),
        key=lambda r: (r[0] is None, -(r[0] or 0), -len(r[1]), xxhash.xxh3_64_intdigest(r[1].encode()) >> 1),
    )
    want = []
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, new, other = (words.fingerprint(x) for x in (text, changed, following))
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), str(own), str(new),
                     I.likeness(own, new), I.likeness(own, other)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    plain = {r.doc_id: r.fingerprint for r in I.fingerprints(frame(spark, rows), words).collect()}
    assert all(plain[r[0]] == r[3] for r in want if r[0] is not None and r[0] != 7)


def lexicon_of(words):
    return I.Lexicon([xxhash.xxh3_64_intdigest(w.encode()) for w in words])


def plain_mark(words, text, level, k):
    """Hash of the sorted lexicon terms of subset k, drawn one by one."""
    known = set(words.hashes.tolist())
    own = sorted({xxhash.xxh3_64_intdigest(t.encode()) for t in I.terms(text)} & known)
    chosen = [h for h in own if int(I.mix(np.array([h], np.uint64) ^ words.seeds[k])[0]) < 2 ** (64 - 2 * level)]
    if not chosen:
        return 0
    return (xxhash.xxh3_64_intdigest(np.array(chosen, np.uint64).tobytes(), k) & 0xFFFFFFFF) or 1


@pytest.mark.parametrize("n", [0, 1, 4, 5, 70, 900])
def test_marks_against_plain_python(n):
    words = lexicon_of(f"w{i}" for i in range(1000))
    text = " ".join(f"w{i}" for i in range(n)) + " unknown"
    got = words.fingerprint(text)
    assert got.level == max(1, next(l for l in range(9) if 4**l >= max(1, n)))
    for j in range(I.LEVELS):
        assert got.marks[j].tolist() == [plain_mark(words, text, got.level - 1 + j, k) for k in range(I.SUBSETS)]
    again = I.Print.parse(str(got))
    assert (again.level, again.whole, again.marks.tolist()) == (got.level, got.whole, got.marks.tolist())
    assert I.likeness(again, got) == 1.0


def test_likeness_follows_the_overlap():
    """Half-replaced texts of any length are clearly nearer than texts without common terms."""
    words = lexicon_of(f"w{i}" for i in range(30_000))
    for n in (8, 40, 200, 1000, 5000):
        half, near, far = [], [], []
        for at in range(0, 20_000, 1000):
            text, rest = [f"w{at + i}" for i in range(n)], [f"w{at + n + i}" for i in range(n)]
            mine = words.fingerprint(" ".join(text))
            near.append(I.likeness(mine, words.fingerprint(" ".join([*text[: -(n // 10) or None], *rest[: n // 10]]))))
            half.append(I.likeness(mine, words.fingerprint(" ".join([*text[: n // 2], *rest[: n // 2]]))))
            far.append(I.likeness(mine, words.fingerprint(" ".join(rest))))
        assert np.mean(near) > 0.6 and 0.12 < np.mean(half) < 0.5 and np.mean(far) < 0.02


def test_fingerprints():
    words = lexicon_of(f"w{i}" for i in range(200))
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(200)}" for _ in range(60))
    same = " ".join(reversed(text.upper().split()))
    assert str(words.fingerprint(text)) == str(words.fingerprint(same))
    assert I.likeness(words.fingerprint("a b"), words.fingerprint("a c")) == 0
    assert I.likeness(words.fingerprint(""), words.fingerprint(" \n")) == 1
    long = words.fingerprint(" ".join(f"w{i}" for i in range(200)))
    assert I.likeness(words.fingerprint("w1"), long) == 0


def test_small_tables(spark, rows):
    words = I.lexicon(frame(spark, rows[:1]))
    got = I.with_next(frame(spark, [(3, "abcd")]), words).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in got] == [(3, 4, 1.0)]
    assert got[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    empty = frame(spark, rows).limit(0)
    assert I.with_next(empty, I.lexicon(empty)).count() == 0
