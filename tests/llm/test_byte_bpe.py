"""Byte-level BPE against the plain library, and an exact round trip."""

import hashlib
import random

import numpy as np
import pytest

from turnsift.llm import byte_bpe as B

TEXTS = [
    None, "", " ", "a", "\n\n  x", "it's 'sa they'll2go", "naïve  café\t x", "日本語 текст 🙂🙂",
    "<|endoftext|> plain", "x" * 3000, " " * 3000, "a1b2" * 800, "'''s't're" * 300, "tab\x0bvt\x85nel",
]


@pytest.fixture(scope="module")
def encoder():
    return B.encoding(B.default_ranks())


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("piece", [1, 3, 50])
def test_pieces_do_not_change_ids(encoder, text, piece):
    assert B.encode_text(encoder, text, piece).tolist() == encoder.encode_ordinary(text or "")
    assert "".join(B.pieces(text or "", piece)) == (text or "")


def test_random_texts(encoder):
    rng = random.Random(5)
    alphabet = "ab'sS tl1  \n\t  éß٣Ⅷ中🙂.-_"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        ids = B.encode_text(encoder, text, rng.randrange(1, 9))
        assert ids.tolist() == encoder.encode_ordinary(text)
        assert B.decode_ids(encoder, ids.tolist()) == text.encode()


def test_query_rows(spark, encoder):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None), (3, "a", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, bytes string")
    got = sorted(map(tuple, B.token_digests(docs).collect()), key=repr)
    want = []
    for i, text, *_ in rows:
        ids = encoder.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert B.token_digests(docs.limit(0)).count() == 0


def test_columns_and_raw_bytes(spark, encoder):
    docs = spark.createDataFrame([(1, "é🙂", "old"), (2, None, "old")], "doc_id long, text string, ids string")
    both = B.decode(B.encode(docs))
    assert both.columns == ["doc_id", "text", "ids", "bytes"]
    assert {r.doc_id: bytes(r.bytes) for r in both.collect()} == {1: "é🙂".encode(), 2: b""}
    cut = spark.createDataFrame([([encoder.encode_ordinary("🙂")[0]],), (None,)], "ids array<int>")
    raw = [bytes(r.bytes) for r in B.decode(cut).collect()]
    assert "🙂".encode().startswith(raw[0]) and raw[0] and raw[1] == b""


def long_space_ids(encoder, before, space, after):
    """The pattern's own split, part by part: the library cannot take the run through its regex."""
    taken = space if not after else space[:-1]
    ids = encoder.encode_ordinary(before) if before else []
    ids = ids + encoder._encode_single_piece(taken)
    return ids + (encoder.encode_ordinary(space[-1] + after) if after else [])


@pytest.mark.parametrize("unit", [" ", "\n", " \n\t\u3000", "\r\n"])
@pytest.mark.parametrize(("before", "after"), [("", ""), ("word", ""), ("", "word"), ("a1 ", "'s it"), ("x", "\U0001f642")])
def test_very_long_white_space(encoder, unit, before, after):
    for chars in (B.LONG_SPACE - 1, B.LONG_SPACE, 20_001):
        space = (unit * chars)[:chars]
        text = before.rstrip() + space + after
        assert B.encode_text(encoder, text).tolist() == encoder.encode_ordinary(text)
        assert B.encode_text(encoder, text).tolist() == long_space_ids(encoder, before.rstrip(), space, after)
    space = (unit * 3_000_000)[:3_000_000]
    ids = B.encode_text(encoder, before.rstrip() + space + after)
    assert ids.tolist() == long_space_ids(encoder, before.rstrip(), space, after)
    assert B.decode_ids(encoder, ids.tolist()) == (before.rstrip() + space + after).encode()
