"""Byte-level BPE encoding and decoding with a local rank file and the tiktoken library.

Contract: one row per input row. A null text is an empty one. An empty text has no ids and
decodes to no bytes. Rows with equal texts or ids are encoded independently. Extra columns are
kept untouched by ``encode`` and ``decode``, whatever their names, unless they are the named
output column, which is replaced. Special tokens are not known: their strings are plain text.

Long texts are cut into pieces of about ``piece_chars`` characters at boundaries no match of the
split pattern spans, so the regex engine and the merge step only ever see bounded input:

* before white space that follows something else: no alternative holds white space after
  another character, and the look-ahead ``\\s+(?!\\S)`` only looks beyond white space;
* between a letter and a digit, in either order: no alternative mixes them, and a contraction
  (apostrophe plus letters) holds no digit.

A run without any such boundary stays whole, because cutting it would change the ids. White space
has none inside, and the look-ahead recurses on it, so a run of ``LONG_SPACE`` or more never meets
the regex: the pattern takes all of it at the end of a text, else all but its last character (which
belongs to what follows), and those bytes are merged as the one match they are.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from turnsift.llm.texts import bounded_batches, text_slices

PIECE_CHARS = 20_000
LONG_SPACE = 2_000
RANK_FILE = "byte_bpe_50k.tiktoken"

_LONG_SPACE = regex.compile(rf"\s{{{LONG_SPACE},}}")
_BOUNDARY = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@functools.lru_cache(maxsize=4)
def encoding(rank_path: str) -> tiktoken.Encoding:
    """The encoding of a rank file; every worker reads the file once."""
    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(
        rank_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def pieces(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    start = 0
    while len(text) - start > piece_chars:
        found = _BOUNDARY.search(text, start + piece_chars)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def _matches(text: str) -> Iterator[tuple[str, bool]]:
    """The text in parts; the flagged ones are one match of the split pattern each."""
    start = 0
    for run in _LONG_SPACE.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        yield text[start : run.start()], False
        yield text[run.start() : stop], True
        start = stop
    yield text[start:], False


def encode_text(encoder: tiktoken.Encoding, text: str | None, piece_chars: int = PIECE_CHARS) -> np.ndarray:
    ids = [np.zeros(0, np.uint32)]
    for part, whole in _matches(text or ""):
        if whole:
            ids.append(np.asarray(encoder._encode_single_piece(part), np.uint32))
        else:
            ids += [np.asarray(encoder.encode_ordinary(piece), np.uint32) for piece in pieces(part, piece_chars)]
    return np.concatenate(ids)


def decode_ids(encoder: tiktoken.Encoding, ids) -> bytes:
    """Raw bytes, so ids that end inside a character survive."""
    return encoder.decode_bytes(list(ids))


def _extended(df: DataFrame, out: str, kind) -> StructType:
    kept = [f for f in df.schema.fields if f.name != out]
    return StructType([*kept, StructField(out, kind)])


def _with(batch: pa.RecordBatch, out: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != out]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], [*names, out])


def default_ranks() -> str:
    return public_tokenizers.path(RANK_FILE)


def encode(df: DataFrame, text: str = "text", out: str = "ids", rank_path: str | None = None,
           piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Add the token ids of ``text`` as array<int>."""
    path = rank_path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path)
        for batch in batches:
            for part in text_slices(batch, text):
                ids = [encode_text(encoder, t, piece_chars).astype(np.int32) for t in part.column(text).to_pylist()]
                yield _with(part, out, pa.array(ids, pa.list_(pa.int32())))

    return bounded_batches(df).mapInArrow(run, _extended(df, out, ArrayType(IntegerType())))


def decode(df: DataFrame, ids: str = "ids", out: str = "bytes", rank_path: str | None = None) -> DataFrame:
    """Add the raw bytes of the token ids; null ids give no bytes."""
    path = rank_path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path)
        for batch in batches:
            raw = [decode_ids(encoder, x or []) for x in batch.column(ids).to_pylist()]
            yield _with(batch, out, pa.array(raw, pa.binary()))

    return bounded_batches(df).mapInArrow(run, _extended(df, out, BinaryType()))


def token_digests(docs: DataFrame, rank_path: str | None = None, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, n_tokens, digest of the ids, digest of the decoded bytes: encode and decode in
    one pass, so neither ids nor bytes leave the worker."""
    path = rank_path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path)
        for batch in batches:
            for part in text_slices(batch):
                counts, ids_hex, raw_hex = [], [], []
                for text in part.column("text").to_pylist():
                    ids = encode_text(encoder, text, piece_chars)
                    counts.append(len(ids))
                    ids_hex.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    raw_hex.append(hashlib.sha256(decode_ids(encoder, ids.tolist())).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(raw_hex)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def round_trip(docs: DataFrame, rank_path: str | None = None, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text's bytes."""
    path = rank_path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path)
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").to_pylist()
                ids = [encode_text(encoder, text, piece_chars) for text in texts]
                whole = [decode_ids(encoder, x.tolist()) == (t or "").encode() for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(n) for n in ("doc_id", "lang", "source")),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                        pa.array(whole, pa.bool_()),
                    ],
                    ["doc_id", "lang", "source", "n_tokens", "ids", "intact"],
                )

    return bounded_batches(docs).select("doc_id", "lang", "source", "text").mapInArrow(
        run, "doc_id long, lang string, source string, n_tokens long, ids array<int>, intact boolean"
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
