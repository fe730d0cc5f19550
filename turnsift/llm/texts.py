"""Arrow text columns as numpy arrays: slices of bounded size, word hashes, shingles.

White space is ``[\\x20\\x09-\\x0D]`` and only A-Z is lower-cased, so everything works on the
UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of a batch between Spark and a Python worker; rows alone do not bound long texts.
BATCH_BYTES = 4 << 20
SLICE_BYTES = 1 << 20
SPACE = " \t\n\x0b\x0c\r"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)
_LENGTH = np.uint64(0xA0761D6478BD642F)

_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounded_batches(df: DataFrame) -> DataFrame:
    """Have the session cut Arrow batches by size as well, and return the table."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def text_slices(
    batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < len(sizes):
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes or code points; equal spans hash alike wherever they are."""
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(symbols)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power(_INVERSE, len(symbols) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _LENGTH)


def _hash_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word; a word also ends where a row ends (``breaks``)."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    cut = np.zeros(len(data) + 1, bool)
    cut[breaks] = True
    before = np.concatenate(([False], inside[:-1])) & ~cut[:-1]
    after = np.concatenate((inside[1:], [False])) & ~cut[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    lower = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    return span_hashes(lower, starts, ends), starts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, word offsets per row). A very long row is worked off in
    pieces cut at white space, so the work space stays bounded."""
    data, rows = utf8_bytes(texts)
    hashes, at = [], []
    start = 0
    while start < len(data):
        stop = min(len(data), start + 2 * SLICE_BYTES)
        while stop < len(data) and data[stop] not in (32, 9, 10, 11, 12, 13):
            stop += 1
        inner = rows[(rows > start) & (rows < stop)] - start
        found, starts = _hash_words(data[start:stop], inner)
        hashes.append(found)
        at.append(starts + start)
        start = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(at), rows).astype(np.int64)


def shingles(
    words: np.ndarray, rows: np.ndarray, width: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets per row) of the distinct ``width``-word shingles, ascending in a row.
    A row with fewer words has its whole sequence as the only shingle, without words none."""
    counts = np.diff(rows)
    total = max(0, len(words) - width + 1)
    value = np.zeros(total, np.uint64)
    for j in range(width):
        value = value * _SHINGLE + words[j : j + total]
    value = mix(value)
    row_of = np.repeat(np.arange(len(counts)), counts)
    whole = row_of[:total] == row_of[width - 1 :] if total else np.zeros(0, bool)
    value, owner = value[whole], row_of[:total][whole]
    for few in range(1, width):
        short = np.flatnonzero(counts == few)
        extra = np.full(len(short), few, np.uint64) * _LENGTH
        for j in range(few):
            extra = extra * _SHINGLE + words[rows[short] + j]
        value = np.concatenate((value, mix(extra)))
        owner = np.concatenate((owner, short))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
        value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))
