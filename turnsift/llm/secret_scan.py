"""Secrets in texts: three plain rules, and character Markov models for what they miss.

Rules (kinds ``assign``, ``access``, ``hex``): leftmost non-overlapping matches of each kind.
Models (kind ``markov``): two first-order character models, one of random strings and one of
ordinary identifiers, over the token characters ``[A-Za-z0-9+/_.=-]``. A token of at least
``LEAST_TOKEN`` characters that touches no rule span is a secret if its log-likelihood ratio
(random against ordinary) is at least ``LEAST_RATIO`` per character step. Steps from or to one of ``+/_.=-`` say nothing (identifiers are
words joined by them), one step counts ``MOST_STEP`` at most, and a token without any letter is a
number, not a secret.

Training samples are labelled by the rules: what they find in the corpus are random strings, every
other token of at least ``LEAST_SAMPLE`` characters is an ordinary identifier. All documents
count; the result is one number per class and character pair, whatever the corpus size. As rule
hits are mostly hexadecimal, the random model is mixed with a uniform one.

Contract: one row per input row; a null text is an empty one; offsets are code points, end
exclusive; spans are ordered by start, then assign, access, hex, markov. Repeated rows and null
ids are rows like any other. Without any rule hit in the corpus the random model is the uniform
one. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnsift.llm.texts import bounded_batches, text_slices, utf8_bytes

KINDS = ("assign", "access", "hex", "markov")
LEAST_TOKEN = 20
LEAST_SAMPLE = 8
LEAST_RATIO = 0.4
UNIFORM = 0.25
SMOOTHING = 1.0
MOST_STEP = 3.0

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_SYMBOL = np.full(256, -1, np.int64)
_SYMBOL[list(ALPHABET.encode())] = np.arange(len(ALPHABET))
_N = len(ALPHABET)
_JOINS = ALPHABET.index("+")  # from here on joining characters
_LETTERS = ALPHABET.index("0")  # up to here letters

_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
_LEAST_VALUE = 8
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LEAST_ACCESS = 16
_HEX = re.compile(r"[0-9a-f]+")
_LEAST_HEX = 32

Span = tuple[int, int, int]  # start, kind, end


def _runs(data: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in bytes of the maximal token runs of at least ``least`` characters."""
    inside = _SYMBOL[data] >= 0
    cut = np.zeros(len(data) + 1, bool)
    cut[rows] = True
    before = np.concatenate(([False], inside[:-1])) & ~cut[:-1]
    after = np.concatenate((inside[1:], [False])) & ~cut[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def _assignments(text: str, lowered: bytes) -> list[tuple[int, int, int]]:
    """(start, end, start of the value); the words are looked up before the regex runs."""
    if not any(word in lowered for word in _ASSIGN_WORDS):
        return []
    return [
        (m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST_VALUE
    ]


class _Slice:
    """Token runs and rule spans of a slice of texts."""

    def __init__(self, texts: pa.Array):
        self.data, self.rows = utf8_bytes(texts)
        self.raw = self.data.tobytes()
        lowered = self.raw.lower()
        self.points = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        least = min(LEAST_SAMPLE, LEAST_TOKEN, _LEAST_ACCESS, _LEAST_HEX)
        self.starts, self.ends = _runs(self.data, self.rows, least)
        self.row_of = np.searchsorted(self.rows, self.starts, "right") - 1
        self.spans: list[list[Span]] = [[] for _ in range(len(self.rows) - 1)]
        self.values: list[tuple[int, int]] = []  # bytes of what the rules found, without the names
        ruled: list[tuple[int, int]] = []  # bytes of whole rule spans
        for row, (a, b) in enumerate(zip(self.rows[:-1], self.rows[1:])):
            low = lowered[a:b]
            if any(word in low for word in _ASSIGN_WORDS):
                text = self.raw[a:b].decode()
                at, counted = int(a), 0  # bytes up to the characters counted so far
                for start, end, value in _assignments(text, low):
                    self.spans[row].append((start, 0, end))
                    head = at + len(text[counted:start].encode())
                    at, counted = head + len(text[start:value].encode()), value
                    self.values.append((at, at + end - value))
                    ruled.append((head, at + end - value))
        for i in np.flatnonzero(self.ends - self.starts >= _LEAST_ACCESS):
            token = self.raw[self.starts[i] : self.ends[i]].decode()
            row = self.row_of[i]
            for kind, rule, short in ((1, _ACCESS, _LEAST_ACCESS), (2, _HEX, _LEAST_HEX)):
                for m in rule.finditer(token):
                    if m.end() - m.start() >= short:
                        at = int(self.starts[i]) + m.start()
                        start = self.point(row, at)
                        self.spans[row].append((start, kind, start + m.end() - m.start()))
                        self.values.append((at, at + m.end() - m.start()))
                        ruled.append((at, at + m.end() - m.start()))
        ruled.sort()
        spans = np.array(ruled, np.int64).reshape(-1, 2)
        #: Starts of the rule spans, ascending, and the largest end so far.
        self.ruled_from, self.ruled_to = spans[:, 0], np.maximum.accumulate(spans[:, 1])

    def point(self, row: int, at: int) -> int:
        return int(self.points[at] - self.points[self.rows[row]])

    def unruled(self, least: int) -> np.ndarray:
        """Numbers of the runs of at least ``least`` characters that touch no rule span."""
        runs = np.flatnonzero(self.ends - self.starts >= least)
        earlier = np.searchsorted(self.ruled_from, self.ends[runs])
        reach = np.concatenate(([-1], self.ruled_to))[earlier]
        return runs[reach <= self.starts[runs]]


def _steps(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(character pair, number of its token) of all steps inside the given tokens."""
    sizes = ends - starts - 1
    if not len(sizes) or sizes.sum() <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    return _SYMBOL[data[at]] * _N + _SYMBOL[data[at + 1]], owner


def ratios(random_counts: np.ndarray, ordinary_counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of every character pair."""

    def share(counts: np.ndarray) -> np.ndarray:
        square = counts.reshape(_N, _N).astype(float)
        return (square + SMOOTHING / _N) / (square.sum(axis=1, keepdims=True) + SMOOTHING)

    mixed = (1 - UNIFORM) * share(random_counts) + UNIFORM / _N
    table = np.log(mixed / share(ordinary_counts)).clip(-MOST_STEP, MOST_STEP)
    table[_JOINS:, :] = table[:, _JOINS:] = 0.0
    return table.reshape(-1)


def token_ratio(token: str, table: np.ndarray) -> float:
    """Ratio per character step of one token."""
    data = np.frombuffer(token.encode(), np.uint8)
    pair, _ = _steps(data, np.array([0]), np.array([len(data)]))
    return float(table[pair].mean()) if len(pair) else 0.0


def train(docs: DataFrame) -> np.ndarray:
    """The ratio table of a corpus that the rules label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, _N * _N), np.int64)
        for batch in batches:
            for part in text_slices(batch):
                found = _Slice(part.column("text"))
                plain = found.unruled(LEAST_SAMPLE)
                for label, (starts, ends) in enumerate((
                    (found.starts[plain], found.ends[plain]),
                    tuple(np.array(found.values, np.int64).reshape(-1, 2).T),
                )):
                    pair, _ = _steps(found.data, starts, ends)
                    sums[label] += np.bincount(pair, minlength=_N * _N)
        label, pair = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label, pa.int32()), pa.array(pair, pa.int32()), pa.array(sums[label, pair])],
            ["label", "pair", "n"],
        )

    rows = (
        bounded_batches(docs).select("text").mapInArrow(count, "label int, pair int, n long")
        .groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()  # two rows a character pair at most
    )
    counts = np.zeros((2, _N * _N), np.int64)
    for row in rows:
        counts[row.label, row.pair] = row.n
    return ratios(counts[1], counts[0])


def scan(docs: DataFrame, table: np.ndarray | None = None, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """doc_id and its spans: array of (kind, start, end, ratio), ratio null for rule spans."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs) if table is None else table)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                found = _Slice(part.column("text"))
                score: dict[tuple[int, Span], float] = {}
                tokens = found.unruled(LEAST_TOKEN)
                pair, owner = _steps(found.data, found.starts[tokens], found.ends[tokens])
                sums = np.bincount(owner, shared.value[pair], minlength=len(tokens))
                for k, i in enumerate(tokens):
                    size = int(found.ends[i] - found.starts[i])
                    ratio = float(sums[k]) / (size - 1)
                    if ratio >= least_ratio and (_SYMBOL[found.data[found.starts[i] : found.ends[i]]] < _LETTERS).any():
                        row = int(found.row_of[i])
                        start = found.point(row, found.starts[i])
                        found.spans[row].append((start, 3, start + size))
                        score[row, (start, 3, start + size)] = ratio
                spans = [
                    [{"kind": KINDS[s[1]], "start": s[0], "end": s[2], "ratio": score.get((row, s))} for s in sorted(own)]
                    for row, own in enumerate(found.spans)
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, end: long, ratio: double>>"
    )


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def span_digests(found: DataFrame) -> DataFrame:
    """Counts per rule, digest of the rule spans and all spans as text."""

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
