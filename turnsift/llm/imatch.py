"""I-Match fingerprints over randomised subsets of a mid-frequency lexicon.

A text's terms are its lower-cased words without repeats, as 64-bit hashes. The lexicon holds the terms
whose share of documents lies in a band (their inverse document frequency is neither near zero nor
so high that one edit changes it). Random subsets of the lexicon are drawn by hashing terms, and a
fingerprint has one hash per subset, of the text's sorted lexicon terms in it.

A subset that holds many of a text's terms changes with any edit, one that holds none says nothing. So
subsets come in levels: a subset of level l holds a term with probability 4**-l, and a text of T
lexicon terms is hashed at three neighbouring levels around log4(T), where a subset holds about one of
its terms. ``likeness`` compares two fingerprints at the finer of their levels: of the subsets that
hold a term of either text, the share whose hashes agree. Without any such subset it is 1 or 0 by a
hash over all terms. Texts of very different size (three levels or more) have likeness 0.

The lexicon can be broadcast: the document frequencies of all terms sum to (documents x mean distinct
terms), so at most mean / lower share terms reach the lower share (1,000 times the mean number of
distinct terms), however many documents there are; a term is eight bytes.

``with_next`` gives every document the one that follows by descending doc_id, and after the last
the first. Texts are range-partitioned once, compressed; inside a partition the follower is the
next row, and only each partition's first and last row are joined.

Contract: one row per input row; a null text is an empty one. A null doc_id follows all others;
rows with equal doc_id are ordered by descending length, then by a hash of the text. A single row
follows itself. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from turnsift.llm.texts import bounded_batches, mix, text_slices
from turnsift.operators.durable import written

SHARES = (0.001, 0.2)
#: Subsets of a level.
SUBSETS = 16
LEVELS = 3
SEED = 1

#: Terms a task holds before it passes on their counts.
_COUNTED = 2_000_000


def terms(text: str) -> set[str]:
    return set(text.lower().split())


def term_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the terms, ascending."""
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(t.encode()) for t in terms(text)), np.uint64))


@dataclass(frozen=True)
class Print:
    """``marks[j, k]``: hash of the terms in subset k of level ``level - 1 + j``, 0 without any."""

    level: int
    whole: int
    marks: np.ndarray

    def __str__(self) -> str:
        return f"{self.level:02x}{self.whole:016x}{self.marks.astype('>u4').tobytes().hex()}"

    @staticmethod
    def parse(text: str) -> Print:
        marks = np.frombuffer(bytes.fromhex(text[18:]), ">u4").reshape(LEVELS, -1)
        return Print(int(text[:2], 16), int(text[2:18], 16), marks)


class Lexicon:
    """The terms of the band by their hashes."""

    def __init__(self, hashes: np.ndarray, subsets: int = SUBSETS, seed: int = SEED):
        self.hashes, self.subsets = np.unique(np.asarray(hashes, np.uint64)), subsets
        self.seeds = mix(np.arange(1, subsets + 1, dtype=np.uint64) + np.uint64(seed << 20))

    def within(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return hashes[:0]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return hashes[self.hashes[at] == hashes]

    def places(self, own: np.ndarray) -> np.ndarray:
        """Per term and subset the deepest level that holds it."""
        lots = mix(own[:, None] ^ self.seeds[None, :])
        # level l holds lots below 2**(64 - 2 l): one level per two leading zeros
        return ((64 - np.frexp((lots >> np.uint64(12)).astype(float))[1] - 12) // 2).astype(np.int64)

    def fingerprint(self, text: str) -> Print:
        hashes = term_hashes(text)
        own = self.within(hashes)
        level = max(1, math.ceil(math.log(max(1, len(own)), 4)))
        deepest = self.places(own)
        marks = np.zeros((LEVELS, self.subsets), np.uint32)
        for j in range(LEVELS):
            holds = deepest >= level - 1 + j
            for k in np.flatnonzero(holds.any(axis=0)):
                marks[j, k] = (xxhash.xxh3_64_intdigest(own[holds[:, k]].tobytes(), int(k)) & 0xFFFFFFFF) or 1
        return Print(level, xxhash.xxh3_64_intdigest(hashes.tobytes()), marks)


def likeness(a: Print, b: Print) -> float:
    near, far = sorted((a.level, b.level))
    if far - near > 2:
        return 0.0
    level = min(far, near + 1)
    x, y = a.marks[level - a.level + 1], b.marks[level - b.level + 1]
    told = (x != 0) | (y != 0)
    if not told.any():
        return float(a.whole == b.whole)
    return float((x == y)[told].mean())


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def lexicon(docs: DataFrame, shares: tuple[float, float] = SHARES, subsets: int = SUBSETS, seed: int = SEED) -> Lexicon:
    """The lexicon of a corpus, from the document frequencies of all its terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def rows() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n, pa.int64())], ["term", "n"])

        for batch in batches:
            for part in text_slices(batch):
                for text in part.column(0).to_pylist():
                    held.append(term_hashes(text or ""))
                    size += len(held[-1])
                if size > _COUNTED:
                    yield rows()
                    held, size = [], 0
        yield rows()

    n_docs = docs.count()
    counted = (
        bounded_batches(docs).select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    )
    band = counted.filter((F.col("n") >= shares[0] * n_docs) & (F.col("n") <= shares[1] * n_docs)).select("term")
    found = band.toArrow().column(0).to_numpy()  # at most mean distinct terms / lower share
    return Lexicon(found.astype(np.int64).view(np.uint64), subsets, seed)


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _result(words: Lexicon, doc_id, text: str, own: Print, following: str, other: Print) -> tuple:
    changed = edited(text, following)
    new = words.fingerprint(changed)
    return (
        doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), str(own), str(new),
        likeness(own, new), likeness(own, other),
    )


def _table(rows: list[tuple], names, types) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, n, h (a hash of the text) and the compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in text_slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                raw = [t.encode() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([xxhash.xxh3_64_intdigest(r) >> 1 for r in raw], pa.int64()),
                        pa.array([pack.compress(r) for r in raw], pa.binary()),
                    ],
                    ["doc_id", "n", "h", "body"],
                )

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h long, body binary")


def with_next(docs: DataFrame, words: Lexicon) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    order = [F.col("doc_id").desc_nulls_last(), F.col("n").desc(), F.col("h")]
    names, types = [*_NAMES, "part", "edge", "body"], [*_TYPES, pa.int32(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unpack = shared.value, zstandard.ZstdDecompressor()
        number = TaskContext.get().partitionId()
        before = None
        for batch in batches:
            out = []
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                text = unpack.decompress(body).decode()
                own = words.fingerprint(text)
                if before is None:
                    out.append((doc_id, *[None] * 6, number, "first", body))
                else:
                    out.append((*_result(words, *before[:3], text, own), None, None, None))
                before = (doc_id, text, own, body)
            yield _table(out, names, types)
        if before is not None:
            yield _table([(before[0], *[None] * 6, number, "last", before[3])], names, types)

    found = written(
        _packed(docs).withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(*order, "row").sortWithinPartitions(*order, "row").drop("row")
        .mapInArrow(run, f"{_RESULT}, part int, edge string, body binary"),
        "imatch-rows",
    )
    firsts = found.filter("edge = 'first'").select("part", F.col("body").alias("following"))
    lasts = found.filter("edge = 'last'").select("part", "doc_id", "body")
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = firsts.select(
        "part",
        F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(along)).alias("next_part"),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unpack = shared.value, zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc_id, body, following in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "body", "following"))):
                text, after = (unpack.decompress(x).decode() for x in (body, following))
                out.append(_result(words, doc_id, text, words.fingerprint(text), after, words.fingerprint(after)))
            yield _table(out, _NAMES, _TYPES)

    edges = (
        lasts.join(follows, "part")
        .join(firsts.withColumnRenamed("part", "next_part"), "next_part")
        .select("doc_id", "body", "following")
        .mapInArrow(join, _RESULT)
    )
    return found.filter("edge IS NULL").select(*_NAMES).unionByName(edges)


def fingerprints(docs: DataFrame, words: Lexicon) -> DataFrame:
    """doc_id and the fingerprint of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                own = [str(shared.value.fingerprint(t or "")) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own, pa.string())], ["doc_id", "fingerprint"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_next(docs, lexicon(docs))
