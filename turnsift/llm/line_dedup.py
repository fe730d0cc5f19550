"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters.

A text is split at \\n (null: one empty line). A line's key is the line with ``[\\x20\\x09-\\x0D]``
stripped at both ends and A-Z lower-cased. A key of at least ``LEAST_CHARS`` code points that
``LEAST_DOCS`` documents hold is *frequent*: all its lines go, except in the largest doc_id that
holds it. Keys are identified by 128-bit BLAKE2 digests.

The index is a set of tables, dealt to shards by key:

* ``refs`` (shard, key, doc): who holds what. The exact ground of everything else.
* ``counts`` (shard, key, n_docs, last): the reference counts.
* ``filters`` (shard, slots, stash): one cuckoo filter per shard over its *frequent* keys.

``insert`` adds documents and puts keys that become frequent into the filters; ``delete`` takes
documents out again and removes keys that stop being frequent, which cuckoo filters allow. A
deletion leaves the same index as never having inserted the document. ``drops`` sends lines to
the filters first and only what may be frequent to the exact counts.

Contract: rows with equal doc_id are one document, a null doc_id is one document, smaller than
all others. One row per input row; an empty table gives no rows; other columns are ignored.

Scale. Texts move once, to meet their dropped keys. A line that a third of all documents hold is
counted before the shuffle, and its shard is probed in as many places as its rows need
(``ROWS_A_PLACE``). A filter holds one shard's frequent keys; the number of shards grows with the
documents of ``dedupe`` and doubles whenever ``insert`` finds more than ``KEYS_A_SHARD`` keys a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnsift.llm.texts import SPACE, bounded_batches, text_slices
from turnsift.operators.durable import written

LEAST_CHARS = 40
LEAST_DOCS = 5
ROWS_A_PLACE = 2_000
KEYS_A_SHARD = 50_000
DOCS_A_SHARD = 1000
LEAST_SHARDS = 64

_WAYS = 4
_KICKS = 200
#: Stands for a null doc_id.
_NO_ID = -(1 << 63)


class CuckooFilter:
    """Set of 128-bit keys with deletion: 16-bit fingerprints in buckets of four, two buckets per
    key. What finds no place after ``_KICKS`` moves goes to a stash, so no key is ever lost."""

    def __init__(self, slots: np.ndarray, stash: np.ndarray):
        self.slots, self.stash = slots, stash

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (_WAYS * 0.6)))))
        return cls(np.zeros((buckets, _WAYS), np.uint16), np.zeros(0, np.uint64))

    @classmethod
    def load(cls, slots: bytes, stash: bytes) -> CuckooFilter:
        return cls(np.frombuffer(slots, np.uint16).reshape(-1, _WAYS).copy(), np.frombuffer(stash, np.uint64).copy())

    def dump(self) -> tuple[bytes, bytes]:
        return self.slots.tobytes(), self.stash.tobytes()

    def _places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        halves = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        mask = len(self.slots) - 1
        mark = (halves[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (halves[:, 1] & np.uint64(mask)).astype(np.int64)
        return mark, first, first ^ self._other(mark)

    def _other(self, mark):
        return (np.asarray(mark, np.int64) * 0x5BD1E995 >> 7) & (len(self.slots) - 1)

    def may_hold(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        mark, a, b = self._places(keys)
        found = (self.slots[a] == mark[:, None]).any(axis=1) | (self.slots[b] == mark[:, None]).any(axis=1)
        if len(self.stash):
            low = np.minimum(a, b).astype(np.uint64) << np.uint64(16) | mark.astype(np.uint64)
            found |= np.isin(low, self.stash)
        return found

    def _put(self, mark: int, bucket: int) -> bool:
        free = np.flatnonzero(self.slots[bucket] == 0)
        if len(free):
            self.slots[bucket, free[0]] = mark
            return True
        return False

    def add(self, key: bytes) -> None:
        mark, a, b = (int(x[0]) for x in self._places([key]))
        if self._put(mark, a) or self._put(mark, b):
            return
        at = a
        for kick in range(_KICKS):
            way = (mark + kick) % _WAYS
            mark, self.slots[at, way] = int(self.slots[at, way]), mark
            at ^= int(self._other(mark))
            if self._put(mark, at):
                return
        low = min(at, at ^ int(self._other(mark)))
        self.stash = np.append(self.stash, np.uint64(low << 16 | mark))

    def remove(self, key: bytes) -> bool:
        """Take out a key that was added."""
        mark, a, b = (int(x[0]) for x in self._places([key]))
        for bucket in (a, b):
            held = np.flatnonzero(self.slots[bucket] == mark)
            if len(held):
                self.slots[bucket, held[0]] = 0
                return True
        held = np.flatnonzero(self.stash == np.uint64(min(a, b) << 16 | mark))
        if len(held):
            self.stash = np.delete(self.stash, held[0])
        return bool(len(held))

    @property
    def crowded(self) -> bool:
        return len(self.slots) >= 1 << 15 and len(self.stash) > 0 or len(self.stash) > len(self.slots) // 4


def line_key(line: str) -> bytes | None:
    """Digest of a line's key, or None if the key is short."""
    key = line.strip(SPACE)
    if len(key) < LEAST_CHARS:
        return None
    return hashlib.blake2b(key.encode().lower(), digest_size=16).digest()


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _doc(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(_NO_ID))


def line_refs(docs: DataFrame, shards: int) -> DataFrame:
    """shard, key, doc: the distinct long keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                keys, owners = [], []
                for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist()):
                    own = {line_key(line) for line in (text or "").split("\n")} - {None}
                    keys.extend(own)
                    owners.extend([doc] * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64())], ["key", "doc"])

    return (
        bounded_batches(docs).select(_doc(F.col("doc_id")).alias("doc"), "text")
        .mapInArrow(run, "key binary, doc long")
        .select(_shard(F.col("key"), shards).alias("shard"), "key", "doc")
    )


_FILTER = "shard int, slots binary, stash binary"


def _filter_row(shard: int, held: CuckooFilter) -> pd.DataFrame:
    slots, stash = held.dump()
    return pd.DataFrame({"shard": [shard], "slots": [slots], "stash": [stash]})


def _built(keys: DataFrame) -> DataFrame:
    """Filters of the given (shard, key) rows; one shard's keys are a bounded group."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        held = CuckooFilter.sized(2 * len(frame))
        for key in frame["key"]:
            held.add(bytes(key))
        return _filter_row(int(frame["shard"].iloc[0]), held)

    return keys.select("shard", "key").groupBy("shard").applyInPandas(build, _FILTER)


@dataclass(frozen=True)
class LineIndex:
    """The tables of the index; every change gives a new one."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    least_docs: int = LEAST_DOCS

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = LEAST_SHARDS, least_docs: int = LEAST_DOCS) -> LineIndex:
        return cls(
            spark.createDataFrame([], "shard int, key binary, doc long"),
            spark.createDataFrame([], "shard int, key binary, n_docs long, last long"),
            spark.createDataFrame([], _FILTER),
            shards, least_docs,
        )

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the lines of further documents; what is known already changes nothing."""
        fresh = line_refs(docs, self.shards).dropDuplicates(["key", "doc"])
        if not self.refs.isEmpty():
            fresh = fresh.join(self.refs.select("key", "doc"), ["key", "doc"], "left_anti").select(*self.refs.columns)
        fresh = written(fresh, "lines-fresh")
        added = fresh.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last"))
        if self.counts.isEmpty():
            counts = written(added, "lines-counts")
            refs = fresh
        else:
            counts = written(
                self.counts.unionByName(added).groupBy("shard", "key")
                .agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last")),
                "lines-counts",
            )
            refs = written(self.refs.unionByName(fresh), "lines-refs")
        shards, keys = self.shards, counts.count()
        while shards * KEYS_A_SHARD < keys:
            shards *= 2
        return self._with(refs, counts) if shards == self.shards else self._split(refs, counts, shards)

    def _split(self, refs: DataFrame, counts: DataFrame, shards: int) -> LineIndex:
        """The tables dealt to more shards, with new filters."""
        refs, counts = (
            written(table.withColumn("shard", _shard(F.col("key"), shards)), f"lines-{name}")
            for name, table in (("refs", refs), ("counts", counts))
        )
        index = LineIndex(refs, counts, self.filters, shards, self.least_docs)
        filters = written(_built(index.frequent()), "lines-filters")
        return LineIndex(refs, counts, filters, shards, self.least_docs)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of ``doc_ids`` (column doc_id)."""
        gone_ids = written(doc_ids.select(_doc(F.col("doc_id")).alias("doc")).distinct(), "lines-gone")
        refs = written(self.refs.join(gone_ids, "doc", "left_anti").select(*self.refs.columns), "lines-refs")
        touched = written(
            self.refs.join(gone_ids, "doc", "left_semi").select("key").distinct(), "lines-touched"
        )
        again = refs.join(touched, "key", "left_semi").groupBy("shard", "key").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last")
        )
        counts = written(
            self.counts.join(touched, "key", "left_anti").select(*self.counts.columns).unionByName(again),
            "lines-counts",
        )
        return self._with(refs, counts)

    def frequent(self) -> DataFrame:
        return self.counts.filter(F.col("n_docs") >= self.least_docs)

    def _with(self, refs: DataFrame, counts: DataFrame) -> LineIndex:
        after = LineIndex(refs, counts, self.filters, self.shards, self.least_docs)
        now = after.frequent().select("shard", "key")
        if self.filters.isEmpty():
            filters = written(_built(now), "lines-filters")
        else:
            before = self.frequent().select("shard", "key")
            changes = now.join(before, ["shard", "key"], "left_anti").withColumn("put", F.lit(True)).unionByName(
                before.join(now, ["shard", "key"], "left_anti").withColumn("put", F.lit(False))
            )
            filters = _changed(self.filters, written(changes, "lines-changes"), now)
        return LineIndex(refs, counts, filters, self.shards, self.least_docs)

    def drops(self, refs: DataFrame) -> DataFrame:
        """doc, key of the lines that go, for (shard, key, doc) rows of indexed documents."""
        maybe = _probed(refs, self.filters)
        last = written(self.frequent().select("key", "last"), "lines-frequent")
        return maybe.join(last, "key").filter("doc <> last").select("doc", "key")

    def save(self, path: str) -> None:
        for name in ("refs", "counts", "filters"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, shards: int, least_docs: int = LEAST_DOCS) -> LineIndex:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("refs", "counts", "filters")), shards, least_docs)


def _changed(filters: DataFrame, changes: DataFrame, now: DataFrame) -> DataFrame:
    """Filters after adding and removing keys; a crowded one is built again from the counts."""

    def change(held_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int((held_rows if len(held_rows) else rows)["shard"].iloc[0])
        if len(held_rows):
            held = CuckooFilter.load(held_rows["slots"].iloc[0], held_rows["stash"].iloc[0])
        else:
            held = CuckooFilter.sized(2 * len(rows))
        for key, put in zip(rows["key"], rows["put"]):
            held.add(bytes(key)) if put else held.remove(bytes(key))
        return _filter_row(shard, held).assign(crowded=held.crowded)

    changed = written(
        filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change, _FILTER + ", crowded boolean"),
        "lines-filters",
    )
    crowded = changed.filter("crowded").select("shard")
    if crowded.isEmpty():
        return changed.drop("crowded")
    good = changed.filter("NOT crowded").drop("crowded")
    return written(good.unionByName(_built(now.join(crowded, "shard", "left_semi"))), "lines-filters")


def _probed(refs: DataFrame, filters: DataFrame) -> DataFrame:
    """key, doc of the rows their shard's filter may hold. A shard's filter goes to one place per
    ``ROWS_A_PLACE`` rows, a row to one of them; in a place the filter comes first."""
    places = written(
        refs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ROWS_A_PLACE).cast("int").alias("places")), "lines-places"
    )
    asked = refs.join(places, "shard").select(
        "shard", F.pmod(F.xxhash64("doc"), F.col("places")).cast("int").alias("salt"), F.lit(1).alias("kind"),
        "key", "doc", F.lit(None).cast("binary").alias("slots"), F.lit(None).cast("binary").alias("stash"),
    )
    told = filters.join(places, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("salt"), F.lit(0).alias("kind"),
        F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc"), "slots", "stash",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, None
        for batch in batches:
            shard, salt, kind = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("shard", "salt", "kind"))
            change = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1
            for start, stop in zip([0, *change], [*change, len(shard)]):
                if stop == start:
                    continue
                here = (shard[start], salt[start])
                if kind[start] == 0:
                    place = here
                    held = CuckooFilter.load(batch.column("slots")[int(start)].as_py(), batch.column("stash")[int(start)].as_py())
                elif place == here:
                    part = batch.slice(start, stop - start).select(["key", "doc"])
                    yield part.filter(pa.array(held.may_hold(part.column("key").to_pylist())))

    return (
        asked.unionByName(told).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        .mapInArrow(run, "key binary, doc long")
    )


def without_dropped(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that stays)."""
    per_doc = drops.groupBy("doc").agg(F.collect_list("key").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                lines_of, dropped, kept = [], [], []
                for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist()):
                    lines = (text or "").split("\n")
                    gone = set(gone or ())
                    stay = [line for line in lines if line_key(line) not in gone] if gone else lines
                    lines_of.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                    kept.append("\n".join(stay))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lines_of, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_lines", "n_dropped", "kept"],
                )

    return (
        bounded_batches(docs).select("doc_id", "text", _doc(F.col("doc_id")).alias("doc")).join(per_doc, "doc", "left")
        .select("doc_id", "text", "gone")
        .mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")
    )


def dedupe(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Index all documents and drop their frequent lines."""
    spark = docs.sparkSession
    shards = LEAST_SHARDS
    n_docs = docs.count()
    while shards * DOCS_A_SHARD < n_docs:
        shards *= 2
    index = LineIndex.empty(spark, shards, least_docs).insert(docs)
    return without_dropped(docs, index.drops(index.refs))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedupe(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), frequent AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last IS NOT NULL AND doc_id <> last) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent USING (key)
GROUP BY doc_id
"""
