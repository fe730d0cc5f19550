"""Exact deduplication by Grace hashing.

Two texts are equal when they are identical after lower-casing A-Z; a null text is an empty one.
Of equal texts the row with the largest doc_id stays (null is the smallest; of rows with equal
doc_id and text any one).

1. Each scan task first drops what it can see itself: an open-addressing table over the complete
   texts maps every row to one row of the task. So a text that fills a third of the corpus leaves
   a task once, not once per row.
2. The remaining records are partitioned by a hash of their text. The bytes per bucket are
   measured beforehand on (hash, length) rows only; buckets over ``BUCKET_BYTES`` are partitioned
   again with the next level's hash function, until every bucket fits or holds a single hash
   value. The partition files are Spark's shuffle files, sorted by bucket (the sorter spills what
   does not fit), so they are written once, outlive a lost task and cost no memory.
3. A task reads its buckets one after the other into an open-addressing table that compares
   complete texts, and empties it at each bucket's end. Copies take no room in the table.

Contract: an empty table gives no rows; extra columns, whatever their names, are kept by
``keep_one`` and ignored by ``copy_groups``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from turnsift.llm.texts import bounded_batches, text_slices
from turnsift.operators.durable import written

BUCKET_BYTES = 8 << 20
TASK_BYTES = 48 << 20
MAX_LEVELS = 16


class ContentTable:
    """Open addressing with linear probing; entries are equal only if their bytes are."""

    def __init__(self, slots: int = 256):
        self._slots = [-1] * slots
        self._hashes: list[int] = []
        self._contents: list[bytes] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self._contents)

    def put(self, value: int, content: bytes) -> tuple[int, bool]:
        """(number of the entry with this content, whether it is new)."""
        mask = len(self._slots) - 1
        at = value & mask
        while (entry := self._slots[at]) >= 0:
            if self._hashes[entry] == value and self._contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        self._slots[at] = entry = len(self._contents)
        self._hashes.append(value)
        self._contents.append(content)
        self.bytes += len(content) + 64
        if 2 * len(self._contents) > len(self._slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        self._slots = [-1] * (2 * len(self._slots))
        mask = len(self._slots) - 1
        for entry, value in enumerate(self._hashes):
            at = value & mask
            while self._slots[at] >= 0:
                at = (at + 1) & mask
            self._slots[at] = entry


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased (bytes.lower changes nothing else)."""
    return (text or "").encode().lower()


def text_hash(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content) - (1 << 63)


def _larger(a: int | None, b: int | None) -> bool:
    return b is None and a is not None or (a is not None and b is not None and a > b)


def _level_bucket(value: str, level: int, buckets: int):
    return F.pmod(F.xxhash64(F.col(value), F.lit(level)), F.lit(buckets)).cast("int")


def _levels(sizes: DataFrame, bucket_bytes: int, value: str) -> list[tuple[int, DataFrame | None]]:
    """Per level: number of buckets, and the buckets that go on to the next level."""
    plan = []
    pending = sizes
    for level in range(MAX_LEVELS):
        total = pending.agg(F.sum("n_bytes")).first()[0] or 0
        buckets = min(max(math.ceil(2 * total / bucket_bytes), 2 if level else 1), 1 << 30)
        dealt = pending.withColumn("bucket", _level_bucket(value, level, buckets))
        over = written(
            dealt.groupBy("bucket")
            .agg(F.sum("n_bytes").alias("total"), (F.min(value) < F.max(value)).alias("mixed"))
            .filter((F.col("total") > bucket_bytes) & F.col("mixed"))
            .select("bucket"),
            "grace-over",
        )
        if over.isEmpty() or level == MAX_LEVELS - 1:
            plan.append((buckets, None))
            break
        plan.append((buckets, over))
        pending = dealt.join(over, "bucket", "left_semi").drop("bucket")
    return plan


def _bucketed(records: DataFrame, value: str, plan, names: tuple[str, str]) -> DataFrame:
    """Records dealt to their final bucket: (level, bucket) of the first level where it fits."""
    level_name, bucket_name = names
    settled = None
    pending = records
    for level, (buckets, over) in enumerate(plan):
        dealt = pending.withColumn(level_name, F.lit(level)).withColumn(
            bucket_name, _level_bucket(value, level, buckets)
        )
        if over is not None:
            over = over.withColumnRenamed("bucket", bucket_name)
            pending = dealt.join(over, bucket_name, "left_semi").drop(level_name, bucket_name)
            dealt = dealt.join(over, bucket_name, "left_anti").select(*dealt.columns)
        settled = dealt if settled is None else settled.unionByName(dealt)
    return settled.repartition(level_name, bucket_name).sortWithinPartitions(level_name, bucket_name)


def _by_bucket(batches: Iterator[pa.RecordBatch], names) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether a new bucket starts, rows of one bucket) in the order read."""
    last = None
    for batch in batches:
        level, bucket = (batch.column(n).to_numpy(zero_copy_only=False) for n in names)
        key = level.astype(np.int64) << 32 | bucket
        cuts = np.flatnonzero(np.diff(key)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(key)]):
            if stop > start:
                yield last is not None and last != key[start], batch.slice(start, stop - start)
                last = key[start]


def _task_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """First pass of ``copy_groups``: a row for each document that names its text's first row in
    this task, and a row with the text for each distinct one."""
    table, firsts, best, counts = ContentTable(), [], [], []

    def texts() -> Iterator[pa.RecordBatch]:
        start = 0
        while start < len(table):
            stop, size = start, 0
            while stop < len(table) and (stop == start or size < (4 << 20)):
                size += len(table._contents[stop])
                stop += 1
            n = stop - start
            body = table._contents[start:stop]
            yield _spill_batch(
                row=[b[1] for b in best[start:stop]], doc_id=[b[0] for b in best[start:stop]],
                first=firsts[start:stop], digest=[None] * n, body=body,
                hash=table._hashes[start:stop], n_bytes=[len(b) for b in body], copies=counts[start:stop],
            )
            start = stop

    for batch in batches:
        for part in text_slices(batch):
            ids, rows = part.column("doc_id").to_pylist(), part.column("_row").to_pylist()
            own, digests = [], []
            for doc_id, row, text in zip(ids, rows, part.column("text").to_pylist()):
                content = normalised(text)
                entry, new = table.put(text_hash(content), content)
                if new:
                    firsts.append(row)
                    best.append((doc_id, row))
                    counts.append(1)
                else:
                    counts[entry] += 1
                    if _larger(doc_id, best[entry][0]):
                        best[entry] = (doc_id, row)
                own.append(firsts[entry])
                digests.append(hashlib.sha256(content).hexdigest())
            none = [None] * len(ids)
            yield _spill_batch(row=rows, doc_id=ids, first=own, digest=digests, body=none, hash=none,
                               n_bytes=none, copies=none)
        if table.bytes >= limit:
            yield from texts()
            table, firsts, best, counts = ContentTable(), [], [], []
    yield from texts()


_SPILL = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("digest", pa.string()),
    ("body", pa.binary()), ("hash", pa.int64()), ("n_bytes", pa.int64()), ("copies", pa.int64()),
])


def _spill_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=_SPILL)


def _bucket_groups(batches: Iterator[pa.RecordBatch], names) -> Iterator[pa.RecordBatch]:
    """Second pass of ``copy_groups``: what every distinct row of a task belongs to."""
    table, members, best, counts = ContentTable(), [], [], []

    def groups() -> pa.RecordBatch:
        out = [(m, *best[e], counts[e]) for e in range(len(table)) for m in members[e]]
        first, keep_id, keep_row, size = zip(*out) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (first, keep_id, keep_row, size)],
            ["first", "keep_id", "keep_row", "group_size"],
        )

    for fresh, part in _by_bucket(batches, names):
        if fresh:
            yield groups()
            table, members, best, counts = ContentTable(), [], [], []
        columns = (part.column(n).to_pylist() for n in ("hash", "body", "first", "doc_id", "row", "copies"))
        for value, body, first, doc_id, row, copies in zip(*columns):
            entry, new = table.put(value, body)
            if new:
                members.append([first])
                best.append((doc_id, row))
                counts.append(copies)
            else:
                members[entry].append(first)
                counts[entry] += copies
                if _larger(doc_id, best[entry][0]):
                    best[entry] = (doc_id, row)
    yield groups()


def copy_groups(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    names = ("_level", "_bucket")
    numbered = bounded_batches(docs).select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    spilled = written(
        numbered.mapInArrow(
            lambda batches: _task_groups(batches, task_bytes),
            "row long, doc_id long, first long, digest string, body binary, hash long, n_bytes long, copies long",
        ),
        "grace-records",
    )
    records = spilled.filter("body IS NOT NULL").drop("digest")
    sizes = spilled.filter("hash IS NOT NULL").groupBy("hash").agg(F.max("n_bytes").alias("n_bytes"))
    plan = _levels(sizes, bucket_bytes, "hash")
    groups = _bucketed(records, "hash", plan, names).mapInArrow(
        lambda batches: _bucket_groups(batches, names),
        "first long, keep_id long, keep_row long, group_size long",
    )
    return (
        spilled.filter("digest IS NOT NULL")
        .select("row", "doc_id", "first", "digest")
        .join(written(groups, "grace-groups"), "first")
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("row") == F.col("keep_row")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def _winners(batches: Iterator[tuple[bool, pa.RecordBatch]], limit: int | None, text: str, value: str | None,
             doc_id: str, drop: tuple[str, ...], out: str | None) -> Iterator[pa.RecordBatch]:
    """The row to keep of each distinct text, per bucket or per ``limit`` bytes."""
    table, best, held, held_bytes = ContentTable(), [], [], 0

    def chosen() -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
        by_batch: dict[int, list[tuple[int, int]]] = {}
        for entry, (_, number, at) in enumerate(best):
            by_batch.setdefault(number, []).append((at, entry))
        for number, picks in by_batch.items():
            picks.sort()
            yield held[number].take(pa.array([at for at, _ in picks], pa.int64())), picks

    def compact() -> list[pa.RecordBatch]:
        """Let go of the rows that lost against a later one."""
        fewer = []
        for rows, picks in list(chosen()):
            for at, (_, entry) in enumerate(picks):
                best[entry] = (best[entry][0], len(fewer), at)
            fewer.append(rows)
        return fewer

    def emit() -> Iterator[pa.RecordBatch]:
        for rows, picks in chosen():
            kept = [n for n in rows.schema.names if n not in drop]
            arrays = [rows.column(n) for n in kept]
            if out:
                kept.append(out)
                arrays.append(pa.array([table._hashes[e] for _, e in picks], pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, kept)

    for fresh, batch in batches:
        if fresh or (limit and table.bytes >= limit):
            yield from emit()
            table, best, held, held_bytes = ContentTable(), [], [], 0
        for part in text_slices(batch, text):
            ids = part.column(doc_id).to_pylist()
            hashes = part.column(value).to_pylist() if value else None
            used = False
            for at, (own, raw) in enumerate(zip(ids, part.column(text).to_pylist())):
                content = normalised(raw)
                entry, new = table.put(hashes[at] if hashes else text_hash(content), content)
                if new:
                    best.append((own, len(held), at))
                    used = True
                elif _larger(own, best[entry][0]):
                    best[entry] = (own, len(held), at)
                    used = True
            held.append(part if used else None)  # even an empty slice would keep the whole batch
            held_bytes += part.nbytes if used else 0
            if held_bytes > 2 * TASK_BYTES + table.bytes:
                held, held_bytes = compact(), 0
    yield from emit()


def keep_one(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows that stay, all columns as given. They come straight out of the buckets, so no
    text is moved twice."""
    value, level, bucket = (
        next(n for n in (f"_{x}", f"_grace_{x}", f"_grace_{x}_") if n not in docs.columns)
        for x in ("hash", "level", "bucket")
    )
    names = (level, bucket)
    with_hash = StructType([*docs.schema.fields, StructField(value, LongType())])
    records = bounded_batches(docs).mapInArrow(
        lambda batches: _winners(((False, b) for b in batches), task_bytes, "text", None, "doc_id", (), value),
        with_hash,
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = [normalised(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([text_hash(c) for c in contents], pa.int64()), pa.array([len(c) for c in contents], pa.int64())],
                [value, "n_bytes"],
            )

    sizes = written(
        docs.select("text").mapInArrow(
            measured, StructType([StructField(value, LongType()), StructField("n_bytes", LongType())])
        ).groupBy(value).agg(F.max("n_bytes").alias("n_bytes")),
        "grace-sizes",
    )
    dealt = _bucketed(records, value, _levels(sizes, bucket_bytes, value), names)
    return dealt.mapInArrow(
        lambda batches: _winners(_by_bucket(batches, names), None, "text", value, "doc_id", (value, *names), None),
        docs.schema,
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Lower-casing A-Z only, as a chain DuckDB and Spark agree on.
ORACLE = """
WITH t AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
