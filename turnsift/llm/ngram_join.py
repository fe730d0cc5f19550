"""N-gram Jaccard self-join by prefixes of document groups, and its connected components.

A document's set holds its distinct five-word shingles (with fewer words, the whole sequence as
one). Two documents link when 100 * intersection >= 80 * union.

1. Order. Any common order of shingles makes the prefix filter exact; rare shingles first makes
   it cheap. A counter array of fixed size (``ORDER_BITS``) counts all shingles of the corpus;
   shingles sort by their counter's logarithm, then by hash.
2. Groups. Documents with equal sets collapse into one, and those with equal prefix and size
   into one group. Only a group's prefix, n - ceil(0.8 n) + 1 shingles, is exploded.
3. Group pairs. Groups meet at a shared prefix shingle. With ``need`` the smallest intersection
   two sizes allow, both positions must be at most n - need; the first shared shingle of any
   link satisfies this, so no link is lost, and it implies the size filter.
4. Members. Surviving group pairs expand to members. A pair can only link if its prefixes share
   enough: with s shared prefix shingles the intersection is at most s + max(n - p) over both
   sides, p being the prefix length. What is left is verified on whole sets.

Large groups of near copies are not paired off. First every bucket only meets one leader, the
group that holds the shingle earliest in its prefix (an edited copy has shingles of its own before
it, its original does not), and what links gets a common label. That is repeated with random
leaders while it links enough; then all remaining pairs of *different* labels are tested, so
components are exact.

Contract: one row per input row. Without words or text the set is empty and linked with nothing;
component_id is then the row's own doc_id. Rows with equal doc_id are separate rows. A null
doc_id counts for links but not as a component's smallest id, unless there is no other. An empty
table gives no rows. Only doc_id and text are read; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnsift.llm.linking import merge
from turnsift.llm.texts import bounded_batches, shingles, text_slices, word_hashes
from turnsift.operators.durable import written

WIDTH = 5
SIMILAR = (80, 100)
ORDER_BITS = 20
#: Bits of the filter that picks the documents whose sets a round needs.
WANTED_BITS = 23
#: A leader round that adds a smaller share of links than this is the last one.
LEAST_GAIN = 0.1

_BLOCKS = 256
_LONG = pa.list_(pa.int64())


def _shingle_classes(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """Per counter eight times the binary logarithm of the number of shingles it counts."""
    size = 1 << bits
    step = size // _BLOCKS

    def blocks(counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(range(_BLOCKS), pa.int32()), pa.array([counts[b * step : (b + 1) * step].tobytes() for b in range(_BLOCKS)])],
            ["block", "counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for part in text_slices(batch):
                value, _ = shingles(*word_hashes(part.column(0)), width)
                counts += np.bincount((value & np.uint64(size - 1)).astype(np.int64), minlength=size)
        yield blocks(counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(raw, np.int64)
        if sums:
            classes = [np.rint(8 * np.log2(1.0 + s)).clip(0, 511).astype(np.uint16).tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(classes)], ["block", "counts"])

    found = (
        docs.select("text").mapInArrow(count, "block int, counts binary")
        .repartition("block").mapInArrow(add, "block int, counts binary")
    )
    out = np.zeros(size, np.uint16)
    for row in found.collect():  # always 2 bytes a counter in all
        out[row.block * step : (row.block + 1) * step] = np.frombuffer(row.counts, np.uint16)
    return out


def _digests(value: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    out = []
    for start, stop in zip(rows[:-1], rows[1:]):
        both = xxhash.xxh3_128_intdigest(value[start:stop].tobytes())
        out.append(((both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)))
    return out


def _prefixes(docs: DataFrame, classes, width: int, similar: tuple[int, int]) -> DataFrame:
    """doc_id, n, set digest, prefix in the common order."""
    part_of, whole = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        mask = np.uint64(len(table) - 1)
        for batch in batches:
            for part in text_slices(batch):
                value, rows = shingles(*word_hashes(part.column("text")), width)
                n = np.diff(rows)
                digests = _digests(value, rows)
                owner = np.repeat(np.arange(len(n)), n)
                value = value[np.lexsort((value, table[(value & mask).astype(np.int64)], owner))]
                length = np.where(n > 0, n - -(-part_of * n // whole) + 1, 0)
                chosen = np.arange(len(value)) - np.repeat(rows[:-1], n) < np.repeat(length, n)
                offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(n, pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[chosen].view(np.int64))),
                    ],
                    ["doc_id", "n", "d1", "d2", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, d1 long, d2 long, prefix array<long>"
    )


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << WANTED_BITS))


def _marks(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap of fixed size over the hashes of the keys."""
    at = _slot(F.col(key)) + 1  # Spark's bitmaps start at one
    rows = (
        keys.groupBy(F.bitmap_bucket_number(at).alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        .collect()
    )
    out = np.zeros((1 << WANTED_BITS) // 8 + 4096, np.uint8)
    for row in rows:
        out[(row.block - 1) * 4096 : row.block * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def _marked(batch: pa.RecordBatch, marks: np.ndarray) -> pa.RecordBatch:
    """Rows whose slot is marked: all wanted ones and a few others."""
    at = batch.column("slot").to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """gid, n, set of the wanted groups' members, read again from the texts."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_marks(wanted, "low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for batch in batches:
            for part in text_slices(_marked(batch, bits.value)):
                value, rows = shingles(*word_hashes(part.column("text")), width)
                digests = _digests(value, rows)
                fresh = []
                for i, digest in enumerate(digests):
                    if rows[i] < rows[i + 1] and digest not in told:
                        told.add(digest)
                        fresh.append(i)
                if len(told) > 200_000:
                    told.clear()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([digests[i][0] for i in fresh], pa.int64()),
                        pa.array([digests[i][1] for i in fresh], pa.int64()),
                        pa.array([value[rows[i] : rows[i + 1]].view(np.int64) for i in fresh], _LONG),
                    ],
                    ["d1", "d2", "items"],
                )

    found = docs.select(_slot(F.col("doc_id")).alias("slot"), "text").mapInArrow(
        run, "d1 long, d2 long, items array<long>"
    )
    return written(
        found.groupBy("d1", "d2").agg(F.first("items").alias("items"))
        .join(wanted.select("gid", "d1", "d2"), ["d1", "d2"]).select("gid", "items"),
        "jaccard-sets",
    )


def _promising(found: DataFrame, pairs: DataFrame, ends: DataFrame, similar) -> DataFrame:
    """Pairs whose prefixes share enough for a link."""
    bits = found.sparkSession.sparkContext.broadcast(_marks(ends, "gid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _marked(batch, bits.value).select(["gid", "n", "prefix"])

    prefixes = written(
        found.select(_slot(F.col("gid")).alias("slot"), "gid", "n", "prefix").mapInArrow(
            run, "gid long, n long, prefix array<long>"
        ),
        "jaccard-ends",
    )
    sides = [
        prefixes.select(F.col("gid").alias(end), F.col("n").alias(f"{end}_n"), F.col("prefix").alias(f"{end}_prefix"))
        for end in ("a", "b")
    ]
    rest = F.greatest(F.col("a_n") - F.size("a_prefix"), F.col("b_n") - F.size("b_prefix"))
    need = F.ceil(similar[0] * (F.col("a_n") + F.col("b_n")) / (similar[0] + similar[1]))
    return (
        pairs.join(sides[0], "a").join(sides[1], "b")
        .filter(F.size(F.array_intersect("a_prefix", "b_prefix")) + rest >= need)
        .select("a", "b")
    )


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("gid")).union(pairs.select("b")).distinct()


def _links(docs: DataFrame, found: DataFrame, pairs: DataFrame, members: DataFrame, width: int, similar) -> DataFrame:
    """The pairs that link."""
    pairs = written(pairs, "jaccard-pairs")
    if pairs.isEmpty():
        return pairs
    pairs = written(_promising(found, pairs, _ends(pairs), similar), "jaccard-promising")
    if pairs.isEmpty():
        return pairs
    sets = _sets(docs, written(members.join(_ends(pairs), "gid", "left_semi"), "jaccard-wanted"), width)
    both = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - both
    linked = (
        pairs.join(sets.select(F.col("gid").alias("a"), F.col("items").alias("left")), "a")
        .join(sets.select(F.col("gid").alias("b"), F.col("items").alias("right")), "b")
        .filter(similar[1] * both >= similar[0] * union)
        .select("a", "b")
    )
    return written(linked, "jaccard-links")


def _possible(a: str, b: str, similar) -> Column:
    """Whether two prefix rows can be the first shared shingle of a link."""
    part_of, whole = similar
    sizes = F.col(f"{a}_n") + F.col(f"{b}_n")
    need = F.ceil(part_of * sizes / (part_of + whole))
    return (F.col(f"{a}_pos") <= F.col(f"{a}_n") - need) & (F.col(f"{b}_pos") <= F.col(f"{b}_n") - need)


def _named(df: DataFrame, to: str) -> DataFrame:
    return df.select("token", *[F.col(c).alias(f"{to}_{c}") for c in ("grp", "n", "pos", "label")])


def _labelled(rows: DataFrame, members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefix rows with their group's label, members with theirs). A group without links is its
    own label; one whose members differ has a label that no other group has."""
    own = written(
        members.select("gid", "grp").join(labels.withColumnRenamed("vertex", "gid"), "gid", "left")
        .withColumn("linked", F.col("label").isNotNull()).withColumn("label", F.coalesce("label", "gid")),
        "jaccard-labels",
    )
    groups = own.groupBy("grp").agg(
        F.when(F.min("label") == F.max("label"), F.min("label")).otherwise(-1 - F.col("grp")).alias("label"),
        F.bool_or("linked").alias("linked"),
    )
    groups = written(groups.filter("linked").drop("linked"), "jaccard-group-labels")
    labelled = rows.select("token", "grp", "n", "pos").join(groups, "grp", "left")
    return labelled.withColumn("label", F.coalesce("label", "grp")), own.drop("linked")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _met_members(met: DataFrame, own: DataFrame) -> DataFrame:
    """Member pairs of leading groups (l_grp) and the groups they may link with (x_grp), and of
    each group's first member and its other members. Only a group's first member leads."""
    member = own.select(F.col("grp").alias("x_grp"), F.col("gid").alias("b"), F.col("label").alias("b_label"))
    first = own.filter("gid = grp").select(
        F.col("gid").alias("l_grp"), F.col("gid").alias("a"), F.col("label").alias("a_label")
    )
    across = met.join(member, "x_grp").join(first, "l_grp").filter("a_label <> b_label").select("a", "b")
    inside = member.filter("x_grp <> b").join(first, F.col("x_grp") == F.col("l_grp")).filter(
        "a_label <> b_label"
    ).select("a", "b")
    return _ordered(across.union(inside))


def _leader_pairs(rows: DataFrame, own: DataFrame, turn: int, similar) -> DataFrame:
    """Pairs with a random leader of every bucket that holds several labels."""
    score = F.struct(F.xxhash64("grp", F.lit(turn)), "grp")
    leaders = written(
        rows.groupBy("token").agg(
            F.max_by(F.struct("grp", "n", "pos", "label"), score).alias("top"),
            (F.min("label") < F.max("label")).alias("live"),
        ).filter("live").select("token", "top.*"),
        "jaccard-leaders",
    )
    met = (
        _named(rows, "x").join(_named(leaders, "l"), "token")
        .filter((F.col("x_label") != F.col("l_label")) & _possible("x", "l", similar))
        .select("l_grp", "x_grp").distinct()
    )
    return _met_members(met, own)


def _other_pairs(rows: DataFrame, own: DataFrame, similar) -> DataFrame:
    """All member pairs with different labels that the filters leave. In a bucket only rows
    outside its most frequent label look for partners."""
    top = written(
        rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
        .filter("labels > 1").drop("labels"),
        "jaccard-tops",
    )
    live = written(rows.join(top, "token"), "jaccard-live")
    met = (
        _named(live.filter("label <> top"), "x")
        .join(_named(live, "y").join(top, "token"), "token")
        .filter(
            (F.col("x_label") != F.col("y_label"))
            & ((F.col("y_label") == F.col("top")) | (F.col("x_grp") < F.col("y_grp")))
            & _possible("x", "y", similar)
        )
        .select("x_grp", "y_grp").distinct()
    )
    left = own.select(F.col("grp").alias("x_grp"), F.col("gid").alias("a"), F.col("label").alias("a_label"))
    right = own.select(F.col("grp").alias("y_grp"), F.col("gid").alias("b"), F.col("label").alias("b_label"))
    across = met.join(left, "x_grp").join(right, "y_grp").filter("a_label <> b_label").select("a", "b")
    inside = left.join(right, F.col("x_grp") == F.col("y_grp")).filter(
        (F.col("a") < F.col("b")) & (F.col("a_label") != F.col("b_label"))
    ).select("a", "b")
    return _ordered(across.union(inside))


def near_copies(
    docs: DataFrame,
    width: int = WIDTH,
    similar: tuple[int, int] = SIMILAR,
    order_bits: int = ORDER_BITS,
    least_gain: float = LEAST_GAIN,
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    spark = bounded_batches(docs).sparkSession
    classes = spark.sparkContext.broadcast(_shingle_classes(docs, width, order_bits))
    found = written(
        _prefixes(docs, classes, width, similar).withColumn("gid", F.monotonically_increasing_id()),
        "jaccard-prefixes",
    )
    distinct = (
        found.filter("n > 0")
        .select("gid", "doc_id", "n", "d1", "d2", F.xxhash64("prefix").alias("p1"),
                F.xxhash64(F.lit(1), "prefix").alias("p2"))
        .groupBy("d1", "d2")
        .agg(F.min("gid").alias("gid"), F.min("doc_id").alias("low"), F.first("n").alias("n"),
             F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    )
    distinct = written(distinct, "jaccard-distinct")
    groups = distinct.groupBy("n", "p1", "p2").agg(F.min("gid").alias("grp"))
    members = written(
        distinct.join(written(groups, "jaccard-groups"), ["n", "p1", "p2"]).select("gid", "grp", "d1", "d2", "low"),
        "jaccard-members",
    )
    heads = members.filter("gid = grp").select("gid")
    bucket = Window.partitionBy("token")
    earliest = F.first(F.struct("grp", "n", "pos")).over(bucket.orderBy("pos", "grp"))
    rows = written(
        found.select("gid", "n", "prefix").join(heads, "gid")
        .select(F.col("gid").alias("grp"), "n", F.posexplode("prefix").alias("pos", "token"))
        .withColumn("top", earliest).withColumn("held", F.count(F.lit(1)).over(bucket))
        .filter("held > 1").drop("held"),
        "jaccard-rows",
    )

    flat = rows.select(
        F.col("grp").alias("x_grp"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"),
        *[F.col(f"top.{c}").alias(f"l_{c}") for c in ("grp", "n", "pos")],
    )
    met = flat.filter((F.col("x_grp") != F.col("l_grp")) & _possible("x", "l", similar)).select("l_grp", "x_grp")
    links = _links(
        docs, found, _met_members(met.distinct(), members.withColumn("label", F.col("gid"))), members, width, similar
    )
    labels, linked, turn = merge(None, links), links.count(), 0
    gained = linked
    while gained > least_gain * linked:
        turn += 1
        buckets, own = _labelled(rows, members, labels)
        links = _links(docs, found, _leader_pairs(buckets, own, turn, similar), members, width, similar)
        gained = links.count()
        linked += gained
        labels = merge(labels, links)
    buckets, own = _labelled(rows, members, labels)
    links = _links(docs, found, _other_pairs(buckets, own, similar), members, width, similar)
    labels = merge(labels, links)

    own = members.join(labels.withColumnRenamed("vertex", "gid"), "gid", "left").withColumn(
        "label", F.coalesce("label", "gid")
    )
    own = written(own.select("d1", "d2", "low", "label"), "jaccard-labels")
    lowest = written(own.groupBy("label").agg(F.min("low").alias("component_id")), "jaccard-components")
    component = written(own.join(lowest, "label").select("d1", "d2", "component_id"), "jaccard-components")
    linked = found.filter("n > 0").select("doc_id", "n", "d1", "d2").join(component, ["d1", "d2"])
    alone = found.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        alone.withColumnRenamed("n", "n_shingles")
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id. Columns as given. Rows
    with the same doc_id are one document; rows without doc_id cannot be named and stay."""
    gone = written(
        near_copies(docs, **options).filter("doc_id <> component_id").select("doc_id").distinct(),
        "jaccard-dropped",
    )
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
