"""Merkle manifest of a dataset as a postorder append log.

A document's leaf is the digest of its five fields. Per language the leaves, ascending by doc_id,
are the bottom of a tree of runs of eight; the roots of the languages are the leaves of a last
tree. Builders take aligned spans of 512 leaves, so every span is a whole subtree. A builder reads
its leaves once and appends each node at the moment it is complete: that is the postorder, and
the root is the last entry. The roots of a tier of spans are the leaves of the next tier.

Nothing in the log says where a node is. A node (level, index) ends at leaf
``e = min((index + 1) * 8**level, n)``; on its own level and below, ``ceil(e / 8**l)`` nodes are
complete by then, above it all of them but its ancestor. Their sum is its position, in a span
(``position``) as in a whole tree (``log_nodes``). Proofs take the siblings from these positions:
inside a span from its log, above it from the path that the tier above hands down, one a span.

Contract. A null field counts as ``-``, any other as byte count, colon, value; an empty text is
``0:``. A null language is a tree of its own, a null doc_id comes first, equal doc_ids go by leaf
and equal rows in any order (each has its own place, so the result is one set of rows). Texts of
any length are hashed where they are read. An empty table has no root and gives no rows. Only the
five fields are read; other columns, whatever their names, do not matter.

Scale. Texts do not move: two digests a row do. Ranks come from ranges of (language, doc_id), so a
language with most rows is many tasks; a span has at most 512 rows. Only the root goes to the
driver. Every tier is a written table, so lost executors cost no more than their own tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from turnsift.llm.ranks import ranked
from turnsift.llm.texts import bounded_batches
from turnsift.operators.durable import written

FANOUT = 8
SPAN_LEVELS = 3
SPAN = FANOUT**SPAN_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX = 64
_PATH = "array<struct<before: string, after: string>>"


def node_digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while leaves > 1:
        leaves = -(-leaves // FANOUT)
        levels += 1
    return levels


def position(level: int, index: int, leaves: int, levels: int) -> int:
    """Place of a node in the postorder log of a tree of ``leaves`` leaves and ``levels`` levels."""
    end = min((index + 1) * FANOUT**level, leaves)
    return sum(-(-end // FANOUT**l) - (l > level) for l in range(levels + 1)) - 1


def append_log(leaves: list[str], levels: int) -> list[str]:
    """All nodes over ``leaves`` in the order in which they are complete."""
    log, open_runs = [], [[] for _ in range(levels + 1)]

    def close(level: int) -> None:
        done = node_digest(open_runs[level])
        open_runs[level].clear()
        log.append(done)
        open_runs[level + 1].append(done)

    for leaf in leaves:
        log.append(leaf)
        open_runs[0].append(leaf)
        level = 0
        while level < levels and len(open_runs[level]) == FANOUT:
            close(level)
            level += 1
    for level in range(levels):
        if open_runs[level]:
            close(level)
    return log


@lru_cache(maxsize=4 * SPAN)
def _places(leaves: int, levels: int) -> list[list[int]]:
    """Per level the log positions of its nodes."""
    return [
        [position(level, i, leaves, levels) for i in range(-(-leaves // FANOUT**level))]
        for level in range(levels + 1)
    ]


def sibling_path(log: list[str], leaves: int, levels: int, leaf: int) -> list[tuple[str, str]]:
    """Per level, from the leaf up: the siblings before and behind, each joined left to right."""
    path = []
    for level, places in enumerate(_places(leaves, levels)[:levels]):
        index = leaf // FANOUT**level
        start = index - index % FANOUT
        run = places[start : start + FANOUT]
        at = index - start
        path.append(("".join(log[p] for p in run[:at]), "".join(log[p] for p in run[at + 1 :])))
    return path


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        digest = sha256(f"{before}{digest}{after}".encode()).hexdigest()
    return digest


def _span_levels(leaves: int) -> int:
    """Levels of a span in a tier of ``leaves``: a tier of one span ends where one node is left."""
    return height(leaves) if leaves <= SPAN else SPAN_LEVELS


@dataclass(frozen=True)
class Manifest:
    """``tiers`` and ``top``: written span tables (tree, block, tier_leaves, rows, log), bottom first.
    ``subroots``: tree, rank, digest. ``root`` is None without documents."""

    tiers: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: str | None


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """Leaf of a row of documents whose text is ``text``."""
    return F.sha2(F.concat(*(_field(F.col(c)) for c in FIELDS[:-1]), _field(text)), 256)


def document_leaves(docs: DataFrame, changed: Column | None = None, changed_text: Column | None = None) -> DataFrame:
    """tree, doc_id, digest and, where ``changed``, the digest over ``changed_text``."""
    other = F.lit(None).cast("string")
    if changed is not None:
        other = F.when(changed, leaf_digest(changed_text))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree"),
        "doc_id",
        leaf_digest(F.col("text")).alias("digest"),
        other.alias("other"),
    )


def _logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("rows")
        at = rows.offsets.to_pylist()
        digests = rows.values.field("digest").to_pylist()
        logs = [
            "".join(append_log(digests[at[i] : at[i + 1]], _span_levels(n)))
            for i, n in enumerate(batch.column("tier_leaves").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(logs, pa.string())], [*batch.schema.names, "log"]
        )


def _tier(leaves: DataFrame, name: str) -> DataFrame:
    """Spans over leaves (tree, rank, tier_leaves, digest and whatever else comes with them)."""
    own = [c for c in leaves.columns if c not in ("tree", "rank", "tier_leaves")]
    spans = leaves.groupBy(
        "tree", F.floor(F.col("rank") / SPAN).alias("block"), "tier_leaves"
    ).agg(F.sort_array(F.collect_list(F.struct("rank", *own))).alias("rows"))
    schema = T.StructType([*spans.schema, T.StructField("log", T.StringType())])
    return written(bounded_batches(spans).mapInArrow(_logs, schema), name)


def _tree(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All tiers over the leaves, and tree, digest of every root."""
    tiers, roots = [], None
    last = F.expr(f"right(log, {_HEX})").alias("digest")
    while True:
        tier = _tier(leaves, f"{name}-{len(tiers)}")
        tiers.append(tier)
        ended = tier.filter(f"tier_leaves <= {SPAN}").select("tree", last)
        roots = ended if roots is None else roots.unionByName(ended)
        going = tier.filter(f"tier_leaves > {SPAN}")
        if going.isEmpty():
            return tiers, roots
        leaves = going.select(
            "tree", F.col("block").alias("rank"),
            F.ceil(F.col("tier_leaves") / SPAN).cast("long").alias("tier_leaves"), last,
        )


def manifest(leaves: DataFrame) -> Manifest:
    """Build all trees over ``document_leaves``."""
    stored = written(leaves, "merkle-leaves")
    placed = ranked(stored, "tree", ["doc_id", "digest"], "merkle-ranges")
    tiers, roots = _tree(placed.withColumnRenamed("group_rows", "tier_leaves"), "merkle-tier")
    named = written(roots.select(F.lit("*").alias("all"), "tree", "digest"), "merkle-roots")
    # "-" (null) sorts before "=" and all names
    subroots = written(ranked(named, "all", ["tree"], "merkle-root-ranges"), "merkle-subroots")
    top, ends = _tree(
        subroots.select(F.col("all").alias("tree"), "rank", F.col("group_rows").alias("tier_leaves"), "digest"),
        "merkle-top",
    )
    end = ends.first()
    return Manifest(tiers, top, subroots.select("tree", "rank", "digest"), end and end.digest)


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"tree": [], "rank": [], "path": []}
        for row in batch.to_pylist():
            inside = [(row["log"][i : i + _HEX]) for i in range(0, len(row["log"]), _HEX)]
            levels = _span_levels(row["tier_leaves"])
            for i in range(row["n"]):
                own = [{"before": b, "after": a} for b, a in sibling_path(inside, row["n"], levels, i)]
                out["tree"].append(row["tree"])
                out["rank"].append(row["block"] * SPAN + i)
                out["path"].append(own + row["path"])
        pair = pa.struct([("before", pa.string()), ("after", pa.string())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["tree"], pa.string()), pa.array(out["rank"], pa.int64()), pa.array(out["path"], pa.list_(pair))],
            ["tree", "rank", "path"],
        )


def _paths(tiers: list[DataFrame], of_roots: DataFrame, name: str) -> DataFrame:
    """tree, rank, path: siblings from the root of every bottom span up; ``of_roots`` has tree, path."""
    above = None
    for k, tier in reversed(list(enumerate(tiers))):
        alone = tier.filter(f"tier_leaves <= {SPAN}").select("tree", F.col("block").alias("rank"))
        paths = alone.join(of_roots, "tree")
        if above is not None:
            paths = paths.unionByName(above)
        if k == 0:
            return paths
        spans = tier.select("tree", F.col("block").alias("rank"), "block", "tier_leaves", "log", F.size("rows").alias("n"))
        above = written(
            bounded_batches(spans.join(paths, ["tree", "rank"]).drop("rank")).mapInArrow(
                _handed_down, f"tree string, rank long, path {_PATH}"
            ),
            f"{name}-{k}",
        )
    raise AssertionError("a tree has a tier")


def _proven(batches: Iterator[pa.RecordBatch], with_path: bool) -> Iterator[pa.RecordBatch]:
    pair = pa.struct([("before", pa.string()), ("after", pa.string())])
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            cell = {c: row.column(c)[0].as_py() for c in ("tier_leaves", "log", "path")}
            rows = row.column("rows").flatten()
            digests, others = rows.field("digest").to_pylist(), rows.field("other").to_pylist()
            log = [cell["log"][i : i + _HEX] for i in range(0, len(cell["log"]), _HEX)]
            levels = _span_levels(cell["tier_leaves"])
            upper = [(p["before"], p["after"]) for p in cell["path"]]
            upper_text = "".join(b + a for b, a in upper)
            ends: dict[str, str] = {}
            proofs, folded, paths = [], [], []
            for i, (digest, other) in enumerate(zip(digests, others, strict=True)):
                own = sibling_path(log, len(digests), levels, i)
                proofs.append(sha256(("".join(b + a for b, a in own) + upper_text).encode()).hexdigest())
                reached = fold(other or digest, own)
                if reached not in ends:
                    ends[reached] = fold(reached, upper)
                folded.append(ends[reached])
                if with_path:
                    paths.append([{"before": b, "after": a} for b, a in own + upper])
            columns = [rows.field("doc_id"), rows.field("digest"), pa.array(proofs, pa.string()), pa.array(folded, pa.string())]
            names = ["doc_id", "leaf", "proof_sha256", "folded_root"]
            for name in ("tree", "subroot"):
                columns.append(pa.array([row.column(name)[0].as_py()] * len(digests), pa.string()))
                names.append(name)
            if with_path:
                columns.append(pa.array(paths, pa.list_(pair)))
                names.append("path")
            yield pa.RecordBatch.from_arrays(columns, names)


def proofs(built: Manifest, with_path: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, tree and, if wanted, the
    siblings themselves (``path``). What is folded is the changed leaf where there is one."""
    bottom = built.tiers[0]
    session = bottom.sparkSession
    kind = bottom.schema["rows"].dataType.elementType["doc_id"].dataType.simpleString()
    none = session.createDataFrame([("*", [])], f"tree string, path {_PATH}")
    spans = _paths(built.top, none, "merkle-top-paths")
    at_top = built.top[0].select("tree", F.col("block").alias("rank"), "block", "tier_leaves", "log", F.size("rows").alias("n"))
    of_roots = bounded_batches(at_top.join(spans, ["tree", "rank"]).drop("rank")).mapInArrow(
        _handed_down, f"tree string, rank long, path {_PATH}"
    )
    of_trees = written(
        built.subroots.join(of_roots.drop("tree"), "rank").select("tree", F.col("digest").alias("subroot"), "path"),
        "merkle-tree-paths",
    )
    paths = _paths(built.tiers, of_trees.select("tree", "path"), "merkle-paths")
    ready = bottom.withColumnRenamed("block", "rank").join(paths, ["tree", "rank"])
    ready = ready.join(of_trees.select("tree", "subroot"), "tree")
    shape = f"doc_id {kind}, leaf string, proof_sha256 string, folded_root string, tree string, subroot string"
    found = bounded_batches(ready).mapInArrow(
        partial(_proven, with_path=with_path), shape + (f", path {_PATH}" if with_path else "")
    )
    return found.select(
        "doc_id", "leaf", "subroot", F.lit(built.root).cast("string").alias("root"), "proof_sha256",
        "folded_root", (F.col("folded_root") == F.lit(built.root)).alias("verified"), "tree",
        *(["path"] if with_path else []),
    )


def log_nodes(built: Manifest) -> DataFrame:
    """tree, position, level, node, digest of every node of the language trees; ``position`` is the
    place in the postorder log of the whole tree, again in closed form."""
    whole = built.tiers[0].select("tree", F.col("tier_leaves").alias("leaves")).distinct()
    parts = [
        tier.select("tree", "block", "tier_leaves", "log", F.size("rows").alias("n"), F.lit(k).alias("tier"))
        for k, tier in enumerate(built.tiers)
    ]
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part)
    return bounded_batches(spans.join(whole, "tree")).mapInArrow(
        _listed, "tree string, position long, level int, node long, digest string"
    )


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            base, top = row["tier"] * SPAN_LEVELS, height(row["leaves"])
            levels = _span_levels(row["tier_leaves"])
            for level, places in enumerate(_places(row["n"], levels)):
                if level == 0 and row["tier"]:
                    continue  # the roots of the tier below
                for i, at in enumerate(places):
                    index = row["block"] * FANOUT ** (SPAN_LEVELS - level) + i
                    place = position(base + level, index, row["leaves"], top)
                    out.append((row["tree"], place, base + level, index, row["log"][at * _HEX : (at + 1) * _HEX]))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["tree", "position", "level", "node", "digest"],
        )


def tampered(doc_id: Column) -> Column:
    """Rows of the query whose text is changed; a null doc_id never is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaves = document_leaves(docs, tampered(F.col("doc_id")), F.translate("text", _UPPER, _LOWER))
    return proofs(manifest(leaves)).drop("tree")


_CRC32 = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS varchar), ''), lambda c: CAST(ascii(c) AS bigint)),
    lambda state, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
      lambda s, bit: xor(s >> 1, (s & 1) * 3988292384), xor(state, byte)), CAST(4294967295 AS bigint)))"""
ORACLE = """
WITH RECURSIVE fields AS (
  SELECT doc_id, text, coalesce('=' || lang, '-') AS tree,
    coalesce(strlen(CAST(doc_id AS varchar)) || ':' || doc_id, '-')
      || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS varchar)) || ':' || n_chars, '-') AS head
  FROM documents),
leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '-')) AS other
  FROM fields),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    row_number() OVER () AS row_id
  FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, place AS idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM ordered
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 8, n),
subroots AS (
  SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place AS idx, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8
  FROM tops WHERE n > 1 GROUP BY level, idx // 8, n),
everything AS (
  SELECT tree, level, idx, digest, n FROM nodes
  UNION ALL SELECT '*', level, idx, digest, n FROM tops),
siblings AS (
  SELECT a.tree, a.level, a.idx,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM everything a JOIN everything b ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.idx),
below AS (
  SELECT row_id, tree, 0 AS level, place AS idx, '' AS proof,
    CASE WHEN coalesce(CRC % 3 = 0, false) THEN other ELSE leaf END AS digest
  FROM ordered
  UNION ALL
  SELECT row_id, tree, b.level + 1, b.idx // 8, proof || before || after, sha256(before || digest || after)
  FROM below b JOIN siblings s USING (tree, level, idx)),
above AS (
  SELECT row_id, 0 AS level, s.place AS idx, proof, digest
  FROM below b JOIN subroots s ON b.tree = s.tree AND b.level = s.height
  UNION ALL
  SELECT row_id, a.level + 1, a.idx // 8, proof || before || after, sha256(before || digest || after)
  FROM above a JOIN siblings s ON s.tree = '*' AND a.level = s.level AND a.idx = s.idx),
root AS (SELECT digest AS root, level AS height FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM above JOIN root ON above.level = root.height JOIN ordered USING (row_id) JOIN subroots USING (tree)
""".replace("CRC", _CRC32)
