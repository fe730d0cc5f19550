"""Links between similar vectors, without comparing what cannot be similar."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from turnsift.functions.grams import cosine
from turnsift.operators.components import connected_components
from turnsift.operators.durable import durable, written

#: Rows of a node that is not split any further, and of a random block.
BLOCK_ROWS = 2_048
#: Rows of one task while nodes are split.
PART_ROWS = 2_048
#: Rows of a group; a task compares two groups.
GROUP_ROWS = 8_192
#: Times that all rows meet in random blocks.
ROUNDS = 2
#: Children of a node: one hexadecimal digit of a path.
FAN = 16

_SLACK = 1e-6
_TIE = 1e-7
_DRAWN = 4 * FAN
#: Rows that meet all others of a task at once; bounds the arrays of their cosines.
_AT_ONCE = 64


def similar_links(
    vectors: DataFrame, at_least: float, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Edges (src, dst) whose connected components are those of "cosine >= at_least".

    ``vectors`` has unique string ``id`` and unit ``vector``. Equal vectors are linked to one
    of them and compared once. The rest is dealt to a tree of balls: every node of more than
    ``block_rows`` rows draws up to ``FAN`` of its own rows as pivots, its rows go to the nearest
    pivot, and the node's children are what the pivots got. The tree grows with the data, level by
    level; a node is split by as many tasks as its rows need, and its path is the key.

    A pivot is a row, so rows similar to it are linked on the way down, one edge per group of
    similar pivots. Rows of a leaf meet in that leaf, and all rows meet in a few rounds of random blocks;
    what these links connect has one label. Rows of one label need no comparison, so a crowd of near
    copies, or the one large component of many similar rows, is never compared with itself.

    The rest is exact: rows are put into groups by label and, where labels are small, by their place in
    the tree, and all pairs of groups that are of different labels and not too far apart, by the
    triangle inequality, are compared. A task holds two groups and returns a spanning forest of their
    labels. A row moves once per group it is compared with, not once per similar row or leaf.
    """
    keyed = durable(
        vectors.select("id", "vector", F.sha2(F.to_json(F.struct("vector")), 256).alias("key"))
    )
    unique = durable(
        keyed.groupBy("key").agg(F.min_by("vector", "id").alias("vector"), F.min("id").alias("id"))
    )
    copies = (
        keyed.select("key", F.col("id").alias("dst"))
        .join(unique.select("key", F.col("id").alias("src")), "key")
        .filter(F.col("src") != F.col("dst"))
        .select("src", "dst")
    )
    leaves, edges = _grown(unique.select("id", "vector"), float(at_least), block_rows)
    if not edges:
        return copies.unionByName(_blocks_forest(leaves, F.col("node"), at_least))
    rows = _labelled(leaves, edges, at_least, block_rows)
    known = rows.select(F.col("label").alias("src"), F.col("id").alias("dst")).filter("src <> dst")
    return copies.unionByName(known).unionByName(_across(_grouped(rows, group_rows), at_least))


def _sized(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows")), "tree-sizes")


def _parts(size: Column) -> Column:
    return F.ceil(size / PART_ROWS).cast("int")


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add the part of its node that a row is handled in."""
    part = F.pmod(F.xxhash64("id", F.lit("part")), _parts(F.col("rows"))).cast("int")
    return rows.join(sizes, "node").withColumn("part", part).drop("rows")


def _each_part(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    return nodes.join(sizes, "node").withColumn(
        "part", F.explode(F.sequence(F.lit(0), _parts(F.col("rows")) - 1))
    ).drop("rows")


def _grown(unique: DataFrame, at_least: float, block_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """(leaves: id, vector, node; per level the edges to pivots)."""
    rows = unique.select("id", "vector", F.lit("").alias("node"))
    leaves, edges = [], []
    while True:
        sizes = _sized(rows)
        large = sizes.filter(F.col("rows") > block_rows)
        if large.isEmpty():
            leaves.append(rows)
            return reduce(DataFrame.unionByName, leaves), edges
        if edges:
            leaves.append(rows.join(large, "node", "left_anti").select(*rows.columns))
        draw = F.pmod(F.xxhash64("id", F.lit(len(edges))), F.lit(1 << 30))
        pivots = written(
            rows.select("node", "id", "vector", draw.alias("draw")).join(large, "node")
            .filter(F.col("draw") * F.col("rows") < F.lit(_DRAWN << 30))
            .groupBy("node").agg(F.sort_array(F.collect_list(F.struct("draw", "id", "vector"))).alias("drawn"))
            .select("node", F.slice("drawn", 1, FAN).alias("drawn"))
            .select("node", F.col("drawn.id").alias("ids"), F.col("drawn.vector").alias("vectors")),
            "tree-pivots",
        )
        split = written(
            _dealt(rows, large).groupBy("node", "part")
            .cogroup(_each_part(pivots, large).groupBy("node", "part"))
            .applyInPandas(_split(at_least), "id string, vector array<double>, node string, links array<string>"),
            "tree-rows",
        )
        edges.append(
            split.select(F.col("id").alias("src"), F.explode("links").alias("dst")).filter("src <> dst")
        )
        rows = split.select(*rows.columns)


def _stacked(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in vectors])


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos((_unit(vectors) @ _unit(pivots).T).clip(-1.0, 1.0))


def _groups(near: np.ndarray) -> np.ndarray:
    """The smallest member of every row's component of a small similarity matrix."""
    group = np.arange(len(near))
    while True:
        lower = np.where(near, group[None, :], len(near)).min(axis=1).clip(max=group)
        if (lower == group).all():
            return group
        group = lower


def _split(at_least: float):
    def split(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "vector", "node", "links"]
        if not len(rows) or not len(pivots):
            return pd.DataFrame(columns=columns)
        node, names = pivots["node"].iloc[0], np.array(list(pivots["ids"].iloc[0]), object)
        matrix, centres = _stacked(rows["vector"]), _stacked(pivots["vectors"].iloc[0])
        angle = _angles(matrix, centres)
        near = angle <= angle.min(axis=1, keepdims=True) + _TIE
        # Equally near pivots share the rows, so a node of rows no angle can tell apart is split too.
        hashed = pd.util.hash_array(rows["id"].to_numpy(object)) % np.uint64(1 << 32)
        nth = hashed.astype(np.int64) % near.sum(axis=1) + 1
        child = ((near.cumsum(axis=1) == nth[:, None]) & near).argmax(axis=1)
        linked = matrix @ centres.T >= at_least
        group = _groups(centres @ centres.T >= at_least)
        first = np.zeros_like(linked)
        for g in np.unique(group):
            members = np.flatnonzero(group == g)
            at = linked[:, members].argmax(axis=1)
            first[np.arange(len(rows)), members[at]] = linked[np.arange(len(rows)), members[at]]
        chosen = np.where(rows["id"].isin(names).to_numpy()[:, None], linked, first)
        return pd.DataFrame(
            {
                "id": rows["id"], "vector": rows["vector"],
                "node": [f"{node}{c:x}" for c in child],
                "links": [list(names[c]) for c in chosen],
            }
        )[columns]

    return split


def _blocks_forest(rows: DataFrame, block: Column, at_least: float) -> DataFrame:
    """Edges of a spanning forest of every block of rows (id, vector)."""
    return rows.select("id", "vector", block.alias("block")).groupBy("block").applyInPandas(
        _forest(at_least), "src string, dst string"
    )


def _labelled(leaves: DataFrame, edges: list[DataFrame], at_least: float, block_rows: int) -> DataFrame:
    """id, vector, node, label: the smallest id that the links found without a search connect a row with.

    These are the links to pivots, those inside leaves, and those inside ``ROUNDS`` random blocks: rows
    with many similar ones are connected by few of them.
    """
    size = leaves.count()
    found = [*edges, _blocks_forest(leaves, F.col("node"), at_least)]
    for number in range(ROUNDS):
        block = F.pmod(F.xxhash64("id", F.lit(f"round {number}")), F.lit(-(-size // block_rows)))
        found.append(_blocks_forest(leaves, block, at_least))
    labels = connected_components(leaves, reduce(DataFrame.unionByName, found))
    return written(
        leaves.select("id", "vector", "node").join(labels.withColumnRenamed("component", "label"), "id"), "tree-labels"
    )


def _grouped(rows: DataFrame, group_rows: int) -> DataFrame:
    """Add the group of a row. Labels of many rows have groups of their own (``pure`` is the label);
    the other rows share groups by the parts of the tree that hold few enough of them."""
    sizes = written(rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows")), "tree-label-sizes")
    many = sizes.filter(F.col("rows") > group_rows // 4)
    own = rows.join(F.broadcast(many), "label").select(
        "id", "vector", "label", F.col("label").alias("pure"),
        F.concat(
            F.lit("="), "label", F.lit("/"),
            F.pmod(F.xxhash64("id", F.lit("group")), F.ceil(F.col("rows") / group_rows)).cast("string"),
        ).alias("group"),
    )
    few = rows.join(F.broadcast(many), "label", "left_anti")
    leaf = few.groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    above = leaf.select(
        "node", "rows", F.explode(F.sequence(F.lit(0), F.length("node"))).alias("depth")
    ).withColumn("part", F.expr("left(node, depth)"))
    fits = above.groupBy("part").agg(F.sum("rows").alias("rows")).filter(F.col("rows") <= group_rows).select("part")
    chosen = written(
        leaf.select("node").join(
            above.join(fits, "part").groupBy("node").agg(F.min("depth").alias("depth")), "node", "left"
        ).select("node", F.expr("left(node, coalesce(depth, length(node)))").alias("group")),
        "tree-groups",
    )
    rest = few.join(chosen, "node").select("id", "vector", "label", F.lit(None).cast("string").alias("pure"), "group")
    return written(own.unionByName(rest), "tree-grouped")


def _ball(group: pd.DataFrame) -> pd.DataFrame:
    matrix = _stacked(group["vector"])
    centre = _unit(matrix.mean(axis=0, keepdims=True))
    radius = max(float(_angles(matrix[at : at + _AT_ONCE], centre).max()) for at in range(0, len(matrix), _AT_ONCE))
    return pd.DataFrame(
        {
            "group": [group["group"].iloc[0]], "pure": [group["pure"].iloc[0]],
            "centre": [centre[0]], "radius": [radius],
        }
    )


def _apart(at_least: float) -> Column:
    """Whether two balls are so far apart that no row of one is similar to a row of the other."""
    reach = float(np.arccos(np.clip(at_least, -1.0, 1.0)))
    between = F.acos(cosine(F.col("a.centre"), F.col("b.centre")))
    return between - F.col("a.radius") - F.col("b.radius") > reach + _SLACK


def _across(rows: DataFrame, at_least: float) -> DataFrame:
    """Edges between similar rows of different labels, from every pair of groups that can hold any."""
    balls = written(
        rows.groupBy("group").applyInPandas(_ball, "group string, pure string, centre array<double>, radius double"),
        "tree-balls",
    )
    a, b = balls.alias("a"), balls.alias("b")
    pairs = written(
        a.join(b, F.expr("a.group <= b.group AND NOT (a.pure <=> b.pure AND a.pure IS NOT NULL)"))
        .filter((F.col("a.group") == F.col("b.group")) | ~_apart(at_least))
        .select(F.col("a.group").alias("one"), F.col("b.group").alias("two")),
        "tree-pairs",
    )

    def side(own: str) -> DataFrame:
        found = rows.join(F.broadcast(pairs), F.col("group") == F.col(own)).select("one", "two", "id", "label", "vector")
        return found.toDF(*(f"{own}_{c}" for c in found.columns))

    keys = [[f"{own}_{c}" for c in ("one", "two")] for own in ("one", "two")]
    return side("one").groupBy(*keys[0]).cogroup(side("two").groupBy(*keys[1])).applyInPandas(
        _between(at_least), "src string, dst string"
    )


def _between(at_least: float):
    def between(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        """A spanning forest of the labels that similar rows of two groups connect."""
        one, two = (side.set_axis(["one", "two", "id", "label", "vector"], axis=1) for side in (one, two))
        names, labels = pd.factorize(pd.concat([one["label"], two["label"]], ignore_index=True))
        mine, theirs = names[: len(one)], names[len(one) :]
        columns = _stacked(two["vector"]).T
        mixed = bool(np.intersect1d(mine, theirs).size)
        root = np.arange(len(labels))
        src, dst = [], []

        def top(at: int) -> int:
            while root[at] != at:
                root[at] = at = root[root[at]]
            return at

        for at in range(0, len(one), _AT_ONCE):
            near = _stacked(one["vector"].iloc[at : at + _AT_ONCE]) @ columns >= at_least
            if mixed:
                near &= mine[at : at + _AT_ONCE, None] != theirs[None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            i += at
            _, kept = np.unique(mine[i].astype(np.int64) * len(labels) + theirs[j], return_index=True)
            for k in kept:
                low, high = sorted((top(mine[i[k]]), top(theirs[j[k]])))
                if low != high:
                    root[high] = low
                    src.append(one["id"].iloc[i[k]])
                    dst.append(two["id"].iloc[j[k]])
        return pd.DataFrame({"src": src, "dst": dst}, dtype=object)

    return between


def _forest(at_least: float):
    def forest(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        matrix = _stacked(group["vector"])
        near = np.empty((len(matrix), len(matrix)), bool)
        for at in range(0, len(matrix), _AT_ONCE):
            np.greater_equal(matrix[at : at + _AT_ONCE] @ matrix.T, at_least, out=near[at : at + _AT_ONCE])
        ids = group["id"].to_numpy()
        unseen = np.ones(len(ids), bool)
        src, dst = [], []
        for root in range(len(ids)):
            if not unseen[root]:
                continue
            unseen[root] = False
            frontier = np.array([root])
            while len(frontier):
                reached = near[frontier].any(axis=0) & unseen
                frontier = np.flatnonzero(reached)
                unseen[frontier] = False
                src += [ids[root]] * len(frontier)
                dst += list(ids[frontier])
        return pd.DataFrame({"src": src, "dst": dst}, dtype=object)

    return forest
