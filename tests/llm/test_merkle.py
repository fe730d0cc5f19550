"""The manifest against a recursive tree in plain Python."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from turnsift.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree string, rank long, root string"
EXTRA = ("x", "y", 7, "z")


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def siblings(tree, i):
    out = []
    for nodes in tree[:-1]:
        start = i - i % 8
        out.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + 8])))
        i //= 8
    return out


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, changed):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row, sorted."""
    trees = {}
    for lang in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = mine, levels([leaf(r) for r in mine])
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = levels([trees[x][1][-1][0] for x in names])
    out = []
    for at, lang in enumerate(names):
        mine, tree = trees[lang]
        for i, row in enumerate(mine):
            path = siblings(tree, i) + siblings(top, at)
            digest = leaf((*row[:4], lowered(row[4]))) if changed(row) else leaf(row)
            for before, after in path:
                digest = h(before + digest + after)
            out.append((row[0], leaf(row), tree[-1][0], top[-1][0], h("".join(b + a for b, a in path)), digest))
    return sorted(out, key=repr)


def built(spark, rows):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    changed = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    return M.manifest(M.document_leaves(docs, changed, F.translate("text", M._UPPER, M._LOWER)))


def found(spark, rows):
    got = M.proofs(built(spark, rows)).collect()
    for r in got:
        assert r.verified == (r.folded_root == r.root)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got), key=repr)


def of_three(row):
    return row[0] is not None and row[0] % 3 == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 511, 512, 513, 4097])
def test_log_order_and_positions(n):
    """The log is the postorder; the closed form finds every node."""
    leaves = [h(str(i)) for i in range(n)]
    tree = levels(leaves)

    def post(level, index):
        if level:
            for child in range(index * 8, min(index * 8 + 8, len(tree[level - 1]))):
                yield from post(level - 1, child)
        yield level, index

    order = list(post(len(tree) - 1, 0))
    assert M.height(n) == len(tree) - 1
    assert M.append_log(leaves, len(tree) - 1) == [tree[l][i] for l, i in order]
    assert [M.position(l, i, n, len(tree) - 1) for l, i in order] == list(range(len(order)))


def test_against_recursion(spark):
    rng = random.Random(5)
    rows = [
        (i, rng.choice(["a", "é", None]), "en" if rng.random() < 0.8 else rng.choice(["de", "xx", "Ü", "", None]),
         rng.choice([None, 0, 12, 123456]), rng.choice([None, "", "Abc Äß", "x" * 50, "plain"]))
        for i in rng.sample(range(5000), 1500)
    ]
    rows += [(None, "s", "en", 1, "T"), (None, "s", "en", 1, "T"), (7, None, "de", None, "Q"), (7, None, "de", None, "Q"), (7, "t", "de", 3, "R")]
    rows += [(9001 + i, "many", f"lang{i:03}", i, "Some Text") for i in range(700)]
    assert found(spark, rows) == brute(rows, of_three)


def test_one_language_of_equal_rows(spark):
    rows = [(3, "s", "en", 4, "Same")] * 1200
    assert found(spark, rows) == brute(rows, of_three)


def test_small_and_empty(spark):
    for rows in ([(1, "a", "en", 2, "Ab")], [(3, None, None, None, None)], [(3, "a", "en", 1, "A"), (4, "a", "de", 1, "a")]):
        assert found(spark, rows) == brute(rows, of_three)
    assert found(spark, []) == []


def test_very_long_text(spark):
    rows = [(3, "a", "en", 1, "Word " * 1_000_000), (6, "a", "en", 1, "x")]
    assert found(spark, rows) == brute(rows, of_three)


def test_whole_log_and_paths(spark):
    rows = [(i, "a", "en" if i % 4 else "de", i, f"T{i}") for i in range(1400)]
    made = built(spark, rows)
    nodes = M.log_nodes(made).collect()
    for lang in ("en", "de"):
        leaves = [leaf(r) for r in sorted(rows) if r[2] == lang]
        tree = levels(leaves)
        mine = sorted((r for r in nodes if r.tree == f"={lang}"), key=lambda r: r.position)
        assert [r.digest for r in mine] == M.append_log(leaves, len(tree) - 1)
        assert all(tree[r.level][r.node] == r.digest for r in mine)
    for r in M.proofs(made, with_path=True).limit(40).collect():
        assert M.fold(r.leaf, [(p.before, p.after) for p in r.path]) == r.root
