"""Hash tables before exact comparison: recall of the tables, exactness of the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnsift.operators import fingerprints as fp, tiles
from turnsift.operators.lsh import HashTables, covered, hits

AT_LEAST = 0.7


def unit(matrix):
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def clouds():
    """3,000 rows and 600 references around 150 centres, and rows far from all."""
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(150, 64)))
    near = lambda n: unit(centres[rng.integers(0, 150, n)] + 0.07 * rng.normal(size=(n, 64)))
    return np.vstack([near(2700), unit(rng.normal(size=(300, 64)))]), near(600)


def frames(spark, rows, refs):
    return (
        spark.createDataFrame([(f"r{i:05}", v.tolist()) for i, v in enumerate(rows)], "id string, vector array<double>"),
        spark.createDataFrame([(f"f{i:05}", f"{i:05}", v.tolist()) for i, v in enumerate(refs)], "ref string, rank string, vector array<double>"),
    )


def test_recall_over_all_rows(spark, clouds):
    rows, refs = frames(spark, *clouds)
    scores = np.round(clouds[0] @ clouds[1].T, 12)
    want = {f"r{i:05}" for i in np.flatnonzero((scores >= AT_LEAST).any(axis=1))}
    found = hits(rows, refs, AT_LEAST).collect()
    assert all(abs(scores[int(r.id[1:]), int(r.ref[1:])] - r.cos) < 1e-9 and r.cos >= AT_LEAST for r in found)
    got = {r.id for r in found}
    assert got <= want and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("hashing", [HashTables(), HashTables(tables=1, directions=20), HashTables(bucket_rows=1)])
def test_covered_is_exact_whatever_the_tables_find(spark, clouds, hashing):
    rows, refs = frames(spark, *clouds)
    scores = np.round(clouds[0] @ clouds[1].T, 12)
    want = {f"r{i:05}" for i in np.flatnonzero((scores >= AT_LEAST).any(axis=1))}
    got = [r.id for r in covered(rows, refs, AT_LEAST, 0, hashing).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_crowded_bucket_makes_no_pairs(spark):
    """A thousand equal references: the tables name none of them, the tiles still cover all rows."""
    v = np.ones((1000, 8)) / np.sqrt(8)
    rows, refs = frames(spark, v, v)
    assert hits(rows, refs, AT_LEAST).count() == 0
    assert covered(rows, refs, AT_LEAST, 0).count() == 1000


def test_empty_sides(spark, clouds):
    rows, refs = frames(spark, clouds[0][:5], clouds[1][:5])
    assert covered(rows.limit(0), refs, AT_LEAST, 0).count() == 0
    assert covered(rows, refs.limit(0), AT_LEAST, 0).count() == 0
    nothing = rows.withColumn("vector", F.lit(None).cast("array<double>"))
    assert hits(nothing, refs, AT_LEAST).count() == 0


@pytest.mark.parametrize(("head", "above"), [(30, 10**9), (60, 0)])
def test_leaders_from_heads(spark, head, above):
    """Short heads that double give the leaders of one pass in order, for few and for many leaders."""
    rng = np.random.default_rng(head)
    crowd = unit(np.abs(rng.normal(size=(150, 12))) + 0.5)
    lonely = unit(rng.normal(size=(120, 48)))
    for matrix in (crowd, lonely):
        want = []
        for i in range(len(matrix)):
            if not any(np.round(matrix[i] @ matrix[j], 12) >= AT_LEAST for j in want):
                want.append(i)
        rows = spark.createDataFrame([(f"r{i:05}", v.tolist()) for i, v in enumerate(matrix)], "id string, vector array<double>")
        got = fp._leaders(rows, AT_LEAST, {}, head, above)
        assert sorted(r.id for r in got.collect()) == [f"r{i:05}" for i in want]


def test_tiles_use_the_cluster():
    """10,000 snippets make at least as many tiles as cores; groups never exceed their sizes."""
    down, across = tiles.grid(10_000, 10_000, tiles.ROW_GROUP, tiles.REF_GROUP, 8)
    assert down * across >= 8
    down, across = tiles.grid(10_000, 3, tiles.ROW_GROUP, tiles.REF_GROUP, 1000)
    assert 10_000 / down >= 256 and across == 1
    down, across = tiles.grid(10**9, 10**6, tiles.ROW_GROUP, tiles.REF_GROUP, 8)
    assert 10**9 / down <= tiles.ROW_GROUP and 10**6 / across <= tiles.REF_GROUP
    assert tiles.grid(0, 0, 10, 10, 8) == (1, 1)
