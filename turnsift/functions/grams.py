"""Character 2- and 3-gram vectors: 256 hashed buckets, unit length.

A gram's bucket comes from integer arithmetic on its code points, so every process and
every engine gets the same vector. Counting runs on numpy arrays inside an Arrow batch;
the rows stay partitioned by Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIMENSIONS = 256
STEP = 65_599
SPREAD = 2_654_435
MASK = 0xFFFFFFFF


#: Characters and texts counted at once; they bound the arrays of a batch of long or of many texts.
SLICE_CHARS = 1 << 18
SLICE_TEXTS = 1 << 10


def _counts(padded: list[str]) -> np.ndarray:
    """Gram counts of padded texts, one row each, from a single code point buffer."""
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(padded)), [len(text) for text in padded])
    pairs = codes[:-1] * STEP + codes[1:]
    triples = pairs[:-1] * STEP + codes[2:]
    keys = np.concatenate((pairs[row[:-1] == row[1:]], triples[row[:-2] == row[2:]])) & MASK
    owner = np.concatenate((row[:-1][row[:-1] == row[1:]], row[:-2][row[:-2] == row[2:]]))
    buckets = (((keys * SPREAD) & MASK) >> 24).astype(np.int64)
    return np.bincount(owner * DIMENSIONS + buckets, minlength=len(padded) * DIMENSIONS).reshape(-1, DIMENSIONS)


def gram_matrix(texts: list[str]) -> np.ndarray:
    """Unit gram vectors, one row per text."""
    out = np.zeros((len(texts), DIMENSIONS))
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        lowered = f" {text.lower()} "
        held.append(lowered)
        size += len(lowered)
        if size >= SLICE_CHARS or len(held) >= SLICE_TEXTS or i == len(texts) - 1:
            part = out[start : i + 1]
            part[:] = _counts(held)
            norm = np.sqrt((part * part).sum(axis=1, keepdims=True))
            part /= np.where(norm == 0, 1.0, norm)
            start, held, size = i + 1, [], 0
    return out


def gram_vector(text: str) -> np.ndarray:
    return gram_matrix([text])[0]


@F.arrow_udf(ArrayType(DoubleType()))
def gram_embedding(texts: pa.Array) -> pa.Array:
    """Gram vector of a text, null for null. The matrix of a batch is handed on as it is, not row by row."""
    present = texts.is_valid().to_numpy(zero_copy_only=False)
    matrix = gram_matrix(texts.drop_null().to_pylist())
    ends = np.concatenate(([0], present.cumsum() * DIMENSIONS)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()), mask=pa.array(~present))


@F.pandas_udf(DoubleType())
def text_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Cosine of the gram vectors of two texts."""
    present = (left.notna() & right.notna()).to_numpy()
    out = np.full(len(left), np.nan)
    a, b = gram_matrix(left[present].tolist()), gram_matrix(right[present].tolist())
    out[present] = (a * b).sum(axis=1)
    return pd.Series(out).astype(object).where(present, None).astype("Float64")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors, clamped; 0 when empty or of different size."""
    comparable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))
    return F.when(comparable, clamped).otherwise(F.lit(0.0))
