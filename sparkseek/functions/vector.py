"""Vector functions: products and norms as Columns, 4-bit residual codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

#: Companding of residuals.
SCALE, MU, BITS = 4.0, 255.0, 4
#: Products of vectors with centres that a Python worker holds at once.
BLOCK_CELLS = 1 << 21


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def elementwise_max(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def compand(x: Column) -> Column:
    y = x.cast("double") * SCALE
    return F.signum(y) * F.log(F.abs(y) * MU + 1) / F.log(F.lit(MU + 1))


def expand(y: Column) -> Column:
    return F.signum(y) * (F.pow(F.lit(MU + 1), F.abs(y)) - 1) / MU / SCALE


def quantize(y: Column, bits: int = BITS) -> Column:
    """[-1, 1] to 0 .. 2^bits - 1, halves away from zero."""
    top = (1 << bits) - 1
    return F.greatest(F.lit(0), F.least(F.lit(top), F.round((y + 1) / 2 * top))).cast("int")


def dequantize(code: Column, bits: int = BITS) -> Column:
    return code.cast("double") / ((1 << bits) - 1) * 2 - 1


@lru_cache
def code_values() -> np.ndarray:
    """What the 16 codes stand for."""
    y = np.arange(16) / 15 * 2 - 1
    return np.sign(y) * ((MU + 1) ** np.abs(y) - 1) / MU / SCALE


def encode_residuals(rows: np.ndarray) -> list[bytes]:
    """Rows as packed codes, two to a byte, the first in the high half; an odd row ends in a zero half."""
    y = np.asarray(rows, dtype=np.float64) * SCALE
    y = np.sign(y) * np.log(np.abs(y) * MU + 1) / np.log(MU + 1)
    scaled = (y + 1) / 2 * 15
    codes = np.clip(np.floor(scaled + 0.5), 0, 15).astype(np.uint8)
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    packed = (codes[:, ::2] << 4) | codes[:, 1::2]
    return [r.tobytes() for r in packed]


def decode_residuals(packed: list[bytes], dim: int) -> np.ndarray:
    if not len(packed):
        return np.zeros((0, dim))
    data = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1)
    return code_values()[np.stack([data >> 4, data & 15], axis=2).reshape(len(packed), -1)[:, :dim]]


def matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64) if len(series) else np.zeros((0, 0))


def similarities(embedding: Column, query: np.ndarray) -> Column:
    """array<double>: the products of a vector with every row of a (bounded) query matrix, one product of matrices a batch."""
    q = np.asarray(query, dtype=np.float64)

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(list(matrix(p) @ q.T) if len(p) else [], dtype=object)

    return run(embedding)


def nearest_rows(rows: np.ndarray, centers: np.ndarray, cells: int = BLOCK_CELLS) -> tuple[np.ndarray, np.ndarray]:
    """For each row the centre with the greatest product, the first of equals, and that product.

    Rows are taken in blocks, so that a block's products with all centres are `cells` numbers, whatever their number.
    """
    at, score = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
    step = max(1, cells // max(1, len(centers)))
    for a in range(0, len(rows), step):
        sims = rows[a : a + step] @ centers.T
        at[a : a + step] = sims.argmax(axis=1)
        score[a : a + step] = sims[np.arange(len(sims)), at[a : a + step]]
    return at, score


def nearest(embedding: Column, centers: np.ndarray) -> Column:
    """struct<bucket, score>: the centre with the greatest product, the first of equals."""
    c = np.asarray(centers, dtype=np.float64)

    @F.pandas_udf(StructType([StructField("bucket", IntegerType()), StructField("score", DoubleType())]))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for p in parts:
            at, score = nearest_rows(matrix(p), c)
            yield pd.DataFrame({"bucket": at.astype("int32"), "score": score})

    return run(embedding)


def residual_codes(embedding: Column, centers: np.ndarray) -> Column:
    """struct<bucket, residual>: the nearest centre, and the packed code of what a vector differs from it by.

    Both come from one function, so a task has one Python worker for them and one copy of the centres. It is called
    nondeterministic, lest filters on the bucket be pushed below it and evaluate it again in workers of their own.
    """
    c = np.asarray(centers, dtype=np.float64)

    @F.pandas_udf(StructType([StructField("bucket", IntegerType()), StructField("residual", BinaryType())]))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for e in parts:
            rows = matrix(e)
            at, _ = nearest_rows(rows, c)
            yield pd.DataFrame({"bucket": at.astype("int32"), "residual": pd.Series(encode_residuals(rows - c[at]) if len(e) else [], dtype=object)})

    return run.asNondeterministic()(embedding)


def residual_similarities(packed: Column, query: np.ndarray) -> Column:
    """array<double>: products of decoded residuals with the rows of a query matrix."""
    q = np.asarray(query, dtype=np.float64)

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(list(decode_residuals(p.tolist(), q.shape[1]) @ q.T), dtype=object)

    return run(packed)
