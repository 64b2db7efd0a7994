"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int]:
    """(key, vector as doubles) of the rows that can take part, their dimension and their number.

    Null or zero vectors, and those that hold a null or a number that isn't finite, take no part; nor do rows with a null key,
    nor vectors of another dimension than the commonest (of those, the largest).
    """
    v = F.col(vector).cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    good = rows.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull()).where(sound)
    sizes = good.groupBy(F.size("v").alias("d")).count().collect()
    if not sizes:
        return good, 0, 0
    d, n = max((r["count"], r["d"]) for r in sizes)[::-1]
    return good.where(F.size("v") == d), d, n


def matrix(column, dimension: int) -> np.ndarray:
    """The vectors of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dimension)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
