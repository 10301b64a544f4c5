"""Columns of vectors as numpy matrices; shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column, zero: bool = True) -> Column:
    """Whether a vector is there, holds something, and all its entries are finite numbers; zero: whether (0, 0, ...) counts."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = vector.isNotNull() & (F.size(vector) > 0) & finite
    return F.coalesce(found if zero else found & F.exists(vector, lambda x: x != 0), F.lit(False))


def usual_length(df: DataFrame, vector: str) -> int:
    """The most frequent length of a column's usable vectors; of equally frequent ones the longest. 0 if there are none."""
    sizes = df.where(usable(F.col(vector))).groupBy(F.size(vector).alias("size")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return first["size"] if first else 0


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """One row for each vector of an Arrow list column whose vectors all have this length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def summed(parts: DataFrame, *columns: str) -> list[np.ndarray]:
    """The element-wise sums of array columns over all rows, worked out by Spark: the driver gets one array of each."""
    out = []
    for c in columns:
        cells = parts.select(F.posexplode(c).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        values = np.zeros(len(cells), cells and type(cells[0]["x"]) or float)
        for r in cells:
            values[r["at"]] = r["x"]
        out.append(values)
    return out
