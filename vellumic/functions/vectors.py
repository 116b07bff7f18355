"""Dense vectors: dot products in Arrow batches, sums and means by dimension."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Score of a row that a mask rules out.
MASKED = -1e9


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(one row for each vector, whether it has ``size`` numbers); others are zero rows."""
    good = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), size), False))
    out = np.zeros((len(column), size))
    out[good] = np.asarray(column.filter(pa.array(good)).flatten(), np.float64).reshape(-1, size)
    return out, good


def dot_with(vector: Sequence[float]):
    """Function of a vector column: its dot product with a given vector; null if lengths differ."""
    query = np.asarray(vector, np.float64)

    @F.arrow_udf(DoubleType())
    def dot(column: pa.Array) -> pa.Array:
        rows, good = _matrix(column, len(query))
        return pa.array(rows @ query, pa.float64(), mask=~good)

    return dot


def dots_with(vectors: Sequence[Sequence[float]]):
    """Function of a vector column: its dot products with each of some given vectors; null if lengths differ."""
    queries = np.asarray(vectors, np.float64).reshape(len(vectors), -1)

    @F.arrow_udf(ArrayType(DoubleType()))
    def dots(column: pa.Array) -> pa.Array:
        rows, good = _matrix(column, queries.shape[1])
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(queries))
        return pa.ListArray.from_arrays(offsets, pa.array((rows @ queries.T).ravel()), mask=pa.array(~good))

    return dots


@F.arrow_udf(DoubleType())
def dot(a: pa.Array, b: pa.Array) -> pa.Array:
    """Dot product of two vector columns; null where either is null or lengths differ."""
    out, size = np.zeros(len(a)), np.asarray(pc.fill_null(pc.list_value_length(a), -1))
    mask = np.ones(len(a), bool)
    for n in np.unique(size[size >= 0]):
        x, good_x = _matrix(a, int(n))
        y, good_y = _matrix(b, int(n))
        both = good_x & good_y
        out[both] = np.einsum("ij,ij->i", x[both], y[both])
        mask &= ~both
    return pa.array(out, pa.float64(), mask=mask)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = norm(vector)
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def dims(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """A row (keys, dim, value) for each number of each vector."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """Back from (keys, dim, value) to one vector for each key; a vector has a fixed length."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("rows"))
    return rows.select(*keys, F.col("rows.value").alias("vector"))
