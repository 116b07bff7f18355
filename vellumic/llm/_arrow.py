"""Arrow plumbing that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most text bytes that one step of an operator holds as Python objects.
STEP_BYTES = 1 << 20


def named(column: str, alias: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col(f"`{column}`").alias(alias)


def extended(before: Iterable[T.StructField], ddl: str, after: Iterable[T.StructField] = ()) -> T.StructType:
    """A schema of fields that are there and of new ones."""
    return T.StructType([*before, *T.StructType.fromDDL(ddl).fields, *after])


def packed(df: DataFrame, text_col: str, *more: Column) -> DataFrame:
    """(text, more, rest): a table whose other columns, whatever their names, are one struct."""
    rest = [F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col)).alias("rest")] if len(df.columns) > 1 else []
    return df.select(named(text_col, "text"), *more, *rest)


def unpacked(out: DataFrame, columns: list[str], text_col: str, **instead: Column) -> DataFrame:
    """The columns that :func:`packed` took together, some of them replaced."""
    pick = lambda c: F.col("text") if c == text_col else instead[c] if c in instead else F.col("rest").getField(c)
    return out.select(*(pick(c).alias(c) for c in columns))


def texts_of(column: pa.Array) -> list[str]:
    """The strings of a column, null as the empty string."""
    return ["" if x is None else x for x in column.to_pylist()]


def sizes_of(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a string column or of each list of strings; null counts none."""
    if pa.types.is_list(column.type):
        ends = np.concatenate([[0], np.cumsum(sizes_of(column.flatten()))])
        per_row = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64))
        return np.diff(ends[np.concatenate([[0], per_row])])
    return np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds at most ``most`` bytes of ``column``, or one row."""
    ends, start, held = np.cumsum(sizes_of(batch.column(batch.schema.get_field_index(column)))), 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, held + most, "right")))
        yield batch.slice(start, stop - start)
        start, held = stop, int(ends[stop - 1])


def map_slices(df: DataFrame, column: str, schema: T.StructType, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Apply ``fn`` to slices of bounded text size; rows stay in their partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield fn(part)

    return df.mapInArrow(run, schema)


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` from batches sorted by it; a run may span batches."""
    open_parts: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if open_parts and part.column(part.schema.get_field_index(key))[0] != open_parts[-1].column(part.schema.get_field_index(key))[0]:
                yield pa.Table.from_batches(open_parts)
                open_parts = []
            open_parts.append(part)
    if open_parts:
        yield pa.Table.from_batches(open_parts)
