"""Joins with tables that know how many rows each of their keys has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that are joined by broadcast, and rows that a key has at least to be one of them.
HOT_KEYS, HOT_ROWS = 50_000, 128


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and in ``count`` its rows in ``rows``.

    Keys of more than ``total / HOT_KEYS`` of the ``total`` rows, of which there can be no more
    than ``HOT_KEYS``, are joined by broadcast where their rows lie. The others are joined as
    the planner sees fit, and none of them is large enough to make one task slow. ``how`` is
    inner or left; a null key has no match.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    others = [c for c in table.columns if c != key]
    hot = table.where(F.col(count) > most).select(F.col(key), F.struct(*others).alias("__hot"))
    cold = table.where(F.col(count) <= most)
    marked = rows.join(F.broadcast(hot), key, "left")
    done = marked.where("__hot IS NOT NULL").select(*rows.columns, *(F.col(f"__hot.{c}").alias(c) for c in others))
    return done.unionByName(marked.where("__hot IS NULL").drop("__hot").join(cold, key, how))
