"""Ranks with one tie-break everywhere: higher score first, then lower id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Scores are compared to so many places, since sums of doubles depend on their order.
PLACES = 9


def best_first(score: str, *ids: str) -> list[Column]:
    return [F.round(score, PLACES).desc(), *(F.col(i).asc() for i in ids)]


def ranked(df: DataFrame, score: str, ids: Sequence[str], by: Sequence[str] = (), most: int | None = None, name: str = "rank") -> DataFrame:
    """``df`` with its rank from 1 within ``by``; with ``most``, only ranks up to it.

    Spark keeps only the first ``most`` rows of each partition before it shuffles them.
    """
    if most is not None and not by:  # the best of each partition, then of all: no full sort
        df = df.orderBy(*best_first(score, *ids)).limit(most)
    window = W.partitionBy(*by).orderBy(*best_first(score, *ids))
    out = df.withColumn(name, F.row_number().over(window).cast("long"))
    return out if most is None else out.where(F.col(name) <= most)


def best_per_group(df: DataFrame, group: Sequence[str], score: str, ids: Sequence[str]) -> DataFrame:
    """The best row of each group, aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in group]
    key = F.struct(-F.round(score, PLACES), *(F.col(i) for i in ids))
    return df.groupBy(*group).agg(F.min_by(F.struct(*rest), key).alias("__r")).select(*group, *(F.col(f"__r.{c}").alias(c) for c in rest))


def first_per_group(df: DataFrame, group: Sequence[str], by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """First occurrence of each group in ranked order, ranked anew within ``by``."""
    rest = [c for c in df.columns if c not in (*group, *by)]
    first = df.groupBy(*by, *group).agg(F.min_by(F.struct(*rest), rank).alias("__r")).select(*by, *group, *(F.col(f"__r.{c}").alias(c) for c in rest))
    return first.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(rank)).cast("long"))
