"""Hybrid rounds: dense and lexical candidates fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumic.operators import dense as D
from vellumic.operators import lexical as L
from vellumic.operators.ranking import best_per_group, ranked

# Candidates from each side, and cards that a round shows.
POOL, CARDS = 30, 6


def sum_fused(first: DataFrame, second: DataFrame, key: str, most: int) -> DataFrame:
    """(rank, key, score, from_first, from_second) of two ranked lists: full outer, ranks summed."""
    both = first.select(key, "rank", F.lit(True).alias("f")).unionByName(second.select(key, "rank", F.lit(False).alias("f")))
    fused = both.groupBy(key).agg(F.sum(L.rrf()).alias("score"), F.max("f").alias("from_first"), F.max(~F.col("f")).alias("from_second"))
    return ranked(fused, "score", [key], most=most)


def lexical_documents(scored: DataFrame, key: str, document: str, most: int = POOL, allowed: DataFrame | None = None, excluded: DataFrame | None = None, cut: int = L.RRF_CUT) -> DataFrame:
    """(document, rank): documents in fused order; category and exclusion come after the cut."""
    fused = ranked(scored, "score", [key], by=["qid"], most=cut).groupBy(key, *([document] if document != key else [])).agg(F.max(L.rrf()).alias("score"))
    top = ranked(fused, "score", [key], most=cut, name="place")
    if allowed is not None:
        top = top.join(allowed, document, "left_semi")
    if excluded is not None:
        top = top.join(excluded, document, "left_anti")
    first = best_per_group(top, [document], "score", ["place"])
    return ranked(first, "score", ["place"], most=most).select(document, "rank")


def hybrid_round(dense_scores: DataFrame, lexical_scores: DataFrame, key: str, document: str, *, excluded: DataFrame | None = None, pool: int = POOL, most: int = CARDS) -> DataFrame:
    """(rank, document, score, from_dense, from_lex) of one round."""
    dense = D.best_per_document(dense_scores, [document], key, pool, excluded)
    lexical = lexical_documents(lexical_scores, key, document, pool, dense_scores.select(document).distinct(), excluded)
    fused = sum_fused(dense, lexical, document, most)
    return fused.select("rank", document, "score", F.col("from_first").alias("from_dense"), F.col("from_second").alias("from_lex"))


def filled(round_: DataFrame, more: DataFrame, document: str, most: int = CARDS) -> DataFrame:
    """A round that a category could not fill, topped up with ``more`` in its order."""
    extra = more.join(round_, document, "left_anti")
    both = round_.select(document, F.lit(0).alias("late"), "rank").unionByName(extra.select(document, F.lit(1).alias("late"), "rank"))
    first = both.orderBy("late", "rank").limit(most)
    out = ranked(first.withColumn("order", -(F.col("late") * 1_000_000 + F.col("rank"))), "order", [document])
    return out.select("rank", document, (F.col("late") == 1).alias("filled"))


def union_of(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """(key, place): ordered distinct union of several ranked lists, for a reranker to decide."""
    rows = None
    for k, source in enumerate(sources):
        part = source.select(key, (F.lit(k).cast("long") * 1_000_000 + F.col("rank")).alias("place"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.min("place").alias("place"))
