"""Dense retrieval: scores, best rows of groups, centroids, votes and feedback vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumic.functions import vectors as V
from vellumic.operators.ranking import PLACES, best_per_group, ranked

# Fixed values of the votes, priors and feedback.
VOTE_K, VOTE_TOP, PREDICTED = 10, 200, 3
PRIOR_WEIGHT = 0.08
ALPHA, BETA, GAMMA = 1.0, 0.75, 0.15


def vector_of(rows: DataFrame, vector: str = "embedding") -> list[float]:
    """The one query vector of ``rows``; it has a fixed number of dimensions."""
    return [float(x) for x in rows.select(vector).first()[0]]


def scored(passages: DataFrame, query: Sequence[float], vector: str = "embedding") -> DataFrame:
    """``passages`` with their ``score``; rows without a vector of that length fall away."""
    return passages.withColumn("score", V.dot_with(query)(F.col(vector))).where("score IS NOT NULL").drop(vector)


def masked(scores: DataFrame, allowed: Column) -> DataFrame:
    """Scores of rows that are not allowed become the least; the rows stay."""
    return scores.withColumn("score", F.when(allowed, F.col("score")).otherwise(F.lit(V.MASKED)))


def search(passages: DataFrame, query: Sequence[float], key: str, most: int, vector: str = "embedding") -> DataFrame:
    return ranked(scored(passages, query, vector), "score", [key], most=most)


def best_per_document(scores: DataFrame, document: Sequence[str], passage: str, most: int | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """The best passage of each document, without excluded documents, ranked."""
    if excluded is not None:
        scores = scores.join(excluded, list(document), "left_anti")
    return ranked(best_per_group(scores, document, "score", [passage]), "score", [passage], most=most)


def best_in_chapters(scores: DataFrame, chapters: DataFrame, chapter: str, passage: str) -> DataFrame:
    """The best passage of each given chapter; chapters without passages fall away."""
    return best_per_group(scores.join(chapters.select(chapter), chapter, "left_semi"), [chapter], "score", [passage])


def _mean_unit(rows: DataFrame, *keys: str) -> DataFrame:
    means = rows.groupBy(*keys, "dim").agg(F.avg("value").alias("value"))
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy(*keys)))
    return means.withColumn("length", length).select(*keys, "dim", F.when(F.col("length") > 0, F.col("value") / F.col("length")).otherwise(F.col("value")).alias("value"))


def centroids(passages: DataFrame, category: str, document: str, vector: str = "embedding") -> DataFrame:
    """(category, dim, value): unit mean of the documents' unit means, so documents weigh alike."""
    by_document = _mean_unit(V.dims(passages, vector, category, document), category, document)
    return _mean_unit(by_document, category)


def predict(centroid_dims: DataFrame, queries: DataFrame, category: str, key: str, most: int = PREDICTED, vector: str = "embedding") -> DataFrame:
    """(key, category, score, rank): the categories whose centroids are nearest to each query.

    The centroids, a row for each category, are one matrix that every batch of queries is
    multiplied with, so no query leaves its place.
    """
    rows = V.gathered(centroid_dims.select(category, "dim", "value"), category).orderBy(category).collect()
    if not rows:
        return queries.limit(0).select(key, F.lit(None).cast(centroid_dims.schema[category].dataType).alias(category), F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("rank"))
    names = F.array(*(F.lit(r[0]) for r in rows))
    scores = queries.select(key, V.dots_with([r["vector"] for r in rows])(F.col(vector)).alias("s")).where("s IS NOT NULL")
    order = F.array_sort(F.transform("s", lambda x, i: F.struct((-F.round(x, PLACES)).alias("m"), i.alias("i"), x.alias("score"))))
    best = scores.select(key, F.posexplode(F.slice(order, 1, most)).alias("place", "b"))
    return best.select(key, F.element_at(names, F.col("b.i") + 1).alias(category), F.col("b.score").alias("score"), (F.col("place") + 1).cast("long").alias("rank"))


def vote(top: DataFrame, category: str, most: int = PREDICTED, k: int = VOTE_K) -> DataFrame:
    """(category, score, rank) by votes 1 / (k + place), places from 0, of ranked passages."""
    votes = top.groupBy(category).agg(F.sum(1.0 / (k + F.col("rank") - 1)).alias("score"))
    return ranked(votes, "score", [category], most=most)


def vote_by_document(top: DataFrame, category: str, document: str, most: int = PREDICTED, k: int = VOTE_K) -> DataFrame:
    """As :func:`vote`, but a document votes once, with its first passage."""
    first = top.groupBy(document).agg(F.min_by(category, "rank").alias(category), F.min("rank").alias("place"))
    again = first.withColumn("rank", F.row_number().over(W.orderBy("place")))  # of the top passages only
    return vote(again, category, most, k)


def category_prior(passages: DataFrame, predicted: DataFrame, category: str, weight: float = PRIOR_WEIGHT) -> DataFrame:
    """``passages`` with a ``bonus`` for predicted categories, 0 for others."""
    bonus = predicted.select(category, (weight * F.col("score")).alias("bonus"))
    return passages.join(F.broadcast(bonus), category, "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))


def multi_query(queries: DataFrame, vector: str = "embedding") -> DataFrame:
    """(dim, value): the unit sum of several query vectors."""
    sums = V.dims(queries, vector).groupBy("dim").agg(F.sum("value").alias("value"))
    return _unit(sums)


def _unit(rows: DataFrame) -> DataFrame:
    length = rows.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    return rows.crossJoin(F.broadcast(length)).select("dim", F.when(F.col("length") > 0, F.col("value") / F.col("length")).otherwise(F.col("value")).alias("value"))


def rocchio(query: DataFrame, judged: DataFrame, vector: str = "embedding", relevant: str = "relevant", alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> DataFrame:
    """(dim, value) of the query moved towards relevant vectors and away from the others.

    ``query`` is one row, ``judged`` has a vector and a boolean. Without judgements the query
    comes back as it is; a sum of length zero gives the query too.
    """
    q = V.dims(query, vector).withColumnRenamed("value", "q")
    means = V.dims(judged, vector, relevant).groupBy("dim").agg(F.avg(F.when(F.col(relevant), F.col("value"))).alias("p"), F.avg(F.when(~F.col(relevant), F.col("value"))).alias("n"))
    moved = q.join(means, "dim", "left").select("dim", "q", (alpha * F.col("q") + beta * F.coalesce("p", F.lit(0.0)) - gamma * F.coalesce("n", F.lit(0.0))).alias("m"), (F.col("p").isNull() & F.col("n").isNull()).alias("same"))
    total = moved.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length"))
    value = F.when(F.col("same") | (F.col("length") == 0), F.col("q")).otherwise(F.col("m") / F.col("length"))
    return moved.crossJoin(F.broadcast(total)).select("dim", value.alias("value"))


def as_list(dim_values: DataFrame) -> list[float]:
    """The numbers of one vector, whose length is fixed."""
    return [r[0] for r in dim_values.orderBy("dim").select("value").collect()]
