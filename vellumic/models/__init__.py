"""Embedders and rerankers as plug-ins, with deterministic ones for use without model files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumic.functions.vectors import MASKED
from vellumic.operators.ranking import best_per_group, ranked

#: A factory, called once in each worker; what it makes maps texts to unit vectors.
Embedder = Callable[[], Callable[[Sequence[str]], np.ndarray]]
#: A factory of functions from (question, passage) pairs to scores.
Reranker = Callable[[], Callable[[Sequence[tuple[str, str]]], np.ndarray]]
DIMS, BATCH, RERANK_BATCH, RERANK_POOL = 384, 64, 16, 50


def hashing_embedder(dims: int = DIMS) -> Embedder:
    """Signed feature hashing of words and their four-letter parts: no model file, no randomness."""

    def make():
        def embed(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for row, text in zip(out, texts):
                for word in text.lower().split():
                    for part in {word, *(word[i : i + 4] for i in range(max(0, len(word) - 3)))}:
                        h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                        row[h % dims] += 1 if h >> 63 else -1
            length = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, length, out=out, where=length > 0)

        return embed

    return make


def overlap_reranker() -> Reranker:
    """Share of the question's words that a passage has."""

    def make():
        def score(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
            words = [(set(q.lower().split()), set(p.lower().split())) for q, p in pairs]
            return np.array([len(q & p) / len(q) if q else 0.0 for q, p in words])

        return score

    return make


def embedded(passages: DataFrame, text: str, embedder: Embedder | None = None, vector: str = "embedding", batch: int = BATCH) -> DataFrame:
    """``passages`` with a unit vector for each text; a model is loaded once a worker."""
    make = embedder or hashing_embedder()

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            rows = [model(list(texts.iloc[k : k + batch].fillna(""))) for k in range(0, len(texts), batch)]
            yield pd.Series([r.astype(np.float32) for r in np.concatenate(rows)] if rows else [])

    return passages.withColumn(vector, embed(F.col(text)))


def reranked(candidates: DataFrame, question: str, text: str, score: str, key: str, chapter: str, reranker: Reranker | None = None, pool: int = RERANK_POOL, most: int = 6) -> DataFrame:
    """Best candidates by ``score``, scored anew against the question, best passage of each chapter.

    Only ``pool`` rows reach the model, and empty texts none of it.
    """
    top = ranked(candidates.where(F.length(F.trim(text)) > 0), score, [key], most=pool, name="place").drop("place")
    again = top.withColumn("rescored", _rescore(question, reranker)(F.col(text)))
    return ranked(best_per_group(again, [chapter], "rescored", [key]), "rescored", [key], most=most)


def rerank_vector(rows: DataFrame, candidates: DataFrame, question: str, text: str, key: str, reranker: Reranker | None = None) -> DataFrame:
    """``rows`` with ``score``: the reranker's for the candidates, the least for all others."""
    again = candidates.where(F.length(F.trim(text)) > 0).select(key, _rescore(question, reranker)(F.col(text)).alias("score"))
    return rows.join(again, key, "left").withColumn("score", F.coalesce("score", F.lit(MASKED)))


def _rescore(question: str, reranker: Reranker | None):
    make = reranker or overlap_reranker()

    @F.pandas_udf("double")
    def rescore(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            parts = [model([(question, t) for t in texts.iloc[k : k + RERANK_BATCH]]) for k in range(0, len(texts), RERANK_BATCH)]
            yield pd.Series(np.concatenate(parts) if parts else [])

    return rescore


def pair_scores(reranker: Reranker | None = None):
    """Function of (question, passage) columns: the reranker's score of each pair."""
    make = reranker or overlap_reranker()

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for questions, texts in batches:
            pairs = list(zip(questions, texts))
            parts = [model(pairs[k : k + RERANK_BATCH]) for k in range(0, len(pairs), RERANK_BATCH)]
            yield pd.Series(np.concatenate(parts) if parts else [])

    return score
