"""Whole ways of searching, for all questions of an evaluation at once.

Passages are (pid, document, category, text, embedding), questions (qid, q, embedding), a stated
set. Lexical scores are (variant, qid, pid, document, score), a variant being a question in one
language. Every way returns (qid, document, rank), documents in the order of their first passage.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumic import models
from vellumic.functions import vectors as V
from vellumic.operators import dense as D
from vellumic.operators import evaluate as E
from vellumic.operators import hybrid as H
from vellumic.operators import lexical as L
from vellumic.operators.ranking import best_per_group, first_per_group, ranked

WAYS = ("cli", "cli-denso", "cli-r2", "cartao", "cartao50", "passagem")
STRATEGIES = ("cru", "filtro", "reforco", "voto-filtro", "voto-reforco", "oracle")
# Documents that the card way reranks, passages of the others, and cards of a round.
CARD_POOL, PASSAGE_POOL, CARDS = 10, 50, 6


def scores(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, pid, document, category, score) of every passage for every question, by one matrix product a batch."""
    rows = questions.select("qid", "embedding").where("embedding IS NOT NULL").orderBy("qid").collect()
    if not rows:
        return passages.select(F.lit(None).cast("long").alias("qid"), "pid", "document", "category", F.lit(0.0).alias("score")).limit(0)
    names = F.array(*(F.lit(r.qid) for r in rows))
    dots = V.dots_with([r.embedding for r in rows])(F.col("embedding"))
    every = passages.select("pid", "document", "category", F.posexplode(dots).alias("k", "score"))
    return every.select(F.element_at(names, F.col("k") + 1).alias("qid"), "pid", "document", "category", "score")


def cut(rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Rows of the categories (qid, category) that a question may see."""
    return rows if allowed is None else rows.join(allowed.select("qid", "category").distinct(), ["qid", "category"], "left_semi")


def documents(scored: DataFrame, most: int | None = None) -> DataFrame:
    """(qid, document, pid, score, rank): each document's best passage, ranked."""
    best = best_per_group(scored.select("qid", "document", "pid", "score"), ["qid", "document"], "score", ["pid"])
    return ranked(best, "score", ["pid"], by=["qid"], most=most)


def fused(scored: DataFrame, lexical: DataFrame | None, most: int = CARDS) -> DataFrame:
    """(qid, document, pid, score, rank) of dense and lexical candidates, with each document's best passage."""
    every = documents(scored)
    dense = every.where(F.col("rank") <= H.POOL)
    if lexical is None:
        return every.where(F.col("rank") <= most)
    first = ranked(lexical, "score", ["pid"], by=["variant"], most=L.RRF_CUT).groupBy("qid", "pid", "document").agg(F.max(L.rrf()).alias("score"))
    top = ranked(first, "score", ["pid"], by=["qid"], most=L.RRF_CUT, name="place").join(every.select("qid", "document"), ["qid", "document"], "left_semi")
    found = best_per_group(top.select("qid", "document", "place", (-F.col("place").cast("double")).alias("score")), ["qid", "document"], "score", ["place"])
    words = ranked(found, "score", ["document"], by=["qid"], most=H.POOL)
    both = dense.select("qid", "document", "rank").unionByName(words.select("qid", "document", "rank"))
    sums = both.groupBy("qid", "document").agg(F.sum(L.rrf()).alias("score"))
    cards = ranked(sums, "score", ["document"], by=["qid"], most=most)
    return cards.join(every.select("qid", "document", "pid"), ["qid", "document"])


def reranked(candidates: DataFrame, passages: DataFrame, questions: DataFrame, reranker: models.Reranker | None = None) -> DataFrame:
    """(qid, document, pid, rank): candidates in the order of the reranker; those without text fall away."""
    rows = candidates.select("qid", "document", "pid").join(passages.select("pid", "text"), "pid").where(F.length(F.trim("text")) > 0)
    rows = rows.join(questions.select("qid", "q"), "qid").withColumn("score", models.pair_scores(reranker)(F.col("q"), F.col("text")))
    return ranked(rows.select("qid", "document", "pid", "score"), "score", ["pid"], by=["qid"])


def in_order(rows: DataFrame) -> DataFrame:
    """(qid, document, rank) of the documents of ranked passages."""
    return first_per_group(rows.select("qid", "document", "rank"), ["document"], by=["qid"]).select("qid", "document", "rank")


def fled(questions: DataFrame, passages: DataFrame, shown: DataFrame) -> DataFrame:
    """``questions`` whose vectors moved away from the passages shown, none of which was right.

    A few passages are shown for each question of a stated set.
    """
    seen: dict = {}
    for r in shown.select("qid", "pid").join(passages.select("pid", "embedding"), "pid").collect():
        seen.setdefault(r.qid, []).append(np.asarray(r.embedding, np.float64))
    rows = []
    for r in questions.where("embedding IS NOT NULL").select("qid", "q", "embedding").collect():
        if r.qid in seen:
            moved = D.ALPHA * np.asarray(r.embedding, np.float64) - D.GAMMA * np.mean(seen[r.qid], axis=0)
            length = np.linalg.norm(moved)
            rows.append((r.qid, r.q, [float(x) for x in (moved / length if length else np.asarray(r.embedding))]))
    kind = questions.schema["qid"].dataType.simpleString()
    return questions.sparkSession.createDataFrame(rows, f"qid {kind}, q string, embedding array<double>")


def way(name: str, passages: DataFrame, questions: DataFrame, lexical: DataFrame, *, targets: DataFrame | None = None, allowed: DataFrame | None = None, scored: DataFrame | None = None, reranker: models.Reranker | None = None) -> DataFrame:
    """(qid, document, rank) by one of ``WAYS``; the second round of cli-r2 needs the ``targets``.

    ``scored`` are the :func:`scores`, where they are kept for several ways.
    """
    scored = cut(scores(passages, questions) if scored is None else scored, allowed)
    again = lambda rows: reranked(rows, passages, questions, reranker)
    if name == "cartao":
        return in_order(again(documents(scored, CARD_POOL)))
    if name in ("cartao50", "passagem"):  # documents come in the order of their best passage either way
        return in_order(again(ranked(scored, "score", ["pid"], by=["qid"], most=PASSAGE_POOL)))
    words = None if name == "cli-denso" else lexical
    first = again(fused(scored, words))
    if name != "cli-r2":
        return in_order(first)
    missed = first.join(first.join(targets, ["qid", "document"], "left_semi").select("qid").distinct(), "qid", "left_anti")
    second = cut(scores(passages, fled(questions, passages, missed)), allowed)
    shown = missed.select("qid", "document").distinct()
    fresh = fused(second.join(shown, ["qid", "document"], "left_anti"), lexical.join(shown.select("qid").distinct(), "qid", "left_semi").join(shown, ["qid", "document"], "left_anti"))
    late = again(fresh).withColumn("rank", F.col("rank") + 1_000)
    return in_order(first.unionByName(late))


def strategy(name: str, passages: DataFrame, questions: DataFrame, *, centroids: DataFrame, targets: DataFrame, scored: DataFrame | None = None, reranker: models.Reranker | None = None, most: int = D.PREDICTED, weight: float = D.PRIOR_WEIGHT) -> DataFrame:
    """(qid, document, rank) by one of ``STRATEGIES`` of choosing categories, then the passages reranked.

    ``centroids`` are (category, dim, value), ``targets`` (qid, document, category).
    """
    scored = scores(passages, questions) if scored is None else scored
    if name == "oracle":  # questions without a target are not cut
        wanted = targets.select("qid", "category").distinct()
        scored = cut(scored, wanted).unionByName(scored.join(wanted.select("qid").distinct(), "qid", "left_anti"))
    elif name in ("filtro", "reforco"):
        predicted = D.predict(centroids, questions, "category", "qid", most).select("qid", "category", (weight * F.col("score")).alias("bonus"))
        scored = cut(scored, predicted) if name == "filtro" else _raised(scored, predicted)
    elif name in ("voto-filtro", "voto-reforco"):
        top = ranked(scored, "score", ["pid"], by=["qid"], most=D.VOTE_TOP)
        votes = top.groupBy("qid", "category").agg(F.sum(1.0 / (D.VOTE_K + F.col("rank") - 1)).alias("score"))
        chosen = ranked(votes, "score", ["category"], by=["qid"], most=most)
        n = chosen.groupBy("qid").agg(F.count("*").alias("n"))
        predicted = chosen.join(n, "qid").select("qid", "category", (weight * (F.col("n") - F.col("rank") + 1) / F.col("n")).alias("bonus"))
        scored = cut(scored, predicted) if name == "voto-filtro" else _raised(scored, predicted)
    elif name != "cru":
        raise ValueError(name)
    pool = ranked(scored, "score", ["pid"], by=["qid"], most=PASSAGE_POOL)
    return in_order(reranked(pool, passages, questions, reranker))


def _raised(scored: DataFrame, predicted: DataFrame) -> DataFrame:
    rows = scored.join(predicted, ["qid", "category"], "left")
    return rows.withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0))).select("qid", "pid", "document", "category", "score")


def measured(rankings: Mapping[str, DataFrame], targets: DataFrame, questions: DataFrame, label: str = "mode") -> DataFrame:
    """(label, hit1, hit3, hit6, hit12, mrr) of each named ranking."""
    out = None
    for name, rows in rankings.items():
        row = E.target_positions(rows, targets, questions, "qid", "document").agg(*E.metrics((1, 3, 6, 12)))
        row = row.select(F.lit(name).alias(label), "hit1", "hit3", "hit6", "hit12", F.round("mrr", 6).alias("mrr"))
        out = row if out is None else out.unionByName(row)
    return out
