"""Lexical index and BM25 search, one question or many at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumic.functions import text as T
from vellumic.operators.ranking import ranked
from vellumic.scratch import Scratch

# Fixed values of the scoring.
K1, B = 1.5, 0.75
RRF_K, RRF_CUT = 60, 200
#: Distinct terms of all questions that are looked up as a literal set.
MOST_TERMS = 20_000


def tokenized(chapters: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(key, keep, tokens, n): the tokens of each chapter, not exploded."""
    rows = chapters.select(key, *keep, T.tokens(F.col(text)).alias("tokens"))
    return rows.withColumn("n", F.coalesce(F.size("tokens"), F.lit(0)).cast("long"))


def postings(lex: DataFrame, key: str) -> DataFrame:
    """(term, key, tf) of every term of every chapter."""
    return lex.select(key, F.explode("tokens").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def totals(lex: DataFrame) -> DataFrame:
    """One row: ``total`` chapters and their ``mean`` length."""
    return lex.agg(F.count("*").alias("total"), F.avg("n").alias("mean"))


def idf(total: str = "total", df: str = "df"):
    return F.log(1 + (F.col(total) - F.col(df) + 0.5) / (F.col(df) + 0.5))


def term_stats(lex: DataFrame, key: str) -> DataFrame:
    """(term, df, idf) over all chapters."""
    dfs = postings(lex, key).groupBy("term").agg(F.count("*").alias("df"))
    return dfs.crossJoin(F.broadcast(totals(lex))).select("term", "df", idf().alias("idf"))


def query_terms(questions: DataFrame, qid: str = "qid", text: str = "q") -> DataFrame:
    """(qid, term, times): a term that a question repeats counts as often."""
    return questions.select(qid, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(qid, "term").agg(F.count("*").alias("times"))


def questions_of(spark, texts: Sequence[str]) -> DataFrame:
    """(qid, q) of a few literal questions, numbered from 0."""
    rows = F.array(*(F.struct(F.lit(k).cast("long").alias("qid"), F.lit(q).alias("q")) for k, q in enumerate(texts)))
    return spark.range(1).select(F.inline(rows))


def bm25(lex: DataFrame, questions: DataFrame, key: str, *keep: str) -> DataFrame:
    """(qid, key, keep, score, n_terms) of every chapter that has a term of a question.

    Chapters are tokenized once: what is kept of each is its length and the tokens that some
    question asks for, and all statistics come from that. The questions' terms are a stated
    set; up to ``MOST_TERMS`` of them are a literal set, more are joined.
    """
    scratch = Scratch(lex.sparkSession, "bm25")
    wanted = scratch.keep(query_terms(questions))
    terms = [r[0] for r in wanted.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(terms) <= MOST_TERMS:
        asked = F.filter("tokens", lambda t: t.isin(*terms)) if terms else F.array().cast("array<string>")
        held = scratch.keep(lex.select(key, *keep, "n", asked.alias("tokens")))
        tf = held.select(key, *keep, "n", F.explode("tokens").alias("term"))
    else:
        held = lex
        tf = lex.select(key, *keep, "n", F.explode("tokens").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    tf = tf.groupBy(key, *keep, "n", "term").agg(F.count("*").alias("tf"))
    return scored(tf, wanted, totals(held), wanted.count() <= MOST_TERMS, key, *keep)


def scored(tf: DataFrame, wanted: DataFrame, total: DataFrame, few: bool, key: str, *keep: str) -> DataFrame:
    """(qid, key, keep, score, n_terms) from counts (key, keep, n, term, tf) of the ``wanted`` (qid, term, times).

    ``few`` says that the wanted rows were counted and are no more than ``MOST_TERMS``; they are
    then broadcast.
    """
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weights = wanted.join(df, "term").crossJoin(F.broadcast(total))
    rows = tf.join(F.broadcast(weights) if few else weights, "term")
    part = idf() * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    scored = rows.groupBy("qid", key, *keep).agg(F.sum(F.col("times") * part).alias("score"), F.count("*").alias("n_terms"))
    return scored.where("score <> 0")


def rrf(rank: str = "rank", k: int = RRF_K):
    """Weight of a rank counted from 1."""
    return 1.0 / (k + F.col(rank))


def max_fused(scored: DataFrame, key: str, cut: int = RRF_CUT) -> DataFrame:
    """(key, score): the best reciprocal rank over the questions' first ``cut`` chapters each."""
    return ranked(scored, "score", [key], by=["qid"], most=cut).groupBy(key).agg(F.max(rrf()).alias("score"))


def search(lex: DataFrame, questions: DataFrame, key: str, most: int) -> DataFrame:
    """(rank, key, score, n_terms) of one question's best chapters."""
    return ranked(bm25(lex, questions, key), "score", [key], most=most).select("rank", key, "score", "n_terms")


def filtered_after(scored: DataFrame, key: str, category: str, allowed: Sequence[str], most: int, cut: int = RRF_CUT) -> DataFrame:
    """(rank, key, category, score): cut to the fused first ``cut``, then filtered, then ranked.

    A filter before the cut would let through chapters that the cut excludes.
    """
    fused = ranked(scored, "score", [key], by=["qid"], most=cut).groupBy(key, category).agg(F.max(rrf()).alias("score"))
    top = ranked(fused, "score", [key], most=cut, name="place").where(F.col(category).isin(*allowed))
    return ranked(top, "score", [key], most=most).select("rank", key, category, "score")


def snippets(chapters: DataFrame, hits: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, snippet) of the hits that a search shows."""
    return chapters.join(hits.select(key), key).select(key, T.snippet(F.col(text), terms).alias("snippet"))
