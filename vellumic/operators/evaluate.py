"""Evaluation: ranks of targets, hit rates, strata, families of errors and lints of ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumic.operators.contains import containing


def matches(marks: Column, folder: Column) -> Column:
    """Whether any mark occurs in a folder's name."""
    return F.exists(marks, lambda m: F.contains(folder, m))


def target_positions(rankings: DataFrame, targets: DataFrame, questions: DataFrame, qid: str, document: str) -> DataFrame:
    """(qid, position): best rank of a target; 0 where none is ranked or there is none."""
    hits = rankings.join(targets, [qid, document], "left_semi").groupBy(qid).agg(F.min("rank").alias("position"))
    return questions.select(qid).join(hits, qid, "left").select(qid, F.coalesce("position", F.lit(0)).cast("long").alias("position"))


def metrics(ks: Sequence[int] = (1, 3, 6), position: str = "position") -> list[Column]:
    """Aggregates hit<k> and mrr over positions; position 0 counts as a miss."""
    hit = lambda k: F.count(F.when(F.col(position).between(1, k), 1)).alias(f"hit{k}")
    reciprocal = F.when(F.col(position) > 0, 1.0 / F.col(position)).otherwise(0.0)
    return [*(hit(k) for k in ks), F.avg(reciprocal).alias("mrr")]


def stratified(positions: DataFrame, *strata: str, ks: Sequence[int] = (1, 3)) -> DataFrame:
    """(stratum, hit<k>, n): all questions, and each value of each stratum, in one pass."""
    sets = [[], *([F.col(s)] for s in strata)]
    rows = positions.groupingSets(sets, *strata).agg(*metrics(ks)[:-1], F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.coalesce(*(F.when(F.col(s).isNotNull(), F.concat(F.lit(f"{s}="), F.col(s).cast("string"))) for s in strata), F.lit("all"))
    return rows.select(name.alias("stratum"), *(f"hit{k}" for k in ks), "n")


def family(position: Column, winner_category: Column, target_categories: Column) -> Column:
    return (
        F.when(position == 1, "acerto")
        .when(position.between(2, 3), "acerto-top3")
        .when(position == 0, "alvo-invisivel")
        .when(F.array_contains(target_categories, winner_category), "distrator-vizinho")
        .otherwise("distrator-de-outra-categoria")
    )


def failure_families(positions: DataFrame, winners: DataFrame, target_categories: DataFrame, qid: str) -> DataFrame:
    """(family, n) from (qid, position), (qid, category) of rank 1 and (qid, categories)."""
    rows = positions.join(winners, qid, "left").join(target_categories, qid, "left")
    found = family(F.col("position"), F.col("category"), F.coalesce("categories", F.array().cast("array<string>")))
    return rows.groupBy(found.alias("family")).agg(F.count("*").alias("n"))


def noise(rankings: DataFrame, targets: DataFrame, document: str, top: int = 3) -> DataFrame:
    """(document, intrusions): times a document that answers no question is among the first."""
    shown = rankings.where(F.col("rank") <= top).join(targets.select(document).distinct(), document, "left_anti")
    return shown.groupBy(document).agg(F.count("*").alias("intrusions"))


def coverage(rankings: DataFrame, targets: DataFrame, qid: str, document: str, kind: str, top: int = 3) -> DataFrame:
    """(kind, n): questions with a target among the first ``top``, and intruders there by their kind.

    The row of the questions has the kind ``covered``. An intruder is no target of its question.
    """
    shown = rankings.where(F.col("rank") <= top)
    covered = shown.join(targets, [qid, document], "left_semi").agg(F.countDistinct(qid).alias("n")).select(F.lit("covered").alias("kind"), "n")
    others = shown.join(targets, [qid, document], "left_anti").groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return covered.unionByName(others)


def predictor_accuracy(predictions: DataFrame, truth: DataFrame, qid: str, category: str, ks: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """One row of hits<k>: questions whose category is among the first k predicted."""
    hits = predictions.join(truth, [qid, category]).groupBy(qid).agg(F.min("rank").alias("r"))
    return hits.agg(*(F.count(F.when(F.col("r") <= k, 1)).alias(f"top{k}") for k in ks))


def lint(questions: DataFrame, marks: DataFrame, folders: DataFrame) -> DataFrame:
    """(kind, n): repeated questions, marks without or with several folders, folders without marks.

    ``questions`` has (qid, q), ``marks`` (qid, mark), ``folders`` (folder). Marks are a stated
    set, which one pass over the folders looks for.
    """
    repeated = questions.groupBy("q").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated").alias("kind"), "n")
    pairs = containing(folders, "folder", marks.select("mark").distinct(), "mark")
    counts = marks.join(pairs.groupBy("mark").agg(F.count("*").alias("c")), "mark", "left").select(F.coalesce("c", F.lit(0)).alias("c"))
    orphan = counts.where("c = 0").agg(F.count("*").alias("n")).select(F.lit("orphan").alias("kind"), "n")
    ambiguous = counts.where("c > 1").agg(F.count("*").alias("n")).select(F.lit("ambiguous").alias("kind"), "n")
    uncovered = folders.select("folder").distinct().join(pairs, "folder", "left_anti").agg(F.count("*").alias("n")).select(F.lit("uncovered").alias("kind"), "n")
    return repeated.unionByName(orphan).unionByName(ambiguous).unionByName(uncovered)


def sampled_pool(docs: DataFrame, targets: DataFrame, key: str, size: int, seed: int = 7) -> DataFrame:
    """All targets and a seeded choice of other documents up to ``size``."""
    wanted = docs.join(targets.select(key).distinct(), key, "left_semi")
    others = docs.join(targets.select(key).distinct(), key, "left_anti")
    extra = others.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed).cast("string"))), key).limit(max(0, size - wanted.count()))
    return wanted.unionByName(extra)
