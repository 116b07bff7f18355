"""Classification by a vocabulary, facets, domains and the library's catalogue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

# Fixed values of the scores.
NAME_POINTS, BODY_CAP, LEAST_POINTS, SHORT_TERM = 6, 8, 4, 4
FACET_SHARE, MOST_FACETS = 0.45, 3
DEFAULT_CATEGORY = "geral"
#: Characters of a document that are classified, and pages that they come from.
SAMPLE_PAGES, SAMPLE_CHARS, FACET_CHAPTER_CHARS = 40, 60_000, 12_000

Vocabulary = Mapping[str, Sequence[str]]
_SCORES = ArrayType(StructType([StructField("category", StringType()), StructField("points", LongType())]))


class Matcher:
    """Counts of all terms of a vocabulary in one pass over a text."""

    def __init__(self, vocabulary: Vocabulary, bounded: bool):
        import ahocorasick

        self.terms = sorted({t for terms in vocabulary.values() for t in terms if t})
        self.bounded = [bounded and len(t) <= SHORT_TERM and " " not in t for t in self.terms]
        self.automaton = ahocorasick.Automaton()
        for k, term in enumerate(self.terms):
            self.automaton.add_word(term, k)
        if self.terms:
            self.automaton.make_automaton()

    def counts(self, text: str) -> dict[str, int]:
        """Occurrences without overlaps; short single words only between non-letters."""
        out: dict[str, int] = {}
        last: dict[int, int] = {}
        for end, k in self.automaton.iter(text) if self.terms else ():
            term = self.terms[k]
            start = end - len(term) + 1
            if start <= last.get(k, -1):
                continue
            if self.bounded[k] and (_plain(text[start - 1 : start]) or _plain(text[end + 1 : end + 2])):
                continue
            last[k] = end
            out[term] = out.get(term, 0) + 1
        return out


def _plain(c: str) -> bool:
    return c.isascii() and (c.islower() or c.isdigit())


def scoreboard(vocabulary: Vocabulary, bounded: bool = True):
    """Function of (name, body): points of every category that has some, in the vocabulary's order.

    A term in the name gives ``NAME_POINTS``, each one in the body 1 up to ``BODY_CAP``. With
    ``bounded``, a single word of up to four letters does not count inside another word.
    """
    vocabulary = {c: list(t) for c, t in vocabulary.items()}
    made: list[Matcher] = []

    @F.arrow_udf(_SCORES)
    def score(names: pa.Array, bodies: pa.Array) -> pa.Array:
        if not made:
            made.append(Matcher(vocabulary, bounded))
        rows = []
        for name, body in zip(names.to_pylist(), bodies.to_pylist()):
            in_name, in_body = made[0].counts((name or "").lower().replace("-", " ")), made[0].counts((body or "").lower())
            points = {c: sum(NAME_POINTS * (t in in_name) + min(in_body.get(t, 0), BODY_CAP) for t in terms) for c, terms in vocabulary.items()}
            rows.append([{"category": c, "points": p} for c, p in points.items() if p])
        return pa.array(rows, pa.list_(pa.struct([("category", pa.string()), ("points", pa.int64())])))

    return score


def _first_best(scores: Column) -> Column:
    top = F.array_max(F.transform(scores, lambda s: s["points"]))
    return F.element_at(F.filter(scores, lambda s: s["points"] == top), 1)


def classified(docs: DataFrame, name: str, body: str, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` with ``category`` and ``points``; the default where nothing reaches ``LEAST_POINTS``."""
    rows = docs.withColumn("__s", scoreboard(vocabulary)(F.col(name), F.col(body)))
    best = F.when(F.size("__s") > 0, _first_best(F.col("__s")))
    rows = rows.withColumn("__b", best)
    enough = F.coalesce(F.col("__b.points") >= LEAST_POINTS, F.lit(False))
    return rows.withColumns({"category": F.when(enough, F.col("__b.category")).otherwise(DEFAULT_CATEGORY), "points": F.coalesce("__b.points", F.lit(0)).cast("long")}).drop("__s", "__b")


def facet_scores(docs: DataFrame, key: str, name: str, body: str, vocabulary: Vocabulary) -> DataFrame:
    """(key, place, category, points): the scoreboard without the rule for short words."""
    return docs.select(key, F.posexplode(scoreboard(vocabulary, bounded=False)(F.col(name), F.col(body))).alias("place", "s")).select(key, "place", "s.*")


def rarity(scores: DataFrame, n_docs: int) -> DataFrame:
    """(category, weight): categories that score in few documents weigh more."""
    return scores.groupBy("category").agg((F.log(F.lit(float(max(n_docs, 1))) / F.count("*")) + 1.0).alias("weight"))


def facets(scores: DataFrame, weights: DataFrame, docs: DataFrame, key: str, dominant: str) -> DataFrame:
    """(key, subjects): up to three categories near the best one, the dominant one first."""
    weighted = scores.join(F.broadcast(weights), "category").select(key, "place", "category", (F.col("points") * F.col("weight")).alias("p"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("m"), "place", "category")))
    lists = weighted.groupBy(key).agg(order.alias("l"), F.max("p").alias("top"))
    near = lists.select(key, F.slice(F.transform(F.filter("l", lambda s: -s["m"] >= F.col("top") * FACET_SHARE), lambda s: s["category"]), 1, MOST_FACETS).alias("c"))
    rows = docs.select(key, dominant).join(near, key, "left")
    listed = F.coalesce("c", F.array().cast("array<string>"))
    first = F.when(F.col(dominant).isNotNull(), F.concat(F.array(dominant), F.array_remove(listed, F.coalesce(F.col(dominant), F.lit(""))))).otherwise(listed)
    return rows.select(key, F.slice(first, 1, MOST_FACETS).alias("subjects"))


def sampled(pages: DataFrame, key: str, order: str, text: str, chars: int = SAMPLE_CHARS, pages_kept: int = SAMPLE_PAGES) -> DataFrame:
    """(key, sample): first pages of a document up to the one that passes ``chars``."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = pages.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(order))).withColumn("__b", F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)))
    kept = rows.where((F.col("__k") <= pages_kept) & (F.col("__b") <= chars))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda s: s["t"]), "\n").alias("sample"))


def domain_bridge(spark: SparkSession, domains: Mapping[str, Sequence[str]], override: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(domain, category); an override replaces whole domains."""
    every = {**domains, **(override or {})}
    rows = [F.struct(F.lit(d).alias("domain"), F.lit(c).alias("category")) for d, cats in every.items() for c in cats]
    return spark.range(1).select(F.inline(F.array(*rows)))


def domain_categories(bridge: DataFrame, existing: DataFrame) -> DataFrame:
    """(domain, category): each domain's categories, and in all of them those in no domain.

    ``existing`` has the categories of the library, so nothing unmapped ever goes missing.
    """
    unmapped = existing.select("category").distinct().join(bridge, "category", "left_anti")
    everywhere = bridge.select("domain").distinct().crossJoin(F.broadcast(unmapped))
    return bridge.select("domain", "category").unionByName(everywhere)


def unmapped_categories(bridge: DataFrame, existing: DataFrame) -> DataFrame:
    return existing.select("category").distinct().join(bridge, "category", "left_anti")


def required_cut(category: str | None, domain: str | None, without: bool, categories: Sequence[str], domains: Sequence[str]) -> None:
    """A new question needs a category, a domain or an explicit wish for neither; unknown names are errors."""
    if category is None and domain is None and not without:
        raise ValueError(f"choose a category of {sorted(categories)}, a domain of {sorted(domains)}, or none explicitly")
    if category is not None and category not in categories:
        raise ValueError(f"unknown category {category!r}; there are {sorted(categories)}")
    if domain is not None and domain not in domains:
        raise ValueError(f"unknown domain {domain!r}; there are {sorted(domains)}")


def summary(docs: DataFrame, size: str, *by: str) -> DataFrame:
    """Totals and one row for each value of each of ``by``, by grouping sets in one pass."""
    sets = [[], *([F.col(b)] for b in by)]
    return docs.groupingSets(sets, *by).agg(F.count("*").alias("docs"), F.sum(size).alias("chars"))
