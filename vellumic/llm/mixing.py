"""Mixing sources to target weights: budgets down a tree, then token prefixes of seeded epochs.

The tree is domain, language, source. A node's budget goes to its children in proportion to
their weights; a child that cannot use its share (its tokens times ``max_epochs``) is given
all it can, and the shortage goes to its siblings. Only what a whole family cannot use is left
to the family's own siblings, since a family's capacity is the sum of its members'. All
quantities are whole tokens; a level leaves less than one token for each child unspent.

DataFrame functions only. The leaf table has a row for each source; no window runs over
documents but in hash ranges whose size does not grow with their leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumic.llm._arrow import named
from vellumic.scratch import Scratch

LEVELS = ("domain", "language", "leaf")
#: Documents of a leaf that one hash range holds on average; the hash has 31 bits for ranges, so
#: this holds for leaves of up to 2e12 documents.
RANGE_DOCS, MOST_RANGES = 1024, (1 << 31) - 1
BROADCAST_LEAVES = 100_000
#: The words of a text stand for its tokens.
WORD = r"[^\x20\x09-\x0D]+"

#: Weights for the registered query: domains, then languages; sources and the rest weigh 1.
DOMAIN_OF = "concat('domain', coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int) % 3, 3))"
DOMAIN_WEIGHTS = {"domain0": 5, "domain1": 3, "domain2": 2}
LANGUAGE_WEIGHTS = {"en": 6, "de": 2, "fr": 1, "es": 1}
#: Share of all tokens that the mix gets, in percent, and how often a document may be taken.
BUDGET_PERCENT, MAX_EPOCHS, SEED = 60, 4, 42


def weight_of(column: str, weights: dict[str, int]) -> Column:
    """The weight of a column's value; 1 where none is given."""
    out = F.lit(1)
    for value, weight in weights.items():
        out = F.when(F.col(column).eqNullSafe(value), weight).otherwise(out)
    return out.cast("long")


def shared_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``children`` (parent columns, child, weight, capacity, given) with each one's ``budget``.

    ``given`` is the parent's budget. Children are filled in order of capacity to weight: with
    those before it full, a child is full too if its capacity is at most its share of the rest.
    """
    order = W.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(child).asc_nulls_first())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    rest = F.greatest(F.lit(0), F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    rows = children.select("*", rest.alias("rest"), F.sum("weight").over(after).alias("weights"))
    full = F.expr("cast(capacity AS decimal(20, 0)) * weights <= cast(rest AS decimal(20, 0)) * weight")
    rows = rows.select("*", full.alias("is_full"))
    # From the first child that is not full on, all share one rest in proportion to weight.
    every = W.partitionBy(*parent)
    first = F.min(F.when(~F.col("is_full"), F.struct((F.col("capacity") / F.col("weight")).alias("r"), F.col(child).isNotNull().alias("k"), F.col(child).alias("c"), "rest", "weights"))).over(every)
    rows = rows.select("*", first.alias("f"))
    partly = F.expr("cast(cast(f.rest AS decimal(20, 0)) * weight div f.weights AS long)")
    at_or_after = F.struct((F.col("capacity") / F.col("weight")).alias("r"), F.col(child).isNotNull().alias("k"), F.col(child).alias("c")) >= F.struct(F.col("f.r").alias("r"), F.col("f.k").alias("k"), F.col("f.c").alias("c"))
    budget = F.when(F.col("f").isNotNull() & at_or_after, F.least(partly, F.col("capacity"))).otherwise(F.col("capacity"))
    return rows.select(*children.columns, budget.alias("budget"))


def budgets(leaves: DataFrame, total: Column, max_epochs: int) -> DataFrame:
    """Token budget of each leaf (domain, language, leaf, w1, w2, w3, n_docs, n_tokens)."""
    capacity = leaves.select("*", (F.col("n_tokens") * max_epochs).alias("capacity"))
    lang = capacity.groupBy("domain", "language").agg(F.max("w1").alias("w1"), F.max("w2").alias("weight"), F.sum("capacity").alias("capacity"))
    top = lang.groupBy("domain").agg(F.max("w1").alias("weight"), F.sum("capacity").alias("capacity")).select("*", F.lit(0).alias("root"), total.alias("given"))
    top = shared_out(top, ["root"], "domain").select(F.col("domain").alias("d"), F.col("budget").alias("given"))
    lang = lang.join(top, F.col("domain").eqNullSafe(F.col("d"))).drop("d", "w1")
    lang = shared_out(lang, ["domain"], "language").select(F.col("domain").alias("d"), F.col("language").alias("l"), F.col("budget").alias("given"))
    leaf = capacity.withColumnRenamed("w3", "weight").join(lang, F.col("domain").eqNullSafe(F.col("d")) & F.col("language").eqNullSafe(F.col("l"))).drop("d", "l", "w1", "w2")
    return shared_out(leaf, ["domain", "language"], "leaf").drop("given", "weight", "capacity")


def mixed(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    language_col: str = "lang",
    source_col: str = "source",
    domain: str = DOMAIN_OF,
    domain_weights: dict[str, int] = DOMAIN_WEIGHTS,
    language_weights: dict[str, int] = LANGUAGE_WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The documents that the mix takes: a row for each time one is taken.

    Returns ``id_col``, ``domain``, ``language``, ``leaf`` (the source), ``n_tokens`` and
    ``epoch`` (from 0). A leaf whose budget is e times its tokens and some more is taken e times
    whole, and of a further epoch's seeded order the longest prefix of documents that starts
    within what is left, so a leaf exceeds its budget by less than one document. ``domain`` is
    an SQL expression over ``source``. Null languages, sources and domains are values of their
    own; a null text has no tokens and is taken with every epoch it stands in; a null id is
    ordered by its text's hash; repeated rows are taken each; ties of the order go by id. Other columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    docs = df.select(named(id_col, "id"), named(text_col, "text"), named(language_col, "language"), named(source_col, "source"))
    docs = docs.select("id", F.coalesce(F.col("id").cast("string"), F.md5("text"), F.lit("")).alias("name"), "language", F.col("source").alias("leaf"), F.expr(domain).alias("domain"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    docs = scratch.keep(docs)

    leaves = docs.groupBy("domain", "language", "leaf").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    leaves = leaves.select("*", weight_of("domain", domain_weights).alias("w1"), weight_of("language", language_weights).alias("w2"), F.lit(1).cast("long").alias("w3"))
    all_tokens = docs.agg(F.sum("n_tokens")).first()[0] or 0
    plan = budgets(leaves, F.lit(all_tokens * budget_percent // 100), max_epochs)
    plan = plan.select(
        F.xxhash64("domain", "language", "leaf").alias("key"), "domain", "language", "leaf", "n_docs",
        F.expr("CASE WHEN n_tokens > 0 THEN budget div n_tokens ELSE 0L END").cast("int").alias("whole"),
        F.expr("CASE WHEN n_tokens > 0 THEN budget % n_tokens ELSE 0L END").alias("part"),
    )
    plan = scratch.keep(plan)
    small = plan.count() <= BROADCAST_LEAVES
    keyed = docs.select("id", "name", "n_tokens", "domain", "language", "leaf", F.xxhash64("domain", "language", "leaf").alias("key"))
    planned = keyed.join((F.broadcast if small else lambda x: x)(plan.drop("domain", "language", "leaf")), "key")

    # The order of the last epoch: a seeded hash. A range is what shares the hash's leading part.
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("whole"), "name")), 1, 15), 16, 10).cast("long")
    ranges = f"shiftright(place, 29) * (1 + least({MOST_RANGES}, n_docs div {RANGE_DOCS})) div 2147483648"  # place has 60 bits
    planned = planned.select("*", place.alias("place")).select("*", F.expr(ranges).alias("range"))
    sums = planned.where("part > 0").groupBy("key", "part", "range").agg(F.sum("n_tokens").alias("sum"))
    before = W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("key", "part", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"), "sum")
    starts = scratch.keep(starts.where("start < part").select("key", "range", "start", (F.col("start") + F.col("sum") <= F.col("part")).alias("inside")))

    n_starts = starts.count()
    whole = planned.where("whole > 0").select("id", "domain", "language", "leaf", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"))
    near = planned.where("part > 0").join((F.broadcast if n_starts <= BROADCAST_LEAVES else lambda x: x)(starts), ["key", "range"])
    inside = near.where("inside").select("id", "domain", "language", "leaf", "n_tokens", F.col("whole").alias("epoch"))
    # Only the range in which the prefix ends is put in order.
    order = W.partitionBy("key", "range").orderBy("place", "name").rowsBetween(W.unboundedPreceding, -1)
    edge = near.where("NOT inside").select("*", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("sofar"))
    edge = edge.where("start + sofar < part").select("id", "domain", "language", "leaf", "n_tokens", F.col("whole").alias("epoch"))
    out = whole.unionByName(inside).unionByName(edge)
    return out.select(F.col("id").alias(id_col), "domain", "language", "leaf", "n_tokens", F.col("epoch").cast("long").alias("epoch"))
