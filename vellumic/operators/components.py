"""Connected components of a graph given by its edges, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumic.operators.skew import join_counted
from vellumic.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), which need a
    logarithmic number of rounds. Each step aggregates a minimum and the number of neighbours
    for each node before it joins the neighbours back, so that those of a node with very many
    are joined where they lie (see :func:`join_counted`).
    """
    kept = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    signature = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first())
    before = signature(kept)
    for _ in range(most_rounds):
        # Each edge goes from its larger node u to the least neighbour m of its smaller one v, or to v.
        both = kept.select("u", "v").unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0")
        large = join_counted(kept, least.withColumnRenamed("u", "v"), "v", "n", before[0])
        large = scratch.keep(large.select("u", F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = join_counted(large, least, "u", "n", before[0])
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last, kept = kept, scratch.keep(small)
        scratch.drop(last)
        scratch.drop(large)
        after = signature(kept)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return kept.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(kept.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
