"""Page layout: body font, repeated borders, heading candidates and blocks as markdown.

Blocks are rows (document, page, block, text, n_lines, size, bold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumic.functions import text as T

# Fixed values of the rules.
BORDER_SHARE, BORDER_PAGES, BORDER_CHARS = 0.4, 5, 120
CANDIDATE_RATIO, FIRST_BLOCKS = 1.25, 3
NUMBER_ONLY = r"^[\s\-–—|]*\d+[\s\-–—|]*$"
DEFAULT_FONT = 10.0


def body_font(blocks: DataFrame, key: str, size: str = "size", text: str = "text") -> DataFrame:
    """(key, body): median block size, weighted by text length, from a count for each size.

    Sizes are few, so the weights are summed for each before they are put in order.
    """
    weight = F.greatest(F.lit(1), F.floor(F.length(text) / 40))
    sums = blocks.where(F.col(size).isNotNull()).groupBy(key, F.col(size).cast("double").alias("s")).agg(F.sum(weight).alias("w"))
    total = F.sum("w").over(W.partitionBy(key))
    upto = F.sum("w").over(W.partitionBy(key).orderBy("s"))
    rows = sums.select(key, "s", "w", total.alias("t"), upto.alias("u"))
    at = lambda place: F.min(F.when(F.col("u") >= place, F.col("s")))
    lower, upper = F.floor((F.col("t") + 1) / 2), F.floor(F.col("t") / 2) + 1
    return rows.groupBy(key).agg(((at(lower) + at(upper)) / 2).alias("body"))


def repeated_borders(blocks: DataFrame, key: str, page: str = "page", block: str = "block", text: str = "text", share: float = BORDER_SHARE) -> DataFrame:
    """(key, signature, n, share): first and last blocks that recur, digits masked, on many pages."""
    ends = blocks.groupBy(key, page).agg(F.min_by(text, block).alias("a"), F.max_by(text, block).alias("z"))
    pages = ends.groupBy(key).agg(F.count("*").alias("total"))
    texts = ends.select(key, page, F.explode(F.array_distinct(F.array("a", "z"))).alias("t")).where(F.length("t") < BORDER_CHARS)
    counts = texts.groupBy(key, T.digit_signature(F.col("t")).alias("signature")).agg(F.count("*").alias("n"))
    rows = counts.join(pages, key).withColumn("share", F.col("n") / F.col("total"))
    return rows.where((F.col("total") >= BORDER_PAGES) & (F.col("share") >= share)).drop("total")


def heading_candidates(blocks: DataFrame, bodies: DataFrame, key: str, page: str = "page", block: str = "block") -> DataFrame:
    """(key, page, size, title): the largest short block among a page's first three."""
    place = F.row_number().over(W.partitionBy(key, page).orderBy(block))
    short = T.trimmed(F.col("text"))
    rows = blocks.withColumn("__k", place).where(F.col("__k") <= FIRST_BLOCKS).join(bodies, key)
    rows = rows.where((F.col("n_lines") <= 3) & F.length(short).between(3, 90) & (F.col("size") >= CANDIDATE_RATIO * F.col("body")))
    best = rows.groupBy(key, page).agg(F.min_by(F.struct("size", "text"), F.struct(-F.col("size"), "__k")).alias("b"))
    return best.select(key, page, (F.round(F.col("b.size") * 2) / 2).alias("size"), T.clean_heading(F.col("b.text")).alias("title"))


def openings(candidates: DataFrame, pages: DataFrame, key: str, page: str = "page") -> DataFrame:
    """(key, page, title): headings of the largest size that occurs as often as chapters do.

    ``pages`` has (key, n_pages). The headings must cover the document: four or more, the
    first in its first quarter, no gap above 35 percent.
    """
    sizes = candidates.groupBy(key, "size").agg(F.count("*").alias("n")).join(pages, key)
    chosen = sizes.where("n BETWEEN 3 AND 80").where("n_pages / n >= 4").groupBy(key).agg(F.max("size").alias("size"))
    found = candidates.join(chosen, [key, "size"]).join(pages, key)
    following = F.coalesce(F.lead(page).over(W.partitionBy(key).orderBy(page)), F.col("n_pages"))
    gaps = found.withColumn("gap", following - F.col(page))
    good = gaps.groupBy(key).agg(F.count("*").alias("n"), F.min(page).alias("first"), F.max("gap").alias("gap"), F.max("n_pages").alias("p"))
    good = good.where((F.col("n") >= 4) & (F.col("first") <= 0.25 * F.col("p")) & (F.col("gap") <= 0.35 * F.col("p"))).select(key)
    return found.join(good, key, "left_semi").select(key, page, "title")


def block_markdown(text: Column, n_lines: Column, size: Column, bold: Column, body: Column, is_border: Column) -> Column:
    """A block as markdown; page numbers and borders are empty, large or bold short ones headings."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    ratio = F.when(body > 0, size / body).otherwise(1.0)
    short = (n_lines <= 2) & (F.length(text) <= 120)
    strong = (ratio >= 1.45) | ((ratio >= 1.15) & (bold > 0.6))
    return (
        F.when(text.rlike(NUMBER_ONLY) | is_border, "")
        .when(short & strong & (ratio >= 1.6), F.concat(F.lit("## "), flat))
        .when(short & (strong | (ratio >= 1.12)), F.concat(F.lit("### "), flat))
        .otherwise(flat)
    )


def pages_markdown(blocks: DataFrame, key: str) -> DataFrame:
    """(key, page, md): pages from their blocks, without borders and page numbers."""
    borders = repeated_borders(blocks, key).select(key, "signature", F.lit(True).alias("__border"))
    rows = blocks.join(body_font(blocks, key), key, "left").withColumn("signature", T.digit_signature(F.col("text"))).join(borders, [key, "signature"], "left")
    md = block_markdown(F.col("text"), F.col("n_lines"), F.col("size"), F.col("bold"), F.coalesce("body", F.lit(DEFAULT_FONT)), F.coalesce("__border", F.lit(False)))
    lists = rows.withColumn("__md", md).where("__md <> ''").groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("block", "__md"))).alias("l"))
    return lists.select(key, "page", F.array_join(F.transform("l", lambda s: s["__md"]), "\n\n").alias("md"))
