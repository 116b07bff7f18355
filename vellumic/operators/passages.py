"""Passages: overlapping word windows, their texts, and the larger windows around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumic.functions import text as T

# Words of a passage, step, least tail, and words of a window around a passage.
WORDS, STEP, TAIL, WINDOW = 60, 50, 25, 420
PREFIX_CHARS = 160


def count_of(n: Column, step: int = STEP, tail: int = TAIL) -> Column:
    """Passages of a text of ``n`` words, in closed form, for overlaps shorter than ``tail``."""
    return F.when(n == 0, 0).otherwise(1 + F.greatest(F.lit(0), F.floor((n - tail) / step))).cast("int")


def passages(chapters: DataFrame, key: str, body: str, *keep: str, words: int = WORDS, step: int = STEP, tail: int = TAIL) -> DataFrame:
    """(key, keep, passage_no, start, n, text): windows of ``words`` words every ``step``.

    A tail of fewer than ``tail`` words behind an earlier window is left out, and no window
    starts once one has reached the end. Words are split once, then sliced.
    """
    rows = chapters.select(key, *keep, T.words(F.coalesce(F.col(body), F.lit(""))).alias("__w"))
    starts = F.sequence(F.lit(0), F.size("__w") - 1, F.lit(step))
    used = F.filter(starts, lambda s: (s == 0) | ((F.size("__w") - s >= tail) & (s - step + words < F.size("__w"))))
    rows = rows.where(F.size("__w") > 0).select(key, *keep, "__w", F.posexplode(used).alias("passage_no", "start"))
    n = F.least(F.lit(words), F.size("__w") - F.col("start"))
    return rows.select(key, *keep, F.col("passage_no").cast("long").alias("passage_no"), F.col("start").cast("long").alias("start"), n.cast("long").alias("n"), F.array_join(F.slice("__w", F.col("start") + 1, n), " ").alias("text"))


def passage_text(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, (start + 1).cast("int"), n.cast("int")), " ")


def window(words: Column, start: Column, n: Column, size: int = WINDOW) -> Column:
    """``size`` words around a passage, cut to whole sentences where one ends near an edge."""
    total = F.size(words)
    first = F.greatest(F.lit(0), (start + F.floor(n / 2) - size // 2).cast("int"))
    last = F.least(total, first + size)
    first = F.greatest(F.lit(0), last - size)
    piece = F.array_join(F.slice(words, first + 1, last - first), " ")
    at = F.instr(piece, ". ")
    opened = F.when((first > 0) & (at > 0) & (at - 1 < F.floor(F.length(piece) / 3)), F.substring(piece, at + 2, F.length(piece))).otherwise(piece)
    back = F.length(opened) - F.instr(F.reverse(opened), " .")  # place of the last ". ", from 1
    ends = (last < total) & (F.instr(opened, ". ") > 0) & (back - 1 > F.floor(F.length(opened) * 2 / 3))
    closed = F.when(ends, F.substring(opened, F.lit(1), back)).otherwise(opened)
    return F.concat(F.when(first > 0, "... ").otherwise(""), closed, F.when(last < total, " ...").otherwise(""))


def context_prefix(title: Column, chapter: Column, terms: Column | None = None) -> Column:
    """Title, chapter and terms before a passage that is to be embedded."""
    parts = [F.nullif(T.trimmed(F.coalesce(c, F.lit(""))), F.lit("")) for c in (title, chapter, *([terms] if terms is not None else []))]
    return F.substring(F.concat_ws(". ", *parts), 1, PREFIX_CHARS)


def embedded_text(prefix: Column, passage: Column) -> Column:
    return F.when(F.length(prefix) > 0, F.concat(prefix, F.lit(". "), passage)).otherwise(passage)


def card(words: Column, start: Column, n: Column, most: int = 25) -> Column:
    """A passage's first words, with dots if it goes on."""
    return F.concat(F.array_join(F.slice(words, (start + 1).cast("int"), F.least(n, F.lit(most)).cast("int")), " "), F.when(n > most, "…").otherwise(""))
