"""Quality rules: per-document failures, host-level rates and verdicts joined back.

A document fails outright by the base rules (too few words, too much repeated text). Weaker
rules only count against its host: their failure rate is shrunk towards the corpus with an
empirical beta prior, and in a host whose shrunk rate is high the documents that break a
weaker rule are rejected. A document that breaks no rule is never rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumic.llm._arrow import extended, map_slices, named, packed, texts_of, unpacked
from vellumic.operators.skew import join_counted
from vellumic.scratch import Scratch

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Weaker rules: symbols per 100 words, repeated lines per 100 words, mean word length x 10.
SOFT_SYMBOLS, SOFT_LINES, SOFT_SHORT, SOFT_LONG = 25, 5, 25, 120
#: A host is rejected from this shrunk rate of failures, in per mille.
HOST_PER_MILLE = 500
#: Rejected hosts up to this number are broadcast; of more, those of very many documents.
BROADCAST_HOSTS = 100_000

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, soft_failed boolean"
_NAMES = [x.split()[0] for x in MEASURES.split(", ")]
_MIX = np.random.default_rng(20).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of ``WINDOW`` words that occurs twice or more, first included."""
    n = len(words) - WINDOW + 1
    if n < 2 or len(set(words)) > len(words) - WINDOW:  # fewer repeated words than one window
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    scrambled = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    scrambled ^= scrambled >> np.uint64(29)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed += scrambled[k : k + n] * _MIX[k]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    in_run = np.zeros(n, bool)
    in_run[1:] |= same
    in_run[:-1] |= same
    seen: dict[bytes, int] = {}  # equal hashes are confirmed on the words' numbers
    starts = order[in_run]
    keys = [ids[s : s + WINDOW].tobytes() for s in starts]
    for key in keys:
        seen[key] = seen.get(key, 0) + 1
    covered = np.zeros(len(words) + 1, np.int64)
    for s, key in zip(starts, keys):
        if seen[key] > 1:
            covered[s] += 1
            covered[s + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str) -> tuple:
    """The values of ``MEASURES`` for one text; words are runs of anything but ASCII spaces."""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    n_dup = 0
    for line in text.split("\n"):
        if line in seen:
            n_dup += 1
        elif line and line.strip(SPACES):
            seen.add(line)
    n_repeat = repeated_words(words)
    base = n_words < MIN_WORDS or 100 * n_repeat > REPEAT_PERCENT * n_words
    soft = base or 100 * n_symbols > SOFT_SYMBOLS * n_words or 100 * n_dup > SOFT_LINES * n_words or 10 * word_chars < SOFT_SHORT * n_words or 10 * word_chars > SOFT_LONG * n_words
    return n_words, word_chars, n_symbols, n_dup, n_repeat, base, soft


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the columns of ``MEASURES``; columns already so named are replaced."""
    keep = [c for c in df.columns if c not in _NAMES]
    rows = df.select(*(f"`{c}`" for c in keep))
    at = keep.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(x) for x in texts_of(batch.column(at))]
        new = [pa.array(v, pa.bool_() if name.endswith("failed") else pa.int64()) for name, v in zip(_NAMES, zip(*rows))]
        return pa.record_batch([*batch.columns, *new], [*batch.schema.names, *_NAMES])

    return map_slices(rows, text_col, extended(rows.schema, MEASURES), run)


def host_verdicts(marks: DataFrame, host: str = "host", per_mille: int = HOST_PER_MILLE) -> DataFrame:
    """(host, n_docs, n_failed, rejected) from rows of (host, soft_failed).

    The prior is the beta distribution whose mean is the corpus rate and whose strength, in
    documents, is the method of moments over hosts, held between 2 and 1000; all in whole
    numbers, so that every engine gets the same verdict. A null host is a host of its own.
    """
    hosts = marks.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col("soft_failed").cast("long")).alias("n_failed"))
    # Moments over hosts: s1 = sum of rates, s2 = sum of squared rates, in per mille.
    rate = F.expr("n_failed * 1000 div n_docs")
    prior = hosts.agg(
        F.count("*").alias("k"),
        F.sum("n_docs").alias("all_docs"),
        F.sum("n_failed").alias("all_failed"),
        F.sum(rate).alias("s1"),
        F.sum(rate * rate).alias("s2"),
    ).selectExpr("all_docs", "all_failed", "all_failed * 1000 div all_docs AS mean", "s2 div k - (s1 div k) * (s1 div k) AS var")
    strength = prior.selectExpr("all_docs", "all_failed", "CASE WHEN var <= 0 THEN 1000L ELSE greatest(2L, least(1000L, mean * (1000 - mean) div var - 1)) END AS strength")
    shrunk = "(cast(n_failed AS decimal(19, 0)) * all_docs + strength * all_failed) * 1000 >= cast({} AS decimal(38, 0)) * (n_docs + strength) * all_docs"
    return hosts.crossJoin(F.broadcast(strength)).select(host, "n_docs", "n_failed", F.expr(shrunk.format(per_mille)).alias("rejected"))


#: A host as a key that is never null.
_HOST_KEY = "coalesce(concat('=', host), '')"


def _bad_hosts(marks: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """(key, n_docs, bad) of the hosts whose verdict is to reject, their number, and that of all documents."""
    hosts = scratch.keep(host_verdicts(marks))
    bad = scratch.keep(hosts.where("rejected").select(F.expr(_HOST_KEY).alias("__host"), F.col("n_docs").alias("__n"), F.lit(True).alias("__bad")))
    return bad, bad.count(), hosts.agg(F.sum("n_docs")).first()[0] or 0


def _flagged(df: DataFrame, bad: DataFrame, n_bad: int, total: int) -> DataFrame:
    """``df`` with ``bad_host``: whether the host's verdict is to reject."""
    if n_bad <= BROADCAST_HOSTS:
        out = df.join(F.broadcast(bad), F.expr(_HOST_KEY) == F.col("__host"), "left")
    else:
        out = join_counted(df.withColumn("__host", F.expr(_HOST_KEY)), bad, "__host", "__n", total, "left")
    return out.withColumn("bad_host", F.coalesce("__bad", F.lit(False))).drop("__host", "__n", "__bad")


def quality_table(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures and verdict of every document.

    Returns ``id_col``, the columns of ``MEASURES``, ``bad_host`` and ``kept``. A null text
    has no words and so fails; a null host is a host of its own; repeated rows each give a
    row and each count for their host; other columns are not read; an empty table gives an
    empty result.
    """
    scratch = Scratch(df.sparkSession, "quality")
    rows = df.select(named(id_col, "id"), named(host_col, "host"), named(text_col, "text"))
    marks = scratch.keep(measured(rows).drop("text"))
    out = _flagged(marks, *_bad_hosts(marks, scratch))
    return out.select(F.col("id").alias(id_col), *_NAMES, "bad_host", _kept().alias("kept"))


def _kept():
    return ~F.col("base_failed") & ~(F.col("soft_failed") & F.col("bad_host"))


def quality_filter(df: DataFrame, *, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``df`` that the rules keep, with the columns of ``df``.

    Texts are measured twice, once for the hosts and once to filter: that costs CPU seconds
    but moves no text between executors. Nulls and repeated rows as in :func:`quality_table`.
    """
    scratch = Scratch(df.sparkSession, "quality")
    marks = measured(df.select(named(host_col, "host"), named(text_col, "text"))).select("host", "soft_failed")
    bad, n_bad, total = _bad_hosts(marks, scratch)
    rows = measured(packed(df, text_col, named(host_col, "host")))
    if n_bad <= BROADCAST_HOSTS:
        out = _flagged(rows, bad, n_bad, total).where(_kept())
    else:  # only documents that break a weaker rule need their host's verdict, so no other text moves
        sure = rows.where("NOT base_failed AND NOT soft_failed").withColumn("bad_host", F.lit(False))
        out = sure.unionByName(_flagged(rows.where("soft_failed AND NOT base_failed"), bad, n_bad, total).where(_kept()))
    return unpacked(out, df.columns, text_col)
