"""What the registered queries share."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from vellumic.operators import lexical, lexindex
from vellumic.scratch import shared_dir
from vellumic.sources.tables import table

__all__ = ["FOLD", "Q1", "Q2", "bm25_sql", "indexed_bm25", "lex_sql", "questions_bm25", "table", "tokens_sql"]

Q1, Q2 = "thble thtion ering", "attion erble oning"

#: Of each index that this application built: the files of its documents, as they were then.
_BUILT: dict[str, tuple] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """(path, length, time) of the files at a path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(root)))


def lexical_index(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the index of ``documents``: loaded, or brought up to date if files changed."""
    name = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    root = f"{shared_dir(spark)}/vellumic-{spark.sparkContext.applicationId}/lexical-{name}"
    stamp = _stamp(spark, f"{sf_dir}/documents.parquet")
    if _BUILT.get(root) != stamp:
        lexindex.refresh(spark, root, table(spark, sf_dir, "documents"), "doc_id", "text", "source")
        _BUILT[root] = stamp
    return root


def indexed_bm25(spark: SparkSession, sf_dir: str, questions: DataFrame) -> DataFrame:
    """(qid, doc_id, source, score, n_terms) of ``documents`` from their index."""
    return lexindex.bm25(spark, lexical_index(spark, sf_dir), questions, "doc_id", "source")


def questions_bm25(spark: SparkSession, sf_dir: str, *texts: str) -> DataFrame:
    return indexed_bm25(spark, sf_dir, lexical.questions_of(spark, texts))


#: DuckDB: the folded text of a column, its tokens, and the chapters as a common table.
FOLD = "regexp_replace(strip_accents(lower({})), '[^\\x00-\\x7F]', '', 'g')"


def tokens_sql(column: str) -> str:
    from vellumic.functions.text import STOPWORDS

    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(regexp_extract_all({FOLD.format(column)}, '[a-z0-9][a-z0-9_]+'), lambda t: t NOT IN ({stop}))"


def lex_sql() -> str:
    """Common tables ``lex`` (doc_id, source, tokens, n) and ``tot`` (total, mean)."""
    return f"""lex AS (
  SELECT doc_id, source, text, toks, len(toks) AS n FROM (SELECT doc_id, source, text, {tokens_sql('text')} AS toks FROM documents)
), tot AS (SELECT count(*) AS total, avg(n) AS mean FROM lex)"""


def bm25_sql(queries: list[str]) -> str:
    """Common tables up to ``scored`` (qid, doc_id, source, score, n_terms)."""
    values = ", ".join(f"({k}, '{t}')" for k, q in enumerate(queries) for t in q.split())
    return f"""{lex_sql()}, q(qid, term) AS (VALUES {values}
), w AS (SELECT qid, term, count(*) AS times FROM q GROUP BY ALL
), tf AS (
  SELECT doc_id, source, n, term, count(*) AS tf FROM (SELECT doc_id, source, n, unnest(toks) AS term FROM lex) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), scored AS (
  SELECT qid, doc_id, source, sum(times * ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))) AS score, count(*) AS n_terms
  FROM w JOIN tf USING (term) JOIN df USING (term), tot GROUP BY qid, doc_id, source
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS r FROM scored
), fused AS (
  SELECT doc_id, source, max(1.0::DOUBLE / (60 + r)) AS score FROM placed WHERE r <= 200 GROUP BY doc_id, source
)"""
