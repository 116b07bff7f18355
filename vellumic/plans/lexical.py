"""Lexical queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumic.functions import text as T
from vellumic.operators import lexical as L
from vellumic.operators.ranking import ranked
from vellumic.operators import lexindex
from vellumic.plans.common import Q1, Q2, bm25_sql, lex_sql, questions_bm25, table, tokens_sql
from vellumic.scratch import Scratch

ALLOWED = ("src1", "src2", "src3")


def _lex(spark, sf_dir):
    return L.tokenized(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def tokenize_counts(spark, sf_dir):
    return _lex(spark, sf_dir).select("doc_id", F.col("n").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


def lex_stats(spark, sf_dir):
    return L.term_stats(_lex(spark, sf_dir), "doc_id").where("df >= 5").select("term", "df", F.round("idf", 6).alias("idf"))


def lex_index_refresh(spark, sf_dir):
    """Terms of an index that knew older documents, after it was brought up to date and compacted."""
    docs = table(spark, sf_dir, "documents")
    older = docs.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit("old words only")).otherwise(F.col("text")))
    gone = docs.where("doc_id % 19 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    root = Scratch(spark, "lex-index-refresh").base
    lexindex.refresh(spark, root, older.unionByName(gone), "doc_id", "text", "source")
    lexindex.refresh(spark, root, docs, "doc_id", "text", "source")
    lexindex.compacted(spark, root, "doc_id")
    return lexindex.term_stats(spark, root, "doc_id").where("df >= 5").select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    out = ranked(questions_bm25(spark, sf_dir, Q1), "score", ["doc_id"], most=20)
    return out.select("rank", "doc_id", F.round("score", 6).alias("score"), "n_terms")


def bm25_filtered_after(spark, sf_dir):
    out = L.filtered_after(questions_bm25(spark, sf_dir, Q1), "doc_id", "source", ALLOWED, 30)
    return out.withColumn("score", F.round("score", 6))


def bm25_multi_rrf(spark, sf_dir):
    scored = questions_bm25(spark, sf_dir, Q1, Q2)
    return ranked(L.max_fused(scored, "doc_id"), "score", ["doc_id"], most=20).select("rank", "doc_id", F.round("score", 6).alias("score"))


def bm25_unindexed(spark, sf_dir):
    """The same search over texts that no index has."""
    out = L.search(_lex(spark, sf_dir), L.questions_of(spark, [Q1]), "doc_id", 20)
    return out.withColumn("score", F.round("score", 6))


def snippet(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = ranked(questions_bm25(spark, sf_dir, Q1), "score", ["doc_id"], most=5)
    return L.snippets(docs, hits, "doc_id", "text", Q1.split())


QUERIES = {f.__name__: f for f in (tokenize_counts, lex_stats, lex_index_refresh, bm25_unindexed, bm25_topk, bm25_filtered_after, bm25_multi_rrf, snippet)}

ORACLES = {
    "tokenize_counts": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)",
    "lex_stats": f"""WITH {lex_sql()}, p AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(toks) AS term FROM lex))
SELECT term, count(*) AS df, round(ln(1 + (any_value(total) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p, tot GROUP BY term HAVING count(*) >= 5""",
    "bm25_topk": f"WITH {bm25_sql([Q1])} SELECT r AS rank, doc_id, round(score, 6) AS score, n_terms FROM placed WHERE r <= 20",
    "bm25_unindexed": f"WITH {bm25_sql([Q1])} SELECT r AS rank, doc_id, round(score, 6) AS score, n_terms FROM placed WHERE r <= 20",
    "bm25_filtered_after": f"""WITH {bm25_sql([Q1])}, top AS (SELECT * FROM fused ORDER BY round(score, 9) DESC, doc_id LIMIT 200)
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, source, round(score, 6) AS score FROM top WHERE source IN ('src1', 'src2', 'src3')
ORDER BY rank LIMIT 30""",
    "bm25_multi_rrf": f"""WITH {bm25_sql([Q1, Q2])}
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM fused ORDER BY rank LIMIT 20""",
    "snippet": f"""WITH {bm25_sql([Q1])}, hit AS (SELECT doc_id, text, regexp_replace(strip_accents(lower(text)), '[^\\x00-\\x7F]', '', 'g') AS p FROM placed JOIN lex USING (doc_id) WHERE r <= 5),
loc AS (SELECT *, coalesce({', '.join(f"nullif(instr(p, '{t}'), 0)" for t in Q1.split())}) AS k FROM hit)
SELECT doc_id, coalesce('...' || trim(regexp_replace(substr(text, greatest(1, k - 120), 240), '\\s+', ' ', 'g')) || '...', '') AS snippet FROM loc""",
}
ORACLES["lex_index_refresh"] = ORACLES["lex_stats"]
