"""Dense and hybrid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumic.functions import vectors as V
from vellumic.operators import dense as D
from vellumic.operators import hybrid as H
from vellumic.operators.ranking import ranked
from vellumic.plans.common import Q1, Q2, bm25_sql, questions_bm25, table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _query(spark, sf_dir, k=0):
    return D.vector_of(_vectors(spark, sf_dir).where(F.col("vec_id") == k))


def _scores(spark, sf_dir):
    return D.scored(_vectors(spark, sf_dir), _query(spark, sf_dir))


def _six(df):
    return df.withColumn("score", F.round("score", 6))


def dense_topk(spark, sf_dir):
    return _six(ranked(_scores(spark, sf_dir), "score", ["vec_id"], most=20)).select("rank", "vec_id", "score")


def dense_masked(spark, sf_dir):
    return _six(D.masked(_scores(spark, sf_dir), F.col("label").isin(1, 2, 3))).select("vec_id", "score")


def dense_best_per_group(spark, sf_dir):
    return _six(D.best_per_document(_scores(spark, sf_dir), ["label"], "vec_id")).select("label", "vec_id", "score")


def _centroids(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("doc", F.col("vec_id") % 50)
    return D.centroids(rows, "label", "doc")


def centroids(spark, sf_dir):
    return _centroids(spark, sf_dir).select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def predict_category(spark, sf_dir):
    return _six(D.predict(_centroids(spark, sf_dir), _vectors(spark, sf_dir), "label", "vec_id")).select("vec_id", "label", "score", "rank")


def category_vote(spark, sf_dir):
    top = ranked(_scores(spark, sf_dir), "score", ["vec_id"], most=D.VOTE_TOP)
    return _six(D.vote(top, "label")).select("label", "score", "rank")


def category_vote_by_doc(spark, sf_dir):
    top = ranked(_scores(spark, sf_dir), "score", ["vec_id"], most=D.VOTE_TOP).withColumn("doc", F.col("vec_id") % 50)
    return _six(D.vote_by_document(top, "label", "doc")).select("label", "score", "rank")


def category_prior_bonus(spark, sf_dir):
    first = _vectors(spark, sf_dir).where("vec_id = 0")
    predicted = D.predict(_centroids(spark, sf_dir), first, "label", "vec_id")
    return D.category_prior(_vectors(spark, sf_dir), predicted, "label").select("vec_id", F.round("bonus", 6).alias("bonus"))


def multi_query_vector(spark, sf_dir):
    return D.multi_query(_vectors(spark, sf_dir).where("vec_id IN (0, 1)")).select(F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def _rocchio(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    judged = rows.where("vec_id IN (1, 2, 3)").withColumn("relevant", F.col("vec_id") < 3)
    return D.rocchio(rows.where("vec_id = 0"), judged)


def rocchio_query(spark, sf_dir):
    return _rocchio(spark, sf_dir).select(F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def rocchio_round2(spark, sf_dir):
    moved = D.as_list(_rocchio(spark, sf_dir))
    left = _vectors(spark, sf_dir).where("vec_id NOT IN (0, 1, 2, 3)")
    return _six(D.search(left, moved, "vec_id", 10)).select("rank", "vec_id", "score")


def _dense_documents(spark, sf_dir):
    """Scores of documents that have a vector."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(_scores(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), "doc_id")


def _lexical(spark, sf_dir):
    return questions_bm25(spark, sf_dir, Q1, Q2)


def hybrid_round(spark, sf_dir):
    return _six(H.hybrid_round(_dense_documents(spark, sf_dir), _lexical(spark, sf_dir), "doc_id", "doc_id"))


def hybrid_excluding(spark, sf_dir):
    """The second round: the first one's documents are left out."""
    dense, lexical = _dense_documents(spark, sf_dir), _lexical(spark, sf_dir)
    shown = H.hybrid_round(dense, lexical, "doc_id", "doc_id").select("doc_id")
    return _six(H.hybrid_round(dense, lexical, "doc_id", "doc_id", excluded=shown))


def hybrid_passage_rrf(spark, sf_dir):
    """Chapters of one category: the lexical side is filtered before its cut."""
    chosen = F.col("source").isin("src1", "src2", "src3")
    dense = ranked(_dense_documents(spark, sf_dir).where(chosen), "score", ["doc_id"], most=200)
    lexical = ranked(_lexical(spark, sf_dir).where("qid = 0").where(chosen), "score", ["doc_id"], most=200)
    return _six(H.sum_fused(dense, lexical, "doc_id", 20)).select("rank", "doc_id", "score")


def fill_from_domain(spark, sf_dir):
    """One source that a query exhausts, topped up from its domain (sources 0, 3, 6, ...)."""
    lexical = _lexical(spark, sf_dir)
    own = ranked(lexical.where("qid = 0 AND source = 'src3'").where("score > 4"), "score", ["doc_id"], most=6)
    domain = lexical.where("qid = 0").where("substring(source, 4) % 3 = 0")
    out = H.filled(own, ranked(domain, "score", ["doc_id"], most=60), "doc_id")
    return out.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("rank", "doc_id", "source", "filled")


QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, dense_masked, dense_best_per_group, centroids, predict_category, category_vote, category_vote_by_doc, category_prior_bonus,
        multi_query_vector, rocchio_query, rocchio_round2, hybrid_round, hybrid_excluding, hybrid_passage_rrf, fill_from_domain,
    )
}

_SCORES = "s AS (SELECT e.vec_id, e.label, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
_CENTROIDS = """x AS (SELECT label, vec_id % 50 AS doc, vec_id, unnest(embedding::DOUBLE[]) AS value, unnest(range(64)) AS dim FROM embeddings
), m AS (SELECT label, doc, dim, avg(value) AS value FROM x GROUP BY ALL
), u AS (SELECT label, doc, dim, value / sqrt(sum(value * value) OVER (PARTITION BY label, doc)) AS value FROM m
), mm AS (SELECT label, dim, avg(value) AS value FROM u GROUP BY ALL
), c AS (SELECT label, dim, value / sqrt(sum(value * value) OVER (PARTITION BY label)) AS value FROM mm)"""
_PREDICTED = f"""{_CENTROIDS}, p AS (SELECT vec_id, c.label, sum(x.value * c.value) AS score FROM x JOIN c USING (dim) GROUP BY ALL
), pr AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) AS rank FROM p)"""
_TOP = f"WITH {_SCORES}, t AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS r FROM s)"
_MOVED = """v AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS value, unnest(range(64)) AS dim FROM embeddings WHERE vec_id < 4
), m AS (SELECT dim, sum(value) FILTER (WHERE vec_id = 0) + 0.75 * avg(value) FILTER (WHERE vec_id IN (1, 2)) - 0.15 * avg(value) FILTER (WHERE vec_id = 3) AS m FROM v GROUP BY dim
), moved AS (SELECT dim, m / sqrt(sum(m * m) OVER ()) AS value FROM m)"""
_HYBRID = f"""{bm25_sql([Q1, Q2])}, {_SCORES}, ds AS (SELECT doc_id, source, s.score FROM s JOIN documents ON vec_id = doc_id
), lx AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS place FROM fused)"""


def _round_sql(name: str, where: str) -> str:
    return f"""{name}d AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM ds WHERE {where}
), {name}l AS (SELECT doc_id, row_number() OVER (ORDER BY place) AS r FROM lx WHERE place <= 200 AND doc_id IN (SELECT doc_id FROM ds) AND {where}
), {name}f AS (
  SELECT doc_id, sum(1.0::DOUBLE / (60 + r)) AS score, bool_or(d) AS from_dense, bool_or(NOT d) AS from_lex
  FROM (SELECT *, true AS d FROM {name}d WHERE r <= 30 UNION ALL SELECT *, false FROM {name}l WHERE r <= 30) GROUP BY doc_id
), {name} AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score, from_dense, from_lex FROM {name}f ORDER BY rank LIMIT 6)"""


ORACLES = {
    "dense_topk": f"{_TOP} SELECT r AS rank, vec_id, round(score, 6) AS score FROM t WHERE r <= 20",
    "dense_masked": f"WITH {_SCORES} SELECT vec_id, CASE WHEN label IN (1, 2, 3) THEN round(score, 6) ELSE -1e9 END AS score FROM s",
    "dense_best_per_group": f"WITH {_SCORES} SELECT label, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) = 1",
    "centroids": f"WITH {_CENTROIDS} SELECT label, dim, round(value, 6) AS value FROM c",
    "predict_category": f"WITH {_PREDICTED} SELECT vec_id, label, round(score, 6) AS score, rank FROM pr WHERE rank <= 3",
    "category_vote": f"{_TOP}, v AS (SELECT label, sum(1.0::DOUBLE / (10 + r - 1)) AS score FROM t WHERE r <= 200 GROUP BY label) SELECT label, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, label) AS rank FROM v ORDER BY rank LIMIT 3",
    "category_vote_by_doc": f"""{_TOP}, d AS (SELECT vec_id % 50 AS doc, min_by(label, r) AS label, min(r) AS r FROM t WHERE r <= 200 GROUP BY 1
), n AS (SELECT label, row_number() OVER (ORDER BY r) AS r FROM d), v AS (SELECT label, sum(1.0::DOUBLE / (10 + r - 1)) AS score FROM n GROUP BY label)
SELECT label, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, label) AS rank FROM v ORDER BY rank LIMIT 3""",
    "category_prior_bonus": f"WITH {_PREDICTED} SELECT vec_id, round(coalesce(0.08::DOUBLE * b.score, 0), 6) AS bonus FROM embeddings LEFT JOIN (SELECT label, score FROM pr WHERE vec_id = 0 AND rank <= 3) b USING (label)",
    "multi_query_vector": "WITH v AS (SELECT unnest(embedding::DOUBLE[]) AS value, unnest(range(64)) AS dim FROM embeddings WHERE vec_id IN (0, 1)), s AS (SELECT dim, sum(value) AS v FROM v GROUP BY dim) SELECT dim, round(v / sqrt(sum(v * v) OVER ()), 6) AS value FROM s",
    "rocchio_query": f"WITH {_MOVED} SELECT dim, round(value, 6) AS value FROM moved",
    "rocchio_round2": f"""WITH {_MOVED}, q AS (SELECT list(value ORDER BY dim) AS q FROM moved), s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE vec_id NOT IN (0, 1, 2, 3))
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank, vec_id, round(score, 6) AS score FROM s ORDER BY rank LIMIT 10""",
    "hybrid_round": f"WITH {_HYBRID}, {_round_sql('one', 'true')} SELECT * FROM one",
    "hybrid_excluding": f"WITH {_HYBRID}, {_round_sql('one', 'true')}, {_round_sql('two', 'doc_id NOT IN (SELECT doc_id FROM one)')} SELECT * FROM two",
    "hybrid_passage_rrf": f"""WITH {_HYBRID}, d AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM ds WHERE source IN ('src1', 'src2', 'src3')
), l AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM scored WHERE qid = 0 AND source IN ('src1', 'src2', 'src3')
), f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM d WHERE r <= 200 UNION ALL SELECT * FROM l WHERE r <= 200) GROUP BY doc_id)
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM f ORDER BY rank LIMIT 20""",
    "fill_from_domain": f"""WITH {bm25_sql([Q1, Q2])}, own AS (SELECT doc_id, source, 0 AS late, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM scored WHERE qid = 0 AND source = 'src3' AND score > 4 ORDER BY r LIMIT 6
), dom AS (SELECT doc_id, source, 1 AS late, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM scored WHERE qid = 0 AND source[4:]::INT % 3 = 0 ORDER BY r LIMIT 60)
SELECT row_number() OVER (ORDER BY late, r) AS rank, doc_id, source, late = 1 AS filled FROM (SELECT * FROM own UNION ALL SELECT * FROM dom WHERE doc_id NOT IN (SELECT doc_id FROM own)) ORDER BY rank LIMIT 6""",
}
