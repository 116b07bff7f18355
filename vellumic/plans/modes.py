"""Queries of whole ways of searching and of choosing categories, measured on the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumic.operators import dense as D
from vellumic.operators import modes as M
from vellumic.operators.contains import containing
from vellumic.operators.ranking import ranked
from vellumic.plans.common import indexed_bm25, table
from vellumic.plans.upkeep import _EVAL
from vellumic.scratch import Scratch


def _evaluation(spark, sf_dir):
    """Documents that have a vector, one passage each; items with the vector of their number as questions."""
    scratch = Scratch(spark, "modes")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    passages = docs.join(vectors, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("pid"), F.col("doc_id").alias("document"), F.col("source").alias("category"), "text", "embedding")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    questions = items.join(vectors, F.col("item_id") == F.col("vec_id"), "left").select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("q"), "embedding")
    targets = containing(docs.withColumnRenamed("text", "body"), "body", items, "text").select(F.col("item_id").alias("qid"), F.col("doc_id").alias("document"), F.col("source").alias("category"))
    questions, targets = scratch.keep(questions), scratch.keep(targets)
    lexical = scratch.keep(indexed_bm25(spark, sf_dir, questions.select("qid", "q"))).select(F.col("qid").alias("variant"), "qid", F.col("doc_id").alias("pid"), F.col("doc_id").alias("document"), "score")
    return scratch.keep(passages), questions, targets, lexical


def eval_modes(spark, sf_dir):
    """Every way without a cut, and with the categories of the targets."""
    passages, questions, targets, lexical = _evaluation(spark, sf_dir)
    scored = Scratch(spark, "modes").keep(M.scores(passages, questions))
    named = {}
    for name in M.WAYS:
        named[name] = M.way(name, passages, questions, lexical, targets=targets, scored=scored)
        named[f"{name} oracle"] = M.way(name, passages, questions, lexical, targets=targets, allowed=targets, scored=scored)
    return M.measured(named, targets, questions)


def eval_strategies(spark, sf_dir):
    passages, questions, targets, _ = _evaluation(spark, sf_dir)
    centroids = Scratch(spark, "modes").keep(D.centroids(passages, "category", "document"))
    scored = Scratch(spark, "modes").keep(M.scores(passages, questions))
    named = {name: M.strategy(name, passages, questions, centroids=centroids, targets=targets, scored=scored) for name in M.STRATEGIES}
    return M.measured(named, targets, questions)


def eval_method_grid(spark, sf_dir):
    """Vectors alone and reranked, with no cut, the targets' domain and their category."""
    passages, questions, targets, _ = _evaluation(spark, sf_dir)
    number = F.substring("category", 4, 9).cast("int") % 3
    domain = targets.select("qid", number.alias("d")).distinct().join(passages.select("category").distinct().withColumn("d", number), "d").select("qid", "category")
    named = {}
    for label, allowed in (("none", None), ("domain", domain), ("category", targets)):
        scored = M.cut(M.scores(passages, questions), allowed)
        named[f"semantic {label}"] = M.documents(scored).select("qid", "document", "rank")
        pool = ranked(scored, "score", ["pid"], by=["qid"], most=M.PASSAGE_POOL)
        named[f"rerank {label}"] = M.in_order(M.reranked(pool, passages, questions))
    return M.measured(named, targets, questions)


QUERIES = {f.__name__: f for f in (eval_modes, eval_strategies, eval_method_grid)}

_BASE = f"""{_EVAL}, pa AS (SELECT doc_id, source, text, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id
), qu AS (SELECT qid, q, embedding::DOUBLE[] AS v FROM it LEFT JOIN embeddings ON qid = vec_id
), s AS (SELECT qid, doc_id, source, list_dot_product(qu.v, pa.v) AS score FROM qu, pa WHERE qu.v IS NOT NULL
), qw AS (SELECT qid, list_distinct(list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda x: x <> '')) AS w FROM it
), rr AS (SELECT qid, doc_id, len(list_filter(w, lambda x: list_contains(t, x)))::DOUBLE / len(w) AS score FROM qw, (SELECT doc_id, regexp_split_to_array(lower(text), '\\s+') AS t FROM pa WHERE trim(text) <> '')
), tc AS (SELECT DISTINCT qid, source FROM tg
), lx AS (SELECT qid, doc_id, source, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS place FROM sc QUALIFY place <= 200)"""


def _ordered(rows: str, score: str = "score") -> str:
    """Rows with their rank ``r`` within each question."""
    return f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round({score}, 9) DESC, doc_id) AS r FROM ({rows})"


def _again(rows: str) -> str:
    """Candidates in the order of the reranker."""
    return _ordered(f"SELECT c.qid, c.doc_id, rr.score FROM ({rows}) c JOIN rr USING (qid, doc_id)")


def _fused(dense: str, words: str) -> str:
    d = f"SELECT qid, doc_id, r FROM ({_ordered(dense)}) WHERE r <= 30"
    w = f"SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY place) AS r FROM ({words}) WHERE (qid, doc_id) IN (SELECT (qid, doc_id) FROM ({dense})) QUALIFY r <= 30"
    sums = f"SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM ({d} UNION ALL {w}) GROUP BY qid, doc_id"
    return f"SELECT qid, doc_id FROM ({_ordered(sums)}) WHERE r <= 6"


def _measured(name: str, rows: str) -> str:
    hits = ", ".join(f"count(*) FILTER (WHERE p BETWEEN 1 AND {k}) AS hit{k}" for k in (1, 3, 6, 12))
    return f"""SELECT '{name}' AS mode, {hits}, round(avg(CASE WHEN p > 0 THEN 1.0::DOUBLE / p ELSE 0 END), 6) AS mrr
FROM (SELECT it.qid, coalesce(min(r), 0) AS p FROM it LEFT JOIN (SELECT x.qid, x.r FROM ({rows}) x JOIN tg ON x.qid = tg.qid AND x.doc_id = tg.doc_id) y ON y.qid = it.qid GROUP BY it.qid)"""


def _ways() -> str:
    ctes, parts = [], []
    for tag, label, where in (("all", "", "true"), ("own", " oracle", "(qid, source) IN (SELECT (qid, source) FROM tc)")):
        dense = f"SELECT qid, doc_id, score FROM s WHERE {where}"
        ctes.append(f"{tag}1 AS ({_again(_fused(dense, 'SELECT * FROM lx'))})")
        ctes.append(f"{tag}m AS (SELECT qid, doc_id FROM {tag}1 WHERE qid NOT IN (SELECT {tag}1.qid FROM {tag}1 JOIN tg ON {tag}1.qid = tg.qid AND {tag}1.doc_id = tg.doc_id))")
        ctes.append(f"{tag}n AS (SELECT qid, k, avg(x) AS x FROM (SELECT m.qid, unnest(v) AS x, unnest(range(len(v))) AS k FROM {tag}m m JOIN pa USING (doc_id)) GROUP BY qid, k)")
        ctes.append(f"{tag}w AS (SELECT qid, k, qx - 0.15::DOUBLE * n.x AS x FROM (SELECT qid, unnest(v) AS qx, unnest(range(len(v))) AS k FROM qu) z JOIN {tag}n n USING (qid, k))")
        ctes.append(f"{tag}v AS (SELECT qid, list(x / l ORDER BY k) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY qid)) AS l FROM {tag}w) GROUP BY qid)")
        second = f"SELECT qid, doc_id, list_dot_product({tag}v.v, pa.v) AS score FROM {tag}v, pa WHERE (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM {tag}m) AND {where}"
        words = f"SELECT * FROM lx WHERE qid IN (SELECT qid FROM {tag}m) AND (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM {tag}m)"
        ctes.append(f"{tag}2 AS (SELECT qid, doc_id, r + (SELECT count(*) FROM {tag}1 f WHERE f.qid = y.qid) AS r FROM ({_again(_fused(second, words))}) y)")
        top = lambda n, dense=dense: f"SELECT qid, doc_id FROM ({_ordered(dense)}) WHERE r <= {n}"
        parts += [
            _measured(f"cli{label}", f"SELECT qid, doc_id, r FROM {tag}1"),
            _measured(f"cli-r2{label}", f"SELECT qid, doc_id, r FROM {tag}1 UNION ALL SELECT qid, doc_id, r FROM {tag}2"),
            *(_measured(f"{name}{label}", _again(top(n))) for name, n in (("cli-denso", 6), ("cartao", 10), ("cartao50", 50), ("passagem", 50))),
        ]
    return f"WITH {_BASE}, {', '.join(ctes)} " + " UNION ALL ".join(parts)


def _strategies() -> str:
    cent = """cx AS (SELECT source, doc_id, unnest(v) AS x, unnest(range(len(v))) AS k FROM pa), cu AS (SELECT source, k, x / sqrt(sum(x * x) OVER (PARTITION BY source, doc_id)) AS x FROM cx
), cm AS (SELECT source, k, avg(x) AS x FROM cu GROUP BY source, k), ce AS (SELECT source, list(x / l ORDER BY k) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY source)) AS l FROM cm) GROUP BY source
), pr AS (SELECT qid, source, list_dot_product(qu.v, ce.v) AS score FROM qu, ce WHERE qu.v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, source) <= 3
), vt AS (SELECT qid, source, sum(1.0::DOUBLE / (10 + r - 1)) AS score FROM (""" + _ordered("SELECT * FROM s") + """) WHERE r <= 200 GROUP BY qid, source
), vo AS (SELECT qid, source, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, source) AS k FROM vt QUALIFY k <= 3
), vb AS (SELECT qid, source, 0.08::DOUBLE * (count(*) OVER (PARTITION BY qid) - k + 1) / count(*) OVER (PARTITION BY qid) AS bonus FROM vo)"""
    among = lambda t: f"SELECT qid, doc_id, score FROM s WHERE (qid, source) IN (SELECT (qid, source) FROM {t})"
    raised = lambda t: f"SELECT s.qid, doc_id, s.score + coalesce(b.bonus, 0) AS score FROM s LEFT JOIN {t} b ON b.qid = s.qid AND b.source = s.source"
    ways = {
        "cru": "SELECT qid, doc_id, score FROM s", "filtro": among("pr"), "reforco": raised("(SELECT qid, source, 0.08::DOUBLE * score AS bonus FROM pr)"),
        "voto-filtro": among("vo"), "voto-reforco": raised("vb"), "oracle": among("tc") + " OR qid NOT IN (SELECT qid FROM tc)",
    }
    return f"WITH {_BASE}, {cent} " + " UNION ALL ".join(_measured(n, _again(f"SELECT qid, doc_id FROM ({_ordered(rows)}) WHERE r <= 50")) for n, rows in ways.items())


def _grid() -> str:
    cuts = {"none": "true", "domain": "(qid, source[4:]::INT % 3) IN (SELECT (qid, source[4:]::INT % 3) FROM tc)", "category": "(qid, source) IN (SELECT (qid, source) FROM tc)"}
    parts = []
    for label, where in cuts.items():
        rows = _ordered(f"SELECT qid, doc_id, score FROM s WHERE {where}")
        parts += [_measured(f"semantic {label}", rows), _measured(f"rerank {label}", _again(f"SELECT qid, doc_id FROM ({rows}) WHERE r <= 50"))]
    return f"WITH {_BASE} " + " UNION ALL ".join(parts)


ORACLES = {"eval_modes": _ways(), "eval_strategies": _strategies(), "eval_method_grid": _grid()}
