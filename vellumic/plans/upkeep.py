"""Queries of incremental upkeep, trails, sessions, evaluation and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumic.operators import evaluate as E
from vellumic.operators import incremental as I
from vellumic.operators.contains import containing
from vellumic.operators.ranking import ranked
from vellumic.plans.common import indexed_bm25, lex_sql, table
from vellumic.streaming import events as V


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _snapshots(spark, sf_dir):
    """An old index without every tenth document and with other texts and titles for some."""
    docs = _docs(spark, sf_dir)
    new = docs.select("doc_id", I.body_hash(F.col("text")).alias("body_hash"), I.meta_hash(F.col("source"), F.col("lang")).alias("meta_hash"), (F.col("doc_id") % 13 != 0).alias("useful"))
    body = F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("text"))
    meta = F.when(F.col("doc_id") % 11 == 0, F.lit("y")).otherwise(F.col("source"))
    old = docs.where("doc_id % 10 <> 0").select("doc_id", I.body_hash(body).alias("body_hash"), I.meta_hash(meta, F.col("lang")).alias("meta_hash"), (F.col("doc_id") % 17 != 0).alias("useful"))
    gone = docs.where("doc_id % 19 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.lit("z").alias("body_hash"), F.lit("z").alias("meta_hash"), F.lit(True).alias("useful"))
    return old.unionByName(gone), new


def index_diff(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return I.index_diff(old, new, "doc_id").groupBy("action").agg(F.count("*").alias("n"))


def staleness(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return I.staleness(old, new, "doc_id", "body_hash")


def dedup_exact(spark, sf_dir):
    return I.exact_duplicates(_docs(spark, sf_dir), "doc_id", "text")


def manifest_routing(spark, sf_dir):
    """Every third document is known, every fifteenth was removed."""
    files = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha"))
    known = files.groupBy("sha").agg(F.min("doc_id").alias("d")).where("d % 3 = 0").select("sha", F.when(F.col("d") % 15 == 0, "removido").otherwise("ok").alias("status"))
    return I.routed(files, known).select("doc_id", "route")


def trail_bonus(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("similarity", F.col("value") / 100)
    return I.trail_strength(rows, "similarity", "user_id", "event_type").select("user_id", "event_type", F.round("bonus", 6).alias("bonus"))


def trail_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))
    return rows.orderBy(F.col("n").desc(), "user_id").limit(15)


def session_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("rounds"), F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("quando"))
    return I.latest_sessions(rows.withColumnRenamed("conv_id", "session"), "quando").select(F.col("session").alias("conv_id"), "rounds", "last_role")


def _evaluation(spark, sf_dir):
    """Benchmark items as questions: their first four words; targets are documents that hold the text."""
    items = table(spark, sf_dir, "benchmark")
    questions = items.select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("q"), "text")
    docs = _docs(spark, sf_dir)
    targets = containing(docs.select("doc_id", "source", F.col("text").alias("body")), "body", questions, "text").select("qid", "doc_id", "source")
    rankings = ranked(indexed_bm25(spark, sf_dir, questions), "score", ["doc_id"], by=["qid"], most=50)
    return questions, targets, rankings


def eval_hit_mrr(spark, sf_dir):
    questions, targets, rankings = _evaluation(spark, sf_dir)
    positions = E.target_positions(rankings, targets, questions, "qid", "doc_id")
    out = positions.agg(*E.metrics())
    return out.select(F.lit("bm25").alias("method"), "hit1", "hit3", "hit6", F.round("mrr", 6).alias("mrr"))


def eval_stratified(spark, sf_dir):
    questions, targets, rankings = _evaluation(spark, sf_dir)
    positions = E.target_positions(rankings, targets, questions, "qid", "doc_id")
    rows = positions.withColumns({"domain": F.col("qid") % 3, "cohort": F.when(F.col("qid") < 20, "old").otherwise("new")})
    return E.stratified(rows, "domain", "cohort")


def failure_families(spark, sf_dir):
    questions, targets, rankings = _evaluation(spark, sf_dir)
    positions = E.target_positions(rankings, targets, questions, "qid", "doc_id")
    winners = rankings.where("rank = 1").select("qid", F.col("source").alias("category"))
    wanted = targets.groupBy("qid").agg(F.collect_set("source").alias("categories"))
    return E.failure_families(positions, winners, wanted, "qid")


def noise_audit(spark, sf_dir):
    _, targets, rankings = _evaluation(spark, sf_dir)
    return E.noise(rankings, targets, "doc_id")


def coverage_audit(spark, sf_dir):
    """Questions with a target among the first three, and intruders there by source."""
    _, targets, rankings = _evaluation(spark, sf_dir)
    return E.coverage(rankings, targets, "qid", "doc_id", "source")


def predictor_accuracy(spark, sf_dir):
    """The sources of a question's first chapters, in order, against those of its targets."""
    _, targets, rankings = _evaluation(spark, sf_dir)
    first = rankings.groupBy("qid", "source").agg(F.min("rank").alias("place"))
    predictions = ranked(first.withColumn("score", -F.col("place").cast("double")), "score", ["source"], by=["qid"], most=3)
    return E.predictor_accuracy(predictions, targets.select("qid", "source").distinct(), "qid", "source")


def ground_truth_lint(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    questions = items.select(F.col("item_id").alias("qid"), F.substring_index("text", " ", 1).alias("q"))
    folders = _docs(spark, sf_dir).select(F.col("text").alias("folder")).distinct()
    return E.lint(questions, items.select(F.col("item_id").alias("qid"), F.col("text").alias("mark")), folders)


def stream_tumbling(spark, sf_dir):
    return V.tumbling(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark, sf_dir):
    return V.sliding(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def stream_sessions(spark, sf_dir):
    out = V.sessions(table(spark, sf_dir, "events"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        index_diff, staleness, dedup_exact, manifest_routing, trail_bonus, trail_listing, session_latest, eval_hit_mrr, eval_stratified, failure_families,
        noise_audit, coverage_audit, predictor_accuracy, ground_truth_lint, stream_tumbling, stream_sliding, stream_sessions,
    )
}

_SNAPSHOTS = """new AS (SELECT doc_id, text AS b, source AS m, doc_id % 13 <> 0 AS u FROM documents
), old AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE text END AS b, CASE WHEN doc_id % 11 = 0 THEN 'y' ELSE source END AS m, doc_id % 17 <> 0 AS u FROM documents WHERE doc_id % 10 <> 0
  UNION ALL SELECT doc_id + 1000000000, 'z', 'z', true FROM documents WHERE doc_id % 19 = 0
), j AS (SELECT o.b AS ob, o.m AS om, coalesce(o.u, false) AS ou, n.b AS nb, n.m AS nm, coalesce(n.u, false) AS nu FROM old o FULL JOIN new n USING (doc_id))"""


def _evaluation_sql() -> str:
    from vellumic.plans.common import tokens_sql

    return f"""{lex_sql()}, it AS (SELECT item_id AS qid, text, array_to_string(string_split(text, ' ')[1:6], ' ') AS q FROM benchmark
), q AS (SELECT qid, unnest({tokens_sql('q')}) AS term FROM it), w AS (SELECT qid, term, count(*) AS times FROM q GROUP BY ALL
), tf AS (SELECT doc_id, source, n, term, count(*) AS tf FROM (SELECT doc_id, source, n, unnest(toks) AS term FROM lex) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), sc AS (
  SELECT qid, doc_id, source, sum(times * ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))) AS score
  FROM w JOIN tf USING (term) JOIN df USING (term), tot GROUP BY qid, doc_id, source
), rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 50
), tg AS (SELECT qid, doc_id, source FROM documents d JOIN it ON contains(d.text, it.text)
), ps AS (SELECT qid, coalesce(min(rank), 0) AS position FROM it LEFT JOIN (SELECT qid, rank FROM rk JOIN tg USING (qid, doc_id)) USING (qid) GROUP BY qid)"""


_EVAL = _evaluation_sql()
_HIT = "count(*) FILTER (WHERE position BETWEEN 1 AND {k}) AS hit{k}"
ORACLES = {
    "index_diff": f"""WITH {_SNAPSHOTS}, a AS (SELECT CASE WHEN nu AND (NOT ou OR ob <> nb) THEN 'embed' WHEN ou AND NOT nu THEN 'delete' WHEN nu AND om <> nm THEN 'refresh' WHEN nu THEN 'keep' END AS action FROM j)
SELECT action, count(*) AS n FROM a WHERE action IS NOT NULL GROUP BY action""",
    "staleness": f"WITH {_SNAPSHOTS} SELECT count(*) FILTER (WHERE ob IS NULL) AS new, count(*) FILTER (WHERE ob <> nb) AS modified, count(*) FILTER (WHERE nb IS NULL) AS missing FROM j",
    "dedup_exact": "SELECT sha256(text) AS sha, min(doc_id) AS keep_id, count(*) AS n_copies FROM documents GROUP BY sha256(text)",
    "manifest_routing": """WITH k AS (SELECT text, min(doc_id) AS d FROM documents GROUP BY text HAVING min(doc_id) % 3 = 0)
SELECT doc_id, CASE WHEN d % 15 = 0 THEN 'removed' WHEN d IS NOT NULL THEN 'duplicate' ELSE 'take' END AS route FROM documents LEFT JOIN k USING (text)""",
    "trail_bonus": "SELECT user_id, event_type, round(0.1::DOUBLE * ln(1 + sum(value / 100)), 6) AS bonus FROM events WHERE value / 100 >= 0.55 GROUP BY ALL",
    "trail_listing": "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 15",
    "session_latest": "SELECT conv_id, count(*) AS rounds, max_by(role, turn) AS last_role FROM conversations GROUP BY conv_id ORDER BY max(turn) DESC, conv_id LIMIT 40",
    "eval_hit_mrr": f"WITH {_EVAL} SELECT 'bm25' AS method, {', '.join(_HIT.format(k=k) for k in (1, 3, 6))}, round(avg(CASE WHEN position > 0 THEN 1.0::DOUBLE / position ELSE 0 END), 6) AS mrr FROM ps",
    "eval_stratified": f"""WITH {_EVAL}, x AS (SELECT *, qid % 3 AS domain, CASE WHEN qid < 20 THEN 'old' ELSE 'new' END AS cohort FROM ps)
SELECT CASE WHEN domain IS NOT NULL THEN 'domain=' || domain WHEN cohort IS NOT NULL THEN 'cohort=' || cohort ELSE 'all' END AS stratum, {', '.join(_HIT.format(k=k) for k in (1, 3))}, count(*) AS n
FROM x GROUP BY GROUPING SETS ((), (domain), (cohort))""",
    "failure_families": f"""WITH {_EVAL}, f AS (SELECT ps.qid, CASE WHEN position = 1 THEN 'acerto' WHEN position BETWEEN 2 AND 3 THEN 'acerto-top3' WHEN position = 0 THEN 'alvo-invisivel'
  WHEN EXISTS (SELECT 1 FROM tg JOIN rk USING (qid) WHERE rk.rank = 1 AND tg.qid = ps.qid AND tg.source = rk.source) THEN 'distrator-vizinho' ELSE 'distrator-de-outra-categoria' END AS family FROM ps)
SELECT family, count(*) AS n FROM f GROUP BY family""",
    "noise_audit": f"WITH {_EVAL} SELECT doc_id, count(*) AS intrusions FROM rk WHERE rank <= 3 AND doc_id NOT IN (SELECT doc_id FROM tg) GROUP BY doc_id",
    "coverage_audit": f"""WITH {_EVAL}, t AS (SELECT qid, doc_id, source, (qid, doc_id) IN (SELECT (qid, doc_id) FROM tg) AS hit FROM rk WHERE rank <= 3)
SELECT 'covered' AS kind, count(DISTINCT qid) AS n FROM t WHERE hit UNION ALL SELECT source, count(*) FROM t WHERE NOT hit GROUP BY source""",
    "predictor_accuracy": f"""WITH {_EVAL}, f AS (SELECT qid, source, row_number() OVER (PARTITION BY qid ORDER BY min(rank), source) AS r FROM rk GROUP BY qid, source
), h AS (SELECT qid, min(r) AS r FROM f JOIN (SELECT DISTINCT qid, source FROM tg) USING (qid, source) WHERE r <= 3 GROUP BY qid)
SELECT count(*) FILTER (WHERE r <= 1) AS top1, count(*) FILTER (WHERE r <= 2) AS top2, count(*) FILTER (WHERE r <= 3) AS top3 FROM h""",
    "ground_truth_lint": """WITH f AS (SELECT DISTINCT text AS folder FROM documents), m AS (SELECT b.item_id, count(folder) AS c FROM benchmark b LEFT JOIN f ON contains(folder, b.text) GROUP BY b.item_id)
SELECT 'repeated' AS kind, count(*) AS n FROM (SELECT split_part(text, ' ', 1) FROM benchmark GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'orphan', count(*) FROM m WHERE c = 0 UNION ALL SELECT 'ambiguous', count(*) FROM m WHERE c > 1
UNION ALL SELECT 'uncovered', count(*) FROM f WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(folder, b.text))""",
    "stream_tumbling": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": "SELECT strftime(date_trunc('hour', ts) - to_hours(h), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events, range(6) t(h) GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
