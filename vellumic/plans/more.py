"""Queries of single rules, samples, unions and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumic.functions import text as T
from vellumic.operators import catalog as C
from vellumic.operators import dense as D
from vellumic.operators import evaluate as E
from vellumic.operators import hybrid as H
from vellumic.operators import incremental as I
from vellumic.operators import layout as Y
from vellumic.operators import lexical as L
from vellumic.operators import passages as P
from vellumic.operators import quality as Q
from vellumic.operators.contains import containing
from vellumic.operators.ranking import best_per_group, first_per_group, ranked
from vellumic.plans.common import Q1, Q2, bm25_sql, indexed_bm25, questions_bm25, table, tokens_sql
from vellumic.sources import chapters as S


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _titles(spark, sf_dir):
    """Titles of several kinds, by id, and first sentences."""
    first = F.split_part("text", F.lit("."), F.lit(1))
    title = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Chapter "), "doc_id")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("5. References "), "doc_id")).when(F.col("doc_id") % 5 == 2, F.lit("Donald Miller")).otherwise(first)
    return _docs(spark, sf_dir).select("doc_id", title.alias("title"))


def title_kinds(spark, sf_dir):
    t = F.col("title")
    return _titles(spark, sf_dir).select("doc_id", Q.is_support_title(t).alias("support"), Q.is_generic_title(t).alias("generic"))


def name_titles(spark, sf_dir):
    return _titles(spark, sf_dir).select("doc_id", Q.is_name_only(F.col("title")).alias("name_only"))


def extraction_canary(spark, sf_dir):
    """Words without and with a tenth of them lost, for documents of enough characters."""
    raw, kept = F.col("n_chars"), F.col("n_chars") - F.col("doc_id") % 4 * F.col("n_chars") / 10
    out = _docs(spark, sf_dir).select("doc_id", F.round(Q.extraction_ratio(kept, raw), 6).alias("ratio"), Q.extraction_warning(kept, raw).alias("warn"), Q.accepted(raw / 6, F.col("doc_id") % 40 + 1).alias("accepted"))
    return out


def front_matter(spark, sf_dir):
    text = F.concat(S.rendered({"titulo": F.concat(F.lit('Um "'), "source", F.lit('": x')), "idioma": F.col("lang")}), F.col("text"))
    rows = _docs(spark, sf_dir).select("doc_id", text.alias("t"))
    return rows.select("doc_id", S.front_matter(F.col("t"))["titulo"].alias("titulo"), S.front_matter(F.col("t"))["idioma"].alias("idioma"), F.md5(S.body(F.col("t"))).alias("body_md5"))


def context_prefix(spark, sf_dir):
    rows = _titles(spark, sf_dir)
    return rows.select("doc_id", P.context_prefix(F.col("title"), F.concat(F.lit("cap "), "doc_id")).alias("prefix"))


def document_sample(spark, sf_dir):
    """The first documents of each source up to 20 000 characters, the one that crosses included."""
    return C.sampled(_docs(spark, sf_dir), "source", "doc_id", "text", chars=20_000).select("source", F.md5("sample").alias("sample_md5"), F.length("sample").cast("long").alias("n_chars"))


def category_counts(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.countDistinct("text").alias("n_docs"))


def first_cards(spark, sf_dir):
    """The first document of each source stands for it."""
    rows = _docs(spark, sf_dir).select("source", "doc_id", "lang", F.lit(0.0).alias("score"))
    return best_per_group(rows, ["source"], "score", ["doc_id"]).select("source", "doc_id", "lang")


def more_of_document(spark, sf_dir):
    """Best passages of a question's first document by BM25 over its own passages."""
    first = ranked(questions_bm25(spark, sf_dir, Q1), "score", ["doc_id"], most=1).select("doc_id")
    parts = P.passages(_docs(spark, sf_dir).join(first, "doc_id", "left_semi"), "doc_id", "text")
    scored = L.bm25(L.tokenized(parts, "passage_no", "text"), L.questions_of(spark, [Q1]), "passage_no")
    return ranked(scored, "score", ["passage_no"], most=10).select(F.col("passage_no").alias("passage"), F.round("score", 6).alias("score"))


def passage_bm25(spark, sf_dir):
    """BM25 on all passages, the best of each document."""
    parts = P.passages(_docs(spark, sf_dir), "doc_id", "text").withColumn("pid", F.col("doc_id") * 100_000 + F.col("passage_no"))
    scored = L.bm25(L.tokenized(parts, "pid", "text", "doc_id"), L.questions_of(spark, [Q1]), "pid", "doc_id")
    return ranked(best_per_group(scored, ["doc_id"], "score", ["pid"]), "score", ["pid"], most=20).select("rank", "doc_id", "pid", F.round("score", 6).alias("score"))


def documents_in_order(spark, sf_dir):
    """Sources in the order of their first chapter among a question's first 200."""
    top = ranked(questions_bm25(spark, sf_dir, Q1), "score", ["doc_id"], most=200).select("source", "doc_id", "rank")
    return first_per_group(top, ["source"]).select("rank", "source", "doc_id")


def candidate_union(spark, sf_dir):
    """Candidates of two questions, the first one's first, for a reranker."""
    lists = [ranked(questions_bm25(spark, sf_dir, q), "score", ["doc_id"], most=50) for q in (Q1, Q2)]
    return H.union_of(lists, "doc_id")


def diagnostic_ranking(spark, sf_dir):
    """Labels by their best of the first 2000 vectors."""
    rows = table(spark, sf_dir, "embeddings")
    query = D.vector_of(rows.where("vec_id = 0"))
    top = ranked(D.scored(rows, query), "score", ["vec_id"], most=2000).drop("rank")
    return ranked(best_per_group(top, ["label"], "score", ["vec_id"]), "score", ["vec_id"], most=50).select("rank", "label", "vec_id", F.round("score", 6).alias("score"))


def judgement_union(spark, sf_dir):
    """Turns of a conversation as judgements of two rounds, accumulated."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") % 2 == 0, F.col("turn"))).alias("a"), F.collect_list(F.when(F.col("turn") >= 3, F.col("turn"))).alias("b"))
    return rows.select("conv_id", F.array_join(I.accumulated(F.col("a"), F.col("b")), ",").alias("judged"))


def body_hashes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", I.body_hash(F.col("text")).alias("body_hash"), I.meta_hash(F.col("source"), F.col("lang")).alias("meta_hash"), I.session_id(F.col("source")).alias("session"))


def block_headings(spark, sf_dir):
    """Lines as blocks whose size falls with their length: markdown by ratio to a body of 10."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    size = F.when(F.length("line") < 20, 17.0).when(F.length("line") < 60, 12.0).otherwise(10.0)
    md = Y.block_markdown(F.col("line"), F.lit(1), size, F.when(F.col("k") == 0, 1.0).otherwise(0.0), F.lit(10.0), F.lit(False))
    return lines.select("doc_id", F.col("k").cast("long").alias("k"), F.md5(md).alias("md_md5"))


def eval_grid(spark, sf_dir):
    """BM25 without a cut, with its domain and with its category, all questions at once."""
    items = table(spark, sf_dir, "benchmark")
    questions = items.select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("q"), "text")
    docs = _docs(spark, sf_dir)
    targets = containing(docs.select("doc_id", "source", F.col("text").alias("body")), "body", questions, "text").select("qid", "doc_id", "source")
    scored = indexed_bm25(spark, sf_dir, questions)
    number = F.substring("source", 4, 9).cast("int")
    domain = targets.select("qid", (number % 3).alias("cut")).distinct()
    cuts = {"none": scored, "domain": scored.withColumn("cut", number % 3).join(domain, ["qid", "cut"], "left_semi"), "category": scored.join(targets.select("qid", "source").distinct(), ["qid", "source"], "left_semi")}
    out = None
    for name, rows in cuts.items():
        rankings = ranked(rows.select("qid", "doc_id", "score"), "score", ["doc_id"], by=["qid"], most=50)
        row = E.target_positions(rankings, targets, questions, "qid", "doc_id").agg(*E.metrics((1, 3))).select(F.lit(name).alias("cut"), "hit1", "hit3", F.round("mrr", 6).alias("mrr"))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        title_kinds, name_titles, extraction_canary, front_matter, context_prefix, document_sample, category_counts, first_cards, more_of_document, passage_bm25,
        documents_in_order, candidate_union, diagnostic_ranking, judgement_union, body_hashes, block_headings, eval_grid,
    )
}

_TITLES = "ti AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Chapter ' || doc_id WHEN 1 THEN '5. References ' || doc_id WHEN 2 THEN 'Donald Miller' ELSE split_part(text, '.', 1) END AS title FROM documents)"
_SUPPORT = Q.SUPPORT_TITLE.replace("(?iU)", "(?i)").replace("'", "''")
_GENERIC = Q.GENERIC_TITLE.replace("(?iU)", "(?i)")
_TITLE_STOP = ", ".join(f"'{w}'" for w in Q.TITLE_STOPWORDS)
_PASSAGES = """p0 AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM {source}
), p1 AS (SELECT doc_id, w, len(w) AS n, unnest(range(0, len(w), 50)) AS s FROM p0
), pa AS (SELECT doc_id, s // 50 AS passage_no, array_to_string(w[s + 1:s + 60], ' ') AS text FROM p1 WHERE s = 0 OR (n - s >= 25 AND s + 10 < n))"""


def _passage_scores(source: str) -> str:
    terms = ", ".join(f"('{t}')" for t in Q1.split())
    return f"""{_PASSAGES.format(source=source)}, lx AS (SELECT doc_id, passage_no, toks, len(toks) AS n FROM (SELECT doc_id, passage_no, {tokens_sql('text')} AS toks FROM pa)
), tt AS (SELECT count(*) AS total, avg(n) AS mean FROM lx), q(term) AS (VALUES {terms}
), tf AS (SELECT doc_id, passage_no, n, term, count(*) AS tf FROM (SELECT doc_id, passage_no, n, unnest(toks) AS term FROM lx) JOIN q USING (term) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), sc AS (
  SELECT doc_id, passage_no, sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))) AS score FROM tf JOIN df USING (term), tt GROUP BY ALL)"""


def _grid() -> str:
    from vellumic.plans.upkeep import _EVAL

    ranked_by = lambda where: f"SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE {where}"
    cuts = {
        "none": "true",
        "domain": "(qid, source[4:]::INT % 3) IN (SELECT (qid, source[4:]::INT % 3) FROM tg)",
        "category": "(qid, source) IN (SELECT (qid, source) FROM tg)",
    }
    one = lambda name, where: f"""SELECT '{name}' AS cut, count(*) FILTER (WHERE p = 1) AS hit1, count(*) FILTER (WHERE p BETWEEN 1 AND 3) AS hit3, round(avg(CASE WHEN p > 0 THEN 1.0::DOUBLE / p ELSE 0 END), 6) AS mrr
FROM (SELECT it.qid, coalesce(min(rank), 0) AS p FROM it LEFT JOIN (SELECT r.qid, r.rank FROM ({ranked_by(where)}) r JOIN tg ON r.qid = tg.qid AND r.doc_id = tg.doc_id WHERE r.rank <= 50) x ON x.qid = it.qid GROUP BY it.qid)"""  # noqa: E731
    return f"WITH {_EVAL} " + " UNION ALL ".join(one(n, w) for n, w in cuts.items())


ORACLES = {
    "title_kinds": f"WITH {_TITLES} SELECT doc_id, regexp_matches(trim(title), '{_SUPPORT}') AS support, regexp_matches(trim(title), '{_GENERIC}') OR length(trim(title)) < 4 AS generic FROM ti",
    "name_titles": f"""WITH {_TITLES}, w AS (SELECT doc_id, list_filter(regexp_extract_all(title, '[\\p{{L}}]+'), lambda x: length(x) > 1) AS w FROM ti)
SELECT doc_id, len(w) BETWEEN 1 AND 6 AND len(list_filter(w[2:], lambda x: lower(x) IN ({_TITLE_STOP}))) = 0 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^\\p{{Lu}}'))) = 0 AS name_only FROM w""",
    "extraction_canary": """WITH x AS (SELECT doc_id, n_chars AS raw, n_chars - doc_id % 4 * n_chars::DOUBLE / 10 AS kept, doc_id % 40 + 1 AS pages FROM documents)
SELECT doc_id, round(CASE WHEN raw < 1000 THEN 0 ELSE kept / raw END, 6)::DOUBLE AS ratio, raw >= 1000 AND kept / raw < 0.8 AS warn, NOT (raw / 6 < 15 * pages AND raw / 6 < 3000) AS accepted FROM x""",
    "front_matter": "SELECT doc_id, 'Um ''' || source || ''': x' AS titulo, lang AS idioma, md5(chr(10) || text) AS body_md5 FROM documents",
    "context_prefix": f"WITH {_TITLES} SELECT doc_id, (CASE WHEN trim(title) <> '' THEN trim(title) || '. ' ELSE '' END || 'cap ' || doc_id)[1:160] AS prefix FROM ti",
    "document_sample": """WITH x AS (SELECT source, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents
), s AS (SELECT source, string_agg(text, chr(10) ORDER BY doc_id) AS t FROM x WHERE b <= 20000 AND k <= 40 GROUP BY source) SELECT source, md5(t) AS sample_md5, length(t) AS n_chars FROM s""",
    "category_counts": "SELECT source, count(DISTINCT text) AS n_docs FROM documents GROUP BY source",
    "first_cards": "SELECT source, min(doc_id) AS doc_id, min_by(lang, doc_id) AS lang FROM documents GROUP BY source",
    "more_of_document": f"WITH one AS (SELECT d.* FROM documents d JOIN (WITH {bm25_sql([Q1])} SELECT doc_id FROM placed WHERE r = 1) USING (doc_id)), {_passage_scores('one')} SELECT passage_no AS passage, round(score, 6) AS score FROM sc ORDER BY round(score, 9) DESC, passage_no LIMIT 10",
    "passage_bm25": f"""WITH {_passage_scores('documents')}, b AS (SELECT doc_id, doc_id * 100000 + passage_no AS pid, score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, passage_no) = 1)
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, pid) AS rank, doc_id, pid, round(score, 6) AS score FROM b ORDER BY rank LIMIT 20""",
    "documents_in_order": f"""WITH {bm25_sql([Q1])}, f AS (SELECT source, min(r) AS r, min_by(doc_id, r) AS doc_id FROM placed WHERE r <= 200 GROUP BY source)
SELECT row_number() OVER (ORDER BY r) AS rank, source, doc_id FROM f""",
    "candidate_union": f"WITH {bm25_sql([Q1, Q2])} SELECT doc_id, min(qid * 1000000 + r)::BIGINT AS place FROM placed WHERE r <= 50 GROUP BY doc_id",
    "diagnostic_ranking": """WITH s AS (SELECT e.vec_id, e.label, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
), t AS (SELECT * FROM s ORDER BY round(score, 9) DESC, vec_id LIMIT 2000), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) = 1)
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank, label, vec_id, round(score, 6) AS score FROM b ORDER BY rank LIMIT 50""",
    "judgement_union": "SELECT conv_id, coalesce(array_to_string(list_sort(list_distinct(list(turn) FILTER (WHERE turn % 2 = 0 OR turn >= 3))), ','), '') AS judged FROM conversations GROUP BY conv_id",
    "body_hashes": "SELECT doc_id, sha1(text)[1:16] AS body_hash, sha1(source || chr(0) || lang)[1:12] AS meta_hash, sha1(source)[1:6] AS session FROM documents",
    "block_headings": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents)
SELECT doc_id, k, md5(CASE WHEN regexp_matches(line, '^[\\s\\-–—|]*\\d+[\\s\\-–—|]*$') THEN '' WHEN length(line) < 20 THEN '## ' || line WHEN length(line) < 60 THEN '### ' || line ELSE line END) AS md_md5 FROM l""",
    "eval_grid": _grid(),
}
