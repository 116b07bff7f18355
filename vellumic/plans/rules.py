"""Queries of title rules, curation, contents, layout, reranking and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumic import models
from vellumic.functions import text as T
from vellumic.operators import catalog as C
from vellumic.operators import dense as D
from vellumic.operators import evaluate as E
from vellumic.operators import graph as G
from vellumic.operators import incremental as I
from vellumic.operators import labels as B
from vellumic.operators import layout as Y
from vellumic.operators import lexical as L
from vellumic.operators import passages as P
from vellumic.operators import slicing as S
from vellumic.operators.ranking import ranked
from vellumic.plans.common import Q1, table
from vellumic.plans.graph import LEAST, _RANKED, _weights, _weights_sql
from vellumic.plans.more import _passage_scores
from vellumic.plans.upkeep import _SNAPSHOTS, _snapshots
from vellumic.scratch import Scratch
from vellumic.sources import chapters as CH
from vellumic.streaming import events as V

ALLOWED = ("src1", "src2", "src3")
DOMAINS = {"even": ("src0", "src2", "src4"), "odd": ("src1", "src3")}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# Titles and names
def heading_cleanup(spark, sf_dir):
    """Whole texts as headings behind a page number."""
    raw = F.concat(F.col("doc_id") % 10000, F.lit(" - \n "), "text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.clean_heading(raw)).alias("heading_md5"))


def caps_titles(spark, sf_dir):
    title = F.concat_ws(" ", F.when(F.col("doc_id") % 3 == 0, F.lit("CHAPTER OF")).otherwise("chapter of"), F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")), F.upper("lang"))
    return _docs(spark, sf_dir).select("doc_id", T.capital_fixed(title).alias("title"))


def epub_titles(spark, sf_dir):
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.concat("source", F.lit("  Book   \\( PDFDrive.com \\).epub")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" - "), "source", F.lit(".azw3 [lib.org] ")))
        .when(F.col("doc_id") % 4 == 2, F.concat("source", F.lit(" (2nd ed.)_")))
        .otherwise(F.col("source"))
    )
    return _docs(spark, sf_dir).select("doc_id", T.clean_epub_title(raw).alias("title"))


def file_titles(spark, sf_dir):
    stated = F.when(F.col("doc_id") % 4 == 0, "Microsoft Word - x").when(F.col("doc_id") % 4 == 1, "abc").when(F.col("doc_id") % 4 == 2, F.concat("source", F.lit(".PDF"))).otherwise(F.concat(F.lit(" Title "), "source"))
    stem = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("1234567-the_"), "source", F.lit("-ebook_v2"))).otherwise(F.lit("pdf"))
    return _docs(spark, sf_dir).select("doc_id", T.title_of(stated, stem).alias("title"))


def xml_names(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.local_name(F.concat(F.lit("{http://x/"), "source", F.lit("}"), "lang")).alias("name"))


def document_keys(spark, sf_dir):
    sep = F.when(F.col("doc_id") % 2 == 0, "/").otherwise("\\")
    return _docs(spark, sf_dir).select("doc_id", CH.document_key(F.concat_ws("", F.lit("markdown"), sep, "source", sep, F.concat(F.lit("d"), "doc_id"), sep, F.lit("01.md"))).alias("key"))


def patched_front_matter(spark, sf_dir):
    """Grading writes its fields anew; what it does not name stays."""
    text = F.concat(CH.rendered({"titulo": F.col("source"), "idioma": F.col("lang"), "autor": F.col("doc_id"), "util": F.lit("sim")}), "text")
    changes = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("titulo"), F.lit("novo"), F.lit("util"), F.lit("nao"))).otherwise(F.create_map(F.lit("tipo"), F.lit("livro")))
    m = CH.patched(CH.front_matter(text), changes, CH.GRADED)
    rows = _docs(spark, sf_dir).select("doc_id", m.alias("m"))
    return rows.select("doc_id", *(F.coalesce(F.col("m")[k], F.lit("-")).alias(k) for k in ("titulo", "idioma", "autor", "util", "tipo")))


def reference_titles(spark, sf_dir):
    head = F.when(F.col("doc_id") % 3 == 0, "### 5. References:").when(F.col("doc_id") % 3 == 1, "**Bibliografia**").otherwise("---")
    return _docs(spark, sf_dir).select("doc_id", S.reference_title(F.concat(head, F.lit("\n"), "text")).alias("title"))


# Curation
def _manifest(spark, sf_dir):
    status = F.when(F.col("doc_id") % 11 == 0, "falha").otherwise("ok")
    return _docs(spark, sf_dir).select(F.sha2("text", 256).alias("sha"), "doc_id", F.col("source").alias("folder"), F.col("lang").alias("category"), status.alias("status"), F.col("n_chars").alias("n_words"))


def library_status(spark, sf_dir):
    return CH.status(_manifest(spark, sf_dir))


def library_report(spark, sf_dir):
    return CH.library_report(_manifest(spark, sf_dir))


def recategorized_manifest(spark, sf_dir):
    out = I.recategorized(_manifest(spark, sf_dir), list(ALLOWED), "moved")
    return out.groupBy("folder", "category").agg(F.count("*").alias("n"))


def removed_manifest(spark, sf_dir):
    out = I.removed(_manifest(spark, sf_dir), list(ALLOWED))
    return out.groupBy("folder", "status").agg(F.count("*").alias("n"))


def upserted_manifest(spark, sf_dir):
    rows = _manifest(spark, sf_dir).drop("sha")
    changes = rows.where("doc_id % 7 = 0").withColumn("status", F.lit("novo"))
    return I.upserted(rows, changes, "doc_id").select("doc_id", "status", "folder")


def archived_files(spark, sf_dir):
    """Files of which the archive, every fourth document, has a copy."""
    rows = _docs(spark, sf_dir).select("doc_id", F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha"))
    return I.archived(rows, rows.where("doc_id % 4 = 0")).select("doc_id")


def merged_index(spark, sf_dir):
    """Passages of the index after an update: kept ones with current metadata, and new ones."""
    old, new = _snapshots(spark, sf_dir)
    docs = _docs(spark, sf_dir)
    actions = I.index_diff(old, new, "doc_id")
    parts = P.passages(docs, "doc_id", "text").select("doc_id", "passage_no")
    index = parts.where("doc_id % 10 <> 0").withColumns({"source": F.lit("old"), "is_new": F.lit(False)})
    embedded = parts.join(actions.where("action = 'embed'").select("doc_id"), "doc_id", "left_semi").join(docs.select("doc_id", "source"), "doc_id").withColumn("is_new", F.lit(True))
    return I.merged_index(index, actions, embedded.select("doc_id", "passage_no", "source", "is_new"), docs.select("doc_id", "source"), "doc_id")


def seeded_trails(spark, sf_dir):
    """Questions with a mark each; folders are sources and languages, chapters their documents."""
    folders = _docs(spark, sf_dir).select(F.concat_ws("-", "source", "lang").alias("folder"), F.concat(F.lit("c"), "doc_id").alias("chapter"), F.col("n_chars").alias("n_words"))
    items = table(spark, sf_dir, "benchmark")
    questions = items.select(F.substring_index("text", " ", 3).alias("question"), F.concat(F.lit("rc"), (F.col("item_id") % 7).cast("string")).alias("mark"))
    existing = items.where("item_id % 5 = 0").select(F.substring_index("text", " ", 3).alias("question"), F.lit("c1").alias("chapter"))
    return I.seeded_trails(questions, folders, existing)


def trail_cosine_bonus(spark, sf_dir):
    """Vectors as past questions, two of three useful, whose chapter is their label."""
    rows = table(spark, sf_dir, "embeddings")
    trails = rows.select("embedding", "label", (F.col("vec_id") % 3 != 0).alias("useful"))
    out = I.trail_bonus(rows.select("vec_id", "label"), trails, D.vector_of(rows.where("vec_id = 0")), "label")
    return out.select("vec_id", F.round("bonus", 6).alias("bonus"))


# Contents and layout
def toc_cuts(spark, sf_dir):
    """Contents tables made of orders: a customer's orders are entries on two levels."""
    orders = table(spark, sf_dir, "orders")
    toc = orders.select(
        F.col("o_custkey").alias("doc"), (1 + F.col("o_orderkey") % 2).alias("level"), (1 + F.col("o_orderkey") % 397).alias("page"), F.lit(400).alias("total"),
        F.col("o_orderkey").alias("place"), F.concat(F.lit(" T \n"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("title"),
    )
    return S.toc_cuts(toc, "doc", "total").select("doc", F.col("cut_no").cast("long").alias("cut_no"), F.col("page").cast("long").alias("page"), "title")


def _blocks(spark, sf_dir):
    """Documents of sources whose pages are the documents, in order of their ids; blocks are sentences."""
    rows = _docs(spark, sf_dir).select("source", F.col("doc_id").alias("page"), F.posexplode(F.split("text", r"\. ")).alias("block", "text"))
    size = F.when((F.col("page") % 3 == 0) & (F.col("block") == 1), 18.0).when(F.length("text") % 7 == 0, 14.0).otherwise(10.0)
    return rows.withColumns({"n_lines": F.lit(1), "size": size})


def heading_candidates(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    out = Y.heading_candidates(blocks, Y.body_font(blocks, "source"), "source")
    return out.select("source", "page", "size", F.md5("title").alias("title_md5"))


def layout_openings(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    found = Y.heading_candidates(blocks, Y.body_font(blocks, "source"), "source")
    last = blocks.groupBy("source").agg(F.max("page").alias("n_pages"))
    return Y.openings(found, last, "source").select("source", "page", F.md5("title").alias("title_md5"))


# Retrieval
def _pool(spark, sf_dir):
    parts = P.passages(_docs(spark, sf_dir), "doc_id", "text").withColumn("pid", F.col("doc_id") * 100_000 + F.col("passage_no"))
    scored = L.bm25(L.tokenized(parts, "pid", "text", "doc_id"), L.questions_of(spark, [Q1]), "pid", "doc_id")
    return parts, scored


def rerank_pool(spark, sf_dir):
    """The best passages of a question, scored anew by the share of its words, best of each document."""
    parts, scored = _pool(spark, sf_dir)
    top = ranked(scored, "score", ["pid"], most=models.RERANK_POOL).drop("rank").join(parts.select("pid", "text"), "pid")
    out = models.reranked(top, Q1, "text", "score", "pid", "doc_id")
    return out.select("rank", "doc_id", "pid", F.round("rescored", 6).alias("score"))


def rerank_vector(spark, sf_dir):
    """A score for every passage: the reranker's for the pool, the least for all others."""
    parts, scored = _pool(spark, sf_dir)
    top = ranked(scored, "score", ["pid"], most=models.RERANK_POOL).drop("rank").join(parts.select("pid", "text"), "pid")
    return models.rerank_vector(parts.select("pid"), top, Q1, "text", "pid").select("pid", F.round("score", 6).alias("score"))


def best_in_chapters(spark, sf_dir):
    """The best vector of each label that a lexical side proposes."""
    rows = table(spark, sf_dir, "embeddings")
    scores = D.scored(rows, D.vector_of(rows.where("vec_id = 0")))
    chapters = rows.where("vec_id % 5 = 0 AND label < 6").select("label").distinct()
    return D.best_in_chapters(scores, chapters, "label", "vec_id").select("label", "vec_id", F.round("score", 6).alias("score"))


def category_cut(spark, sf_dir):
    """What a question may see by category, by domain and by neither."""
    docs, existing = _docs(spark, sf_dir), _docs(spark, sf_dir).select(F.col("source").alias("category"))
    by_domain = C.domain_categories(C.domain_bridge(spark, DOMAINS), existing)
    cuts = [
        docs.where(F.col("source").isin(*ALLOWED)).groupBy().agg(F.count("*").alias("n")).select(F.lit("category").alias("cut"), "n"),
        docs.join(by_domain.withColumnRenamed("category", "source"), "source").groupBy(F.concat(F.lit("domain "), "domain").alias("cut")).agg(F.count("*").alias("n")),
        docs.groupBy().agg(F.count("*").alias("n")).select(F.lit("none").alias("cut"), "n"),
    ]
    return cuts[0].unionByName(cuts[1]).unionByName(cuts[2])


def unmapped_categories(spark, sf_dir):
    existing = _docs(spark, sf_dir).select(F.col("source").alias("category"))
    return C.unmapped_categories(C.domain_bridge(spark, DOMAINS), existing)


def sampled_pool(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id")
    return E.sampled_pool(docs, docs.where("doc_id % 97 = 0"), "doc_id", 150)


def library_map(spark, sf_dir):
    """One card for each document with its best concepts."""
    cards = _docs(spark, sf_dir).select("source", "doc_id")
    out = B.library_map(cards, G.concepts(_weights(spark, sf_dir), "doc_id"), "doc_id", "source")
    return out.select("source", "doc_id", F.array_join("concepts", ", ").alias("concepts"))


# Tables that are written and read back
def chapter_table(spark, sf_dir):
    """Chapters by category; writing one category again leaves the others."""
    path = Scratch(spark, "chapter-table").base
    docs = _docs(spark, sf_dir).select("doc_id", "n_chars", F.col("source").alias("category"))
    CH.write_chapters(docs, path)
    CH.write_chapters(docs.where("category = 'src1' AND doc_id % 2 = 1").withColumn("n_chars", F.lit(0).cast("long")), path)
    return spark.read.parquet(path).groupBy("category").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def manifest_versions(spark, sf_dir):
    """A manifest after two saves."""
    path = Scratch(spark, "manifest-versions").base
    rows = _manifest(spark, sf_dir).select("doc_id", "status", "folder")
    CH.write_version(spark, rows, path)
    CH.write_version(spark, I.removed(CH.read_version(spark, path), list(ALLOWED)), path)
    return CH.read_version(spark, path)


def trail_log(spark, sf_dir):
    """Judgements appended twice, and read with a line that is no record."""
    path = Scratch(spark, "trail-log").base
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("q"), "conv_id").alias("question"), F.concat(F.lit("a\\b\\"), "turn").alias("chapter"), (F.col("turn") % 2 == 0).alias("useful"))
    CH.append_trail(rows, path)
    CH.append_trail(rows.where("turn = 0"), path)
    spark.createDataFrame([("no record {",)], "value string").write.mode("append").text(path)
    return CH.read_trails(spark, path).groupBy("question", "useful").agg(F.count("*").alias("n"), F.min("chapter").alias("first"))


def _streamed(spark, name, rows):
    """The last state of a query over a stream, as its sink has it."""
    scratch = Scratch(spark, name)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{scratch.base}/out")

    query = rows.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{scratch.base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{scratch.base}/out")


def _event_stream(spark, sf_dir):
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(kind).parquet(f"{sf_dir}/event[s].parquet")


def streamed_windows(spark, sf_dir):
    out = _streamed(spark, "streamed-windows", V.tumbling(_event_stream(spark, sf_dir)))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def streamed_sessions(spark, sf_dir):
    out = _streamed(spark, "streamed-sessions", V.sessions(_event_stream(spark, sf_dir)))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        heading_cleanup, caps_titles, epub_titles, file_titles, xml_names, document_keys, patched_front_matter, reference_titles, library_status, library_report,
        recategorized_manifest, removed_manifest, upserted_manifest, archived_files, merged_index, seeded_trails, trail_cosine_bonus, toc_cuts, heading_candidates,
        layout_openings, rerank_pool, rerank_vector, best_in_chapters, category_cut, unmapped_categories, sampled_pool, library_map, chapter_table,
        manifest_versions, trail_log, streamed_windows, streamed_sessions,
    )
}

_MANIFEST = "mf AS (SELECT doc_id, source AS folder, lang AS category, CASE WHEN doc_id % 11 = 0 THEN 'falha' ELSE 'ok' END AS status, n_chars AS n_words FROM documents)"
_THOUSANDS = "regexp_replace(replace(format('{{:,}}', {}::BIGINT), ',', '.'), '^$', '')"
_PAGE_NUMBER = r"^\d{1,4}[\s.:\-–]*"
_EDGES = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_CANDIDATES = f"""b0 AS (SELECT source, doc_id AS page, unnest(string_split(text, '. ')) AS text, unnest(range(len(string_split(text, '. ')))) AS block FROM documents
), bl AS (SELECT *, CASE WHEN page % 3 = 0 AND block = 1 THEN 18.0::DOUBLE WHEN length(text) % 7 = 0 THEN 14.0 ELSE 10.0 END AS size FROM b0
), bf AS (SELECT source, median(size) AS body FROM (SELECT source, size, unnest(range(greatest(1, length(text) // 40))) FROM bl) GROUP BY source
), ca AS (SELECT source, page, round(size * 2) / 2 AS size, {_EDGES.format(f"regexp_replace({_EDGES.format("regexp_replace(text, '[[:space:]]+', ' ', 'g')")}, '{_PAGE_NUMBER}', '')")} AS title
  FROM bl JOIN bf USING (source) WHERE block < 3 AND length({_EDGES.format('text')}) BETWEEN 3 AND 90 AND size >= 1.25 * body
  QUALIFY row_number() OVER (PARTITION BY source, page ORDER BY size DESC, block) = 1)"""
_RESCORED = f"""{_passage_scores('documents')}, top AS (SELECT doc_id, doc_id * 100000 + passage_no AS pid, score, text FROM sc JOIN pa USING (doc_id, passage_no) ORDER BY round(score, 9) DESC, pid LIMIT 50
), again AS (SELECT doc_id, pid, len(list_filter(['{"', '".join(Q1.split())}'], lambda x: list_contains(regexp_split_to_array(lower(text), '\\s+'), x)))::DOUBLE / {len(Q1.split())} AS score FROM top)"""

ORACLES = {
    "heading_cleanup": f"SELECT doc_id, md5({_EDGES.format(f"regexp_replace({_EDGES.format("regexp_replace((doc_id % 10000) || ' - ' || chr(10) || ' ' || text, '[[:space:]]+', ' ', 'g')")}, '{_PAGE_NUMBER}', '')")}) AS heading_md5 FROM documents",
    "caps_titles": """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'CHAPTER OF' ELSE 'chapter of' END || ' ' || CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || ' ' || upper(lang) AS t FROM documents)
SELECT doc_id, CASE WHEN length(regexp_replace(t, '[^A-Z]', '', 'g')) > 0.7 * length(regexp_replace(t, '[^A-Za-z]', '', 'g')) THEN upper(t[1]) || lower(t[2:]) ELSE t END AS title FROM t""",
    "epub_titles": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || ' Book' WHEN 1 THEN source WHEN 2 THEN source || ' (2nd ed.)' ELSE source END AS title FROM documents",
    "file_titles": "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'Title ' || source WHEN doc_id % 3 = 0 THEN 'the ' || source ELSE 'pdf' END AS title FROM documents",
    "xml_names": "SELECT doc_id, lang AS name FROM documents",
    "document_keys": "SELECT doc_id, source || '/d' || doc_id AS key FROM documents",
    "patched_front_matter": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'novo' ELSE source END AS titulo, '-' AS idioma, doc_id::VARCHAR AS autor, CASE WHEN doc_id % 2 = 0 THEN 'nao' ELSE '-' END AS util, CASE WHEN doc_id % 2 = 0 THEN '-' ELSE 'livro' END AS tipo FROM documents",
    "reference_titles": "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'Bibliografia' ELSE 'References' END AS title FROM documents",
    "library_status": f"WITH {_MANIFEST} SELECT count(*) FILTER (WHERE status = 'ok') AS docs, coalesce(sum(n_words) FILTER (WHERE status = 'ok'), 0)::BIGINT AS words, count(*) FILTER (WHERE status = 'falha') AS failures FROM mf",
    "library_report": f"WITH {_MANIFEST} SELECT category, count(*) AS docs, {_THOUSANDS.format('sum(n_words)')} AS words FROM mf WHERE status = 'ok' GROUP BY category",
    "recategorized_manifest": f"WITH {_MANIFEST} SELECT folder, CASE WHEN folder IN {ALLOWED} THEN 'moved' ELSE category END AS category, count(*) AS n FROM mf GROUP BY ALL",
    "removed_manifest": f"WITH {_MANIFEST} SELECT folder, CASE WHEN folder IN {ALLOWED} THEN 'removido' ELSE status END AS status, count(*) AS n FROM mf GROUP BY ALL",
    "upserted_manifest": f"WITH {_MANIFEST} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'novo' ELSE status END AS status, folder FROM mf",
    "archived_files": "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 4 = 0)",
    "merged_index": f"""WITH {_SNAPSHOTS.replace('AS nm, coalesce(n.u, false) AS nu', 'AS nm, coalesce(n.u, false) AS nu, doc_id')}, a AS (SELECT doc_id, nu AND (NOT ou OR ob <> nb) AS is_new FROM j WHERE nu
), w AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents
), p AS (SELECT doc_id, source, n, unnest(range(0, n, 50)) AS s FROM w)
SELECT doc_id, s // 50 AS passage_no, source, is_new FROM p JOIN a USING (doc_id) WHERE s = 0 OR (n - s >= 25 AND s + 10 < n)""",
    "seeded_trails": """WITH f AS (SELECT source || '-' || lang AS folder, 'c' || arg_max(doc_id::VARCHAR, (n_chars, 'c' || doc_id)) AS chapter FROM documents GROUP BY 1
), q AS (SELECT array_to_string(string_split(text, ' ')[1:3], ' ') AS question, 'rc' || item_id % 7 AS mark, item_id FROM benchmark)
SELECT DISTINCT question, chapter FROM q JOIN f ON contains(folder, mark) WHERE (question, chapter) NOT IN (SELECT (question, 'c1') FROM q WHERE item_id % 5 = 0)""",
    "trail_cosine_bonus": """WITH s AS (SELECT e.vec_id, e.label, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
), b AS (SELECT label, 0.1::DOUBLE * ln(1 + sum(score)) AS bonus FROM s WHERE vec_id % 3 <> 0 AND score >= 0.55 GROUP BY label)
SELECT vec_id, round(coalesce(bonus, 0), 6) AS bonus FROM embeddings LEFT JOIN b USING (label)""",
    "toc_cuts": """WITH t AS (SELECT o_custkey AS doc, 1 + o_orderkey % 2 AS level, 1 + o_orderkey % 397 AS page, o_orderkey AS place, 'T ' || lpad(o_orderkey::VARCHAR, 9, '0') AS title FROM orders
), n AS (SELECT doc, level, count(DISTINCT page) AS n FROM t GROUP BY ALL), ch AS (SELECT doc, level FROM n WHERE n BETWEEN 3 AND 300 AND 400 / n >= 2 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY abs(400::DOUBLE / n - 22), level) = 1
), e AS (SELECT t.*, max(page) OVER (PARTITION BY doc ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t JOIN ch USING (doc, level)
), g AS (SELECT *, sum(CASE WHEN before IS NULL OR page > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY place) AS k FROM e)
SELECT doc, (k - 1)::BIGINT AS cut_no, max(page) AS page, string_agg(title, ' / ' ORDER BY place) AS title FROM (SELECT doc, k, title, place, CASE WHEN before IS NULL OR page > before THEN page END AS page FROM g) GROUP BY doc, k""",
    "heading_candidates": f"WITH {_CANDIDATES} SELECT source, page, size, md5(title) AS title_md5 FROM ca",
    "layout_openings": f"""WITH {_CANDIDATES}, np AS (SELECT source, max(doc_id) AS n_pages FROM documents GROUP BY source
), sz AS (SELECT source, max(size) AS size FROM (SELECT source, size, count(*) AS n FROM ca GROUP BY ALL) JOIN np USING (source) WHERE n BETWEEN 3 AND 80 AND n_pages / n >= 4 GROUP BY source
), f AS (SELECT ca.*, n_pages, coalesce(lead(page) OVER (PARTITION BY source ORDER BY page), n_pages) - page AS gap FROM ca JOIN sz USING (source, size) JOIN np USING (source)
), ok AS (SELECT source FROM f GROUP BY source HAVING count(*) >= 4 AND min(page) <= 0.25 * max(n_pages) AND max(gap) <= 0.35 * max(n_pages))
SELECT source, page, md5(title) AS title_md5 FROM f WHERE source IN (SELECT source FROM ok)""",
    "rerank_pool": f"""WITH {_RESCORED}, b AS (SELECT * FROM again QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pid) = 1)
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, pid) AS rank, doc_id, pid, round(score, 6) AS score FROM b ORDER BY rank LIMIT 6""",
    "rerank_vector": f"WITH {_RESCORED} SELECT p.pid, coalesce(round(again.score, 6), -1e9)::DOUBLE AS score FROM (SELECT doc_id * 100000 + passage_no AS pid FROM pa) p LEFT JOIN again ON again.pid = p.pid",
    "best_in_chapters": """WITH s AS (SELECT e.vec_id, e.label, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
SELECT label, vec_id, round(score, 6) AS score FROM s WHERE label IN (SELECT label FROM embeddings WHERE vec_id % 5 = 0 AND label < 6) QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) = 1""",
    "category_cut": f"""WITH m AS (SELECT * FROM (VALUES {', '.join(f"('{d}', '{c}')" for d, cs in DOMAINS.items() for c in cs)}) t(domain, category)
), u AS (SELECT domain, category FROM m UNION SELECT d.domain, s.source FROM (SELECT DISTINCT domain FROM m) d, (SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT category FROM m)) s)
SELECT 'category' AS cut, count(*) AS n FROM documents WHERE source IN {ALLOWED}
UNION ALL SELECT 'domain ' || domain, count(*) FROM documents JOIN u ON source = category GROUP BY domain UNION ALL SELECT 'none', count(*) FROM documents""",
    "unmapped_categories": f"SELECT DISTINCT source AS category FROM documents WHERE source NOT IN ({', '.join(repr(c) for cs in DOMAINS.values() for c in cs)})",
    "sampled_pool": """WITH t AS (SELECT doc_id FROM documents WHERE doc_id % 97 = 0), o AS (SELECT doc_id FROM documents WHERE doc_id % 97 <> 0 ORDER BY md5(doc_id || '|7'), doc_id LIMIT greatest(0, 150 - (SELECT count(*) FROM t)))
SELECT doc_id FROM t UNION ALL SELECT doc_id FROM o""",
    "library_map": f"""WITH {_weights_sql('doc_id', LEAST)}, {_RANKED} SELECT source, doc_id, coalesce(c, '') AS concepts
FROM documents LEFT JOIN (SELECT doc_id, string_agg(term, ', ' ORDER BY rank) AS c FROM rk WHERE rank <= 10 GROUP BY doc_id) USING (doc_id)""",
    "chapter_table": "SELECT source AS category, count(*) AS n, sum(CASE WHEN source = 'src1' THEN 0 ELSE n_chars END)::BIGINT AS chars FROM documents WHERE source <> 'src1' OR doc_id % 2 = 1 GROUP BY source",
    "manifest_versions": f"WITH {_MANIFEST} SELECT doc_id, CASE WHEN folder IN {ALLOWED} THEN 'removido' ELSE status END AS status, folder FROM mf",
    "trail_log": "SELECT 'q' || conv_id AS question, turn % 2 = 0 AS useful, count(*) AS n, min('a/b/' || turn) AS first FROM (SELECT conv_id, turn FROM conversations UNION ALL SELECT conv_id, turn FROM conversations WHERE turn = 0) GROUP BY ALL",
    "streamed_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "streamed_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
