"""Queries of grading, classification and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumic.functions import text as T
from vellumic.operators import catalog as C
from vellumic.operators import quality as Q
from vellumic.plans.common import FOLD, table

#: A vocabulary of the fixtures' invented words; a library brings its own.
VOCABULARY = {
    "alfa": ["thble", "tion er", "ing the", "ea"],
    "beta": ["ouer", "ment", "eau le", "il"],
    "gama": ["ciente", "mente la", "os", "ando"],
    "delta": ["keit", "schein", "er ver", "un"],
}
DOMAINS = {"one": ["src0", "src3", "src6", "src9"], "two": ["src1", "src4", "src7"], "three": ["src2", "src5"]}
OVERRIDE = {"three": ["src2", "src8"]}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("title", F.split_part("text", F.lit("."), F.lit(1)))


def usefulness(spark, sf_dir):
    return Q.graded(_docs(spark, sf_dir), "title", "text").select("doc_id", "useful", "reason")


def usefulness_reasons(spark, sf_dir):
    rows = usefulness(spark, sf_dir).withColumn("reason", F.regexp_replace("reason", r" ?\(.*", ""))
    return rows.groupBy("useful", "reason").agg(F.count("*").alias("n"))


def usefulness_vs_labels(spark, sf_dir):
    rows = usefulness(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("useful", "quality").agg(F.count("*").alias("n"))


def language_detect(spark, sf_dir):
    return Q.language(_docs(spark, sf_dir), "text").select("doc_id", "lang_detected", "confidence")


def language_confusion(spark, sf_dir):
    return Q.language(_docs(spark, sf_dir), "text").groupBy("lang", "lang_detected").agg(F.count("*").alias("n"))


def doc_type(spark, sf_dir):
    return Q.kind(_docs(spark, sf_dir), "title", "text").select("doc_id", "doc_type")


def keyword_classify(spark, sf_dir):
    return C.classified(_docs(spark, sf_dir), "title", "text", VOCABULARY).select("doc_id", "category", "points")


def _facets(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    scores = C.facet_scores(docs, "doc_id", "title", "text", VOCABULARY)
    return docs, scores, C.rarity(scores, docs.count())


def category_rarity(spark, sf_dir):
    return _facets(spark, sf_dir)[2].select("category", F.round("weight", 6).alias("weight"))


def facets(spark, sf_dir):
    docs, scores, weights = _facets(spark, sf_dir)
    docs = C.classified(docs, "title", "text", VOCABULARY).select("doc_id", "category")
    return C.facets(scores, weights, docs, "doc_id", "category").select("doc_id", F.array_join("subjects", ", ").alias("subjects"))


def slug(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.slug(F.col("title")).alias("value"))


def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalized(F.col("text"))).alias("value"))


def digit_signature(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.digit_signature(F.col("text"))).alias("value"))


def domain_categories(spark, sf_dir):
    existing = table(spark, sf_dir, "documents").select(F.col("source").alias("category"))
    return C.domain_categories(C.domain_bridge(spark, DOMAINS, OVERRIDE), existing)


def catalog_summary(spark, sf_dir):
    out = C.summary(table(spark, sf_dir, "documents"), "n_chars", "lang", "source")
    return out.select("lang", "source", "docs", "chars")


def safe_dpi(spark, sf_dir):
    """Rendering resolution under a cap of 40 million pixels, from part sizes as page sizes."""
    pixels = F.col("p_size").cast("double") * 2_000_000
    return table(spark, sf_dir, "part").select("p_partkey", F.when(pixels > 40e6, F.greatest(F.lit(1), F.floor(300 * F.sqrt(40e6 / pixels)))).otherwise(300).cast("long").alias("dpi"))


QUERIES = {
    f.__name__: f
    for f in (
        usefulness, usefulness_reasons, usefulness_vs_labels, language_detect, language_confusion, doc_type, keyword_classify, category_rarity, facets,
        slug, normalize_text, digit_signature, domain_categories, catalog_summary, safe_dpi,
    )
}


def _q(text: str) -> str:
    return text.replace("'", "''")


_SUPPORT = _q(Q.SUPPORT_TITLE.replace("(?iU)", "(?i)"))
_SALES = ", ".join(f"'{m}'" for m in Q.SALES_MARKS)
_GRADED = f"""g0 AS (
  SELECT doc_id, trim(split_part(text, '.', 1)) AS title, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS body FROM documents
), g1 AS (SELECT *, list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '') AS ws, lower(body) AS low FROM g0
), g2 AS (
  SELECT *, len(ws) AS n, list_filter([{_SALES}], lambda m: contains(low, m)) AS sales, len(regexp_extract_all(body, '(?:\\.\\s*){{4,}}')) AS runs,
    length(body) - length(regexp_replace(body, '(?:\\.\\s*){{4,}}', '', 'g')) AS dotted,
    list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines,
    len(list_filter(ws, lambda w: regexp_full_match(w, '[\\d.,:%/-]+'))) AS numbers, len(list_distinct(list_transform(ws, lambda w: lower(w)))) AS uniq FROM g1
), g AS (
  SELECT doc_id, CASE
    WHEN regexp_matches(title, '{_SUPPORT}') THEN 'secao de apoio (copyright, sumario, indice, referencias)'
    WHEN n < 120 THEN 'curto demais (' || n || ' palavras)'
    WHEN len(sales) > 0 AND n <= 1500 THEN 'pagina de venda, nao conteudo (' || array_to_string(sales[1:2], ', ') || ')'
    WHEN runs >= 12 AND dotted >= 0.1 * length(body) THEN 'sumario (pontilhado ocupa ' || round_even(dotted * 100.0::DOUBLE / length(body), 0)::BIGINT || '% do texto)'
    WHEN len(list_filter(lines, lambda x: length(x) < 90 AND regexp_matches(x, '[.\\s]\\d{{1,4}}$'))) > 0.45 * len(lines) THEN 'parece sumario ou indice remissivo'
    WHEN numbers > 0.5 * n THEN 'tabela de numeros (' || (numbers * 100 // n) || '% do texto)'
    WHEN uniq < 0.08 * n THEN 'vocabulario degenerado (' || uniq || ' palavras unicas)'
    ELSE '' END AS reason FROM g2)"""
_COUNTS = ", ".join("len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{m}'" for m in sorted(set(marks.split()))) + ")))" for marks in Q.LANGUAGE_MARKS.values())
_LANGUAGE = f"""l0 AS (SELECT doc_id, lang, regexp_extract_all({FOLD.format('text[1:40000]')}, '[a-z]+') AS w FROM documents
), l1 AS (SELECT doc_id, lang, len(w) AS n, [{_COUNTS}] AS c FROM l0
), l2 AS (SELECT *, list_max(c) AS best, list_sort(c, 'DESC')[2] AS second FROM l1
), l AS (
  SELECT doc_id, lang, CASE WHEN ok THEN {list(Q.LANGUAGE_MARKS)}[list_position(c, best)] ELSE 'xx' END AS lang_detected,
    CASE WHEN ok THEN round_even((best - second) / best, 2) ELSE 0.0 END::DOUBLE AS confidence
  FROM (SELECT *, n >= 50 AND best > 0 AND best >= 0.04::DOUBLE * n AS ok FROM l2))"""
_KIND = " ".join(
    "WHEN (" + " + ".join(f"contains(t, '{_q(m)}')::INT" for m in marks) + f") >= {least} THEN '{name}'" for name, (least, marks) in Q.KIND_MARKS.items()
)


def _points(term: str, name: str, body: str, bounded: bool) -> str:
    if bounded and len(term) <= 4 and " " not in term:
        count = lambda x: f"len(list_filter(regexp_split_to_array({x}, '[^a-z0-9]+'), lambda w: w = '{term}'))"
    else:
        count = lambda x: f"((length({x}) - length(replace({x}, '{term}', ''))) // {len(term)})"
    return f"(6 * ({count(name)} > 0)::INT + least({count(body)}, 8))"


def _scores(bounded: bool) -> str:
    lists = ", ".join("{'k': %d, 'category': '%s', 'p': %s}" % (k, c, " + ".join(_points(t, "name", "low", bounded) for t in terms)) for k, (c, terms) in enumerate(VOCABULARY.items()))
    return f"SELECT doc_id, unnest([{lists}], recursive := true) FROM (SELECT doc_id, replace(lower(split_part(text, '.', 1)), '-', ' ') AS name, lower(text) AS low FROM documents)"


_CLASS = f"""cs AS ({_scores(True)}
), best AS (SELECT doc_id, category, p FROM cs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, k) = 1
), cl AS (SELECT doc_id, CASE WHEN p >= 4 THEN category ELSE 'geral' END AS category, p::BIGINT AS points FROM best)"""
_RARE = f"""fs AS (SELECT * FROM ({_scores(False)}) WHERE p > 0
), ra AS (SELECT category, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) + 1 AS weight FROM fs GROUP BY category)"""

ORACLES = {
    "usefulness": f"WITH {_GRADED} SELECT doc_id, reason = '' AS useful, reason FROM g",
    "usefulness_reasons": f"WITH {_GRADED} SELECT reason = '' AS useful, regexp_replace(reason, ' ?\\(.*', '') AS reason, count(*) AS n FROM g GROUP BY ALL",
    "usefulness_vs_labels": f"WITH {_GRADED} SELECT reason = '' AS useful, quality, count(*) AS n FROM g JOIN labels USING (doc_id) GROUP BY ALL",
    "language_detect": f"WITH {_LANGUAGE} SELECT doc_id, lang_detected, confidence FROM l",
    "language_confusion": f"WITH {_LANGUAGE} SELECT lang, lang_detected, count(*) AS n FROM l GROUP BY ALL",
    "doc_type": f"SELECT doc_id, CASE {_KIND} ELSE 'livro' END AS doc_type FROM (SELECT doc_id, {FOLD.format('''split_part(text, '.', 1) || chr(10) || text[1:12000]''')} AS t FROM documents)",
    "keyword_classify": f"WITH {_CLASS} SELECT doc_id, category, points FROM cl",
    "category_rarity": f"WITH {_RARE} SELECT category, round(weight, 6) AS weight FROM ra",
    "facets": f"""WITH {_CLASS}, {_RARE}, fw AS (SELECT doc_id, k, category, p * weight AS p FROM fs JOIN ra USING (category)
), fl AS (SELECT doc_id, list(category ORDER BY p DESC, k)[1:3] AS c FROM (SELECT *, max(p) OVER (PARTITION BY doc_id) AS top FROM fw) WHERE p >= top * 0.45::DOUBLE GROUP BY doc_id)
SELECT doc_id, array_to_string(list_concat([category], list_filter(coalesce(c, []), lambda x: x <> category))[1:3], ', ') AS subjects FROM cl LEFT JOIN fl USING (doc_id)""",
    "slug": f"""SELECT doc_id, coalesce(nullif(regexp_replace(trim(regexp_replace({FOLD.format("split_part(text, '.', 1)")}, '[^a-z0-9]+', '-', 'g'), '-')[1:60], '-+$', ''), ''), 'sem-titulo') AS value FROM documents""",
    "normalize_text": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, '’', ''''), '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t ]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS value FROM documents""",
    "digit_signature": r"SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '\d+', '#', 'g'), '^\s+|\s+$', '', 'g')) AS value FROM documents",
    "domain_categories": """WITH b(domain, category) AS (VALUES ('one', 'src0'), ('one', 'src3'), ('one', 'src6'), ('one', 'src9'), ('two', 'src1'), ('two', 'src4'), ('two', 'src7'), ('three', 'src2'), ('three', 'src8'))
SELECT * FROM b UNION ALL SELECT d.domain, u.category FROM (SELECT DISTINCT domain FROM b) d, (SELECT DISTINCT source AS category FROM documents WHERE source NOT IN (SELECT category FROM b)) u""",
    "catalog_summary": "SELECT lang, source, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((), (lang), (source))",
    "safe_dpi": "SELECT p_partkey, CASE WHEN p_size * 2e6 > 40e6 THEN greatest(1, floor(300 * sqrt(40e6 / (p_size * 2e6)))) ELSE 300 END::BIGINT AS dpi FROM part",
}
