"""Queries of passages, slicing, layout and HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumic.functions import text as T
from vellumic.operators import layout as Y
from vellumic.operators import passages as P
from vellumic.operators import slicing as S
from vellumic.plans.common import table
from vellumic.sources import html as H


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def passages(spark, sf_dir):
    return P.passages(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "passage_no", "start", "n", F.md5("text").alias("text_md5"))


def passages_long(spark, sf_dir):
    """Windows of 200 words every 170, as models of longer texts take them."""
    return P.passages(_docs(spark, sf_dir), "doc_id", "text", words=200, step=170).select("doc_id", "passage_no", "start", "n")


def passage_windows(spark, sf_dir):
    """The window around the passage nearest the middle of each document."""
    rows = _docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("w")).where("size(w) > 0")
    rows = rows.withColumn("start", (F.floor(F.size("w") / 100) * 50).cast("int"))
    rows = rows.withColumn("n", F.least(F.lit(60), F.size("w") - F.col("start")))
    return rows.select("doc_id", F.md5(P.window(F.col("w"), F.col("start"), F.col("n"))).alias("window_md5"))


def result_cards(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("w"))
    return rows.select("doc_id", P.card(F.col("w"), F.lit(0), F.size("w")).alias("card"))


def _pages(spark, sf_dir):
    """Lines as pages; every fifth gets a chapter heading."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    page = F.col("k") + 1
    text = F.when(page % 5 == 3, F.concat(F.lit("## Chapter "), page.cast("string"), F.lit("\n"), "line")).otherwise(F.col("line"))
    return lines.select("doc_id", page.cast("long").alias("page"), text.alias("text"))


def page_cuts(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    cuts = S.text_cuts(pages, "doc_id", "page", "text").join(pages.groupBy("doc_id").agg(F.max("page").alias("last")), "doc_id")
    return S.spans(cuts, "doc_id", "page", "title", "last")


def page_join(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return S.joined_pages(pages, page_cuts(spark, sf_dir), "doc_id", "page", "text").select("doc_id", "cut_no", F.md5("md").alias("md_md5"))


def reference_split(spark, sf_dir):
    """Documents with a reference list put behind every third, and an appendix behind every sixth."""
    refs = F.concat(F.lit("\n### References\n"), F.repeat(F.lit("Author A et al. 2019 Title of a work pp. 1 doi 7\n"), 20))
    tail = F.when(F.col("doc_id") % 6 == 0, F.lit("## Appendix\nmore words here")).otherwise("")
    md = F.when(F.col("doc_id") % 3 == 0, F.concat("text", refs, tail)).otherwise(F.col("text"))
    out = S.references(_docs(spark, sf_dir).select("doc_id", md.alias("md")), "doc_id", "md")
    return out.select("doc_id", T.word_count(F.col("body")).alias("body_words"), F.coalesce(T.word_count(F.col("block")), F.lit(0)).cast("long").alias("ref_words"))


def size_slices(spark, sf_dir):
    return S.sliced_by_size(_pages(spark, sf_dir), "doc_id", "page", "text", target=150)


def short_merge(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    raw = pages.select("doc_id", F.col("page").alias("ord"), F.concat(F.lit("Part "), "page").alias("title"), F.col("text").alias("md"), F.col("page").alias("page_from"), F.col("page").alias("page_to"))
    return S.compacted(raw, "doc_id", least=40, most=400, target=200).drop("md")


def chapter_slicer(spark, sf_dir):
    return S.chapters(_pages(spark, sf_dir), "doc_id", "page", "text").drop("md")


def toc_levels(spark, sf_dir):
    """Contents tables made of orders: a customer's orders are entries on two levels."""
    orders = table(spark, sf_dir, "orders")
    toc = orders.select(F.col("o_custkey").alias("doc"), (1 + F.col("o_orderkey") % 2).alias("level"), (1 + F.col("o_orderkey") % 397).alias("page"), F.lit(400).alias("total"))
    return S.toc_level(toc, "doc", "total")


def repeated_borders(spark, sf_dir):
    """First and last lines of documents that recur within a source."""
    blocks = _docs(spark, sf_dir).select("source", F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("block", "text"))
    return Y.repeated_borders(blocks, "source", share=0.02).select("source", "signature", "n", F.round("share", 6).alias("share"))


def body_font_median(spark, sf_dir):
    """Median line length of a source, as block size, weighted by length."""
    lines = _docs(spark, sf_dir).select("source", F.explode(F.split("text", "\n")).alias("text")).withColumn("size", F.length("text"))
    return Y.body_font(lines, "source").select("source", F.col("body").alias("median"))


def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(H.markdown(F.col("html"))).alias("text_md5"))


def html_title_headings(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", H.title(F.col("html")).alias("title"), H.count(F.col("html"), "h[1-6]").alias("n_headings"), H.count(F.col("html"), "a").alias("n_links"))


QUERIES = {
    f.__name__: f
    for f in (
        passages, passages_long, passage_windows, result_cards, page_cuts, page_join, reference_split, size_slices, short_merge, chapter_slicer, toc_levels,
        repeated_borders, body_font_median, html_to_text, html_title_headings,
    )
}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')"
_PASSAGES = """SELECT doc_id, (s // {step})::BIGINT AS passage_no, s::BIGINT AS start, least({words}, n - s)::BIGINT AS n{more} FROM (
  SELECT doc_id, w, n, unnest(range(0, n, {step})) AS s FROM (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {w} AS w FROM documents)))
WHERE s = 0 OR (n - s >= 25 AND s - {step} + {words} < n)"""
_PAGES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents
), pg AS (SELECT doc_id, page, CASE WHEN page % 5 = 3 THEN '## Chapter ' || page || chr(10) || line ELSE line END AS text FROM lines)"""
_CUTS = f"""{_PAGES}, c0 AS (SELECT doc_id, page, 'Chapter ' || page AS title FROM pg WHERE page % 5 = 3
), c1 AS (SELECT * FROM c0 WHERE doc_id IN (SELECT doc_id FROM c0 GROUP BY doc_id HAVING count(*) >= 3)
), c2 AS (SELECT * FROM c1 UNION ALL SELECT doc_id, 1, 'Abertura' FROM c1 GROUP BY doc_id
), la AS (SELECT doc_id, max(page) AS last FROM pg GROUP BY doc_id
), cuts AS (
  SELECT doc_id, row_number() OVER w - 1 AS cut_no, page AS page_from, greatest(page, coalesce(lead(page) OVER w - 1, last)) AS page_to, title FROM c2 JOIN la USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY page))"""

def _html_sql() -> str:
    out = "regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>', '', 'g')"
    for tag in ("head", "script", "style", "svg"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    for tag, level in H.LEVELS.items():
        out = f"regexp_replace(regexp_replace({out}, '(?i)<{tag}\\b[^>]*>', chr(10) || chr(10) || '{'#' * level} ', 'g'), '(?i)</{tag}\\s*>', chr(10) || chr(10), 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?i)</?(?:{H.APART})\\b[^>]*>', chr(10) || chr(10), 'g'), '(?s)<[a-zA-Z/][^>]*>', '', 'g')"
    for name, c in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{c}')"
    out = f"regexp_replace({out}, '([\\p{{L}}\\p{{N}}_])-\\s*\\n\\s*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    out = f"regexp_replace({out}, '[ \\t\u00a0]+', ' ', 'g')"
    return f"SELECT page_id, md5(regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM pages"


_HTML = _html_sql()

ORACLES = {
    "passages": _PASSAGES.format(words=60, step=50, w=_WORDS, more=", md5(array_to_string(w[s + 1:s + 60], ' ')) AS text_md5"),
    "passages_long": _PASSAGES.format(words=200, step=170, w=_WORDS, more=""),
    "passage_windows": f"""WITH a AS (SELECT doc_id, w, len(w) AS total, (len(w) // 100) * 50 AS start FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0
), b AS (SELECT *, greatest(0, start + least(60, total - start) // 2 - 210) AS i0 FROM a
), c AS (SELECT *, least(total, i0 + 420) AS z FROM b), d AS (SELECT *, greatest(0, z - 420) AS i FROM c
), e AS (SELECT *, array_to_string(w[i + 1:z], ' ') AS t FROM d
), f AS (SELECT *, CASE WHEN i > 0 AND instr(t, '. ') > 0 AND instr(t, '. ') - 1 < length(t) // 3 THEN substr(t, instr(t, '. ') + 2) ELSE t END AS o FROM e
), g AS (SELECT *, length(o) - instr(reverse(o), ' .') AS back FROM f
), h AS (SELECT *, CASE WHEN z < total AND instr(o, '. ') > 0 AND back - 1 > length(o) * 2 // 3 THEN o[1:back] ELSE o END AS x FROM g)
SELECT doc_id, md5(CASE WHEN i > 0 THEN '... ' ELSE '' END || x || CASE WHEN z < total THEN ' ...' ELSE '' END) AS window_md5 FROM h""",
    "result_cards": f"SELECT doc_id, array_to_string(w[1:25], ' ') || CASE WHEN len(w) > 25 THEN '…' ELSE '' END AS card FROM (SELECT doc_id, {_WORDS} AS w FROM documents)",
    "page_cuts": f"WITH {_CUTS} SELECT * FROM cuts",
    "page_join": f"""WITH {_CUTS} SELECT doc_id, cut_no, md5(string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY page)) AS md_md5
FROM cuts JOIN pg USING (doc_id) WHERE page BETWEEN page_from AND page_to AND regexp_matches(text, '\\S') GROUP BY ALL""",
    "reference_split": f"""WITH t AS (SELECT doc_id, len({_WORDS}) AS n FROM documents)
SELECT doc_id, n + CASE WHEN doc_id % 6 = 0 THEN 5 ELSE 0 END AS body_words, CASE WHEN doc_id % 3 = 0 THEN 262 ELSE 0 END::BIGINT AS ref_words FROM t""",
    "toc_levels": """WITH t AS (SELECT o_custkey AS doc, 1 + o_orderkey % 2 AS level, count(DISTINCT 1 + o_orderkey % 397) AS n FROM orders GROUP BY ALL)
SELECT doc, level FROM t WHERE n BETWEEN 3 AND 300 AND 400 / n >= 2 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY abs(400::DOUBLE / n - 22), level) = 1""",
    "repeated_borders": """WITH e AS (SELECT source, doc_id, unnest(list_distinct([string_split(text, chr(10))[1], string_split(text, chr(10))[-1]])) AS t FROM documents
), p AS (SELECT source, count(*) AS total FROM documents GROUP BY source
), c AS (SELECT source, trim(regexp_replace(lower(t), '\\d+', '#', 'g')) AS signature, count(*) AS n FROM e WHERE length(t) < 120 GROUP BY ALL)
SELECT source, signature, n, round(n::DOUBLE / total, 6) AS share FROM c JOIN p USING (source) WHERE total >= 5 AND n::DOUBLE / total >= 0.02""",
    "body_font_median": """WITH l AS (SELECT source, length(t)::DOUBLE AS size, greatest(1, length(t) // 40) AS w FROM (SELECT source, unnest(string_split(text, chr(10))) AS t FROM documents))
SELECT source, median(size) AS median FROM (SELECT source, size, unnest(range(w)) FROM l) GROUP BY source""",
    "html_to_text": _HTML,
    "html_title_headings": """SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
  len(regexp_extract_all(html, '(?i)<h[1-6][\\s>]'))::BIGINT AS n_headings, len(regexp_extract_all(html, '(?i)<a[\\s>]'))::BIGINT AS n_links FROM pages""",
}

#: Words of each page (a line), and the folds of runs that close before they pass a size.
_LINE_WORDS = f"lw AS (SELECT doc_id, page, CASE WHEN page % 5 = 3 THEN 3 ELSE 0 END + len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) AS n FROM lines)"
ORACLES["size_slices"] = f"""WITH RECURSIVE {_PAGES}, {_LINE_WORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS r FROM lw WHERE n > 0
), f AS (
  SELECT doc_id, page, n, r, n AS held, 1 AS k FROM o WHERE r = 1
  UNION ALL SELECT o.doc_id, o.page, o.n, o.r, CASE WHEN held + o.n > 150 THEN o.n ELSE held + o.n END, k + CASE WHEN held + o.n > 150 THEN 1 ELSE 0 END FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r + 1
)
SELECT doc_id, k::BIGINT AS ord, 'Trecho ' || k AS title, min(page) AS page_from, max(page) AS page_to, sum(n)::BIGINT AS n_words FROM f GROUP BY doc_id, k"""
ORACLES["short_merge"] = f"""WITH RECURSIVE {_PAGES}, {_LINE_WORDS}, g0 AS (SELECT *, sum(CASE WHEN n >= 40 OR page = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS g FROM lw
), g AS (SELECT *, min(page) OVER (PARTITION BY doc_id, g) AS first_page, max(page) OVER (PARTITION BY doc_id, g) AS last_page FROM g0
), pieces AS (
  SELECT doc_id, g, 2 * page AS place, n FROM g WHERE n > 0 UNION ALL SELECT doc_id, g, 2 * page - 1, 3 FROM g WHERE page > first_page
), total AS (SELECT doc_id, g, any_value(first_page) AS page_from, any_value(last_page) AS page_to, sum(n + CASE WHEN page > first_page THEN 3 ELSE 0 END) AS words FROM g GROUP BY doc_id, g
), o AS (SELECT p.*, row_number() OVER (PARTITION BY p.doc_id, p.g ORDER BY place) AS r FROM pieces p JOIN total USING (doc_id, g) WHERE words > 400
), f AS (
  SELECT doc_id, g, n, r, n AS held, 1 AS k FROM o WHERE r = 1
  UNION ALL SELECT o.doc_id, o.g, o.n, o.r, CASE WHEN held + o.n > 200 THEN o.n ELSE held + o.n END, k + CASE WHEN held + o.n > 200 THEN 1 ELSE 0 END FROM f JOIN o ON o.doc_id = f.doc_id AND o.g = f.g AND o.r = f.r + 1
), parts AS (
  SELECT doc_id, g, k, sum(n) AS n_words, max(k) OVER (PARTITION BY doc_id, g) AS parts FROM f GROUP BY doc_id, g, k
  UNION ALL SELECT doc_id, g, 1, words, 0 FROM total WHERE words <= 400
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, k) AS ord, 'Part ' || page_from || CASE WHEN parts > 0 THEN ' (parte ' || k || '/' || parts || ')' ELSE '' END AS title, page_from, page_to, n_words::BIGINT AS n_words
FROM parts JOIN total USING (doc_id, g)"""
