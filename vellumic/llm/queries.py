"""Registered queries of the subpackage and the SQL that they are compared with."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumic.llm import chat_format, decontamination, html_layout, mixing, neardup, pii, quality_rules, secret_scan, token_counts, url_filter
from vellumic.sources.tables import table


def tokenizer_path() -> str:
    """The model file: ``VELLUMIC_TOKENIZER`` or that of the installed public tokenizers."""
    if named := os.environ.get("VELLUMIC_TOKENIZER"):
        return named
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_table(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.rules(spark))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.html_text(table(spark, sf_dir, "pages"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)], rows.schema)
    return chat_format.digests(chat_format.chat_format(rows.unionByName(extra)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_table(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_table(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_decontamination": op4_decontamination,
    "op5_secret_scan": op5_secret_scan,
    "op6_url_filter": op6_url_filter,
    "op7_html_text": op7_html_text,
    "op8_chat_format": op8_chat_format,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
}

_FILL = """
{0}_r AS (
  SELECT *, capacity::DOUBLE / weight AS r FROM {0}
), {0}_o AS (
  SELECT *, greatest(0, given - coalesce(sum(capacity) OVER (PARTITION BY {1} ORDER BY r, {2} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS rest,
    (sum(weight) OVER (PARTITION BY {1} ORDER BY r, {2} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS weights,
    row_number() OVER (PARTITION BY {1} ORDER BY r, {2}) AS k FROM {0}_r
), {0}_f AS (
  SELECT *, min(CASE WHEN capacity * weights > rest * weight THEN k END) OVER (PARTITION BY {1}) AS f FROM {0}_o
), {0}_b AS (
  SELECT *, (CASE WHEN k >= f THEN least(capacity, max(CASE WHEN k = f THEN rest END) OVER (PARTITION BY {1}) * weight // max(CASE WHEN k = f THEN weights END) OVER (PARTITION BY {1}))
    ELSE capacity END)::HUGEINT AS budget FROM {0}_f
)"""

ORACLES: dict[str, str] = {
    "op2_mixing": r"""
WITH d AS (
  SELECT doc_id, lang AS language, source AS leaf, 'domain' || coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3, 3) AS domain,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents
), leaf0 AS (
  SELECT domain, language, leaf, sum(n_tokens)::HUGEINT AS n_tokens, sum(n_tokens)::HUGEINT * 4 AS capacity, 1 AS weight FROM d GROUP BY ALL
), top AS (
  SELECT 0 AS root, domain, CASE domain WHEN 'domain0' THEN 5 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END AS weight, sum(capacity) AS capacity,
    (SELECT sum(n_tokens) * 60 // 100 FROM leaf0) AS given FROM leaf0 GROUP BY domain
), """
    + _FILL.format("top", "root", "domain").strip()
    + """, language AS (
  SELECT l.domain, l.language, CASE l.language WHEN 'en' THEN 6 WHEN 'de' THEN 2 ELSE 1 END AS weight, sum(l.capacity) AS capacity, any_value(budget) AS given
  FROM leaf0 l JOIN top_b USING (domain) GROUP BY l.domain, l.language
), """
    + _FILL.format("language", "domain", "language").strip()
    + """, leaf AS (
  SELECT l.*, b.budget AS given FROM leaf0 l JOIN language_b b ON l.domain = b.domain AND l.language = b.language
), """
    + _FILL.format("leaf", "domain, language", "leaf").strip()
    + """, plan AS (
  SELECT domain, language, leaf, (budget // n_tokens)::BIGINT AS whole, (budget % n_tokens)::BIGINT AS part FROM leaf_b WHERE n_tokens > 0
), p AS (
  SELECT d.*, whole, part, md5('42|' || whole || '|' || doc_id)[1:15] AS place FROM d JOIN plan USING (domain, language, leaf)
), o AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, leaf ORDER BY place, doc_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p
)
SELECT doc_id, domain, language, leaf, n_tokens, whole AS epoch FROM o WHERE start < part
UNION ALL SELECT doc_id, domain, language, leaf, n_tokens, unnest(range(whole)) AS epoch FROM p
""",
    "op6_url_filter": r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT rid, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM p
), base(rh, rp, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fit AS (
  SELECT rid, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC) AS k
  FROM h JOIN base ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
), further(pattern) AS (
  VALUES """
    + ", ".join(f"('{p}')" for p, _ in url_filter.PATTERN_RULES)
    + """
), more AS (
  SELECT rid, pattern, row_number() OVER (PARTITION BY rid ORDER BY length(pattern) DESC, pattern) AS k FROM h JOIN further ON regexp_matches(low, pattern)
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN pattern END AS pattern,
  coalesce(verdict, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (rid) LEFT JOIN (SELECT rid, pattern FROM more WHERE k = 1) USING (rid)
""",
    "op3_near_duplicates": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM d WHERE len(ws) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept
FROM d JOIN reach ON a = doc_id LEFT JOIN size USING (doc_id) GROUP BY doc_id
""",
    "op4_decontamination": r"""
WITH dw AS (
  SELECT doc_id, p, w FROM (
    SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p
    FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents))
), bw AS (
  SELECT item_id, n, p, w FROM (
    SELECT item_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS p
    FROM (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark))
  WHERE n >= 5
), near AS (
  SELECT doc_id, item_id, n, dw.p - bw.p AS off, count(*) AS agree, list(bw.p) AS ps
  FROM dw JOIN bw USING (w) GROUP BY ALL HAVING count(*) >= least(13, 0.8 * least(20, n))
), run AS (
  SELECT doc_id, item_id, n, off, agree,
    bool_or(s + least(20, n) <= n AND 100 * len(list_filter(ps, lambda x: x >= s AND x < s + least(20, n))) >= 80 * least(20, n)
      OR s + least(13, n) <= n AND len(list_filter(ps, lambda x: x >= s AND x < s + least(13, n))) = least(13, n)) AS counts
  FROM (SELECT *, unnest(range(n)) AS s FROM near) GROUP BY ALL
)
SELECT doc_id, item_id, max(n)::BIGINT AS item_words, max(agree)::BIGINT AS n_agree, min(off)::BIGINT AS first_word
FROM (SELECT *, rank() OVER (PARTITION BY doc_id, item_id ORDER BY agree DESC, off) AS r FROM run WHERE counts)
WHERE r = 1 GROUP BY doc_id, item_id
""",
    "op8_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, length('<turn ' || '>' || chr(10) || '</turn>' || chr(10))
    + length(regexp_replace(role, '(\\|</?turn|###|>)', '\\\1', 'g'))
    + length(regexp_replace(text, '(\\|</?turn|###|>)', '\\\1', 'g')) AS size
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
""",
    "op10_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT rid, p, ws[p:p + 7] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS p FROM w)
), rep AS (
  SELECT rid, count(DISTINCT q) AS n FROM (
    SELECT rid, unnest(range(p, p + 8)) AS q FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1
  ) GROUP BY rid
), lines AS (
  SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS n
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words,
    (length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), s AS (
  SELECT *, base_failed OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 5 * n_words
    OR 10 * word_chars < 25 * n_words OR 10 * word_chars > 120 * n_words AS soft_failed FROM b
), h AS (
  SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE soft_failed) AS n_failed FROM s GROUP BY source
), prior AS (
  SELECT sum(n_docs)::HUGEINT AS all_docs, sum(n_failed)::HUGEINT AS all_failed,
    (sum(n_failed) * 1000 // sum(n_docs))::HUGEINT AS mean,
    (sum((n_failed * 1000 // n_docs) * (n_failed * 1000 // n_docs)) // count(*)
      - (sum(n_failed * 1000 // n_docs) // count(*)) * (sum(n_failed * 1000 // n_docs) // count(*)))::HUGEINT AS var
  FROM h
), strength AS (
  SELECT *, CASE WHEN var <= 0 THEN 1000 ELSE greatest(2, least(1000, mean * (1000 - mean) // var - 1)) END::HUGEINT AS k FROM prior
), v AS (
  SELECT source, (n_failed * all_docs + k * all_failed) * 1000 >= 500 * (n_docs + k) * all_docs AS rejected FROM h, strength
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed,
  rejected AS bad_host, NOT base_failed AND NOT (soft_failed AND rejected) AS kept
FROM s JOIN v ON s.source IS NOT DISTINCT FROM v.source
""",
}
