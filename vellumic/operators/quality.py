"""Grading of chapters: usefulness, language and kind of document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumic.functions import text as T

# Titles of sections that support a text (prefixes, except "index").
SUPPORT_TITLE = (
    r"(?iU)^\W*(?:(?:\d{1,2}(?:\.\d+)*|[A-Z])[\.\):]?\s+)?("
    r"copyright|creditos|cr[eé]ditos|about this ebook|sobre este|dedicat|dedicac|"
    r"acknowledg|agradecim|table of contents|contents|sumario|sum[áa]rio|indice|"
    r"[ií]ndice|bibliogra|references|refer[eê]ncias|colophon|"
    r"ficha catalografica|isbn|page de titre|title page|half title|"
    r"series editor foreword|foreword|epigraph|errata|notas de rodape|"
    r"advance praise|praise for|what people are saying|elogios|"
    r"sobre o autor|about the author|acerca del autor|nota do tradutor|"
    r"(?:author|subject|name) index|index(?:\s+of\b|\s*\(parte|\s*$))"
)
GENERIC_TITLE = r"(?iU)^(trecho|abertura|parte|cap[ií]tulo|chapter|se[cç][aã]o|section|unidade|modulo|m[oó]dulo|lesson|li[cç][aã]o)\b[\s\d\.:/()-]*$"
# Marks of a sales page, and thresholds of the rules.
SALES_MARKS = ("testbank", "test bank", "solutions manual", "instant download", "available formats", "how to access product", "add to cart", "digital instant download", "ebook pdf download")
MIN_WORDS, SALES_WORDS, DOT_RUNS = 120, 1500, 12
TITLE_STOPWORDS = tuple("de da do das dos e ou em no na para por com sem que a o as os um uma ao the of and to in for with a an on is are how what why when".split())
# Function words that tell languages apart, first language first on ties.
LANGUAGE_MARKS = {
    "pt": """de que nao para uma com os as dos das ele ela isso este esta muito
             quando entao voce nos seu sua pelo pela ate porque tambem ja mais
             sao esta estao fazer ser tem""",
    "es": """de que no para una con los las del ella eso este esta muy cuando
             entonces usted nosotros su por hasta porque tambien ya mas son
             estan hacer ser tiene pero""",
    "en": """the of and to in that is for with as was are this these from have
             has been will would there their which when what about into than""",
    "fr": """le la les des une pour avec dans que qui est sont ete plus cette
             ces vous nous leur mais comme sur par tout meme aussi ou donc""",
    "it": """il lo la gli che non per una con del della sono stato questo questa
             molto quando anche piu essere hanno come sul nella""",
    "de": """der die das und nicht fur mit von den dem ein eine ist sind war
             auch wenn dann sich uber aber nach durch werden""",
    "id": """yang dan untuk dengan tidak ini itu dari pada adalah akan saya kita
             mereka bisa juga karena atau dalam sebagai lebih sudah""",
}
LANGUAGE_SAMPLE, LANGUAGE_WORDS, LANGUAGE_SHARE = 40_000, 50, 0.04
# Marks of a kind of document and how many of them it takes.
KIND_MARKS = {
    "tese": (2, ("bachelors thesis", "master's thesis", "masters thesis", "phd thesis", "doctoral dissertation", "submitted in partial fulfillment", "projeto de graduacao", "trabalho de conclusao de curso", "dissertacao apresentada", "tese apresentada", "orientador:", "universidade federal", "escola politecnica", "in partial fulfillment")),
    "paper": (2, ("abstract", "keywords:", "palavras-chave:", "doi:", "arxiv:", "we propose", "in this paper", "neste artigo", "related work")),
    "manual": (1, ("manual do usuario", "manual de produto", "manual de instalacao", "user manual", "getting started manual", "guia de instalacao", "especificacoes tecnicas", "rev.", "revisao tecnica")),
    "apostila": (1, ("apostila", "material do aluno", "caderno de exercicios", "curso de formacao", "modulo 1", "aula 1")),
}
KIND_SAMPLE, KIND_DEFAULT = 12_000, "livro"


def is_support_title(title: Column) -> Column:
    return T.trimmed(title).rlike(SUPPORT_TITLE)


def is_generic_title(title: Column) -> Column:
    stripped = T.trimmed(F.coalesce(title, F.lit("")))
    return stripped.rlike(GENERIC_TITLE) | (F.length(stripped) < 4)


def is_name_only(title: Column) -> Column:
    """Up to six words, all with a capital, no function word after the first."""
    found = F.filter(F.regexp_extract_all(title, F.lit(r"(?U)[^\W\d_]+"), F.lit(0)), lambda w: F.length(w) > 1)
    plain = F.forall(F.slice(found, 2, 6), lambda w: ~F.lower(w).isin(*TITLE_STOPWORDS))
    return (F.size(found) > 0) & (F.size(found) <= 6) & plain & F.forall(found, lambda w: w.rlike(r"^\p{Lu}"))


def _percent(part: Column, whole: Column) -> Column:
    return F.format_string("%d", F.bround(part * 100.0 / whole, 0).cast("long"))


def graded(chapters: DataFrame, title: str, body: str) -> DataFrame:
    """``chapters`` with ``useful`` and ``reason``; the first rule that fails decides.

    Counts are columns of their own, so that each is computed once a row.
    """
    text = T.trimmed(F.coalesce(F.col(body), F.lit("")))
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), T.trimmed), lambda x: x != "")
    dots = r"(?:\.\s*){4,}"
    rows = chapters.withColumns({"__body": text, "__words": T.words(text)}).withColumns(
        {
            "__n": F.size("__words"),
            "__low": F.lower("__body"),
            "__lines": lines,
            "__dots": F.regexp_count("__body", F.lit(dots)),
            "__dotted": F.length("__body") - F.length(F.regexp_replace("__body", dots, "")),
            "__numbers": F.size(F.filter("__words", lambda w: w.rlike(r"^[\d.,:%/-]+$"))),
            "__unique": F.size(F.array_distinct(F.transform("__words", F.lower))),
        }
    )
    sales = F.filter(F.array(*(F.when(F.contains("__low", F.lit(m)), F.lit(m)) for m in SALES_MARKS)), lambda m: m.isNotNull())
    numbered = F.size(F.filter("__lines", lambda x: (F.length(x) < 90) & x.rlike(r"[.\s]\d{1,4}$")))
    n, size = F.col("__n"), F.length("__body")
    reason = (
        F.when(is_support_title(F.coalesce(F.col(title), F.lit(""))), F.lit("secao de apoio (copyright, sumario, indice, referencias)"))
        .when(n < MIN_WORDS, F.format_string("curto demais (%d palavras)", n))
        .when((F.size(sales) > 0) & (n <= SALES_WORDS), F.concat(F.lit("pagina de venda, nao conteudo ("), F.array_join(F.slice(sales, 1, 2), ", "), F.lit(")")))
        .when((F.col("__dots") >= DOT_RUNS) & (F.col("__dotted") >= 0.1 * size), F.concat(F.lit("sumario (pontilhado ocupa "), _percent(F.col("__dotted"), size), F.lit("% do texto)")))
        .when(numbered > 0.45 * F.size("__lines"), F.lit("parece sumario ou indice remissivo"))
        .when(F.col("__numbers") > 0.5 * n, F.concat(F.lit("tabela de numeros ("), F.expr("cast(__numbers * 100L div __n AS string)"), F.lit("% do texto)")))
        .when(F.col("__unique") < 0.08 * n, F.format_string("vocabulario degenerado (%d palavras unicas)", F.col("__unique")))
        .otherwise(F.lit(""))
    )
    out = rows.withColumn("reason", reason).withColumn("useful", F.col("reason") == "")
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def language(docs: DataFrame, text: str, sample: int = LANGUAGE_SAMPLE) -> DataFrame:
    """``docs`` with ``lang_detected`` (``xx`` if unclear) and ``confidence``."""
    found = F.regexp_extract_all(T.fold(F.substring(F.coalesce(F.col(text), F.lit("")), 1, sample)), F.lit("[a-z]+"), F.lit(0))
    rows = docs.withColumn("__w", found)
    hits = lambda marks: F.size(F.filter("__w", lambda w: w.isin(*sorted(set(marks.split())))))
    counts = [hits(marks) for marks in LANGUAGE_MARKS.values()]
    rows = rows.withColumn("__c", F.array(*counts)).withColumn("__s", F.sort_array("__c", asc=False))
    best, second = F.col("__s")[0], F.col("__s")[1]
    named = F.element_at(F.array(*map(F.lit, LANGUAGE_MARKS)), F.array_position("__c", best).cast("int"))
    clear = (F.size("__w") >= LANGUAGE_WORDS) & (best > 0) & (best >= LANGUAGE_SHARE * F.size("__w"))
    return rows.withColumns({"lang_detected": F.when(clear, named).otherwise("xx"), "confidence": F.when(clear, F.bround((best - second) / best, 2)).otherwise(0.0)}).drop("__w", "__c", "__s")


def kind(docs: DataFrame, title: str, text: str) -> DataFrame:
    """``docs`` with ``doc_type`` from marks in the title and the text's start."""
    sample = F.substring(F.coalesce(F.col(text), F.lit("")), 1, KIND_SAMPLE)
    rows = docs.withColumn("__t", T.fold(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), sample)))
    out = F.when(F.lit(False), "")
    for name, (least, marks) in KIND_MARKS.items():
        out = out.when(sum(F.contains("__t", F.lit(m)).cast("int") for m in marks) >= least, name)
    return rows.withColumn("doc_type", out.otherwise(KIND_DEFAULT)).drop("__t")


def accepted(words: Column, pages: Column) -> Column:
    """Whether an extracted document is taken in: enough words a page, or enough at all."""
    return ~((words < 15 * pages) & (words < 3000))


def extraction_ratio(words: Column, raw: Column, least: int = 1000) -> Column:
    """Share of the raw words that extraction kept; 0 where there are too few to judge."""
    return F.when(raw < least, 0.0).otherwise(words / raw)


def extraction_warning(words: Column, raw: Column) -> Column:
    return (raw >= 1000) & (extraction_ratio(words, raw) < 0.80)
