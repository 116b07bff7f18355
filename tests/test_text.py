"""Text functions against plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vellumic.functions import text as T


def values(spark, texts, *columns):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    return [tuple(r)[1:] for r in df.select("k", *columns).orderBy("k").collect()]


TEXTS = ["Straße Ñandú ÇÉ", "ﬁne ﬂow… ½ ™", "a–b “q” Precificação: o Guia!", "", "tab\tand\nline", "ＦＵＬＬ Ⅻ İstanbul"]


def test_fold(spark):
    plain = lambda t: unicodedata.normalize("NFKD", t.lower()).encode("ascii", "ignore").decode()
    got = values(spark, TEXTS, T.fold(F.col("t")), T.fold_exact(F.col("t")))
    assert [b for _, b in got] == [plain(t) for t in TEXTS]
    assert [a for a, _ in got][:5] == [plain(t) for t in TEXTS][:5]


def test_tokens_drop_stopwords_and_keep_repeats(spark):
    assert values(spark, ["The Rust of rust é um x Índice_2"], T.tokens(F.col("t"))) == [(["rust", "rust", "indice_2"],)]


def test_slug(spark):
    got = values(spark, ["Precificação: o Guia!", "???", "x" * 59 + " yz"], T.slug(F.col("t")))
    assert got == [("precificacao-o-guia",), ("sem-titulo",), ("x" * 59,)]


def test_normalized(spark):
    assert values(spark, ["compre-\nendeu", " a  b\t c ", "‘x’ soft­hyphen"], T.normalized(F.col("t"))) == [("compreendeu",), ("a b c",), ("'x' softhyphen",)]


def test_signature_joins_numbers(spark):
    a, b = values(spark, ["Capitulo 3 | 41", "Capitulo 3 | 42"], T.digit_signature(F.col("t")))
    assert a == b


@pytest.mark.parametrize("term, text, n", [("cro", "creditos autorais macro", 0), ("rust", "building trust frustrated", 0), ("rust", "a linguagem rust e boa", 1), ("gap selling", "sobre gap selling, o metodo", 1)])
def test_short_terms_need_boundaries(spark, term, text, n):
    assert values(spark, [text], T.occurrences(F.col("t"), term)) == [(n,)]


def test_titles(spark):
    got = values(spark, ["The Challenger Sale   \\( PDFDrive.com \\).epub", "44\nCapitulo dos", "TODO EM CAIXA"], T.clean_epub_title(F.col("t")), T.clean_heading(F.col("t")), T.capital_fixed(F.col("t")))
    assert got[0][0] == "The Challenger Sale" and got[1][1] == "Capitulo dos" and got[2][2] == "Todo em caixa"


def test_title_of(spark):
    stem = F.lit("123456-my_book-pdf_v2")
    assert values(spark, ["", "Real Title", "x.pdf"], T.title_of(F.col("t"), stem)) == [("my book",), ("Real Title",), ("my book",)]


def test_snippet_centres_on_the_first_term(spark):
    text = "x " * 200 + "Agulha no palheiro " + "y " * 200
    got = values(spark, [text, "nothing"], T.snippet(F.col("t"), ["agulha"], 40))
    assert "Agulha" in got[0][0] and got[0][0].startswith("...") and len(got[0][0]) <= 46 and got[1] == ("",)


def test_thousands_and_local_name(spark):
    assert values(spark, ["{ns}spine"], T.local_name(F.col("t")), T.thousands(F.lit(1234567))) == [("spine", "1.234.567")]


def test_words_take_any_white_space(spark):
    assert values(spark, [" a b\n c ", ""], T.word_count(F.col("t"))) == [(3,), (0,)]
    assert re.split(r"\s+", "a b") == ["a", "b"]
