"""Grading rules on inputs with known outcomes."""

import pytest
from pyspark.sql import functions as F

from vellumic.operators import catalog as C
from vellumic.operators import quality as Q

BODY = " ".join(f"palavra{i % 90}" for i in range(300))


def grade(spark, title, md):
    row = Q.graded(spark.createDataFrame([(title, md)], "title string, md string"), "title", "md").first()
    return row.useful, row.reason


@pytest.mark.parametrize("title", ["5. References", "A. Bibliografia", "Index of terms", "Sumário", "Agradecimentos", "Index", "Author index"])
def test_support_titles(spark, title):
    assert grade(spark, title, BODY)[0] is False


@pytest.mark.parametrize("title", ["5. Encapsulation", "Index construction", "Indexing", "Uma historia"])
def test_content_titles(spark, title):
    assert grade(spark, title, BODY) == (True, "")


def test_sales_page_is_short(spark):
    assert grade(spark, "x", BODY + " instant download add to cart")[1] == "pagina de venda, nao conteudo (instant download, add to cart)"
    long = " ".join(f"palavra{i % 900}" for i in range(3000)) + " add to cart" * 5
    assert grade(spark, "x", long) == (True, "")


def test_short_lines_dots_numbers_and_vocabulary(spark):
    assert grade(spark, "x", "a b c") == (False, "curto demais (3 palavras)")
    assert "indice" in grade(spark, "x", "\n".join(f"Assunto numero {i} {i * 3}" for i in range(60)))[1]
    assert grade(spark, "x", "\n".join(["Hierarquia e tudo . . . . . . . . . . 54 texto"] * 40))[1].startswith("sumario (pontilhado")
    prose = "\n".join(" ".join(f"palavra{(i * 7 + j) % 300}" for j in range(15)) + " fim" for i in range(80))
    assert grade(spark, "x", prose + "\n" + "\n".join(["valor . . . . . 5 mil"] * 5)) == (True, "")
    assert grade(spark, "x", " ".join(f"{i / 7:.2f}" for i in range(400)))[1].startswith("tabela de numeros")
    assert grade(spark, "x", "mesma palavra " * 200)[1].startswith("vocabulario degenerado")


def test_nulls_are_short(spark):
    assert grade(spark, None, None) == (False, "curto demais (0 palavras)")


SAMPLES = {
    "pt": "de que nao para uma com os as dos das ele ela isso este esta muito quando entao voce nos seu sua pelo pela ate",
    "es": "de que no para una con los las del ella eso este esta muy cuando entonces usted nosotros su por hasta porque tambien",
    "en": "the of and to in that is for with as was are this these from have has been will would there their which when",
    "fr": "le la les des une pour avec dans que qui est sont ete plus cette ces vous nous leur mais comme sur par tout",
}


@pytest.mark.parametrize("code", SAMPLES)
def test_language(spark, code):
    df = spark.createDataFrame([(f"{SAMPLES[code]} " * 3,)], "t string")
    assert Q.language(df, "t").first().lang_detected == code


def test_language_unclear(spark):
    df = spark.createDataFrame([("oi",), ("12 34 56 78 " * 60,), (None,)], "t string")
    assert [tuple(r)[1:] for r in Q.language(df, "t").collect()] == [("xx", 0.0)] * 3


@pytest.mark.parametrize("title, sample, kind", [("x", "orientador: fulano", "livro"), ("x", "orientador: fulano, universidade federal, tese apresentada", "tese"), ("x", "manual do usuario", "manual"), ("Apostila", "", "apostila"), ("x", "texto", "livro")])
def test_kind(spark, title, sample, kind):
    assert Q.kind(spark.createDataFrame([(title, sample)], "a string, b string"), "a", "b").first().doc_type == kind


def test_extraction(spark):
    df = spark.createDataFrame([(31092, 141113), (20247, 21192), (60000, 120)], "w long, r long")
    rows = df.select(Q.extraction_ratio(F.col("w"), F.col("r")), Q.extraction_warning(F.col("w"), F.col("r"))).collect()
    assert rows[0][0] < 0.8 and rows[0][1] and rows[1][0] > 0.9 and not rows[1][1] and rows[2][0] == 0 and not rows[2][1]
    assert [r[0] for r in spark.createDataFrame([(100, 10), (4000, 1000), (200, 10)], "w long, p long").select(Q.accepted(F.col("w"), F.col("p"))).collect()] == [False, True, True]


VOCABULARY = {"vendas": ["spin selling", "negotiation"], "rust": ["rust", "borrow checker"]}


def test_classification(spark):
    rows = [("spin-selling-espanol", "x"), ("xyz", ""), ("a", "trust " * 30), ("a", "rust " * 30), (None, None)]
    got = C.classified(spark.createDataFrame(rows, "n string, b string"), "n", "b", VOCABULARY).collect()
    assert [(r.category, r.points) for r in got] == [("vendas", 6), ("geral", 0), ("geral", 0), ("rust", 8), ("geral", 0)]


def test_matcher_counts_without_overlap():
    m = C.Matcher({"x": ["aa", "aaa"]}, bounded=False)
    assert m.counts("aaaaa") == {"aa": 2, "aaa": 1}


def test_facets_put_the_dominant_first(spark):
    scores = spark.createDataFrame([(1, 0, "a", 10), (1, 1, "b", 6), (1, 2, "c", 1), (2, 0, "a", 9)], "d long, place int, category string, points long")
    docs = spark.createDataFrame([(1, "b"), (2, "z"), (3, None)], "d long, cat string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "category string, weight double")
    got = {r.d: r.subjects for r in C.facets(scores, weights, docs, "d", "cat").collect()}
    assert got == {1: ["b", "a"], 2: ["z", "a"], 3: []}


def test_domains(spark):
    bridge = C.domain_bridge(spark, {"com": ["vendas", "x"], "tec": ["python"]}, {"com": ["vendas"]})
    existing = spark.createDataFrame([("vendas",), ("python",), ("geral",), ("x",)], "category string")
    got = sorted(map(tuple, C.domain_categories(bridge, existing).collect()))
    assert got == [("com", "geral"), ("com", "vendas"), ("com", "x"), ("tec", "geral"), ("tec", "python"), ("tec", "x")]
    assert sorted(r[0] for r in C.unmapped_categories(bridge, existing).collect()) == ["geral", "x"]


def test_gate():
    C.required_cut(None, None, True, ["a"], ["d"])
    C.required_cut("a", None, False, ["a"], ["d"])
    for cut in ((None, None, False), ("b", None, False), (None, "e", False)):
        with pytest.raises(ValueError):
            C.required_cut(*cut, ["a"], ["d"])


def test_sample_keeps_the_page_that_crosses(spark):
    pages = spark.createDataFrame([(1, k, "x" * 10) for k in range(5)], "d long, p long, t string")
    assert len(C.sampled(pages, "d", "p", "t", chars=15).first().sample) == 21
