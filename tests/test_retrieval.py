"""BM25, fusion, dense search and feedback on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from vellumic import models
from vellumic.operators import dense as D
from vellumic.operators import hybrid as H
from vellumic.operators import lexical as L
from vellumic.operators import lexindex as X
from vellumic.operators.ranking import ranked

DOCS = [("a", "preco preco preco venda"), ("b", "preco outra coisa distinta aqui"), ("c", "nada relevante"), ("d", None)]


def lex(spark, docs=DOCS):
    return L.tokenized(spark.createDataFrame(docs, "id string, t string"), "id", "t")


def brute(docs, query):
    import re

    toks = {i: re.findall("[a-z0-9][a-z0-9_]+", t or "") for i, t in docs}
    mean = sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, ts in toks.items():
        s = 0.0
        for q in query.split():
            df = sum(q in x for x in toks.values())
            f = ts.count(q)
            if f:
                s += math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(ts) / mean))
        if s:
            out[i] = s
    return out


@pytest.mark.parametrize("query", ["preco", "preco preco venda", "coisa nada", "ausente"])
def test_bm25(spark, query):
    got = {r.id: r.score for r in L.bm25(lex(spark), L.questions_of(spark, [query]), "id").collect()}
    assert got == pytest.approx(brute(DOCS, query))


def test_focused_chapter_beats_giant(spark):
    docs = [("giant", "preco preco " + "palavra qualquer " * 2500), ("focused", "preco preco " + "palavra qualquer " * 150)]
    hits = L.search(lex(spark, docs), L.questions_of(spark, ["preco"]), "id", 5).orderBy("rank").collect()
    assert [h.id for h in hits] == ["focused", "giant"]


def test_max_fusion_takes_the_better_language(spark):
    scored = L.bm25(lex(spark), L.questions_of(spark, ["venda", "coisa"]), "id")
    got = {r.id: r.score for r in L.max_fused(scored, "id").collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 1 / 61})


def test_cut_comes_before_the_filter(spark):
    docs = spark.createDataFrame([(k, "alvo " * (k + 1) + "resto " * 10, "x" if k < 5 else "y") for k in range(10)], "id long, t string, cat string")
    rows = L.filtered_after(L.bm25(L.tokenized(docs, "id", "t", "cat"), L.questions_of(spark, ["alvo"]), "id", "cat"), "id", "cat", ["x"], 10, cut=6)
    assert [r.id for r in rows.collect()] == [4]


VECTORS = [(0, "livro-a", "v", [1.0, 0.0, 0.0, 0.0]), (1, "livro-a", "v", [0.9, 0.1, 0.0, 0.0]), (2, "livro-b", "v", [0.0, 1.0, 0.0, 0.0]), (3, "livro-c", "p", [0.0, 0.0, 1.0, 0.0]), (4, "null", "p", None)]


def vectors(spark):
    return spark.createDataFrame(VECTORS, "pid long, doc string, cat string, embedding array<double>")


def test_dense_best_per_document(spark):
    scores = D.scored(vectors(spark), [1.0, 0.5, 0.0, 0.0])
    assert scores.count() == 4
    best = D.best_per_document(scores, ["doc"], "pid").orderBy("rank").collect()
    assert [(r.doc, r.pid) for r in best] == [("livro-a", 0), ("livro-b", 2), ("livro-c", 3)]
    shown = spark.createDataFrame([("livro-a",)], "doc string")
    assert D.best_per_document(scores, ["doc"], "pid", excluded=shown).orderBy("rank").first().doc == "livro-b"


def test_masked_rows_stay(spark):
    rows = D.masked(D.scored(vectors(spark), [1.0, 0.0, 0.0, 0.0]), F.col("cat") == "p").collect()
    assert sorted(r.score for r in rows)[:3] == [-1e9] * 3 and len(rows) == 4


def rocchio(spark, judged):
    eye = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    q = spark.createDataFrame([(eye[0],)], "embedding array<double>")
    rows = spark.createDataFrame([(eye[k], r) for k, r in judged], "embedding array<double>, relevant boolean")
    return D.as_list(D.rocchio(q, rows))


def test_rocchio(spark):
    assert rocchio(spark, []) == [1, 0, 0]
    got = rocchio(spark, [(1, True), (2, False)])
    assert got[1] > 0 > got[2] and abs(got[1]) > abs(got[2]) and math.isclose(sum(x * x for x in got), 1)


def test_centroids_weigh_documents_alike(spark):
    rows = {(r.cat, r.dim): r.value for r in D.centroids(vectors(spark).where("embedding IS NOT NULL"), "cat", "doc").collect()}
    assert rows["v", 0] == pytest.approx(rows["v", 1], abs=0.06) and rows["p", 2] == 1


def test_votes(spark):
    top = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2"), (3, "b", "d2"), (4, "b", "d2")], "rank long, cat string, doc string")
    assert [r.cat for r in D.vote(top, "cat").orderBy("rank").collect()] == ["b", "a"]
    assert [r.cat for r in D.vote_by_document(top, "cat", "doc").orderBy("rank").collect()] == ["a", "b"]


def test_sum_fusion_is_symmetric_but_for_flags(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "d string, rank long")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "d string, rank long")
    one = [(r.d, round(r.score, 9)) for r in H.sum_fused(a, b, "d", 5).orderBy("rank").collect()]
    two = [(r.d, round(r.score, 9)) for r in H.sum_fused(b, a, "d", 5).orderBy("rank").collect()]
    assert one == two and one[0] == ("y", round(1 / 62 + 1 / 61, 9))


def test_fill_up_adds_unseen_documents(spark):
    own = spark.createDataFrame([("x", 1)], "d string, rank long")
    more = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "d string, rank long")
    got = [(r.d, r.filled) for r in H.filled(own, more, "d", 2).orderBy("rank").collect()]
    assert got == [("x", False), ("y", True)]


def test_ranks_break_ties_by_id(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 2.0)], "id long, s double")
    assert [(r.id, r["rank"]) for r in ranked(df, "s", ["id"], most=2).orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_models(spark):
    docs = spark.createDataFrame([(1, "preco de venda", "a"), (2, "motor eletrico", "b"), (3, " ", "c")], "pid long, t string, ch string")
    rows = models.embedded(docs, "t").collect()
    assert all(len(r.embedding) == models.DIMS for r in rows) and math.isclose(sum(x * x for x in rows[0].embedding), 1, rel_tol=1e-5)
    top = models.reranked(docs.withColumn("s", F.lit(1.0)), "motor novo", "t", "s", "pid", "ch").orderBy("rank").collect()
    assert [r.pid for r in top] == [2, 1]


def test_lexical_index(spark, tmp_path):
    """After every refresh the index scores as a search of the texts does."""
    root = str(tmp_path / "index")
    words = ["alvo um", "alvo alvo dois", "tres um", "", "dois alvo quatro", None]
    docs = spark.createDataFrame([(k, t, "x" if k % 2 else "y") for k, t in enumerate(words)], "id long, t string, cat string")
    later = [
        docs,
        docs.withColumn("t", F.when(F.col("id") == 2, F.lit("alvo novo")).otherwise(F.col("t"))),
        docs.where("id <> 1").withColumn("cat", F.when(F.col("id") == 4, F.lit("z")).otherwise(F.col("cat"))),
        docs.limit(0),
        docs,
    ]
    questions = L.questions_of(spark, ["alvo um um", "novo quatro"])
    rows = lambda df: sorted((r.qid, r.id, r.cat, round(r.score, 9), r.n_terms) for r in df.collect())
    done = []
    for state in later:
        done.append({r.action: r.n for r in X.refresh(spark, root, state, "id", "t", "cat").collect()})
        want = rows(L.bm25(L.tokenized(state, "id", "t", "cat"), questions, "id", "cat"))
        assert rows(X.bm25(spark, root, questions, "id", "cat")) == want
        X.compacted(spark, root, "id") if len(done) == 3 else None
        assert rows(X.bm25(spark, root, questions, "id", "cat")) == want
    assert done == [{"embed": 6}, {"embed": 1, "keep": 5}, {"embed": 2, "delete": 1, "keep": 3}, {"delete": 5}, {"embed": 6}]
    plan = X.bm25(spark, root, questions, "id", "cat")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(term" in plan
