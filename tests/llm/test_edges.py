"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, for all operators and stages."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from vellumic.llm import chat_format, decontamination, html_layout, mixing, neardup, pii, quality_rules, queries, secret_scan, token_counts, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{i} mail{i}@example.com" for i in range(60))
LONG = " ".join(f"long{i}" for i in range(120_000))
ROWS = [
    (1, PROSE, "en", "src1", len(PROSE)),
    (1, PROSE, "en", "src1", len(PROSE)),
    (2, PROSE, "de", "src2", len(PROSE)),
    (3, None, None, None, None),
    (4, "", "en", "src1", 0),
    (5, LONG, "fr", "src3", len(LONG)),
    (6, " \t\n\v\f\r", "en", "", 6),
    (None, "no id here", "en", "src1", 10),
    (None, None, None, None, None),
    (7, "tiny", "es", "odd", 4),
]
CLASHES = ["id", "host", "size", "rest", "kept", "node", "unit", "n_words", "base_failed", "count", "key", "row", "__bad", "a b.c"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def clashing(docs):
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def items(spark, rows=((0, " ".join(f"word{i} mail{i}@example.com" for i in range(8, 24))), (1, None), (None, ""), (2, "word1"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


TABLES = {
    "op1": lambda s, d: token_counts.token_counts(d, queries.tokenizer_path()),
    "op2": lambda s, d: mixing.mixed(d),
    "op3": lambda s, d: neardup.near_duplicates(d),
    "op4": lambda s, d: decontamination.contaminated(d, items(s)),
    "op5": lambda s, d: secret_scan.secret_table(d),
    "op9": lambda s, d: pii.pii_table(d),
    "op10": lambda s, d: quality_rules.quality_table(d),
}


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


@pytest.mark.parametrize("name", TABLES)
def test_clashing_columns_change_nothing(spark, docs, name):
    assert rows(TABLES[name](spark, clashing(docs))) == rows(TABLES[name](spark, docs))


@pytest.mark.parametrize("name", TABLES)
def test_empty_table(spark, docs, name):
    assert TABLES[name](spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1", "op3", "op5", "op9", "op10"])
def test_a_row_for_each_row(spark, docs, name):
    got = TABLES[name](spark, docs)
    assert sorted(map(str, (r.doc_id for r in got.select("doc_id").collect()))) == sorted(str(r[0]) for r in ROWS)


def test_near_duplicates_of_edges(spark, docs):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in TABLES["op3"](spark, docs).collect()}
    assert got[1, 116] == (1, True) and got[2, 116] == (1, False)
    assert got[3, 0] == (3, True) and got[4, 0] == (4, True) and got[6, 0] == (6, True)
    assert got[7, 1] == (7, True) and got[None, 1] == (None, True) and got[None, 0] == (None, True)


def test_quality_of_edges(spark, docs):
    got = {r.doc_id: r for r in TABLES["op10"](spark, docs).collect() if r.doc_id is not None}
    assert got[3].base_failed and not got[3].kept and got[3].n_words == 0
    assert got[1].kept and got[6].word_chars == 0 and got[5].n_words == 120_000


def test_many_bad_hosts_find_the_same(spark, monkeypatch):
    soft, clean = " ".join(f"word{i}###" for i in range(30)), " ".join(f"word{i}" for i in range(30))
    hosts = [None, "", "a", "b", "c"]
    rows_ = [(k, None if k == 7 else clean if k % 5 == 0 else soft, "en", hosts[k % 5] if k % 3 else "good", 1) for k in range(120)] + [(200 + k, clean, "en", "good", 1) for k in range(200)]
    docs = spark.createDataFrame(rows_, SCHEMA)
    table, kept = rows(quality_rules.quality_table(docs)), rows(quality_rules.quality_filter(docs))
    assert any("bad_host': True" in r for r in table) and len(kept) < 320
    monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", 0)
    assert rows(quality_rules.quality_table(docs)) == table and rows(quality_rules.quality_filter(docs)) == kept


def test_contaminated_documents(spark, docs):
    got = sorted((r.doc_id, r.item_id, r.item_words, r.n_agree, r.first_word) for r in TABLES["op4"](spark, docs).collect())
    assert got == [(1, 0, 32, 32, 16), (1, 0, 32, 32, 16), (2, 0, 32, 32, 16)]


def test_decontamination_without_items(spark, docs):
    none = items(spark, [(1, None)])
    assert decontamination.contaminated(docs, none).count() == 0
    assert decontamination.decontaminate(docs, none).count() == len(ROWS)


def test_blocks_of_items_find_the_same(spark, docs, monkeypatch):
    whole = rows(TABLES["op4"](spark, docs))
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (decontamination.LEAST, 40))
    assert rows(TABLES["op4"](spark, docs)) == whole


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    items(spark).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_the_columns(spark, docs, sf, name, stage):
    out = stage(spark, docs, sf)
    if name != "mixing":
        assert out.schema.simpleString() == docs.schema.simpleString()
        wide = stage(spark, clashing(docs), sf)
        assert wide.columns == clashing(docs).columns
        assert rows(wide.select(*docs.columns)) == rows(out)
        assert set(wide.select(*(f"`{c}`" for c in CLASHES)).distinct().collect()) == {("clash",) * len(CLASHES)}
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_stage_results(spark, docs, sf):
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    assert ids(corpus_pipeline.quality(spark, docs, sf)) == ["1", "1", "2", "5"]
    assert ids(corpus_pipeline.deduplicate(spark, docs, sf)) == ["1", "3", "4", "5", "6", "7", "None", "None"]
    assert ids(corpus_pipeline.decontaminate(spark, docs, sf)) == ["3", "4", "5", "6", "7", "None", "None"]
    masked = {r.doc_id: r for r in corpus_pipeline.mask_personal_data(spark, docs, sf).collect()}
    assert "@" not in masked[1].text and masked[1].text.count("[EMAIL]") == 60 and masked[1].n_chars == len(masked[1].text)
    assert masked[3].text is None and masked[4].text == "" and masked[5].text == LONG


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/fr/x", "<p>a<p>b"), (2, None, None), (2, None, None), (None, "no scheme", ""), (3, "https://EXAMPLE.com", "<" * 50), (4, "http://spam-farm.example.org/en/1", "x")], "page_id long, url string, html string")
    pages = pages.withColumn("token", F.lit("t")).withColumn("rule", F.lit("r")).withColumn("text", F.lit("clash"))
    judged = {r.page_id: tuple(r)[1:] for r in url_filter.judged(pages, url_filter.rules(spark)).collect()}
    assert judged[1] == ("a.net", "/fr/x", "net/fr/", None, "block") and judged[2] == ("", "", None, None, "allow")
    assert judged[3] == ("example.com", "", None, None, "allow") and judged[4][2:] == (None, r"[/.-]spam[.-]", "block")
    texts = {r.page_id: r.text for r in html_layout.html_text(pages).collect()}
    assert texts == {1: "a\n\nb", 2: "", None: "", 3: "<" * 50, 4: "x"}
    assert url_filter.judged(pages.limit(0), url_filter.rules(spark)).count() == 0 == html_layout.html_text(pages.limit(0)).count()
    assert url_filter.judged(pages, url_filter.rules(spark)).count() == 6


def test_rules_that_end_inside_a_token(spark):
    table = spark.createDataFrame([url_filter.host_path_rule(*r) for r in (("example.com", "/en", "block"), ("a-b.org", "", "block"), ("c.org", "/X-y/Z9", "block"))], "rule string, verdict string, base boolean, whole boolean, pattern string, tokens array<string>")
    urls = {"http://example.com/english/a": "block", "http://example.com/en/a": "block", "http://example.com/fr/en": "allow", "http://www.a-b.org": "block", "http://a-b.org/x": "block", "http://a-b.orgs/x": "allow", "http://c.org/X-y/Z99": "block", "http://c.org/x-y/Z99": "allow", "http://notexample.com/en": "allow"}
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(list(urls) * 3)], "page_id long, url string")
    got = url_filter.judged(pages, table).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == list(enumerate(list(urls.values()) * 3))
    with pytest.raises(ValueError):
        url_filter.judged(pages, table.withColumn("tokens", F.expr("filter(tokens, t -> false)")))


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (None, 1, "user", "y"), (2, None, "user", ""), (2, None, "assistant", "</turn>\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash")).withColumn("loss", F.lit("clash"))
    out = chat_format.chat_format(df)
    got = {r.conv_id: r for r in out.where("conv_id IS NOT NULL").collect()}
    alone = sorted((chat_format.parse(r.formatted), r.loss) for r in out.where("conv_id IS NULL").collect())
    assert alone == [([("", "x")], []), ([("user", "y")], [])]
    assert chat_format.parse(got[1].formatted) == [("user", ""), ("assistant", "b"), ("assistant", "b")] and len(got[1].loss) == 2
    assert chat_format.parse(got[2].formatted) == [("assistant", "</turn>\n"), ("user", "")]
    assert sorted((str(r.conv_id), r.loss_chars) for r in chat_format.digests(out).collect()) == [("1", 2), ("2", 8), ("None", 0), ("None", 0)]
    assert chat_format.chat_format(df.limit(0)).count() == 0
