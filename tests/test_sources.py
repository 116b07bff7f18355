"""Files, chapter files, manifests and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellumic.sources import chapters as C
from vellumic.sources import files as FS
from vellumic.sources import html as H
from vellumic.streaming import events as V
from vellumic.streaming import upkeep as U

CONTAINER = '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf"><metadata><title xmlns="dc">T</title></metadata><manifest>
<item id="b" href="two.xhtml"/><item id="a" href="one.xhtml"/><item id="e" href="empty.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="e"/><itemref idref="b"/></spine></package>"""


def epub(one="<html><head><style>p{}</style></head><body><h1>Um\n dois</h1><p>corpo</p></body></html>", container=CONTAINER):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if container:
            z.writestr("META-INF/container.xml", container)
        z.writestr("OEBPS/book.opf", OPF)
        z.writestr("OEBPS/one.xhtml", one)
        z.writestr("OEBPS/two.xhtml", "<p>segundo</p>" if one else "")
        z.writestr("OEBPS/empty.xhtml", "<p> </p>")
    return out.getvalue()


def test_epub():
    title, _, pages = FS.read_epub(epub())
    assert title == "T" and pages == ["## Um dois\n\ncorpo", "segundo"]
    assert FS.read_epub(epub(container=None))[2] == pages
    with pytest.raises(ValueError):
        FS.read_epub(epub(one=""))


def test_epub_references_and_titles(spark, tmp_path):
    opf = """<package xmlns="x"><metadata><title> </title><title>Book   \\( Site.com \\).epub </title><title>Other</title><creator>A</creator><creator>B</creator></metadata>
<manifest><item id="1" href="Ch%201.xhtml"/><item id="2" href="b.xhtml#top"/><item id="3" href="../c.xhtml"/><item id="4" href="only.xhtml"/><item id="5"/></manifest>
<spine><itemref idref="3"/><itemref idref="1"/><itemref idref="4"/><itemref idref="2"/><itemref idref="5"/><itemref idref="9"/></spine></package>"""
    with zipfile.ZipFile(tmp_path / "x.epub", "w") as z:
        z.writestr("META-INF/container.xml", "<broken")
        z.writestr("OEBPS/book.OPF", opf)
        z.writestr("OEBPS/Ch 1.xhtml", "<head><title>no</title></head><svg>no</svg><h2>One</h2><p>ﬁrst &amp; com-\n pound</p>\n\n\n<p>next<br/>line</p>")
        z.writestr("OEBPS/b.xhtml", "<ul><li>a</li><li>b</li></ul><h4>Deep\n er</h4>")
        z.writestr("c.xhtml", "<div>zero&nbsp; &eacute;</div>")
        z.writestr("OEBPS/only.xhtml", "<h1> </h1><h3></h3>")
    rows = FS.pages(FS.inbox(spark, str(tmp_path))).orderBy("page").collect()
    assert [r.md for r in rows] == ["zero é", "## One\n\nfirst & compound\n\nnext\n\nline", "a\n\nb\n\n#### Deep er"]
    assert {(r.title, r.author) for r in rows} == {("Book", "A")}


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, t: f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Heading1', 'A')}{p('', 'texto')}{p('Titulo9', 'B')}{p('', ' ')}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="Titulo9"><w:name w:val="heading 9"/></w:style></w:styles>')
    return out.getvalue()


def test_docx():
    assert FS.read_docx(docx())[2] == ["## A\n\ntexto\n\n###### B"]


def test_inbox(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in (("a.txt", "olá".encode() + b"\xff"), ("sub/b.epub", epub()), ("c.docx", docx()), ("bad.epub", b"no zip"), ("d.pdf", b"%PDF"), ("skip.png", b"x")):
        (tmp_path / name).write_bytes(content)
    files = FS.inbox(spark, str(tmp_path))
    assert files.count() == 5
    rows = FS.pages(files).withColumn("stem", FS.stem(F.col("path"))).orderBy("path", "page").collect()
    got = {(r.stem, r.page): r.md for r in rows if r.error is None}
    assert got["a", 1] == "olá�" and got["b", 2] == "segundo" and ("c", 1) in got
    assert {r.stem for r in rows if r.error} == {"bad", "d"}


def test_chapter_files(spark, tmp_path):
    folder = tmp_path / "markdown" / "vendas" / "livro"
    folder.mkdir(parents=True)
    (folder / "01.md").write_text('---\ntitulo: "Um: dois"\nutil: "sim"\n---\ncorpo\n---\nmais')
    (folder / "02.md").write_text("sem frontmatter")
    (folder / "03.md").write_text('---\nutil: "nao"\nutil: "sim"\n---\n')
    (folder / "INDEX.md").write_text("x")
    rows = {r.file: r for r in C.read_chapters(spark, str(tmp_path / "markdown")).collect()}
    assert set(rows) == {"01.md", "02.md", "03.md"}
    assert rows["01.md"].titulo == "Um: dois" and rows["01.md"].body.strip() == "corpo\n---\nmais"
    assert (rows["02.md"].titulo, rows["02.md"].capitulo, rows["02.md"].categoria, rows["02.md"].idioma) == ("livro", "02", "vendas", "xx")
    assert rows["03.md"].useful


def test_front_matter_round_trip(spark):
    df = spark.createDataFrame([('diz "oi"', 3)], "t string, n long")
    text = df.select(C.rendered({"titulo": F.col("t"), "n": F.col("n")}).alias("x"))
    assert text.select(C.front_matter(F.col("x"))).first()[0] == {"titulo": "diz 'oi'", "n": "3"}
    patched = text.select(C.patched(C.front_matter(F.col("x")), F.create_map(F.lit("n"), F.lit("4"))))
    assert patched.first()[0] == {"titulo": "diz 'oi'", "n": "4"}
    assert spark.createDataFrame([("a/b/c/d.md",)], "p string").select(C.document_key(F.col("p"))).first()[0] == "b/c"


def test_manifest_versions(spark, tmp_path):
    path = str(tmp_path / "m")
    for k in range(3):
        C.write_version(spark, spark.createDataFrame([("s", k)], "sha string, k int"), path)
    (tmp_path / "m" / "version=9").mkdir()
    assert C.read_version(spark, str(tmp_path / "none")) is None
    assert C.read_version(spark, path).first().k == 2


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "c")
    C.write_chapters(spark.createDataFrame([(1, "a"), (2, "b")], "k int, category string"), path)
    C.write_chapters(spark.createDataFrame([(3, "a")], "k int, category string"), path)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [2, 3]


def test_reports(spark):
    docs = spark.createDataFrame([("a", "ok", 1000), ("a", "ok", 234), ("b", "ok", 5), ("b", "falha", 0)], "category string, status string, n_words long")
    assert [tuple(r) for r in C.library_report(docs).collect()] == [("a", 2, "1.234"), ("b", 1, "5")]
    assert tuple(C.status(docs).first()) == (3, 1239, 1)
    ch = spark.createDataFrame([("a", "f", 1, "T", 1500, False, "curto")], "category string, folder string, ord int, title string, n_words long, useful boolean, reason string")
    assert C.document_report(ch).first().row == "| | 1 | T | 1.500 | curto | |"


def test_trails_file(spark, tmp_path):
    path = str(tmp_path / "t")
    C.append_trail(spark.createDataFrame([("q", "a\\b", True)], "question string, chapter string, useful boolean"), path)
    C.append_trail(spark.createDataFrame([("r", "c", False)], "question string, chapter string, useful boolean"), path)
    (tmp_path / "t" / "part-x.json").write_text("not json\n")
    assert sorted((r.question, r.chapter) for r in C.read_trails(spark, path).collect()) == [("q", "a/b"), ("r", "c")]


def test_html(spark):
    df = spark.createDataFrame([("<html><head><title>T</title></head><body><h2>A<b>b</b></h2><p>x &amp; y<br>z<script>p</script></body>",)], "h string")
    assert tuple(df.select(H.title(F.col("h")), H.markdown(F.col("h"))).first()) == ("T", "## Ab\n\nx & y\n\nz")


def test_streams_match_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, fn in (("tumbling", V.tumbling), ("sliding", V.sliding)):
        query = fn(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
        key = lambda rows: sorted((str(r.start), r.n) for r in rows)
        assert key(spark.table(name).collect()) == key(fn(events).collect())
    assert V.deduplicated(events.union(events)).count() == events.count()


def test_index_upkeep(spark, tmp_path):
    schema = "chapter string, body string, useful boolean, changed long"
    source, index, checkpoint = (str(tmp_path / x) for x in ("in", "index", "cp"))
    stream = None
    for rows in ([("a", "w " * 120, True, 1), ("b", "v " * 10, True, 1)], [("a", "new " * 30, True, 3), ("a", "other " * 20, True, 2), ("b", "v", False, 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = U.index_writer(stream, index, checkpoint, "changed").trigger(availableNow=True).start()
        query.awaitTermination()
    rows = U.current_index(spark, index).collect()
    assert [(r.chapter, r.n) for r in rows] == [("a", 30)]
