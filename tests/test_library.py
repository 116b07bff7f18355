"""A library from files to answers."""

import json

import pytest
from test_sources import docx, epub

from vellumic.__main__ import main
from vellumic.library import Library

VOCABULARY = {"vendas": ["preco", "venda", "objecao"], "rust": ["rust", "borrow checker"]}
DOMAINS = {"comercial": ["vendas"], "tecnico": ["rust", "geral"]}


def prose(word, n=400):
    return " ".join(f"{word}{k % 97} {word}" if k % 3 == 0 else f"palavra{(k * 7) % 211}" for k in range(n))


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("library")
    inbox = base / "inbox"
    inbox.mkdir()
    (inbox / "spin-selling.txt").write_text("preco venda objecao " * 20 + prose("cliente"))
    (inbox / "livro-rust.md").write_text("rust borrow checker " * 20 + prose("memoria"))
    (inbox / "copia.md").write_text("rust borrow checker " * 20 + prose("memoria"))
    (inbox / "outro.md").write_text(prose("jardim"))
    (inbox / "curto.docx").write_bytes(docx())
    (inbox / "livro.epub").write_bytes(epub(one=f"<h1>Um</h1><p>{prose('epub')}</p>"))
    (inbox / "bad.epub").write_bytes(b"no zip")
    lib = Library(spark, str(base / "lib"), VOCABULARY, DOMAINS)
    lib.ingest(str(inbox))
    return lib, str(inbox)


def test_ingest(library):
    lib, inbox = library
    rows = {r.path.rsplit("/", 1)[-1]: r for r in lib.manifest().collect()}
    assert "livro-rust.md" not in rows or "copia.md" not in rows
    assert rows["spin-selling.txt"].category == "vendas" and rows["outro.md"].category == "geral" and rows["spin-selling.txt"].title == "spin selling"
    assert {k for k, r in rows.items() if r.status == "falha"} == {"bad.epub", "curto.docx"}
    assert lib.ingest(inbox).where("status = 'ok'").count() == 0
    assert lib.chapters().count() >= 4


def test_index_and_questions(library):
    lib, _ = library
    assert {r.action for r in lib.index().collect()} == {"embed"}
    assert {r.action for r in lib.index().collect()} == {"keep"}
    assert tuple(lib.stale().first()) == (0, 0, 0)
    with pytest.raises(ValueError):
        lib.consult(["preco"])
    first = lib.search(["preco venda", "price"], 3).orderBy("rank").first()
    assert first.category == "vendas"
    assert lib.semantic("borrow checker rust", 2).orderBy("rank").first().category == "rust"
    assert lib.semantic("borrow checker rust", 2, rerank=True).orderBy("rank").first().category == "rust"
    cards, vector = lib.consult(["rust borrow checker"], everywhere=True, most=3)
    rows = cards.collect()
    assert rows[0].document and rows[0].from_dense and rows[0].from_lex and [r["rank"] for r in rows] == [1, 2, 3]
    again, _ = lib.consult(["rust borrow checker"], everywhere=True, query=lib.moved(vector, [rows[0].passage_id]), shown=[rows[0].sha])
    assert rows[0].sha not in {r.sha for r in again.collect()}
    only, _ = lib.consult(["rust"], category="rust", most=2)
    assert [r.sha for r in only.collect()][0] == rows[0].sha and only.count() == 2
    assert "borrow checker" in lib.opened(rows[0].passage_id)
    assert lib.more(vector, rows[0].sha).count() == 1
    assert "rust" in {r.category for r in lib.predicted("rust borrow checker").collect()}


def test_descriptions(library):
    lib, _ = library
    assert lib.labels().count() == lib.chapters().count()
    assert {r.subjects[0] for r in lib.facets().collect()} == {"vendas", "rust", "geral"}
    edges, top, bridges = lib.graph()
    assert top.count() > 0 and edges.count() >= 0 and bridges.count() >= 0


def test_curation(library):
    lib, inbox = library
    before = sorted(map(str, lib.manifest().collect()))
    assert lib.move(["outro"], "vendas", dry=True).where("category = 'vendas'").count() == 2
    assert sorted(map(str, lib.manifest().collect())) == before
    lib.move(["outro"], "vendas", reindex=False)
    lib.remove(["spin-selling"], reindex=False)
    assert {r.action: r.n for r in lib.index().collect()}.get("refresh") == 1
    assert {r.category for r in lib.chapters().where("folder = 'outro'").collect()} == {"vendas"}
    assert lib.ingest(inbox).where("status = 'ok'").count() == 0 and lib.chapters().where("folder = 'spin-selling'").count() == 0


def test_sessions(library):
    lib, _ = library
    assert lib.session("preco?") is None
    lib.save_session("preco?", [1.0, 0.0], ["p1"], ["p9"], ["d1"])
    lib.save_session("rust?", [0.0, 1.0])
    lib.save_session("preco?", [0.5, 0.5], ["p2", "p1"], [], ["d2"])
    row = lib.session("preco?")
    assert (row.query, row.relevant, row.others, row.shown) == ([0.5, 0.5], ["p1", "p2"], ["p9"], ["d1", "d2"])
    assert lib.sessions().count() == 2


def test_rules_anew(library, monkeypatch):
    lib, _ = library
    assert lib.revise(dry=True).count() == 0
    before = {r.chapter_id: r.useful for r in lib.chapters(useful_only=False).collect()}
    lib.revise(reindex=False)
    assert {r.chapter_id: r.useful for r in lib.chapters(useful_only=False).collect()} == before
    sections = {r.section for r in lib.graph_report().collect()}
    assert sections & {"communities", "alone"} and sections <= {"communities", "alone", "edges", "bridges"}
    lib.move(["outro"], "geral")
    assert {r.action for r in lib.index().collect()} == {"keep"}
    assert lib.search(["jardim"], 1).first().category == "geral"


def test_command_line(library, capsys):
    lib, _ = library
    main([lib.root, "search", "rust borrow", "--everywhere", "--most", "1"])
    main([lib.root, "status"])
    main([lib.root, "move", "outro", "--to", "x", "--dry"])
    found, status, *rows = map(json.loads, capsys.readouterr().out.splitlines())
    assert found["category"] == "rust" and status["docs"] >= 3 and {"x"} <= {r["category"] for r in rows}
    with pytest.raises(SystemExit):
        main([lib.root, "search", "rust"])
