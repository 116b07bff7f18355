"""Every stage of the pipeline on its own input, against SQL or brute force, and the whole."""

import re

import corpus_pipeline
import duckdb
import pytest
from test_brute import brute_components, brute_overlap, brute_pii

from vellumic.llm import pii, queries


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """(path of the input, path of the result) of each stage."""
    base = tmp_path_factory.mktemp("stages")
    at, out = f"{sf_dir}/documents.parquet", []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(at), sf_dir).coalesce(1).write.parquet(f"{base}/{k}")
        out.append((at, f"{base}/{k}"))
        at = f"{base}/{k}"
    return out


def table(path):
    source = path if path.endswith(".parquet") else f"{path}/*.parquet"
    return duckdb.execute(f"SELECT * FROM '{source}'").fetchall()


def by_sql(name, path, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path if path.endswith('.parquet') else path + '/*.parquet'}'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf_dir}/benchmark.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    return [dict(zip(names, r)) for r in cursor.fetchall()]


def test_quality(steps, sf_dir):
    before, after = steps[0]
    kept = {r["doc_id"] for r in by_sql("op10_quality_rules", before, sf_dir) if r["kept"]}
    assert sorted(table(after)) == sorted(r for r in table(before) if r[0] in kept)


def test_near_duplicates(steps):
    before, after = steps[1]
    roots = brute_components([(r[0], r[1]) for r in table(before)], 80)
    assert sorted(table(after)) == sorted(r for r in table(before) if roots[r[0]][1] == r[0])


def test_decontamination(steps, sf_dir):
    before, after = steps[2]
    items = [t for _, t in table(f"{sf_dir}/benchmark.parquet")]
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t)
    near = lambda text: [t for t in items if len(set(lower(t).split()) & set(lower(text).split())) >= min(10, 0.7 * len(set(t.split())))]
    clean = [r for r in table(before) if not any(brute_overlap(r[1], t) for t in near(r[1]))]
    assert sorted(table(after)) == sorted(clean)


def test_personal_data(steps):
    before, after = steps[3]
    old, new = {r[0]: r for r in table(before)}, {r[0]: r for r in table(after)}
    assert old.keys() == new.keys()
    for k, row in old.items():
        assert new[k][2:4] == row[2:4] and new[k][4] == len(new[k][1])
        if not pii.scan(row[1])[1]:
            assert new[k] == row
        else:
            assert "[" in new[k][1] and not set(brute_pii(new[k][1])) & set(brute_pii(row[1]))


def test_mixing(steps, sf_dir):
    before, after = steps[4]
    want = sorted((r["doc_id"], r["epoch"], r["leaf"]) for r in by_sql("op2_mixing", before, sf_dir))
    assert sorted((r[0], r[5], r[3]) for r in table(after)) == want


def test_run(spark, sf_dir, steps):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(table(steps[4][1]))
