"""The driver's comparison: columns by name, row count, types and an order-insensitive value match."""

from __future__ import annotations

import decimal
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(row[k]) for k in order) for row in cursor.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(row[c]) for c in names) for row in df.collect())


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, rows = spark_rows(df)
    want_names, want = oracle_rows(sql, sf_dir)
    assert names == want_names
    assert rows == want, f"only here {list((rows - want).items())[:3]}, only there {list((want - rows).items())[:3]}"
