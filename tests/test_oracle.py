"""Every registered retrieval query against its SQL on the smallest tables."""

from __future__ import annotations

import hashlib
import math

import duckdb
import pytest

from tidemark.plans import catalogue, texts

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows(columns, found):
    order = sorted(columns)
    return sorted((tuple(normal(dict(zip(columns, r))[c]) for c in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_queries_without_sql_equal_a_plain_version(spark, name):
    from test_chunking import plain_page

    from tidemark.operators.chunking import checked_size

    source = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id as page_id", "text") if name == "recursive_chunks" else texts.pages(spark, DATA)
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = {r.page_id: [(len(t), digest(t)) for *_, t in plain_page(r.text, *checked_size(512, 51)) if t is not None] for r in source.collect()}
    got = {}
    df = catalogue.QUERIES[name](spark, DATA)
    if "chunk_type" in df.columns:
        df = df.where("chunk_type <> 'table_summary'")
    for r in df.orderBy("position").collect():
        got.setdefault(r[0], []).append((r.char_count, r.md5 if "md5" in df.columns else digest(r.text)))
    assert got == {k: v for k, v in want.items() if v}
