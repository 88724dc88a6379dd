"""Every query against its DuckDB SQL, on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from docloom.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return round(float(v), 7) if isinstance(v, float) else v

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    want = plain(duck.execute(f"select {', '.join(columns)} from ({plans.SQL[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.SQL.keys()))
def test_has_rows(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert plans.QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", ["vector_topk", "vector_topk_filtered", "rrf_fusion", "parent_rollup"])
def test_every_twentieth_row_is_searched(spark, name):
    ids = {r.vec_id for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect() if r.vec_id % 20 == 0}
    assert len(ids) > 5 and {r.query_id for r in plans.QUERIES[name](spark, FOLDER).collect()} == ids


def test_questions_are_whole_texts(spark):
    import re

    words = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    asked = {r.item_id: words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    held = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    want = {(q, c) for q, a in asked.items() for c, t in held.items() if a <= t}
    assert {tuple(r) for r in plans.QUERIES["fulltext_match_all"](spark, FOLDER).select("query_id", "chunk_id").collect()} == want
    _, wanted = plans._text_index(spark, FOLDER)
    got = {}
    for r in wanted.collect():
        got.setdefault(r.query_id, set()).add(r.term)
    assert got == asked and max(map(len, asked.values())) > 2
    assert {r.query_id for r in plans.QUERIES["bm25_topk"](spark, FOLDER).collect()} == asked.keys()


def test_hybrid_asks_whole_texts_and_both_variants(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(plans.retrieval, "hybrid", lambda chunks, questions, *a: seen.append(questions) or questions)
    plans.QUERIES["hybrid_retrieval"](spark, FOLDER)
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    assert sorted((r.query_id, r.variant, r.text) for r in seen[0].collect()) == sorted((i, v, t) for i, t in texts.items() for v in (0, 1))


def test_every_position_is_fetched(spark):
    folder = "/root/testdata/sf0.1"  # smaller tables have no label with more than 40 active rows
    active = {r.chunk_id for r in plans._chunks(spark, folder).filter("is_active").select("chunk_id").collect()}
    want = sorted(3 * r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect() if 3 * r.vec_id in active)
    got = plans.QUERIES["late_fetch"](spark, folder).select("position", "parent_id").collect()
    assert sorted(r.parent_id for r in got) == want and max(r.position for r in got) > 40
