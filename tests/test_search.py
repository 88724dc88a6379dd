"""The stored indexes of vectors and texts against searches that look at everything."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval, text_index, vector_index


def nearest(rows, asked, k):
    """{query: [(id, score)]} in double precision, ties by id."""
    unit = lambda v: v / n if (n := np.linalg.norm(v)) > 0 else v
    ids, x = [i for i, _ in rows], np.array([unit(np.array(v, float)) for _, v in rows])
    out = {}
    for q, v in asked:
        s = np.round(x @ unit(np.array(v, float)), 6)
        out[q] = [(ids[i], s[i]) for i in sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    x[700:1200] = x[0]  # a third of all are one vector
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


SCHEMA = "chunk_id long, embedding array<double>, kind int"
NAN = float("nan")


@pytest.fixture(scope="module")
def corpus(spark, clustered):
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [NAN] * 16), (2003, [1.0] * 3), (2004, [math.inf] + [0.0] * 15)]
    return spark.createDataFrame([(i, v, i % 3) for i, v in [*clustered, *odd]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def asked(spark, clustered):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x + 0.1 * y) for x, y in zip(v, rng.normal(size=16), strict=True)]) for i, v in clustered[:600:10]]
    return rows, spark.createDataFrame(rows, "query_id long, embedding array<double>")


def test_exact_search_in_tiles(corpus, clustered, asked, monkeypatch):
    rows, queries = asked
    usable = corpus.filter("chunk_id < 2000")
    want = nearest(clustered, rows, 7)
    assert found(retrieval.vector_topk(usable, queries)) == want
    monkeypatch.setattr(retrieval, "QUERY_BLOCK_BYTES", 100)
    assert found(retrieval.vector_topk(usable, queries)) == want
    one = lambda df: df.withColumn("cell", F.lit(0))
    small = retrieval.ranked(retrieval.tiled(one(usable), one(queries), 7, rows=40), 7)  # 38 x 2 tiles
    assert found(small) == want


def test_index_holds_every_row_and_finds_neighbours(spark, corpus, clustered, asked, tmp_path):
    rows, queries = asked
    index = vector_index.build(corpus, str(tmp_path / "v"))
    stored = index.vectors(spark)
    assert sorted(r.chunk_id for r in stored.select("chunk_id").collect()) == sorted([*range(1500), *range(2000, 2005)])
    assert {r.chunk_id: r.cell for r in stored.filter("cell < 0").collect()} == {2000: -2, 2001: -1, 2002: -2, 2003: -2, 2004: -2}
    want = nearest(clustered, rows, 7)
    got = found(vector_index.search(index, queries))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.95 * 7 * len(want) and index.probes < len(index.centroids)
    assert found(vector_index.search(index, queries, probes=1, exact=True)) == want
    only = [(i, v) for i, v in clustered if i % 3 == 1]
    again = vector_index.load(spark, str(tmp_path / "v"))
    assert again.probes == index.probes and np.array_equal(again.centroids, index.centroids)
    assert found(vector_index.search(again, queries, filters=F.col("kind") == 1, exact=True)) == nearest(only, rows, 7)


def test_added_rows_are_found(spark, corpus, clustered, asked, tmp_path):
    rows, queries = asked
    index = vector_index.build(corpus.filter("chunk_id % 2 = 0"), str(tmp_path / "v"), cells=9)
    vector_index.add(index, corpus.filter("chunk_id % 2 = 1"))
    zeros = spark.createDataFrame([(7000, [0.0] * 16)], "query_id long, embedding array<double>")
    assert found(vector_index.search(index, queries, k=3, exact=True)) == nearest(clustered, rows, 3)
    assert found(vector_index.search(index, zeros, k=2, exact=True)) == {7000: [(0, 0.0), (1, 0.0)]}
    assert vector_index.search(index, zeros).count() == 0


def test_a_search_opens_only_asked_cells(spark, corpus, asked, tmp_path):
    _, queries = asked
    index = vector_index.build(corpus, str(tmp_path / "v"))
    plan = vector_index.search(index, queries.limit(1), probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = vector_index.build(none, str(tmp_path / "v"))
    assert vector_index.search(index, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")).count() == 0


def test_recall_on_the_given_vectors(spark, tmp_path):
    """Vectors without clusters: most cells have to be asked, which the sample tells."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = e.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    index = vector_index.build(e, str(tmp_path / "v"))
    pair = lambda df: {(r.query_id, r.chunk_id) for r in df.collect()}
    want = pair(retrieval.vector_topk(e, queries))
    assert len(pair(vector_index.search(index, queries)) & want) >= 0.95 * len(want)


# -- texts -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["the", "of", "and", *(f"w{i}" for i in range(30)), "Đại", "HỌC", "x1"]
    weight = [60, 40, 30, *(30 / (i + 1) for i in range(30)), 2, 2, 1]
    docs = [(i, " ".join(rng.choices(words, weight, k=rng.choice([3, 20, 60])))) for i in range(250)]
    docs += [(900, None), (901, ""), (902, "., !"), *((1000 + i, "the of and w0 w1 the same") for i in range(120))]
    asked = [(i, " ".join(rng.choices(words, weight, k=rng.choice([1, 2, 3, 5])))) for i in range(40)]
    return docs, [*asked, (70, "the, THE the"), (71, "nowhere the"), (72, ""), (73, None), (74, "the same of")]


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    docs = spark.createDataFrame(texts[0], "chunk_id long, content string").repartition(3)
    made = text_index.build(docs, str(tmp_path_factory.mktemp("text") / "i"), buckets=5)
    assert text_index.load(spark, made.path) == made and made.n_docs == len(texts[0])
    return made


@pytest.fixture(scope="module")
def wanted(spark, texts):
    return text_index.query_terms(spark.createDataFrame(texts[1], "query_id long, text string"))


def test_postings_hold_places(spark, index, texts):
    want = Counter()
    for i, t in texts[0]:
        w = words_of(t)
        for term in set(w):
            want[term, i, len(w), w.count(term), tuple(k for k, x in enumerate(w) if x == term)] += 1
    assert Counter((r.term, r.chunk_id, r.length, r.tf, tuple(r.pos)) for r in index.postings(spark).collect()) == want


def test_match_all_and_cover_density(spark, index, wanted, texts):
    held = {i: words_of(t) for i, t in texts[0]}
    want = {(q, i) for q, t in texts[1] if words_of(t) for i, w in held.items() if set(words_of(t)) <= set(w)}
    assert {tuple(r) for r in text_index.match_all(index, wanted).collect()} == want
    few = spark.createDataFrame([(i,) for i in range(0, 1100, 2)], "chunk_id long")
    assert {tuple(r) for r in text_index.match_all(index, wanted, few).collect()} == {x for x in want if x[1] % 2 == 0 and x[1] < 1100}
    scores = {}
    for q, t in texts[1]:
        names = set(words_of(t))
        for i, w in held.items():
            if (q, i) in want:
                at = [(k, x) for k, x in enumerate(w) if x in names]
                scores[q, i] = round(text_index._covers([k for k, _ in at], [x for _, x in at], len(names)), 6)
    got = text_index.cover_density(index, wanted, k=None).collect()
    assert {(r.query_id, r.chunk_id): r.score for r in got} == scores and len(got) == len(scores)


def test_bm25_leaves_out_nothing_that_ranks(index, wanted, texts):
    docs = {i: words_of(t) for i, t in texts[0]}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(x for w in docs.values() for x in set(w))
    want = {}
    for q, t in texts[1]:
        s = {}
        for i, w in docs.items():
            parts = [math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(words_of(t)) if x in w]
            if parts:
                s[i] = round(sum(parts), 6)
        if s:
            want[q] = [(i, s[i]) for i in sorted(s, key=lambda i: (-s[i], i))[:5]]
    assert found(text_index.bm25(index, wanted)) == want


def test_scores_under_the_kth_are_not_held(monkeypatch):
    """What a task sorts and holds grows with the queries, not with the vectors."""
    import numpy as np

    rng = np.random.default_rng(3)
    q, x, names = rng.normal(size=(5, 8)), np.round(rng.normal(size=(4000, 8)), 1), rng.permutation(4000)
    x[::3], x[7] = x[0], np.nan
    sorted_, best = [], retrieval._best
    monkeypatch.setattr(retrieval, "_best", lambda i, *a: sorted_.append(len(i)) or best(i, *a))
    monkeypatch.setattr(retrieval, "SCORES", 100)
    held = retrieval._Held(q, 3, 6)
    for at in range(0, 4000, 900):
        held.add(names[at : at + 900], x[at : at + 900])
    i, ids, s = held.best()
    scores = np.nan_to_num(np.round(retrieval.unit(q) @ retrieval.unit(x).T, 6), nan=-np.inf)
    want = [(row, names[j], scores[row, j]) for row in range(5) for j in np.lexsort((names, -scores[row]))[:3]]
    assert list(zip(i, ids, s, strict=True)) == want and sum(sorted_) < 2500


def test_tasks_that_count_words_follow_the_texts(spark, tmp_path, monkeypatch):
    asked, kind = [], type(spark.range(1))
    whole = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: asked.append(a) or whole(self, *a))
    monkeypatch.setattr(text_index, "DEALT_BYTES", 100)
    docs = spark.createDataFrame([(i, "á b " * 5 if i else None) for i in range(101)], "chunk_id long, content string")
    index = text_index.build(docs, str(tmp_path / "i"))
    assert asked == [(25, "chunk_id")]
    assert index.n_docs == 101 and {(r.term, r.df) for r in index.terms(spark).collect()} == {("á", 100), ("b", 100)}

def test_bm25_shuffles_postings_and_not_their_pairs(spark, tmp_path, monkeypatch):
    """Pairs of a query and a chunk are made and added up in the tasks that hold the chunk's postings."""
    asked, kind = [], type(spark.range(1))
    whole = kind.repartition
    monkeypatch.setattr(text_index, "DEALT_PAIRS", 100)
    docs = spark.createDataFrame([(i, f"common w{i % 7} " * (1 + i % 3)) for i in range(120)], "chunk_id long, content string")
    index = text_index.build(docs, str(tmp_path / "i"))
    asks = text_index.query_terms(spark.createDataFrame([(q, f"common w{q % 7}") for q in range(20)], "query_id long, text string"))
    monkeypatch.setattr(kind, "repartition", lambda self, *a: asked.append(a) or whole(self, *a))
    got = text_index.bm25(index, asks)
    assert asked == [(28, "chunk_id")]  # 20 queries meet 120 postings of one term and 17 or 18 of another
    plan = got._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len([x for x in exchanges if "(chunk_id#" in x]) == 1 and "WindowGroupLimit" in plan
    assert not any("query_id#" in x and "chunk_id#" in x for x in exchanges)
    assert got.count() == 100
