"""Two-level running sums against plain loops, and what is built on them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.operators import dialogue, retrieval, scan


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_running_sums(spark, many_ranges):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), i, rng.choice([None, 1, 5])) for i in range(600)]
    want, sums = {}, {}
    for k, i, v in rows:
        want[i] = sums.get(k, (0, 0))
        sums[k] = (want[i][0] + (v or 0), want[i][1] + 1)
    df = spark.createDataFrame(rows, "k string, i int, v long").repartition(5).withColumn("one", F.lit(1).cast("long"))
    got = scan.running(df, "k", ["i"], {"total": "v", "n": "one"})
    assert got.columns == ["k", "i", "v", "one", "total", "n"] and {r.i: (r.total, r.n) for r in got.collect()} == want
    assert {r.i: r.position for r in scan.numbered(df, "k", ["i"]).collect()} == {i: n + 1 for i, (_, n) in want.items()}
    assert scan.running(df.limit(0), "k", ["i"], {"total": "v"}).count() == 0


def test_a_hot_group_is_in_many_tasks(spark, many_ranges):
    df = spark.range(2000).select(F.lit("hot").alias("k"), "id")
    parts = scan.running(df, "k", ["id"], {"n": "id"}).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 1000


def test_budget_of_hot_and_null_groups(spark, many_ranges):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, None if rng.random() < 0.1 else "x" * rng.choice([0, 3, 80, 240])) for i in range(120)]
    want, used = {}, {}
    for q, i, t in rows:
        if t is None:
            continue
        rest = 500 - used.get(q, 0)
        used[q] = used.get(q, 0) + len(t)
        if len(t) <= rest:
            want[i] = t
        elif rest > 100:
            want[i] = t[:rest] + "..."
    df = spark.createDataFrame(rows, "query_id int, position int, content string").repartition(4)
    for most_rows in (1 << 18, 0):  # the kept rows broadcast, and not
        retrieval.BROADCAST_ROWS, before = most_rows, retrieval.BROADCAST_ROWS
        try:
            assert {r.position: r.emitted for r in retrieval.budget(df, 500).collect()} == want
        finally:
            retrieval.BROADCAST_ROWS = before


def test_lookup_finds_the_newest_entries_alone(spark, many_ranges):
    rng = random.Random(8)
    at = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    entries = [(i, rng.choice("xy"), at(rng.randrange(900)), [1.0, rng.random()]) for i in range(150)]
    asks = [(i, rng.choice("xy"), at(rng.randrange(1000)), [1.0, rng.random()]) for i in range(80)]
    cos = lambda v, w: round(sum(a * b for a, b in zip(v, w, strict=True)) / (sum(a * a for a in v) * sum(b * b for b in w)) ** 0.5, 6)
    want = {}
    for i, action, t, v in asks:
        kept = sorted((e for e in entries if e[2] <= t), key=lambda e: (e[2], str(e[0])))[-20:]
        live = [(-cos(v, e[3]), e[0]) for e in kept if e[1] == action and (t - e[2]).total_seconds() < 300]
        if live:
            want[i] = (min(live)[1], -min(live)[0])
    cache = spark.createDataFrame(entries, "entry_id int, action string, saved_at timestamp, embedding array<double>")
    requests = spark.createDataFrame(asks, "request_id int, action string, asked_at timestamp, embedding array<double>")
    got = dialogue.cache_lookup(requests, cache, 300, 0.9, most=20).collect()
    assert {r.request_id: (r.entry_id, r.similarity) for r in got} == want and all(r.hit == (r.similarity >= 0.9) for r in got)


def test_intermediates_are_cleared(spark):
    from pathlib import Path

    from docloom.sources import tables

    kept = tables.materialized(spark.range(3))
    folder = Path(tables._own(spark).removeprefix("file:"))
    assert kept.count() == 3 and any(folder.iterdir())
    tables.clear(spark)
    assert not folder.exists() and tables.materialized(spark.range(2)).count() == 2
