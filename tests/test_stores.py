"""Stores as keyed state: streams against batch forms and plain loops, restarts, expiry."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.operators import dialogue
from docloom.streaming import stores

START = datetime(2026, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stores.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stream(spark, folder, schema, build, out, checkpoint):
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))
    query = build(rows).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(out)).collect()


def put(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


SESSIONS = "store string, ts timestamp, request_id long, session_id string, document string"


def test_sessions_of_the_events_equal_the_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.lit("one").alias("store"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("session_id"))
    e = e.withColumn("document", F.when(F.col("request_id") % 3 == 0, F.concat(F.lit("d"), "request_id"))).orderBy("ts", "request_id").collect()
    parts = [e[: len(e) // 3], e[len(e) // 3 : len(e) // 2], e[len(e) // 2 :]]
    build = lambda df: stores.document_sessions(df, ttl_seconds=36_000)
    for part in parts:  # each run goes on from the checkpoint of the one before
        put(spark.createDataFrame(part, SESSIONS), tmp_path / "in")
        got = stream(spark, tmp_path / "in", SESSIONS, build, tmp_path / "out", tmp_path / "cp")
    every = spark.createDataFrame(e, SESSIONS)
    want = dialogue.session_lookup(every.filter("document is not null"), every.filter("document is null"), 36_000)
    assert sorted((r.request_id, r.document or "") for r in got) == sorted((r.request_id, r.document or "") for r in want.collect())
    assert len(got) == sum(r.document is None for r in e) and any(r.document for r in got) and not all(r.document for r in got)


def session_loop(rows, ttl, most):
    held, out = {}, {}
    for store, ts, request, session, document in sorted(rows, key=lambda r: (r[1], r[2])):
        if document is not None:
            if len(held.setdefault(store, {})) > most:
                held[store].clear()
            held[store][session] = (ts, document)
            continue
        found = held.setdefault(store, {}).get(session)
        if found and (ts - found[0]).total_seconds() > ttl:
            del held[store][session]
            found = None
        out[request] = found[1] if found else None
    return out


def test_a_full_store_is_cleared(spark, tmp_path):
    rows, rng = [], random.Random(3)
    for i in range(120):
        store, session = rng.choice("ab"), f"s{rng.randrange(11)}"
        rows.append((store, START + timedelta(seconds=20 * i), i, session, f"d{i}" if i % 3 else None))
    want = session_loop(rows, 300, 7)
    for k in range(3):
        put(spark.createDataFrame(rows[40 * k : 40 * k + 40], SESSIONS), tmp_path / "in")
    got = stream(spark, tmp_path / "in", SESSIONS, lambda df: stores.document_sessions(df, most=7), tmp_path / "out", tmp_path / "cp")
    assert {r.request_id: r.document for r in got} == want and len(got) == len(want)
    assert want != session_loop(rows, 300, 1000) and want != session_loop(rows, 10**6, 7)  # clearing and expiry both show


TASKS = "store string, ts timestamp, event_id long, task_id string, file_name string, status string, message string"


def test_tasks(spark, tmp_path):
    rows = [("x", START + timedelta(seconds=i), i, f"t{i * 7 % 13}", f"f{i * 7 % 13}", ["running", "completed", "failed"][i % 3], f"m{i}") for i in range(60)]
    held, want = {}, []
    for store, ts, i, task, file, status, message in rows:
        if task in held:
            held[task] = (*held[task][:1], status, message, held[task][3])
        else:
            held[task] = (file, "pending", "", ts)
        new = held[task]
        if len(held) > 5:
            del held[min(held, key=lambda t: held[t][3])]
        want.append((store, task, *new, ts, len(held)))
    for k in range(2):
        put(spark.createDataFrame(rows[30 * k : 30 * k + 30], TASKS), tmp_path / "in")
    got = stream(spark, tmp_path / "in", TASKS, lambda df: stores.tasks(df, most=5), tmp_path / "out", tmp_path / "cp")
    assert sorted(map(tuple, got)) == sorted(want)


MESSAGES = "conv_id long, ts timestamp, turn long, role string, text string"


def test_histories_equal_the_batch_and_expire(spark, tmp_path):
    m = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60))
    m = m.select("conv_id", "ts", "turn", "role", "text")
    for k in (0, 1):
        put(m.filter(F.floor(F.col("turn") / 3) == k if k == 0 else F.col("turn") >= 3), tmp_path / "in")
    got = stream(spark, tmp_path / "in", MESSAGES, lambda df: stores.histories(df, 3, late="1 hour"), tmp_path / "out", tmp_path / "cp")
    want = dialogue.recent(m, 3).collect()
    assert sorted((r.conv_id, r.turn, r.history) for r in got) == sorted((r.conv_id, r.turn, r.history) for r in want)

    rows = [[(1, START, 0, "user", "old")], [(2, START + timedelta(days=1), 0, "user", "moves the watermark")], [(2, START + timedelta(days=1, minutes=1), 1, "user", "and lets timers run")], [(1, START + timedelta(days=1, minutes=2), 1, "user", "new")]]
    seen = {}
    for k, part in enumerate(rows):
        put(spark.createDataFrame(part, MESSAGES), tmp_path / "late")
        seen = {(r.conv_id, r.turn): r.history for r in stream(spark, tmp_path / "late", MESSAGES, lambda df: stores.histories(df, 3, keep_seconds=600, late="1 minute"), tmp_path / "late-out", tmp_path / "late-cp")}
        assert len(seen) == k + 1
    assert seen[1, 1] == [] and seen[2, 1] == ["user: moves the watermark"]
