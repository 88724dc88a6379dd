"""Structured Streaming forms of the stateful operators.

State is keyed by client or action and lives in the state store, so it survives lost
executors and restarts; batches of one key are put in event order before they are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import config


def _timeout(late: str | None) -> str:
    return "NoTimeout" if late is None else "EventTimeTimeout"


def _expire(state: Any, at_ms: int) -> None:
    state.setTimeoutTimestamp(max(at_ms, state.getCurrentWatermarkMs() + 1))


def rate_limited(requests: DataFrame, most: int = config.RATE_LIMIT, seconds: int = config.RATE_WINDOW_SECONDS, late: str | None = None) -> DataFrame:
    """client, ts, request_id, allowed of a stream (client, ts, request_id): at most
    `most` allowed requests per client in any window; refused ones don't count. With
    late, a watermark that much behind drops later requests, and a client's state goes
    once its last request is a window behind; without, nothing is dropped or forgotten."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"], ignore_index=True)
        at = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        allowed = []
        for t in at:
            kept = [x for x in kept if x > t - seconds * 1_000_000]
            allowed.append(len(kept) < most)
            if allowed[-1]:
                kept.append(int(t))
        state.update((kept,))
        if late is not None:
            _expire(state, int(at[-1]) // 1000 + seconds * 1000)
        yield rows.assign(client=key[0], allowed=allowed)[["client", "ts", "request_id", "allowed"]]

    kind = requests.schema["client"].dataType.simpleString()
    rid = requests.schema["request_id"].dataType.simpleString()
    seen = requests if late is None else requests.withWatermark("ts", late)
    return seen.groupBy("client").applyInPandasWithState(step, f"client {kind}, ts timestamp, request_id {rid}, allowed boolean", "times array<long>", "append", _timeout(late))


def cached(requests: DataFrame, least: float = config.CACHE_SIMILARITY, most: int = config.CACHE_SIZE, ttl_seconds: int = config.CACHE_TTL_SECONDS, late: str | None = None) -> DataFrame:
    """request_id, action, hit, entry_id, similarity of a stream (request_id, action, ts,
    embedding). A miss is saved under its own id; entries expire, and each action keeps
    its newest `most`. With late, a watermark that much behind drops later requests, and
    an action's state goes once all its entries have expired."""
    import numpy as np

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, times, vectors = ([*x] for x in state.get) if state.exists else ([], [], [])
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"], ignore_index=True)
        width = len(rows["embedding"].iat[0])
        held = np.asarray([list(x) for x in vectors], np.float64).reshape(-1, width)
        times, out, t = np.asarray(times, np.int64), [], 0
        for r in rows.itertuples():
            t = int(pd.Timestamp(r.ts).value // 1000)
            live = t - times < ttl_seconds * 1_000_000
            if not live.all():
                ids, times, held = [x for x, y in zip(ids, live, strict=True) if y], times[live], held[live]
            v = np.asarray(r.embedding, np.float64)
            best, at = 0.0, None
            if ids:
                n = np.linalg.norm(held, axis=1) * np.linalg.norm(v)
                s = np.divide(held @ v, n, out=np.zeros(len(held)), where=n > 0)
                if s.max() > 0:
                    best, at = float(s.max()), int(s.argmax())
            hit = at is not None and best >= least
            out.append((r.request_id, key[0], hit, ids[at] if hit else None, best))
            if not hit:
                ids, times, held = [*ids, r.request_id][-most:], np.append(times, t)[-most:], np.vstack((held, v))[-most:]
        state.update((ids, times.tolist(), held.tolist()))
        if late is not None:
            _expire(state, t // 1000 + ttl_seconds * 1000)
        yield pd.DataFrame(out, columns=["request_id", "action", "hit", "entry_id", "similarity"])

    rid = requests.schema["request_id"].dataType.simpleString()
    kind = requests.schema["action"].dataType.simpleString()
    seen = requests if late is None else requests.withWatermark("ts", late)
    return seen.groupBy("action").applyInPandasWithState(step, f"request_id {rid}, action {kind}, hit boolean, entry_id {rid}, similarity double", f"ids array<{rid}>, times array<long>, vectors array<array<double>>", "append", _timeout(late))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their value by type and tumbling window, late ones up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def ingest_stream(files: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Runs process over the files that are there and appends its new chunks to target;
    a batch that runs again inserts nothing. Returns the finished query."""
    from docloom.operators.ingest import insert

    def each(batch: DataFrame, _: int) -> None:
        insert(process(batch), target)

    query = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
