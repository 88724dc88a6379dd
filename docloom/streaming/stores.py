"""Stores of a running service as keyed state: document sessions, tasks, chat histories.

Each store is one key's map or list in the state store (RocksDB), so it is read and changed
entry by entry, survives lost executors and restarts, and goes by an event-time timer once
nothing in it can be asked for any more. Rows of one key are taken in event order within a
batch; docloom.operators.dialogue has the batch forms.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom import config

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the session's state store to the one that these stores need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(by, ignore_index=True)


def _micros(ts: Any) -> int:
    return pd.Timestamp(ts).value // 1000


class _Expiring(StatefulProcessor):
    """Keeps one timer per key, moved on with each batch; late: whether there is a watermark."""

    def __init__(self, late: bool, keep_seconds: int) -> None:
        self.late, self.keep_ms = late, keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open()

    def open(self) -> None: ...

    def forget(self) -> None: ...

    def expire_after(self, newest_us: int, timers: Any) -> None:
        if self.late:
            for at in [*self.handle.listTimers()]:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(max(newest_us // 1000 + self.keep_ms + 1, timers.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter(())

    def close(self) -> None: ...


class DocumentSessions(_Expiring):
    """Rows (store, ts, request_id, session_id, document): a document is put, or, where it
    is null, asked for. A put clears a store of over `most` sessions first, expired ones
    counted, which go only when they are asked for."""

    def __init__(self, late: bool, ttl_seconds: int, most: int) -> None:
        super().__init__(late, ttl_seconds)
        self.ttl_us, self.most = ttl_seconds * 1_000_000, most

    def open(self) -> None:
        self.held = self.handle.getMapState("sessions", "session_id string", "at long, document string")
        self.size = self.handle.getValueState("size", "n long")

    def forget(self) -> None:
        self.held.clear()
        self.size.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = self.size.get()[0] if self.size.exists() else 0
        out, at = [], 0
        for r in _ordered(rows, ["ts", "request_id"]).itertuples():
            at, name = _micros(r.ts), (r.session_id,)
            if r.document is not None:
                if n > self.most:
                    self.held.clear()
                    n = 0
                n += not self.held.containsKey(name)
                self.held.updateValue(name, (at, r.document))
                continue
            found = self.held.getValue(name) if self.held.containsKey(name) else None
            if found is not None and at - found[0] > self.ttl_us:
                self.held.removeKey(name)
                n, found = n - 1, None
            out.append((key[0], r.ts, r.request_id, r.session_id, found[1] if found else None))
        self.size.update((n,))
        self.expire_after(at, timerValues)
        yield pd.DataFrame(out, columns=["store", "ts", "request_id", "session_id", "document"])


def document_sessions(requests: DataFrame, ttl_seconds: int = config.SESSION_TTL_SECONDS, most: int = config.SESSIONS, late: str | None = None) -> DataFrame:
    """store, ts, request_id, session_id, document of what a stream (store, ts, request_id,
    session_id, document) asks for: the document last put, if it isn't older than the TTL,
    else null. With late, a watermark so much behind drops later rows, and a store goes
    once its newest session has expired."""
    seen = requests if late is None else requests.withWatermark("ts", late)
    kind = requests.schema["request_id"].dataType.simpleString()
    made = DocumentSessions(late is not None, ttl_seconds, most)
    return seen.groupBy("store").transformWithStateInPandas(made, f"store string, ts timestamp, request_id {kind}, session_id string, document string", "append", "EventTime" if late else "None")


class Tasks(_Expiring):
    """Rows (store, ts, event_id, task_id, file_name, status, message): a task unknown so
    far is created pending, a known one takes status and message. A new task beyond `most`
    drives out the one created first."""

    def __init__(self, late: bool, keep_seconds: int, most: int) -> None:
        super().__init__(late, keep_seconds)
        self.most = most

    def open(self) -> None:
        self.held = self.handle.getMapState("tasks", "task_id string", "file_name string, status string, message string, created long, event long, updated long")
        self.size = self.handle.getValueState("size", "n long")

    def forget(self) -> None:
        self.held.clear()
        self.size.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = self.size.get()[0] if self.size.exists() else 0
        out, at = [], 0
        for r in _ordered(rows, ["ts", "event_id"]).itertuples():
            at, name = _micros(r.ts), (r.task_id,)
            if self.held.containsKey(name):
                old = self.held.getValue(name)
                new = (old[0], r.status, r.message, old[3], old[4], at)
            else:
                new, n = (r.file_name, "pending", "", at, int(r.event_id), at), n + 1
            self.held.updateValue(name, new)
            if n > self.most:
                oldest = min(((v[3], v[4]), k) for k, v in self.held.iterator())[1]  # at most one more than most
                self.held.removeKey(oldest)
                n -= 1
            out.append((key[0], r.task_id, *new[:3], pd.Timestamp(new[3], unit="us"), pd.Timestamp(at, unit="us"), n))
        self.size.update((n,))
        self.expire_after(at, timerValues)
        yield pd.DataFrame(out, columns=["store", "task_id", "file_name", "status", "message", "created_at", "updated_at", "n_tasks"])


def tasks(events: DataFrame, most: int = config.TASKS, keep_seconds: int = 7 * 86400, late: str | None = None) -> DataFrame:
    """store, task_id, file_name, status, message, created_at, updated_at, n_tasks after
    each row of a stream (store, ts, event_id, task_id, file_name, status, message). With
    late, a store goes keep_seconds after its last change."""
    seen = events if late is None else events.withWatermark("ts", late)
    made = Tasks(late is not None, keep_seconds, most)
    return seen.groupBy("store").transformWithStateInPandas(made, "store string, task_id string, file_name string, status string, message string, created_at timestamp, updated_at timestamp, n_tasks long", "append", "EventTime" if late else "None")


class Histories(_Expiring):
    """Rows (conv_id, ts, turn, role, text): each gives the last `most` messages before it."""

    def __init__(self, late: bool, keep_seconds: int, most: int) -> None:
        super().__init__(late, keep_seconds)
        self.most = most

    def open(self) -> None:
        self.held = self.handle.getListState("messages", "role string, text string")

    def forget(self) -> None:
        self.held.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        out, at = [], 0
        for r in _ordered(rows, ["ts", "turn"]).itertuples():
            at = _micros(r.ts)
            out.append((key[0], r.turn, r.role, r.text, [f"{role}: {text}" for role, text in kept]))
            kept = [*kept, (r.role, r.text)][-self.most :]
        self.held.put(kept)
        self.expire_after(at, timerValues)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "history"])


def histories(messages: DataFrame, most: int = config.API_HISTORY, keep_seconds: int = 86400, late: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, history of a stream (conv_id, ts, turn, role, text):
    history are the last `most` messages before, each as role: text. With late, a
    conversation goes keep_seconds after its last message."""
    seen = messages if late is None else messages.withWatermark("ts", late)
    kind, turn = (messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    made = Histories(late is not None, keep_seconds, most)
    return seen.groupBy("conv_id").transformWithStateInPandas(made, f"conv_id {kind}, turn {turn}, role string, text string, history array<string>", "append", "EventTime" if late else "None")
