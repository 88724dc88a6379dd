"""Metrics of a run as rows, observed while it runs.

Batch: an observation counts what passes a point of a plan, without another pass over it.
Stream: a listener turns what each micro-batch observed and did into rows. Both end in one
table of (run_id, stage, metric, value, seconds, at), which a request log, a progress view
and the statistics of clients are read from.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "run_id string, stage string, metric string, value double, seconds double, at timestamp"


class Run:
    """The stages of one run. log: where save() appends the rows (a folder of JSON)."""

    def __init__(self, run_id: str, now: Callable[[], float] = time.time) -> None:
        self.run_id, self.now = run_id, now
        self._open: list[tuple[str, Observation]] = []
        self._rows: list[tuple] = []

    def watch(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """df, whose rows (and metrics: aggregates) are counted when it is next run."""
        seen = Observation(f"{self.run_id}/{stage}")
        self._open.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])

    def step(self, stage: str, run: Callable[[], DataFrame]) -> DataFrame:
        """What run returns, and how many seconds it took, with what was watched in it."""
        began = self.now()
        out = run()
        self._close(self.now() - began)
        self._add(stage, "seconds", self.now() - began, self.now() - began)
        return out

    def _close(self, seconds: float) -> None:
        for stage, seen in self._open:
            for metric, value in seen.get.items():
                self._add(stage, metric, value, seconds)
        self._open = []

    def _add(self, stage: str, metric: str, value: object, seconds: float | None) -> None:
        self._rows.append((self.run_id, stage, metric, None if value is None else float(value), seconds, datetime.fromtimestamp(self.now(), timezone.utc)))

    def rows(self, spark: SparkSession) -> DataFrame:
        """The metrics so far; what is watched must have run."""
        self._close(None)
        return spark.createDataFrame(self._rows, SCHEMA)

    def save(self, spark: SparkSession, log: str) -> None:
        self.rows(spark).coalesce(1).write.mode("append").json(log)


class Listener(StreamingQueryListener):
    """Rows of every micro-batch of queries whose name is wanted (all, if none is given):
    rows read, each observed metric, and the batch's seconds."""

    def __init__(self, *names: str) -> None:
        self.names, self.found, self.ended = {*names}, [], {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.names and p.name not in self.names:
            return
        run, at, seconds = f"{p.name}/{p.batchId}", datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")), p.batchDuration / 1000
        self.found.append((run, "source", "rows", float(p.numInputRows), seconds, at))
        for stage, row in p.observedMetrics.items():
            self.found += [(run, stage, metric, None if value is None else float(value), seconds, at) for metric, value in row.asDict().items()]

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.found, SCHEMA)


def summary(rows: DataFrame) -> DataFrame:
    """stage, metric, runs, total, least and most of metric rows: statistics of a client, a
    node or a stage over all its runs."""
    return rows.groupBy("stage", "metric").agg(F.count("*").alias("runs"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
