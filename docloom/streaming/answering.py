"""Answering a stream of requests: look up, ask for what is missing, save, evict.

One micro-batch is one step. The cache is a snapshot per batch, of bounded size: a step
reads the newest one of an earlier batch and writes its own, so a batch that runs again
finds what it found before and leaves the same behind, wherever it broke off.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import config
from docloom.operators import dialogue
from docloom.sources.tables import materialized


@dataclass(frozen=True)
class Cache:
    """Snapshots under path/cache and answers under path/answers, by batch. ids: the type
    of request ids."""

    path: str
    ids: str = "long"
    most: int = config.CACHE_SIZE
    ttl_seconds: int = config.CACHE_TTL_SECONDS
    least: float = config.CACHE_SIMILARITY

    @property
    def entries(self) -> str:
        return f"entry_id {self.ids}, action string, saved_at timestamp, embedding array<double>, answer string"

    def _batches(self, spark: SparkSession, name: str) -> dict[int, str]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [str(s.getPath()) for s in files.listStatus(folder)] if files.exists(folder) else []
        whole = [f for f in found if "batch=" in f and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))]
        return {int(f.rpartition("batch=")[2]): f for f in whole}

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """The entries that batch finds."""
        last = max((b for b in self._batches(spark, "cache") if b < batch), default=None)
        return spark.createDataFrame([], self.entries) if last is None else spark.read.schema(self.entries).parquet(f"{self.path}/cache/batch={last}")

    def answers(self, spark: SparkSession) -> DataFrame:
        """request_id, action, answer, hit, entry_id, similarity, batch of all that was answered."""
        columns = f"request_id {self.ids}, action string, answer string, hit boolean, entry_id {self.ids}, similarity double, batch int"
        return spark.read.schema(columns).parquet(f"{self.path}/answers") if self._batches(spark, "answers") else spark.createDataFrame([], columns)

    def step(self, requests: DataFrame, batch: int, ask: Callable[[DataFrame], DataFrame]) -> None:
        """Answers requests (request_id, action, asked_at, embedding, text). What the cache
        holds a like request for is answered from it, the rest goes to ask, which adds
        answer; answers that aren't null are saved, the newest `most` of all stay.
        Requests of one batch don't find each other's answers."""
        spark, held = requests.sparkSession, materialized(self.before(requests.sparkSession, batch))
        asked = materialized(requests.select("request_id", F.col("action").cast("string").alias("action"), "asked_at", F.col("embedding").cast("array<double>").alias("embedding"), "text"))
        found = dialogue.cache_lookup(asked, held, self.ttl_seconds, self.least).filter("hit")
        hits = asked.join(found, "request_id").join(held.select("entry_id", "answer"), "entry_id")
        missed = materialized(ask(asked.join(found.select("request_id"), "request_id", "left_anti")))
        fresh = missed.filter("answer is not null").select(F.col("request_id").alias("entry_id"), "action", F.col("asked_at").alias("saved_at"), "embedding", "answer")
        kept = dialogue.cache_state(held.unionByName(fresh).withColumn("n_results", F.lit(1)), self.most).drop("n_results")
        kept.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cache/batch={batch}")  # at most `most` rows
        none = F.lit(None)
        out = hits.select("request_id", "action", "answer", "hit", "entry_id", "similarity").unionByName(missed.select("request_id", "action", "answer", F.lit(False).alias("hit"), none.cast(self.ids).alias("entry_id"), none.cast("double").alias("similarity")))
        out.write.mode("overwrite").parquet(f"{self.path}/answers/batch={batch}")
        self._drop_before(spark, batch - 1)

    def _drop_before(self, spark: SparkSession, batch: int) -> None:
        """The newest snapshot before `batch` may still be read, those before it not."""
        jvm = spark.sparkContext._jvm
        for b in sorted(b for b in self._batches(spark, "cache") if b < batch)[:-1]:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/cache/batch={b}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def run(self, requests: DataFrame, ask: Callable[[DataFrame], DataFrame], checkpoint: str):
        """Answers what a stream of requests has, batch by batch; returns the finished query."""
        each = lambda rows, batch: self.step(rows, batch, ask)
        query = requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
