"""Deciding, deduplicating, writing and retiring ingested chunks.

Tables are immutable snapshots: each operation returns the next state of a table, to be
written as a whole or by partition. Chunk ids come from content, so a run that is
repeated inserts nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_KEY = ["content_hash", "source", "version"]


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(*parts: str) -> Column:
    return F.sha2(F.concat_ws("␟", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def decide(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """files (file_name, file_hash) with action: a known hash that completed is skipped, a
    known hash or name is an update, all else an insert."""
    by_hash = ledger.groupBy("file_hash").agg(F.bool_or(F.col("status") == "completed").alias("done"))
    by_name = ledger.select("file_name").distinct().withColumn("named", F.lit(True))
    action = F.when(F.col("done"), "skip").when(F.col("done").isNotNull() | F.col("named"), "update").otherwise("insert")
    return files.join(by_hash, "file_hash", "left").join(by_name, "file_name", "left").withColumn("action", action).drop("done", "named")


def new_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks that the table lacks, each once: the anti-join runs before any embedding."""
    return chunks.dropDuplicates(CHUNK_KEY).join(stored.select(*CHUNK_KEY), CHUNK_KEY, "left_anti")


def insert(chunks: DataFrame, path: str) -> int:
    """Appends what is new to the Parquet table at path; returns how many rows that was."""
    spark = chunks.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    known = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    fresh = new_chunks(chunks, spark.read.parquet(path)) if known else chunks.dropDuplicates(CHUNK_KEY)
    from docloom.sources.tables import materialized

    fresh = materialized(fresh)
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def deactivate(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """chunks with is_active false for the given sources."""
    gone = sources.select("source").distinct().withColumn("_gone", F.lit(True))
    return chunks.join(gone, "source", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")


def update(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Next state of a table when sources are ingested again: rows of these sources go
    inactive unless the new chunks hold them, whose unchanged rows come back."""
    key = chunks.select(*CHUNK_KEY).distinct().withColumn("_again", F.lit(True))
    touched = chunks.select("source").distinct().withColumn("_touched", F.lit(True))
    kept = stored.join(touched, "source", "left").join(key, CHUNK_KEY, "left")
    kept = kept.withColumn("is_active", F.when(F.col("_touched"), F.coalesce("_again", F.lit(False))).otherwise(F.col("is_active"))).select(*stored.columns)
    return kept.unionByName(new_chunks(chunks, stored), allowMissingColumns=True)


def upsert_ledger(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """The ledger after entries (file_hash, file_name, status, chunks_count, updated_at):
    a known hash keeps its name and first time and takes the rest."""
    new = entries.select(F.col("file_hash"), *[F.col(c).alias(f"n_{c}") for c in ("file_name", "status", "chunks_count", "updated_at")])
    j = ledger.join(new, "file_hash", "full_outer")
    return j.select("file_hash", F.coalesce("file_name", "n_file_name").alias("file_name"), F.coalesce("n_status", "status").alias("status"), F.coalesce("n_chunks_count", "chunks_count").alias("chunks_count"), F.coalesce("created_at", "n_updated_at").alias("created_at"), F.coalesce("n_updated_at", "updated_at").alias("updated_at"))


def without_sources(chunks: DataFrame, *like: str) -> DataFrame:
    """Scoped rebuild: rows whose source matches none of the LIKE patterns."""
    keep = F.lit(True)
    for p in like:
        keep = keep & ~F.col("source").like(p)
    return chunks.filter(keep)


def preview(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.concat(F.left("chunk_id", F.lit(12)), F.lit("...")).alias("chunk_id"), F.when(F.length("content") > 300, F.concat(F.left("content", F.lit(300)), F.lit("..."))).otherwise(F.col("content")).alias("content"))
