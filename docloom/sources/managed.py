"""Tables that ingestion changes in place: chunks by source, the ledger by file hash.

A table is a Parquet folder in buckets of its key. A change reads the buckets that hold a
touched key, writes their next state beside the table and then over just these buckets
(dynamic partition overwrite), so the rest of the table is neither read nor written, and
says how many rows it affected. All changes can be repeated: chunk ids and hashes come from
content, so a run that broke off after the chunks and before the ledger does the same
again. One writer at a time is assumed, as a ledger has one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.operators import ingest
from docloom.sources.tables import materialized


@dataclass(frozen=True)
class Table:
    """A folder of Parquet files in `buckets` buckets of the column key. columns are the
    table's, as in DDL; a table that nothing was written to yet is empty."""

    path: str
    columns: str
    key: str
    buckets: int = 64

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(self.key).cast("string"), F.lit(""))), F.lit(self.buckets)).cast("int").alias("bucket")

    def _folder(self, spark: SparkSession, name: str = ""):
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _stored(self, spark: SparkSession) -> DataFrame:
        folder, files = self._folder(spark)
        columns = StructType(self.schema.fields).add("bucket", "integer")
        return spark.read.schema(columns).parquet(self.path) if files.exists(folder) else spark.createDataFrame([], columns)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop("bucket")

    def of(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is in keys (a column of the key's name): of their buckets alone."""
        spark = keys.sparkSession
        near = self._stored(spark).join(F.broadcast(keys.select(self._bucket()).distinct()), "bucket", "left_semi")  # no more than there are buckets
        return near.drop("bucket").join(keys.select(self.key).distinct(), self.key, "left_semi")

    def append(self, rows: DataFrame) -> int:
        """Adds rows; returns how many."""
        fresh = materialized(self._fitted(rows))
        n = fresh.count()
        if n:
            fresh.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
        return n

    def _fitted(self, rows: DataFrame) -> DataFrame:
        known = {c.lower(): c for c in rows.columns}
        return rows.select(*[(F.col(known[f.name.lower()]) if f.name.lower() in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn("bucket", self._bucket())

    def rewrite(self, spark: SparkSession, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the rows of touched buckets (a column bucket) by change of them. change
        gets the buckets' rows and keeps their keys, or drops rows."""
        touched = materialized(touched.select("bucket").distinct())
        old = self._stored(spark).join(F.broadcast(touched), "bucket", "left_semi").drop("bucket")
        new = materialized(self._fitted(change(old)))
        left = {r[0] for r in new.select("bucket").distinct().collect()}  # no more than there are buckets
        new.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for bucket in {r[0] for r in touched.collect()} - left:
            folder, files = self._folder(spark, f"bucket={bucket}")
            files.delete(folder, True)

    def replace(self, rows: DataFrame) -> int:
        """The whole table is rows from now on; returns how many."""
        fresh = materialized(self._fitted(rows))
        fresh.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(self.path)
        return fresh.count()

    def delete(self, spark: SparkSession, gone: Column) -> int:
        """Drops the rows for which gone holds; returns how many. A null doesn't hold."""
        gone = F.coalesce(gone, F.lit(False))
        hit = materialized(self._stored(spark).filter(gone).groupBy("bucket").count())
        n = hit.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        if n:
            self.rewrite(spark, hit, lambda old: old.filter(~gone))
        return n


# -- chunks ----------------------------------------------------------------------------


def chunk_table(path: str, columns: str, buckets: int = 64) -> Table:
    """A table of chunks, which have content_hash, source, version and is_active."""
    return Table(path, columns, "source", buckets)


def insert(table: Table, chunks: DataFrame) -> int:
    """Adds the chunks that the table lacks by content, source and version, each once;
    returns how many. Only buckets of the chunks' sources are looked at."""
    return table.append(ingest.new_chunks(chunks, table.of(chunks)))


def deactivate(table: Table, sources: DataFrame) -> int:
    """Soft delete of sources (source); returns how many rows were active until then."""
    spark = sources.sparkSession
    n = table.of(sources).filter("is_active").count()
    if n:
        table.rewrite(spark, sources.select(table._bucket()), lambda old: ingest.deactivate(old, sources))
    return n


def ingest_again(table: Table, chunks: DataFrame) -> dict[str, int]:
    """Sources are ingested again: what they held and no longer hold goes inactive, what
    they hold again comes back, new chunks are added. Returns how many of each."""
    spark, chunks = chunks.sparkSession, materialized(chunks)
    sources, old = chunks.select("source").distinct(), table.of(chunks.select("source"))
    again = old.join(chunks.select(*ingest.CHUNK_KEY).distinct().withColumn("_again", F.lit(True)), ingest.CHUNK_KEY, "left")
    counts = again.agg(F.count_if(F.col("is_active") & F.col("_again").isNull()).alias("retired"), F.count_if(~F.col("is_active") & F.col("_again").isNotNull()).alias("restored")).first().asDict()
    counts["inserted"] = ingest.new_chunks(chunks, old).count()
    if any(counts.values()):
        table.rewrite(spark, sources.select(table._bucket()), lambda rows: ingest.update(chunks, rows))
    return counts


def rebuild(table: Table, chunks: DataFrame, *like: str) -> dict[str, int]:
    """Scoped rebuild: rows whose source matches a LIKE pattern go, chunks are inserted.
    Without patterns the whole table goes. Returns how many of each."""
    spark, chunks = chunks.sparkSession, materialized(chunks)
    if not like:
        n = table.read(spark).count()
        return {"deleted": n, "inserted": table.replace(chunks.dropDuplicates(ingest.CHUNK_KEY))}
    n = table.delete(spark, reduce(lambda a, p: a | F.col("source").like(p), like, F.lit(False)))
    return {"deleted": n, "inserted": insert(table, chunks)}


# -- ledger ----------------------------------------------------------------------------

LEDGER = "file_hash string, file_name string, status string, chunks_count long, created_at timestamp, updated_at timestamp"


def ledger_table(path: str, buckets: int = 16) -> Table:
    return Table(path, LEDGER, "file_hash", buckets)


def record(ledger: Table, entries: DataFrame) -> int:
    """Upserts entries (file_hash, each once; file_name, status, chunks_count, updated_at):
    a known hash keeps its name and its first time. Returns how many entries there were."""
    entries = materialized(entries)
    n = entries.count()
    if n:
        ledger.rewrite(entries.sparkSession, entries.select(ledger._bucket()), lambda old: ingest.upsert_ledger(old, entries))
    return n


def forget(ledger: Table, names: DataFrame) -> int:
    """Drops the ledger's rows of files (file_name); returns how many."""
    spark = names.sparkSession
    gone = names.select("file_name").distinct()
    hit = ledger._stored(spark).join(gone, "file_name", "left_semi").groupBy("bucket").count()
    hit = materialized(hit)
    n = hit.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    if n:
        ledger.rewrite(spark, hit, lambda old: old.join(gone, "file_name", "left_anti"))
    return n
