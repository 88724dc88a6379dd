"""Catalogue statistics over chunks and the ingestion ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def documents(chunks: DataFrame) -> DataFrame:
    """One row per source; every aggregate combines before the shuffle."""
    return chunks.groupBy("source").agg(
        F.max("program_level").alias("program_level"),
        F.count("*").alias("n_chunks"),
        F.sum("char_count").alias("chars"),
        F.bool_and("is_active").alias("is_active"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
    )


def orphan_logs(logs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Log rows whose file has no active chunk."""
    live = chunks.filter("is_active").select(F.col("source").alias("file_name"))
    return logs.join(live, "file_name", "left_anti")


def listing(logs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Active documents, then files known from logs alone with nothing else filled in."""
    rest = orphan_logs(logs, chunks).select(F.col("file_name").alias("source"), F.col("status"))
    return documents(chunks.filter("is_active")).unionByName(rest, allowMissingColumns=True)


def stats(logs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals."""
    c = chunks.agg(F.count_if("is_active").alias("n_chunks"), F.coalesce(F.sum(F.when(F.col("is_active"), F.col("char_count"))), F.lit(0)).cast("long").alias("chars"), F.count_if(F.col("is_active") & F.col("has_embedding")).alias("n_embedded"))
    done = logs.agg(F.count_if(F.col("status") == "completed").alias("n_completed"))
    return done.join(c)  # one row beside one row


def levels(chunks: DataFrame) -> DataFrame:
    """Documents and chunks by level; a missing or empty level is unknown."""
    level = F.coalesce(F.nullif(F.col("program_level"), F.lit("")), F.lit("unknown"))
    return chunks.filter("is_active").groupBy(level.alias("program_level")).agg(F.count_distinct("source").alias("n_documents"), F.count("*").alias("n_chunks"))


def parent_child(chunks: DataFrame) -> DataFrame:
    """Active parents beside their active children."""
    p = chunks.filter("is_active and chunk_level = 'parent'").select(F.col("chunk_id").alias("parent_id"), F.col("content").alias("parent_content"))
    c = chunks.filter("is_active and chunk_level = 'child'").select("parent_id", F.col("chunk_id").alias("child_id"), "chunk_index", F.col("content").alias("child_content"))
    return p.join(c, "parent_id")


def trees(chunks: DataFrame) -> DataFrame:
    """Parents with their children in order, as nested rows."""
    kids = chunks.filter("chunk_level = 'child'").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content"))).alias("children"))
    tops = chunks.filter("chunk_level <> 'child'").join(kids.withColumnRenamed("parent_id", "chunk_id"), "chunk_id", "left")
    return tops.withColumn("children_count", F.greatest(F.coalesce(F.size("children"), F.lit(0)), F.lit(0)))


def program_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("program_level", "program_name").agg(
        F.count_if(F.col("chunk_level") == "parent").alias("parents"),
        F.count_if(F.col("chunk_level") == "child").alias("children"),
        F.array_join(F.array_sort(F.collect_set("section_name")), "|").alias("sections"),
        F.count_if(F.col("chunk_level").isin("parent", "child")).alias("total"),
    )


def chunk_quality(chunks: DataFrame, low: int = 10, high: int = 800) -> DataFrame:
    """Token bounds per level, with the chunks that have them; ties go to the smaller id."""
    return chunks.groupBy("chunk_level").agg(
        F.count("*").alias("n"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
        F.min(F.struct("token_count", "chunk_id"))["chunk_id"].alias("min_chunk"),
        F.min(F.struct(-F.col("token_count"), "chunk_id"))["chunk_id"].alias("max_chunk"),
        F.count_if(F.col("token_count") > high).alias("n_over"),
        F.count_if(F.col("token_count") < low).alias("n_under"),
        F.floor(F.sum("token_count") / F.greatest(F.lit(1), F.count("*"))).alias("mean_tokens"),
    )


def newest(rows: DataFrame, order: str, key: str, most: int) -> DataFrame:
    """The newest rows, as a top-k without a global sort."""
    return rows.orderBy(F.desc(order), key).limit(most)


def latest_status(events: DataFrame) -> DataFrame:
    """Last status of each task (task_id, status, updated_at)."""
    return events.groupBy("task_id").agg(F.max_by("status", F.struct("updated_at", "status")).alias("status"), F.max("updated_at").alias("updated_at"))


def children_ids(children: DataFrame) -> DataFrame:
    return children.groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x["chunk_id"]).alias("children_ids"))


def reindexed(parents: DataFrame) -> DataFrame:
    """Global numbers 1..n within a source, and n."""
    w = Window.partitionBy("source")
    return parents.withColumn("chunk_index", F.row_number().over(w.orderBy("seq"))).withColumn("total_chunks_in_section", F.count("*").over(w))
