"""Drivers of ingestion: files to chunks to a changed table and its ledger.

A file whose content completed before is skipped; a known name or hash is ingested again;
all else is new. Chunks are written before the ledger says that a file is completed, so
whatever breaks off is done again by the next run, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunking, ingest, structured
from docloom.sources import files, managed
from docloom.sources.tables import materialized

#: Which sources a rebuild of structured files replaces.
STRUCTURED_LIKE = ("ThS %.txt", "NCS %.txt")

Embed = Callable[[DataFrame], DataFrame]


@dataclass
class Report:
    """What a run did: files by decision, and what happened to the table's rows."""

    files: dict[str, int] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)


def _completed(decided: DataFrame, chunks: DataFrame, at: str) -> DataFrame:
    n = chunks.groupBy(F.col("source").alias("file_name")).agg(F.count("*").alias("chunks_count"))
    done = decided.join(n, "file_name", "left").select("file_hash", "file_name", F.lit("completed").alias("status"), F.coalesce("chunks_count", F.lit(0)).alias("chunks_count"), F.lit(at).cast("timestamp").alias("updated_at"))
    return done.groupBy("file_hash").agg(F.min(F.struct("file_name", "status", "chunks_count", "updated_at")).alias("e")).select("file_hash", "e.*")


def run(source: DataFrame, cut: Callable[[DataFrame], DataFrame], chunks: managed.Table, ledger: managed.Table, at: str, embed: Embed | None = None, rebuild: tuple[str, ...] | None = None) -> Report:
    """Ingests source (source, path, text). cut makes the chunks of such rows; embed adds an
    embedding to those the table lacks. rebuild, LIKE patterns of sources or () for the
    whole table, drops what is there first and skips no file. at: the time of the run."""
    spark = source.sparkSession
    found = source.withColumn("file_hash", F.sha2("text", 256)).withColumn("file_name", F.col("source"))
    found = materialized(found)
    decided = ingest.decide(found, ledger.read(spark)) if rebuild is None else found.withColumn("action", F.lit("insert"))
    decided = materialized(decided.select("source", "path", "file_hash", "file_name", "action"))
    report = Report({r["action"]: r["count"] for r in decided.groupBy("action").count().collect()})
    todo = decided.filter("action <> 'skip'")
    made = materialized(cut(found.join(todo.select("path"), "path", "left_semi").drop("file_hash", "file_name")))
    if embed is not None:
        fresh = made if rebuild is not None else ingest.new_chunks(made, chunks.of(made))
        vectors = materialized(embed(fresh.select(*ingest.CHUNK_KEY, "content").dropDuplicates(ingest.CHUNK_KEY)).drop("content"))
        made = made.drop("embedding").join(vectors, ingest.CHUNK_KEY, "left")
    report.rows = managed.ingest_again(chunks, made) if rebuild is None else managed.rebuild(chunks, made, *rebuild)
    managed.record(ledger, _completed(todo, made, at))
    return report


def markdown_chunks(docs: DataFrame, embed: Embed | None = None) -> DataFrame:
    """Parents and children of Markdown files (source, path, text) as rows of a chunk table."""
    rows = chunking.hierarchy(docs.select(F.col("source").alias("doc_id"), "text"), embed)
    named = rows.select("chunk_id", "parent_id", "chunk_level", F.col("doc_id").alias("source"), F.lit(1).alias("version"), "chunk_index", "section_path", "section_name", "content", F.sha2("content", 256).alias("content_hash"), F.lit(True).alias("is_active"))
    return named


def structured_chunks(docs: DataFrame, year: str = "2026") -> DataFrame:
    return structured.chunks(docs, year)


#: Columns of the chunk table that both kinds of files fill.
CHUNKS = "chunk_id string, parent_id string, chunk_level string, source string, version int, chunk_index int, section_path string, section_name string, program_name string, program_level string, program_code string, academic_year string, content string, content_hash string, is_active boolean, embedding array<float>"


def ingest_all(spark: SparkSession, markdown: str, structured_folders: list[str], store: str, at: str, embed: Embed | None = None, rebuild: bool = False) -> dict[str, Report]:
    """Markdown files, then structured ones, into the tables chunks and ledger under store.
    A failure of the first leaves the second undone. rebuild drops the whole table before
    the Markdown files and the structured sources before the others."""
    chunks, ledger = managed.chunk_table(f"{store}/chunks", CHUNKS), managed.ledger_table(f"{store}/ledger")
    first = run(files.markdown_files(spark, markdown), markdown_chunks, chunks, ledger, at, embed, () if rebuild else None)
    second = run(files.structured_files(spark, *structured_folders), structured_chunks, chunks, ledger, at, embed, STRUCTURED_LIKE if rebuild else None)
    return {"markdown": first, "structured": second}


def ingest_file(spark: SparkSession, path: str, store: str, at: str, embed: Embed | None = None) -> Report:
    """One file, by its ending a Markdown or a structured one."""
    chunks, ledger = managed.chunk_table(f"{store}/chunks", CHUNKS), managed.ledger_table(f"{store}/ledger")
    kind, cut = (files.structured_files, structured_chunks) if path.endswith(".txt") else (files.markdown_files, markdown_chunks)
    return run(kind(spark, path), cut, chunks, ledger, at, embed)
