"""Document sources and sinks: Markdown, structured text, uploads, HTML, JSON, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed limits of an upload.
EXTENSIONS, UPLOAD_BYTES = ["md", "markdown", "txt"], 10 << 20


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _path() -> Column:
    """Where a file stands, as it is named: its metadata has the path as part of a URL."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """source, path, text of all *.md under folder; editors' lock files (~$...) are left out."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    named = read.select(_name(_path()).alias("source"), _path().alias("path"), F.col("value").alias("text"))
    return named.filter(~F.col("source").startswith("~$"))


def structured_files(spark: SparkSession, *folders: str) -> DataFrame:
    """source, path, text of the *.txt directly in the folders."""
    read = spark.read.option("pathGlobFilter", "*.txt").text(list(folders), wholetext=True)
    return read.select(_name(_path()).alias("source"), _path().alias("path"), _clean(F.col("value")).alias("text"))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """source, size, text, reason of every file; reason says why one is rejected, and
    its text is null. Rows are never dropped."""
    read = spark.read.format("binaryFile").load(folder)
    extension = F.lower(F.element_at(F.split(_name(F.col("path")), r"\."), -1))
    reason = (
        F.when(~extension.isin(EXTENSIONS), "extension")
        .when(F.col("length") > UPLOAD_BYTES, "too large")
        .when(F.col("length") == 0, "empty")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
    )
    return read.select(_name(F.col("path")).alias("source"), F.col("length").alias("size"), F.when(reason.isNull(), _clean(F.col("content").cast("string"))).alias("text"), reason.alias("reason"))


def export_json(trees: DataFrame, path: str, summary: DataFrame | None = None) -> None:
    """Nested parents and children as JSON lines under path/chunks, and, if given, a summary
    by program under path/summary; embeddings as size, first eight and norm."""
    from docloom.functions.vectors import norm

    if "embedding" in trees.columns:
        e = F.col("embedding")
        trees = trees.withColumn("embedding", F.when(e.isNotNull(), F.struct(F.size(e).alias("dims"), F.slice(e, 1, 8).alias("first"), F.round(norm(e), 6).alias("norm"))))
    trees.write.mode("overwrite").json(f"{path}/chunks")
    if summary is not None:
        summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def config_file(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON file as a dict; empty if it isn't there or holds no mapping."""
    import yaml

    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        return {}
    rows = spark.read.text(path, wholetext=True).collect()  # one file
    read = yaml.safe_load(rows[0][0]) if rows else None
    return read if isinstance(read, dict) else {}


def event_frames(texts: DataFrame) -> DataFrame:
    """id, seq, frame: server-sent events of (id, text), with a final done marker."""
    from docloom.functions.text import sse_pieces

    pieces = texts.select("id", F.posexplode(sse_pieces(F.col("text"))).alias("seq", "chunk"))
    frames = pieces.select("id", "seq", F.concat(F.lit("data: "), F.to_json(F.struct("chunk")), F.lit("\n\n")).alias("frame"))
    last = texts.select("id", F.greatest(F.size(sse_pieces(F.col("text"))), F.lit(0)).alias("seq"), F.lit('data: {"done":true}\n\n').alias("frame"))
    return frames.unionByName(last)
