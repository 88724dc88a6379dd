"""Drivers that rewrite a folder of Markdown files, what was there kept as .bak."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import rewriting
from docloom.sources import files
from docloom.sources.file_sink import write_files
from docloom.sources.tables import materialized


def _named(rows: DataFrame, folder: str) -> DataFrame:
    """name: the path below folder."""
    root = F.lit(folder.rstrip("/") + "/")
    return rows.withColumn("name", F.substring("path", F.instr("path", root) + F.length(root), F.length("path")))


def normalize_headers(spark: SparkSession, folder: str, write: bool = False) -> dict[str, int]:
    """Gives old headers under folder a frontmatter; returns files by status. Without write
    nothing is changed."""
    made = materialized(rewriting.converted(files.markdown_files(spark, folder)).drop("meta"))
    if write:
        write_files(_named(made.filter("status = 'converted'"), folder).select("name", F.col("new_text").alias("text")), folder)
    return {r["status"]: r["count"] for r in made.groupBy("status").count().collect()}


def compress_forms(spark: SparkSession, folder: str) -> dict[str, int]:
    """Shortens the placeholders of forms under folder; returns how many files there are
    and changed, and characters and dots before and after."""
    made = materialized(rewriting.compressed(files.markdown_files(spark, folder)))
    write_files(_named(made.filter("saved > 0"), folder).select("name", F.col("new_text").alias("text")), folder)
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return made.agg(F.count("*").alias("files"), F.count_if(F.col("saved") > 0).alias("changed"), n(F.when(F.col("saved") > 0, F.col("saved"))).alias("saved"), n("dots_before").alias("dots_before"), n("dots_after").alias("dots_after")).first().asDict()
