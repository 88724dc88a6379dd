"""Reading tables, and writing intermediate ones where executors share a folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where nothing is set a temporary one is
    made, on a local master only: executors elsewhere wouldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named and not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def _own(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{_shared(spark)}/docloom/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A path of its own in the shared folder, for what one query writes."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written with scratch and materialized. Call it
    when results were read or written: those that still lead there can't be any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Spark's setting by which an execution removes its own shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialized(df: DataFrame, compact: bool = False) -> DataFrame:
    """df as written to the shared folder and read back: it is computed once and survives
    lost executors. compact: the shuffle files that made it go as soon as it is there, and
    its own are compressed as zstd."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    if compact:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd" if compact else None)
    finally:
        if compact:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
