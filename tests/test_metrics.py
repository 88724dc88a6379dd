"""Observed metrics against counts of the results, for batch and stream."""

import time

from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.plans import metrics, providers


def test_batch_metrics_equal_the_results(spark, tmp_path):
    run = metrics.Run("r1")
    df = spark.range(100).withColumn("content", F.concat(F.lit("w "), "id"))
    small = run.watch(df.filter("id % 3 = 0"), "kept", most=F.max("id"))
    embedded = run.watch(providers.with_embeddings(small), "embedded", dims=F.max(F.size("embedding")))
    out = run.step("embed", lambda: spark.createDataFrame(embedded.collect(), embedded.schema))
    got = {(r.stage, r.metric): r.value for r in run.rows(spark).collect()}
    assert got.pop(("embed", "seconds")) > 0
    assert got == {("kept", "rows"): out.count(), ("kept", "most"): 99, ("embedded", "rows"): 34, ("embedded", "dims"): 64}
    run.save(spark, str(tmp_path / "log"))
    metrics.Run("r2").save(spark, str(tmp_path / "log"))
    saved = spark.read.schema(metrics.SCHEMA).json(str(tmp_path / "log"))
    assert saved.count() == 5
    assert {(r.stage, r.metric): (r.runs, r.total) for r in metrics.summary(saved).collect()}["kept", "rows"] == (1, 34.0)


def test_retrieval_metrics(spark):
    chunks = spark.createDataFrame([(i, f"học phí số {i}", [1.0, float(i)], True, "parent", None, None) for i in range(20)], "chunk_id long, content string, embedding array<double>, is_active boolean, chunk_level string, parent_id long, program_level string")
    asked = spark.createDataFrame([(7, 0, "học phí", [1.0, 3.0]), (8, 0, "không", None)], "query_id long, variant int, text string, embedding array<double>")
    run = metrics.Run("q")
    found = run.step("hybrid", lambda: retrieval.hybrid(chunks, asked))
    rows = {r.query_id: r for r in run.watch(found, "answers", n_vector=F.sum("n_vector"), n_text=F.sum("n_text"), unique=F.sum("n_chunks")).collect()}
    got = {(r.stage, r.metric): r.value for r in run.rows(spark).collect()}
    assert (got["answers", "n_vector"], got["answers", "n_text"]) == (7, 5) and got["answers", "unique"] == rows[7].n_chunks and rows[8].context == ""


def test_stream_metrics_equal_the_results(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = metrics.Listener("watched")
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        seen = rows.filter("id % 2 = 0").observe("even", F.count("*").alias("rows"), F.sum("id").alias("total"))
        query = seen.writeStream.queryName("watched").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if listener.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    total = {(r.stage, r.metric): (r.runs, r.total) for r in metrics.summary(listener.rows(spark)).collect()}
    out = spark.read.parquet(str(tmp_path / "out"))
    assert total["source", "rows"][1] == 30 and total["even", "rows"][1] == out.count() == 15 and total["even", "total"][1] == out.agg(F.sum("id")).first()[0]
    assert len({r.run_id for r in listener.rows(spark).filter("stage = 'even'").collect()}) == 3
