"""A stored positional index of texts, and searches that start from rare terms.

Postings (term, chunk, places) are written once, in buckets of terms, with each term's
document frequency. A search for all of a query's terms follows the postings of the rarest
and keeps what holds the next ones; only what is left is looked up for every term, with the
same rows as a search that looks at everything. A ranked search deals the postings of the
queries' terms out by chunk and scores inside tasks: of the pairs of a query and a chunk,
the best of each task alone are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from docloom import config
from docloom.operators.retrieval import ranked
from docloom.sources.tables import materialized

#: Buckets of the stored postings. Most terms of questions that are broadcast; more are
#: joined by a shuffle.
BUCKETS, BROADCAST_TERMS = 64, 1 << 19
#: Bytes of text that a task counts the words of.
DEALT_BYTES = 16 << 20
#: Postings, once for each query that asks for their term, that a task scores.
DEALT_PAIRS = 1 << 22


@dataclass(frozen=True)
class Index:
    """Where the index lies, and what its scores are bounded for."""

    path: str
    n_docs: int
    mean_length: float
    k1: float
    b: float
    buckets: int
    chunk_type: str

    def postings(self, spark: SparkSession) -> DataFrame:
        """term, chunk_id, length (words of the chunk), tf, pos (places, ascending), bucket."""
        return spark.read.schema(f"term string, chunk_id {self.chunk_type}, length int, tf long, pos array<int>, bucket int").parquet(f"{self.path}/postings")

    def terms(self, spark: SparkSession) -> DataFrame:
        """term, df, bucket."""
        return spark.read.schema("term string, df long, bucket int").parquet(f"{self.path}/terms")

    def part(self) -> Column:
        """What a posting adds to a score, but for its term's weight."""
        return F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("length") / self.mean_length))

    def idf(self) -> Column:
        return F.log1p((self.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, without stemming."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term (each once), n_terms of queries (query_id, text)."""
    t = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("t"))
    return t.select("query_id", F.size("t").alias("n_terms"), F.explode("t").alias("term"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")


def _listed(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows of the terms in listed (term, each once)."""
    n = listed.limit(BROADCAST_TERMS + 1).count()
    return rows.join(F.broadcast(listed) if n <= BROADCAST_TERMS else listed, "term", "left_semi")


def build(docs: DataFrame, path: str, only: DataFrame | None = None, k1: float = 1.2, b: float = 0.75, buckets: int = BUCKETS, places: bool = True) -> Index:
    """Writes the index of docs (chunk_id, each once; content) to path; with only (term),
    of these terms alone, for searches that ask for no others; without places, for those
    that don't ask how terms stand. Chunks without words count as chunks of length 0.

    Chunks are dealt out by id before they are split, so counting needs no further shuffle;
    postings are then dealt out by bucket, a large bucket over several tasks. The number of
    tasks that count follows the bytes of the texts, so that none counts more as they grow;
    number and lengths of the texts are observed on the way."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    dealt = docs.select("chunk_id", "content").repartition(max(spark.sparkContext.defaultParallelism, -(-size // DEALT_BYTES)), "chunk_id")
    split = dealt.select("chunk_id", terms(F.coalesce("content", F.lit(""))).alias("t")).withColumn("length", F.size("t"))
    sizes = Observation()
    split = split.observe(sizes, F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"))
    each = split.select("chunk_id", "length", F.posexplode("t").alias("at", "term"))
    each = each if only is None else _listed(each, only.select("term").distinct())
    pos = F.array_sort(F.collect_list("at")) if places else F.lit(None).cast("array<int>")
    found = each.groupBy("chunk_id", "term").agg(F.max("length").alias("length"), F.count("*").alias("tf"), pos.alias("pos"))
    found.select("term", "chunk_id", "length", "tf", "pos", _bucket(buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    seen = sizes.get
    index = Index(path, seen["n"], max(seen["words"] / max(1, seen["n"]), 1e-9), k1, b, buckets, docs.schema["chunk_id"].dataType.simpleString())
    each = index.postings(spark).groupBy("bucket", "term").agg(F.count("*").alias("df"))
    each.select("term", "df", "bucket").hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    spark.createDataFrame([(index.n_docs, index.mean_length, k1, b, buckets, index.chunk_type)], "n_docs long, mean_length double, k1 double, b double, buckets int, chunk_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
    return index


def load(spark: SparkSession, path: str) -> Index:
    return Index(path, *spark.read.parquet(f"{path}/sizes").first())


def _asked(index: Index, wanted: DataFrame, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """wanted with df and place (from 1 at the rarest), as far as terms are known,
    and the postings of these terms, in allowed chunks (chunk_id) if given."""
    spark = wanted.sparkSession
    known = wanted.join(index.terms(spark).drop("bucket"), "term")
    known = materialized(known.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))))
    buckets = F.broadcast(known.select(_bucket(index.buckets)).distinct())  # no more than the index has
    rows = _listed(index.postings(spark).join(buckets, "bucket", "left_semi").drop("bucket"), known.select("term").distinct())
    return known, rows if allowed is None else rows.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")


def _all_terms(known: DataFrame, rows: DataFrame, more: list[str]) -> DataFrame:
    """query_id, chunk_id, n_terms and the columns `more` of postings, in rows (term, *more),
    of the chunks that hold every term of a query. Queries with an unknown term are out
    from the start; then the rarest term leads, and the two after it narrow."""
    whole = known.join(known.groupBy("query_id").count().withColumnRenamed("query_id", "q"), (F.col("query_id") == F.col("q")) & (F.col("n_terms") == F.col("count"))).drop("q", "count", "df")
    lean = rows.select("term", "chunk_id")
    found = whole.filter("place = 1").join(lean, "term").select("query_id", "n_terms", "chunk_id")
    for place in (2, 3):
        need = whole.filter(F.col("place") == place).select("query_id", "term")
        more_to_hold = found.filter(F.col("n_terms") >= place).join(need, "query_id").join(lean, ["term", "chunk_id"], "left_semi")
        found = found.filter(F.col("n_terms") < place).unionByName(more_to_hold.select("query_id", "n_terms", "chunk_id"))
    found = materialized(found)
    each = found.join(whole.select("query_id", "term"), "query_id").join(rows.select("term", "chunk_id", *more), ["term", "chunk_id"])
    held = F.collect_list(F.struct("term", *more)).alias("rows")
    return each.groupBy("query_id", "chunk_id", "n_terms").agg(F.count("*").alias("n"), held).filter("n = n_terms").select("query_id", "chunk_id", "n_terms", "rows")


def match_all(index: Index, wanted: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id of the chunks that hold every term of a query; wanted are
    query_terms."""
    known, rows = _asked(index, wanted, allowed)
    return _all_terms(known, rows, []).select("query_id", "chunk_id")


def _covers(positions: list[int], names: list[str], n_terms: int) -> float:
    """Sum over the minimal stretches that hold all terms: a tenth for each, over one more
    than the words in it that are none of the terms' places."""
    last: dict[str, int] = {}
    score, done = 0.0, -1
    for at, (_, name) in enumerate(zip(positions, names, strict=True)):
        last[name] = at
        if len(last) == n_terms and (first := min(last.values())) > done:
            noise = (positions[at] - positions[first]) - (at - first)
            score += 0.1 / (1 + noise)
            done = first
    return score


def cover_density(index: Index, wanted: DataFrame, k: int | None = config.TEXT_TOP_K, allowed: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """query_id, chunk_id, score (and rank, of the k best) of the chunks that hold every
    term of a query, by how close together they stand. Places are gathered for matching
    chunks only, one chunk's at a time."""
    known, rows = _asked(index, wanted, allowed)
    matched = _all_terms(known, rows, ["pos"])
    places = F.array_sort(F.flatten(F.transform("rows", lambda r: F.transform(r["pos"], lambda p: F.struct(p.alias("pos"), r["term"].alias("term")))))).alias("at")
    gathered = matched.select("query_id", "chunk_id", "n_terms", places)
    kinds = [f"{c} {gathered.schema[c].dataType.simpleString()}" for c in ("query_id", "chunk_id")]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [round(_covers([x["pos"] for x in a], [x["term"] for x in a], n), digits) for a, n in zip(pdf["at"], pdf["n_terms"], strict=True)]
            yield pdf[["query_id", "chunk_id"]].assign(score=found)

    scored = gathered.mapInPandas(score, ", ".join(kinds) + ", score double")
    return scored if k is None else ranked(scored, k)


def bm25(index: Index, wanted: DataFrame, k: int = config.TEXT_TOP_K, allowed: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """query_id, chunk_id, score, rank of the k chunks of highest BM25 score for each query;
    a query's terms need not all be there. Weights are those of the whole index, whatever
    is allowed.

    Postings are dealt out by chunk, each once; the queries' terms go to the tasks. A task
    makes the pairs of its chunks and the queries, adds them up and sends the k best of each
    query on: no pair that can't rank is shuffled. The number of tasks follows the number
    of (posting, query), so that none holds more as either grows."""
    known, rows = _asked(index, wanted, allowed)
    asked = known.select("query_id", "term", index.idf().alias("idf"))
    n, met = known.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    tasks = max(wanted.sparkSession.sparkContext.defaultParallelism, -(-met // DEALT_PAIRS))
    dealt = rows.select("term", "chunk_id", index.part().alias("part")).repartition(tasks, "chunk_id")
    pairs = dealt.join(F.broadcast(asked) if n <= BROADCAST_TERMS else asked, "term")
    return ranked(pairs.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("idf") * F.col("part")), digits).alias("score")), k)
