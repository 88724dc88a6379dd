"""A stored index of vectors by cells, for searches that read a part of the corpus.

Centroids are fitted on a bounded sample; every vector is assigned to the nearest one and
stored under its cell, with its angle to the centroid. A search asks the cells nearest to
each query, as many as the sample needed for the wanted recall; vectors and queries are
both dealt out by cell, a large cell in tiles. Scores are exact, so only the choice of
cells can miss a neighbour; an exact search goes on to every cell that, by the widest
angle in it, could still hold a better one than the k-th found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import config
from docloom.functions.vectors import norm
from docloom.operators.retrieval import matrix, ranked, tiled, unit
from docloom.sources.tables import materialized

#: Expected rows of the sample that centroids are fitted on and probes are set by, of which
#: so many at most ask; most cells, and most bytes of centroids.
SAMPLE, ASKED, CELLS, CENTROID_BYTES = 1 << 18, 512, 1 << 14, 64 << 20
#: Cells of vectors that no centroid is near: of zeros, whose score is 0, and unusable ones.
ZEROS, UNUSABLE = -1, -2


@dataclass(frozen=True)
class Index:
    """Where the index lies, the columns of its rows, its centroids (one per cell) and how
    many cells a query asks."""

    path: str
    columns: str
    centroids: np.ndarray
    probes: int

    def vectors(self, spark: SparkSession) -> DataFrame:
        """chunk_id, embedding, what else was indexed, angle, cell."""
        return spark.read.schema(self.columns).parquet(f"{self.path}/vectors")


def _usable(dims: int) -> Column:
    e = F.col("embedding")
    return e.isNotNull() & (F.size(e) == dims) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _nearest(q: np.ndarray, centroids: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """The p nearest cells of each row of unit vectors, nearest first, and their cosines."""
    s = np.round(q @ centroids.T, 9)
    at = np.argsort(-s, axis=1, kind="stable")[:, :p]
    return at, np.take_along_axis(s, at, 1)


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with angle to the nearest centroid, and cell."""
    dims = centroids.shape[1]
    state = F.when(~_usable(dims), UNUSABLE).when(norm(F.col("embedding")) == 0, ZEROS).otherwise(0)
    marked = rows.withColumn("cell", F.coalesce(state, F.lit(UNUSABLE)))
    schema = marked.drop("cell").schema.add("angle", "float").add("cell", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False).astype(np.int32)
            angle, ok = np.zeros(len(cell), np.float32), cell == 0
            if ok.any():
                at, s = _nearest(unit(matrix(batch.column("embedding").filter(pa.array(ok)), int(ok.sum()))), centroids, 1)
                # rounded up: no vector lies farther out than its angle says
                cell[ok], angle[ok] = at[:, 0], np.nextafter(np.arccos(np.clip(s[:, 0], -1, 1)).astype(np.float32) + np.float32(1e-4), np.float32(4))
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["cell"]).columns, pa.array(angle), pa.array(cell)], names=schema.names)

    return marked.mapInArrow(run, schema)


def _sample(corpus: DataFrame, n: int, dims: int, rows: int) -> DataFrame:
    """About `rows` usable rows, which their ids choose."""
    every = max(1, -(-n // rows))
    return corpus.filter(_usable(dims) & (F.pmod(F.xxhash64("chunk_id"), F.lit(every)) == 0)).filter(norm(F.col("embedding")) > 0)


def fit(corpus: DataFrame, cells: int | None = None, k: int = config.VECTOR_TOP_K, recall: float = 0.97, sample: int = SAMPLE, seed: int = 7) -> tuple[np.ndarray, int]:
    """Centroids, and how many cells a query asks, for corpus (chunk_id, embedding).

    k-means by cosine over the sample; about the root of the corpus's rows in cells, unless
    given. Rows of the sample then ask for their k nearest others in it: the number of
    cells is the least that holds the wanted share of these. Neighbours in a sample are
    farther apart than in the corpus, so the share there is no smaller as a rule."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n, dims = corpus.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    taken = materialized(_sample(corpus.select("chunk_id", "embedding"), n, dims, sample))
    m = taken.count()
    if not m:
        return np.zeros((1, max(1, dims))), 1
    count = max(1, min(cells or int(np.ceil(np.sqrt(n))), CELLS, m, CENTROID_BYTES // (8 * dims)))
    if count == 1:
        return unit(np.ones((1, dims))), 1
    features = taken.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=count, distanceMeasure="cosine", maxIter=10, seed=seed).fit(features)
    centroids = unit(np.array(model.clusterCenters(), np.float64))
    return centroids, _probes(taken, m, centroids, k, recall)


def _probes(taken: DataFrame, m: int, centroids: np.ndarray, k: int, recall: float) -> int:
    from docloom.operators.retrieval import vector_topk

    asking = _sample(taken, m, centroids.shape[1], ASKED).orderBy(F.xxhash64("chunk_id")).limit(ASKED).withColumnRenamed("chunk_id", "query_id")
    near = vector_topk(taken, asking, k + 1).filter("query_id <> chunk_id")
    held = _assigned(taken, centroids).select("chunk_id", "cell")
    pairs = near.join(held, "chunk_id").join(asking, "query_id").select("cell", "embedding")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.round(unit(matrix(batch.column("embedding"), batch.num_rows)) @ centroids.T, 9)
            own = s[np.arange(len(s)), batch.column("cell").to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array((s > own[:, None]).sum(1) + 1, pa.int32())], names=["place"])

    places = np.sort([r[0] for r in pairs.mapInArrow(place, "place int").collect()])  # at most (k + 1) * ASKED
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) if len(places) else len(centroids)


def build(corpus: DataFrame, path: str, **how) -> Index:
    """Fits and writes the index of corpus (chunk_id, embedding and what filters ask for)
    to path. Every row is stored: null vectors, and those with a null or infinite or NaN
    component or of another length, in a cell that no search asks. Large cells are written
    by several tasks, small ones together."""
    spark = corpus.sparkSession
    centroids, probes = fit(corpus, **how)
    rows = _assigned(corpus, centroids)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    _store(rows, path, "overwrite")
    cells = [(i, [float(x) for x in c], probes, columns) for i, c in enumerate(centroids)]
    spark.createDataFrame(cells, "cell int, centroid array<double>, probes int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return Index(path, columns, centroids, probes)


def _store(rows: DataFrame, path: str, mode: str) -> None:
    rows.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # at most CELLS
    return Index(path, rows[0]["columns"], np.array([r["centroid"] for r in rows]), rows[0]["probes"])


def add(index: Index, rows: DataFrame) -> None:
    """Appends rows, with the columns that were indexed, under the centroids there are."""
    _store(_assigned(rows, index.centroids), index.path, "append")


def search(index: Index, queries: DataFrame, k: int = config.VECTOR_TOP_K, filters: Column | None = None, probes: int | None = None, exact: bool = False, digits: int = 6) -> DataFrame:
    """query_id, chunk_id, score, rank of the k best rows that pass filters for each of
    queries (query_id, embedding), out of the cells asked; with exact, out of all. Queries
    of another length, of zeros or not finite find nothing, but for an exact search of
    zeros, which scores 0 everywhere."""
    spark, c = queries.sparkSession, index.centroids
    p = min(len(c), probes or index.probes)
    vectors = index.vectors(spark).filter(f"cell > {UNUSABLE}")
    stored = vectors if filters is None else vectors.filter(filters)
    kind = queries.schema["query_id"].dataType.simpleString()
    width = queries.schema["embedding"].dataType.simpleString()
    usable = queries.filter(_usable(c.shape[1])).select("query_id", "embedding")
    usable = usable if exact else usable.filter(norm(F.col("embedding")) > 0)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _ = _nearest(unit(matrix(batch.column("embedding"), batch.num_rows)), c, p)
            row = pa.array(np.repeat(np.arange(batch.num_rows), p))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(row), batch.column("embedding").take(row), pa.array(at.ravel(), pa.int32())], names=["query_id", "embedding", "cell"])

    asked = usable.mapInArrow(cells, f"query_id {kind}, embedding {width}, cell int")
    found = tiled(_read(stored, asked), asked, k, digits)
    if not exact:
        return ranked(found, k)
    found = materialized(ranked(found, k))
    kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    open_ = usable.join(kth, "query_id", "left").select("query_id", "embedding", F.coalesce("kth", F.lit(-2.0)).alias("kth"))
    radius = np.full(len(c), -1.0)  # of a cell without vectors
    for r in stored.filter("cell >= 0").groupBy("cell").agg(F.max("angle").alias("a")).collect():  # at most CELLS
        radius[r["cell"]] = r["a"]

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, least = unit(matrix(batch.column("embedding"), batch.num_rows)), batch.column("kth").to_numpy()
            at, s = _nearest(q, c, len(c))
            bound = np.cos(np.maximum(0, np.arccos(np.clip(s, -1, 1)) - radius[at]))
            bound[(q == 0).all(1)] = 0
            wanted = (bound >= least[:, None] - 1e-5) & (radius[at] >= 0)
            wanted[:, :p] = False
            i, j = np.nonzero(wanted)
            zero = np.flatnonzero(least <= 1e-5)
            row, cell = pa.array(np.concatenate((i, zero))), np.concatenate((at[i, j], np.full(len(zero), ZEROS)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(row), batch.column("embedding").take(row), pa.array(cell, pa.int32())], names=["query_id", "embedding", "cell"])

    rest = materialized(open_.mapInArrow(more, f"query_id {kind}, embedding {width}, cell int"))
    return ranked(found.drop("rank").unionByName(tiled(_read(stored, rest), rest, k, digits)), k)


def _read(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """The vectors of cells that are asked: other cells' files are not opened."""
    return stored.select("cell", "chunk_id", "embedding").join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi")
