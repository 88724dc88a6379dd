"""Batched hybrid retrieval: vector and text candidates, fusion, parents, context.

All functions take many queries at once. Scores are rounded before they rank and ids
break ties, so that results don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import config

if TYPE_CHECKING:
    from docloom.operators.text_index import Index

#: Most bytes of query vectors that go to the tasks as they are, scores that a task holds
#: at once, and rows of either side of a tile.
QUERY_BLOCK_BYTES, SCORES, TILE_ROWS = 8 << 20, 1 << 20, 1 << 15
#: Most rows of ids that are broadcast to fetch texts.
BROADCAST_ROWS = 1 << 18


def metadata_filter(level: str | None = None, name: str | None = None, only_active: bool = True) -> Column:
    """Missing metadata passes; % and _ in a name are ordinary characters."""
    c = F.col("is_active") if only_active else F.lit(True)
    if level is not None:
        c = c & (F.col("program_level").isNull() | (F.col("program_level") == level))
    if name is not None:
        c = c & (F.col("program_name").isNull() | F.contains(F.lower("program_name"), F.lit(name.lower())))
    return c


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int = config.VECTOR_TOP_K, digits: int = 6) -> DataFrame:
    """query_id, chunk_id, score, rank of the k nearest of corpus (chunk_id, embedding) to
    each of queries (query_id, embedding). Vectors with NaN rank nowhere, nor do vectors
    of another length than the queries'.

    Exact. Queries of up to QUERY_BLOCK_BYTES go to the tasks as they are, with one scan
    of the corpus and no shuffle of it; more of them meet the corpus in tiles of bounded
    size. Either way a task keeps the k best of each query, which is all that is shuffled
    then. docloom.operators.vector_index reads a part of the corpus only.
    """
    usable = queries.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("query_id", "embedding")
    n, dims = usable.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    fits = lambda df: df.filter(F.size("embedding") == dims)
    if n * dims * 8 > QUERY_BLOCK_BYTES:
        one = lambda df: fits(df).withColumn("cell", F.lit(0))
        return ranked(tiled(one(corpus.select("chunk_id", "embedding")), one(usable), k, digits), k)
    kind = queries.schema["query_id"].dataType.simpleString()
    block = [(r["query_id"], r["embedding"]) for r in fits(usable).collect()]
    return ranked(_scored(fits(corpus), block, k, digits, kind), k)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """Vectors of equal length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _best(i: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query number i by score, then id."""
    order = np.lexsort((ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1], -s, i))
    i, ids, s = i[order], ids[order], s[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], ids[keep], s[keep]


class _Held:
    """The k best of each of some queries, over batches of vectors. Scores under the k-th
    held so far are dropped where they are made."""

    def __init__(self, q: np.ndarray, k: int, digits: int) -> None:
        self.q, self.k, self.digits = unit(q), k, digits
        self.kth = np.full((len(q), 1), -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, names: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, SCORES // max(1, len(self.q)))
        for at in range(0, len(vectors), step):  # scores of a bounded number of pairs
            s = self.q @ unit(vectors[at : at + step]).T
            np.round(s, self.digits, out=s)
            s[np.isnan(s)] = -np.inf
            open_ = (s >= self.kth) & (s > -np.inf)
            if np.count_nonzero(open_) > self.k * len(self.q):
                rest = s.shape[1] - min(self.k, s.shape[1])
                open_ &= s >= np.partition(s, rest, axis=1)[:, rest, None]
            i, j = np.nonzero(open_)
            if len(i):
                self.parts.append(_best(i, names[at + j], s[i, j], self.k))
                self.n += len(self.parts[-1][0])
            if self.n > 2 * self.k * len(self.q):
                self.parts = [self.best()]
                i, _, s = self.parts[0]
                self.n, found = len(i), np.bincount(i, minlength=len(self.q))
                full = found == self.k
                self.kth[full, 0] = s[np.cumsum(found)[full] - 1]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _best(*(np.concatenate(c) for c in zip(*self.parts, strict=True)), self.k)


def _scored(corpus: DataFrame, queries: list, k: int, digits: int, kind: str) -> DataFrame:
    ids = [i for i, _ in queries]
    q = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
    chunk = corpus.schema["chunk_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, type_ = _Held(q, k, digits), None
        for batch in batches:
            if batch.num_rows and len(q):
                type_ = batch.column("chunk_id").type
                held.add(batch.column("chunk_id").to_numpy(zero_copy_only=False), matrix(batch.column("embedding"), batch.num_rows))
        if held.parts:
            i, names, s = held.best()
            yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in i]), pa.array(names, type_), pa.array(s)], names=["query_id", "chunk_id", "score"])

    usable = corpus.filter(F.col("embedding").isNotNull())
    return usable.select("chunk_id", "embedding").mapInArrow(score, f"query_id {kind}, chunk_id {chunk}, score double")


def tiled(corpus: DataFrame, queries: DataFrame, k: int, digits: int = 6, rows: int = TILE_ROWS) -> DataFrame:
    """query_id, chunk_id, score: the k best per query and tile, of corpus (cell, chunk_id,
    embedding) and queries (cell, query_id, embedding), each query against its cell's
    vectors; all vectors have one length. Cells are few (they are broadcast with their
    sizes); a cell's vectors and queries are dealt into blocks of about `rows` rows each,
    and every two blocks of a cell meet in a task of their own, however large the cell."""
    blocks = lambda n: F.ceil(F.col(n) / rows).cast("long")
    sizes = corpus.groupBy("cell").agg(F.count("*").alias("n")).join(queries.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    sizes = F.broadcast(sizes.select("cell", blocks("n").alias("ni"), blocks("m").alias("nj")))
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = corpus.join(sizes, "cell").withColumn("i", F.pmod(F.xxhash64("chunk_id"), "ni")).withColumn("j", other("nj")).select("cell", "i", "j", "chunk_id", "embedding")
    right = queries.join(sizes, "cell").withColumn("j", F.pmod(F.xxhash64("query_id"), "nj")).withColumn("i", other("ni")).select("cell", "i", "j", "query_id", "embedding")

    def score(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        fields = [("query_id", asked.schema.field("query_id").type), ("chunk_id", vectors.schema.field("chunk_id").type), ("score", pa.float64())]
        if not len(vectors) or not len(asked):
            return pa.schema(fields).empty_table()
        held = _Held(matrix(asked["embedding"], len(asked)), k, digits)
        held.add(vectors["chunk_id"].to_numpy(), matrix(vectors["embedding"], len(vectors)))
        if not held.parts:
            return pa.schema(fields).empty_table()
        i, names, s = held.best()
        return pa.Table.from_arrays([asked["query_id"].take(pa.array(i)), pa.array(names, fields[1][1]), pa.array(s)], schema=pa.schema(fields))

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}, score double"
    return left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInArrow(score, kinds)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(lists: DataFrame, k: int = config.RRF_K, digits: int = 9) -> DataFrame:
    """Weighted reciprocal-rank fusion of rows (query_id, list_no, source, weight,
    chunk_id, rank, score): rrf sums over lists; a chunk's own row is its first, a vector
    row before others. Ties keep the order of first appearance."""
    seen = F.struct(F.when(F.col("source") == "vector", 0).otherwise(1).alias("kind"), "list_no", "rank")
    fused = lists.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), digits).alias("rrf"),
        F.min(F.struct("list_no", "rank")).alias("first"),
        F.min_by(F.struct("source", "score"), seen).alias("row"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first.list_no", "first.rank", "chunk_id")
    return fused.select("query_id", "chunk_id", "rrf", "row.source", "row.score", F.row_number().over(w).alias("rank"))


def representatives(fused: DataFrame, chunks: DataFrame, top: int = config.TOP_PARENTS) -> DataFrame:
    """query_id, parent_id, position: the first distinct parents in rank order. A child
    stands for its parent, other chunks for themselves."""
    own = F.when((F.col("chunk_level") == "child") & F.col("parent_id").isNotNull(), F.col("parent_id")).otherwise(F.col("chunk_id"))
    of = fused.join(chunks.select("chunk_id", "chunk_level", "parent_id"), "chunk_id").withColumn("parent", own)
    best = of.groupBy("query_id", "parent").agg(F.min("rank").alias("best"))
    w = Window.partitionBy("query_id").orderBy("best")
    return best.select("query_id", F.col("parent").alias("parent_id"), F.row_number().over(w).alias("position")).filter(F.col("position") <= top)


def fetch(positions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Content of the active parents, in order; ids that are gone drop out."""
    content = chunks.filter("is_active").select(F.col("chunk_id").alias("parent_id"), "content")
    return positions.join(content, "parent_id").select("query_id", "position", "parent_id", "content")


def budget(docs: DataFrame, most: int = config.CONTEXT_CHARS, least: int = config.MIN_TRUNCATED) -> DataFrame:
    """Rows (query_id, position, content) that the budget allows, with emitted: whole
    while they fit, then one cut to the rest if more than `least` is left.

    Lengths alone are summed, group by group of any size; texts are read for the rows that
    are left. A null content counts as nothing and is not emitted."""
    from docloom.operators.scan import running
    from docloom.sources.tables import materialized

    sizes = docs.filter("content is not null").select("query_id", "position", F.length("content").cast("long").alias("n"))
    rest = most - F.col("before")
    fits = materialized(running(sizes, "query_id", ["position"], {"before": "n"}).filter((F.col("n") <= rest) | (rest > least)).select("query_id", "position", rest.cast("int").alias("_rest")))
    kept = F.broadcast(fits) if fits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else fits
    same = docs["query_id"].eqNullSafe(kept["query_id"]) & (docs["position"] == kept["position"])
    met = docs.join(kept, same).select(*[docs[c] for c in docs.columns], "_rest")
    emitted = F.when(F.length("content") <= F.col("_rest"), F.col("content")).otherwise(F.concat(F.left("content", F.col("_rest")), F.lit("...")))
    return met.withColumn("emitted", emitted).drop("_rest")


def context(docs: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """query_id, context."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "emitted"))), lambda x: x["emitted"])
    return budget(docs).groupBy("query_id").agg(F.array_join(parts, separator).alias("context"))


def hybrid(chunks: DataFrame, questions: DataFrame, filters: Column | None = None, text: Index | None = None) -> DataFrame:
    """The whole retrieval for questions (query_id, variant, text, embedding): variant 0
    is the question itself and boosted if there are others. Text candidates are ranked by
    how close together the question's terms stand. Returns query_id, context, n_chunks,
    top_cosine, and the candidates of either kind (n_vector, n_text). Questions without an
    embedding are searched by text alone. text is the index of all chunks' content; without
    one it is built for these questions' terms."""
    from docloom.operators import text_index
    from docloom.sources.tables import materialized, scratch

    keep = filters if filters is not None else metadata_filter()
    rows = chunks.filter(keep)
    several = questions.groupBy("query_id").agg((F.count("embedding") > 1).alias("several"))
    keyed = questions.withColumn("key", F.concat_ws("#", "query_id", "variant"))
    vectors = vector_topk(rows.select("chunk_id", "embedding"), keyed.select(F.col("key").alias("query_id"), "embedding"))
    vectors = vectors.withColumnRenamed("query_id", "key").join(keyed.select("key", "query_id", F.col("variant").alias("list_no")), "key").join(several, "query_id")
    weight = F.when(F.col("several") & (F.col("list_no") == 0), config.STANDALONE_BOOST).otherwise(1.0)
    vectors = vectors.select("query_id", "list_no", F.lit("vector").alias("source"), weight.alias("weight"), "chunk_id", "rank", "score")
    wanted = text_index.query_terms(questions.filter("variant = 0").select("query_id", "text"))
    if text is None:
        text, allowed = text_index.build(rows.select("chunk_id", "content"), scratch(chunks.sparkSession, "text-index"), wanted), None
    else:
        allowed = rows.select("chunk_id")
    said = text_index.cover_density(text, wanted, allowed=allowed)
    said = said.select("query_id", F.lit(1 << 20).alias("list_no"), F.lit("text").alias("source"), F.lit(1.0).alias("weight"), "chunk_id", "rank", "score")
    found = materialized(vectors.unionByName(said))
    counts = found.groupBy("query_id").agg(F.count_if(F.col("source") == "vector").alias("n_vector"), F.count_if(F.col("source") == "text").alias("n_text"))
    fused = materialized(fuse(found))
    parents = fetch(representatives(fused, chunks), chunks)
    stats = fused.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.max(F.when(F.col("source") == "vector", F.col("score"))).alias("top_cosine"))
    every = questions.select("query_id").distinct().join(stats, "query_id", "left").join(counts, "query_id", "left").join(context(parents), "query_id", "left")
    none = F.lit(0).cast("long")
    return every.select("query_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("n_chunks", none).alias("n_chunks"), "top_cosine", F.coalesce("n_vector", none).alias("n_vector"), F.coalesce("n_text", none).alias("n_text"))
