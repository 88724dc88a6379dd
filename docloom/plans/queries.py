"""One query per operator over the driver's tables, and the same in DuckDB SQL.

Corpus views: documents are files and chunks (labels.quality tells active ones),
embeddings are chunk vectors (label is the level; the stated queries are those with a
vec_id divisible by 20; every fifth row is a parent), benchmark texts are questions,
conversations are history, events are requests, pages are HTML.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import config
from docloom.functions import text as T
from docloom.functions import vectors as V
from docloom.operators import answers, catalog, chunking, dialogue, headers, ingest, responses, retrieval, rewriting, scan, structured, text_index, vector_index
from docloom.plans import compose, loops, providers
from docloom.sources import managed
from docloom.sources.tables import read_table, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- corpus views ----------------------------------------------------------------------


def _corpus(s: SparkSession, d: str) -> DataFrame:
    e = read_table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), "embedding", F.nullif(F.col("label"), F.lit(3)).cast("string").alias("program_level"), F.lit(True).alias("is_active"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: every third is a parent of the two after it."""
    labels = read_table(s, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    x = read_table(s, d, "documents").join(labels, "doc_id", "left")
    parent = F.col("doc_id") % 3 == 0
    return x.select(
        F.col("doc_id").alias("chunk_id"), "source", F.nullif(F.col("lang"), F.lit("es")).alias("program_level"), F.col("lang").alias("program_name"), F.concat(F.lit("s"), F.col("doc_id") % 4).alias("section_name"),
        F.col("text").alias("content"), F.length("text").cast("long").alias("char_count"), (F.coalesce("quality", F.lit(1)) == 1).alias("is_active"), (F.col("doc_id") % 2 == 0).alias("has_embedding"),
        F.when(parent, "parent").otherwise("child").alias("chunk_level"), F.when(~parent, F.col("doc_id") - F.col("doc_id") % 3).alias("parent_id"), (F.col("doc_id") % 3).alias("chunk_index"),
        F.col("doc_id").alias("created_at"), (F.col("doc_id") * 2).alias("updated_at"), T.length_tokens(F.col("text")).alias("token_count"),
    )


_CHUNKS = """chunks AS (SELECT d.doc_id AS chunk_id, source, nullif(lang, 'es') AS program_level, lang AS program_name, 's' || (d.doc_id % 4) AS section_name,
 text AS content, length(text) AS char_count, coalesce(quality, 1) = 1 AS is_active, d.doc_id % 2 = 0 AS has_embedding,
 CASE WHEN d.doc_id % 3 = 0 THEN 'parent' ELSE 'child' END AS chunk_level, CASE WHEN d.doc_id % 3 <> 0 THEN d.doc_id - d.doc_id % 3 END AS parent_id, d.doc_id % 3 AS chunk_index,
 d.doc_id AS created_at, d.doc_id * 2 AS updated_at, greatest(1, length(text) // 4) AS token_count
 FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id)"""


def _logs(s: SparkSession, d: str) -> DataFrame:
    x = read_table(s, d, "labels").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    return x.select(F.concat(F.lit("src"), F.col("doc_id") % 40).alias("file_name"), F.when(F.col("toxic") == 0, "completed").otherwise("failed").alias("status"), F.col("doc_id").alias("log_id"))


_LOGS = "logs AS (SELECT 'src' || (doc_id % 40) AS file_name, CASE WHEN min(toxic) = 0 THEN 'completed' ELSE 'failed' END AS status, doc_id AS log_id FROM labels GROUP BY doc_id)"

# -- retrieval -------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6)"


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {_COS} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, score, rank::INT AS rank FROM r WHERE rank <= 7""")
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_topk(_corpus(s, d), _asked(s, d))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {_COS} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND (nullif(c.label, 3) IS NULL OR nullif(c.label, 3) = 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, score, rank::INT AS rank FROM r WHERE rank <= 7""")
def vector_topk_filtered(s: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_topk(_corpus(s, d).filter(retrieval.metadata_filter(level="2")), _asked(s, d))


@query()
def vector_index_topk(s: SparkSession, d: str) -> DataFrame:
    """As vector_topk, from the cells nearest to each query: 0.95 of the same rows or more."""
    return vector_index.search(vector_index.build(_corpus(s, d), scratch(s, "vector-index")), _asked(s, d))


@query(SQL["vector_topk"])
def vector_index_exact(s: SparkSession, d: str) -> DataFrame:
    """As vector_topk, from the cells that can hold a neighbour."""
    return vector_index.search(vector_index.build(_corpus(s, d), scratch(s, "vector-index")), _asked(s, d), exact=True)


@query(SQL["vector_topk_filtered"])
def vector_index_filtered(s: SparkSession, d: str) -> DataFrame:
    """As vector_topk_filtered, from an index of all rows that is filtered when it is read."""
    index = vector_index.build(_corpus(s, d), scratch(s, "vector-index"))
    return vector_index.search(index, _asked(s, d), filters=retrieval.metadata_filter(level="2"), exact=True)


_TERMS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_POSTINGS = f"""docs AS (SELECT doc_id AS chunk_id, {_TERMS.format("text")} AS t FROM documents),
p AS (SELECT chunk_id, len(t) AS length, term, count(*) AS tf FROM (SELECT chunk_id, t, unnest(t) AS term FROM docs) GROUP BY ALL),
wanted AS (SELECT query_id, len(list_distinct(t)) AS n_terms, unnest(list_distinct(t)) AS term FROM (SELECT item_id AS query_id, {_TERMS.format("text")} AS t FROM benchmark))"""


def _text_index(s: SparkSession, d: str, places: bool = False) -> tuple[text_index.Index, DataFrame]:
    """The index of all documents for the terms of the benchmark's texts, and these terms."""
    docs = read_table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    wanted = text_index.query_terms(read_table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return text_index.build(docs, scratch(s, "text-index"), wanted, places=places), wanted


@query(f"WITH {_POSTINGS} SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, count(*) AS n, max(n_terms) AS m FROM p JOIN wanted USING (term) GROUP BY ALL) WHERE n = m")
def fulltext_match_all(s: SparkSession, d: str) -> DataFrame:
    return text_index.match_all(*_text_index(s, d))


@query(f"""WITH {_POSTINGS}, df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), sz AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM docs),
s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM p JOIN wanted USING (term) JOIN df USING (term), sz GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return text_index.bm25(*_text_index(s, d))


def _lists(s: SparkSession, d: str) -> DataFrame:
    """Two vector lists (a query and the row after it) and one of the query's label, for each query."""
    e = read_table(s, d, "embeddings")
    both = e.filter("vec_id % 20 < 2").select(F.col("vec_id").alias("query_id"), "embedding")
    second = F.col("query_id") % 20
    vec = retrieval.vector_topk(_corpus(s, d), both).select((F.col("query_id") - second).alias("query_id"), second.cast("int").alias("list_no"), F.lit("vector").alias("source"), F.when(second == 0, config.STANDALONE_BOOST).otherwise(1.0).alias("weight"), "chunk_id", "rank", "score")
    by_label = scan.numbered(e.select("label", "vec_id"), "label", ["vec_id"], "rank").withColumn("rank", F.col("rank").cast("int")).filter(F.col("rank") <= config.TEXT_TOP_K).select("label", F.col("vec_id").alias("chunk_id"), "rank")
    text = e.filter("vec_id % 20 = 0").select("label", F.col("vec_id").alias("query_id")).join(by_label, "label")
    return vec.unionByName(text.select("query_id", F.lit(9).alias("list_no"), F.lit("text").alias("source"), F.lit(1.0).alias("weight"), "chunk_id", "rank", F.lit(0.5).alias("score")))


_FUSED = f"""v AS (SELECT q.vec_id AS q, c.vec_id AS chunk_id, {_COS} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 IN (0, 1)),
vr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_id) AS rank FROM v),
t AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY c.vec_id) AS rank FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 20 = 0),
l AS (SELECT q - q % 20 AS query_id, q % 20 AS list_no, 'vector' AS source, CASE WHEN q % 20 = 0 THEN 1.2 ELSE 1.0 END AS weight, chunk_id, rank, score FROM vr WHERE rank <= 7
 UNION ALL SELECT query_id, 9, 'text', 1.0, chunk_id, rank, 0.5 FROM t WHERE rank <= 5),
f AS (SELECT query_id, chunk_id, round(sum(weight::DOUBLE / (60 + rank)), 9) AS rrf, min(list_no * 1000 + rank) AS first,
 arg_min(source, (CASE source WHEN 'vector' THEN 0 ELSE 1 END) * 1000000 + list_no * 1000 + rank) AS source, arg_min(score, (CASE source WHEN 'vector' THEN 0 ELSE 1 END) * 1000000 + list_no * 1000 + rank) AS score FROM l GROUP BY 1, 2),
fused AS (SELECT query_id, chunk_id, rrf, source, score, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, chunk_id) AS rank FROM f)"""


@query(f"WITH {_FUSED} SELECT query_id, chunk_id, rrf, source, score::DOUBLE AS score, rank::INT AS rank FROM fused")
def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(_lists(s, d))


@query(f"""WITH {_FUSED}, o AS (SELECT query_id, chunk_id - chunk_id % 5 AS parent_id, min(rank) AS best FROM fused GROUP BY 1, 2)
SELECT query_id, parent_id, position::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best) AS position FROM o) WHERE position <= 4""")
def parent_rollup(s: SparkSession, d: str) -> DataFrame:
    chunks = read_table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 5 == 0, "parent").otherwise("child").alias("chunk_level"), (F.col("vec_id") - F.col("vec_id") % 5).alias("parent_id"))
    return retrieval.representatives(retrieval.fuse(_lists(s, d)), chunks)


def _per_source(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("position"), F.col("text").alias("content"))


@query("""WITH p AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position, text AS content FROM documents),
b AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
e AS (SELECT *, CASE WHEN length(content) <= 5000 - before THEN content WHEN 5000 - before > 100 THEN left(content, (5000 - before)::BIGINT) || '...' END AS emitted FROM b)
SELECT query_id, position::INT AS position, emitted FROM e WHERE emitted IS NOT NULL""")
def context_budget(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("position")  # what is left is within the budget
    return retrieval.budget(_per_source(s, d)).select("query_id", F.row_number().over(w).alias("position"), "emitted")


@query("""WITH p AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position, text AS content FROM documents),
b AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
e AS (SELECT *, CASE WHEN length(content) <= 5000 - before THEN content WHEN 5000 - before > 100 THEN left(content, (5000 - before)::BIGINT) || '...' END AS emitted FROM b)
SELECT query_id, string_agg(emitted, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS context FROM e WHERE emitted IS NOT NULL GROUP BY 1""")
def context_text(s: SparkSession, d: str) -> DataFrame:
    return retrieval.context(_per_source(s, d))


@query(f"""WITH {_CHUNKS}, p AS (SELECT label::BIGINT AS query_id, (vec_id * 3) AS wanted, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS position FROM embeddings)
SELECT query_id, position::INT AS position, wanted AS parent_id, sha256(content) AS content_hash FROM p JOIN chunks ON wanted = chunk_id WHERE is_active""")
def late_fetch(s: SparkSession, d: str) -> DataFrame:
    p = scan.numbered(read_table(s, d, "embeddings").select(F.col("label").cast("long").alias("query_id"), "vec_id"), "query_id", ["vec_id"]).withColumn("position", F.col("position").cast("int"))
    return retrieval.fetch(p.select("query_id", "position", (F.col("vec_id") * 3).alias("parent_id")), _chunks(s, d)).select("query_id", "position", "parent_id", F.sha2("content", 256).alias("content_hash"))


# -- ingestion and catalogue -----------------------------------------------------------


@query("""WITH c AS (SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1)
SELECT content_hash FROM c WHERE content_hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)""")
def content_dedup(s: SparkSession, d: str) -> DataFrame:
    x = read_table(s, d, "documents").select(ingest.content_hash(F.col("text")).alias("content_hash"), F.lit("a").alias("source"), F.lit(1).alias("version"), "doc_id")
    return ingest.new_chunks(x, x.filter("doc_id % 10 = 0")).select("content_hash")


@query("""WITH ledger AS (SELECT sha256(text) AS file_hash, 'f' || (d.doc_id // 2) AS file_name, CASE WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS status FROM documents d JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id),
h AS (SELECT file_hash, bool_or(status = 'completed') AS done FROM ledger GROUP BY 1)
SELECT doc_id, CASE WHEN done THEN 'skip' WHEN done IS NOT NULL OR 'f' || (doc_id // 2) IN (SELECT file_name FROM ledger) THEN 'update' ELSE 'insert' END AS action FROM documents LEFT JOIN h ON sha256(text) = file_hash""")
def file_decision(s: SparkSession, d: str) -> DataFrame:
    files = read_table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 2)).alias("file_name"))
    labels = read_table(s, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ledger = files.join(labels, "doc_id").select("file_hash", "file_name", F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"))
    return ingest.decide(files, ledger).select("doc_id", "action")


@query(f"WITH {_CHUNKS} SELECT source, max(program_level) AS program_level, count(*) AS n_chunks, sum(char_count)::BIGINT AS chars, bool_and(is_active) AS is_active, min(created_at) AS created_at, max(updated_at) AS updated_at FROM chunks GROUP BY 1")
def catalog_documents(s: SparkSession, d: str) -> DataFrame:
    return catalog.documents(_chunks(s, d))


@query(f"""WITH {_CHUNKS}, {_LOGS} SELECT source, max(program_level) AS program_level, count(*) AS n_chunks, sum(char_count)::BIGINT AS chars, NULL AS status FROM chunks WHERE is_active GROUP BY 1
UNION ALL SELECT file_name, NULL, 0, 0, status FROM logs WHERE file_name NOT IN (SELECT source FROM chunks WHERE is_active)""")
def catalog_listing(s: SparkSession, d: str) -> DataFrame:
    return catalog.listing(_logs(s, d), _chunks(s, d)).select("source", "program_level", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("chars", F.lit(0)).alias("chars"), "status")


@query(f"WITH {_CHUNKS}, {_LOGS} SELECT (SELECT count(*) FROM logs WHERE status = 'completed') AS n_completed, count(*) AS n_chunks, coalesce(sum(char_count), 0)::BIGINT AS chars, count(*) FILTER (has_embedding) AS n_embedded FROM chunks WHERE is_active")
def catalog_stats(s: SparkSession, d: str) -> DataFrame:
    return catalog.stats(_logs(s, d), _chunks(s, d))


@query(f"WITH {_CHUNKS} SELECT coalesce(nullif(program_level, ''), 'unknown') AS program_level, count(DISTINCT source) AS n_documents, count(*) AS n_chunks FROM chunks WHERE is_active GROUP BY 1")
def catalog_levels(s: SparkSession, d: str) -> DataFrame:
    return catalog.levels(_chunks(s, d))


@query(f"WITH {_CHUNKS}, {_LOGS} SELECT file_name, status, log_id FROM logs WHERE file_name NOT IN (SELECT source FROM chunks WHERE is_active)")
def orphan_logs(s: SparkSession, d: str) -> DataFrame:
    return catalog.orphan_logs(_logs(s, d), _chunks(s, d))


@query(f"WITH {_CHUNKS} SELECT p.chunk_id AS parent_id, c.chunk_id AS child_id, c.chunk_index, length(p.content) AS parent_chars, length(c.content) AS child_chars FROM chunks p JOIN chunks c ON c.parent_id = p.chunk_id WHERE p.is_active AND c.is_active AND p.chunk_level = 'parent'")
def parent_child_view(s: SparkSession, d: str) -> DataFrame:
    v = catalog.parent_child(_chunks(s, d))
    return v.select("parent_id", "child_id", "chunk_index", F.length("parent_content").cast("long").alias("parent_chars"), F.length("child_content").cast("long").alias("child_chars"))


@query(f"""WITH {_CHUNKS} SELECT p.chunk_id, coalesce(k.n, 0) AS children_count, coalesce(k.ids, '') AS children FROM chunks p LEFT JOIN (SELECT parent_id, count(*) AS n, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_index, chunk_id) AS ids FROM chunks WHERE chunk_level = 'child' GROUP BY 1) k ON k.parent_id = p.chunk_id WHERE p.chunk_level = 'parent'""")
def chunk_trees(s: SparkSession, d: str) -> DataFrame:
    t = catalog.trees(_chunks(s, d))
    return t.select("chunk_id", F.col("children_count").cast("long").alias("children_count"), F.coalesce(F.array_join(F.transform("children", lambda c: c["chunk_id"].cast("string")), ","), F.lit("")).alias("children"))


@query(f"WITH {_CHUNKS} SELECT program_level, program_name, count(*) FILTER (chunk_level = 'parent') AS parents, count(*) FILTER (chunk_level = 'child') AS children, string_agg(DISTINCT section_name, '|' ORDER BY section_name) AS sections, count(*) AS total FROM chunks GROUP BY 1, 2")
def program_summary(s: SparkSession, d: str) -> DataFrame:
    return catalog.program_summary(_chunks(s, d))


@query(f"WITH {_CHUNKS} SELECT chunk_level, count(*) AS n, min(token_count) AS min_tokens, max(token_count) AS max_tokens, arg_min(chunk_id, (token_count, chunk_id)) AS min_chunk, arg_min(chunk_id, (-token_count, chunk_id)) AS max_chunk, count(*) FILTER (token_count > 800) AS n_over, count(*) FILTER (token_count < 10) AS n_under, (sum(token_count) // greatest(1, count(*)))::BIGINT AS mean_tokens FROM chunks GROUP BY 1")
def chunk_quality(s: SparkSession, d: str) -> DataFrame:
    return catalog.chunk_quality(_chunks(s, d))


@query(f"WITH {_CHUNKS} SELECT chunk_id, is_active AND source NOT IN ('src0', 'src7') AS is_active FROM chunks")
def soft_delete(s: SparkSession, d: str) -> DataFrame:
    gone = s.createDataFrame([("src0",), ("src7",)], "source string")
    return ingest.deactivate(_chunks(s, d), gone).select("chunk_id", "is_active")


@query(f"WITH {_CHUNKS} SELECT chunk_id, source FROM chunks WHERE NOT (source LIKE 'src1%' OR source LIKE '%7')")
def scoped_rebuild(s: SparkSession, d: str) -> DataFrame:
    return ingest.without_sources(_chunks(s, d), "src1%", "%7").select("chunk_id", "source")


@query("""WITH l AS (SELECT doc_id AS k, quality FROM (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1)),
o AS (SELECT 'h' || k AS file_hash, 'n' || k AS file_name, 'pending' AS status, k AS chunks_count, k AS created_at, k AS updated_at FROM l WHERE k % 2 = 0),
n AS (SELECT 'h' || k AS file_hash, 'm' || k AS file_name, 'completed' AS status, k + 1 AS chunks_count, k + 5 AS updated_at FROM l WHERE k % 3 = 0)
SELECT coalesce(o.file_hash, n.file_hash) AS file_hash, coalesce(o.file_name, n.file_name) AS file_name, coalesce(n.status, o.status) AS status, coalesce(n.chunks_count, o.chunks_count) AS chunks_count, coalesce(o.created_at, n.updated_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at FROM o FULL JOIN n ON o.file_hash = n.file_hash""")
def ledger_upsert(s: SparkSession, d: str) -> DataFrame:
    k = read_table(s, d, "labels").select(F.col("doc_id").alias("k")).distinct()
    old = k.filter("k % 2 = 0").select(F.concat(F.lit("h"), "k").alias("file_hash"), F.concat(F.lit("n"), "k").alias("file_name"), F.lit("pending").alias("status"), F.col("k").alias("chunks_count"), F.col("k").alias("created_at"), F.col("k").alias("updated_at"))
    new = k.filter("k % 3 = 0").select(F.concat(F.lit("h"), "k").alias("file_hash"), F.concat(F.lit("m"), "k").alias("file_name"), F.lit("completed").alias("status"), (F.col("k") + 1).alias("chunks_count"), (F.col("k") + 5).alias("updated_at"))
    return ingest.upsert_ledger(old, new)


@query(f"WITH {_CHUNKS} SELECT left(chunk_id::VARCHAR, 12) || '...' AS chunk_id, CASE WHEN length(content) > 300 THEN left(content, 300) || '...' ELSE content END AS content FROM chunks")
def dry_run_preview(s: SparkSession, d: str) -> DataFrame:
    return ingest.preview(_chunks(s, d).withColumn("chunk_id", F.col("chunk_id").cast("string")))


@query("""WITH c AS (SELECT DISTINCT sha256(text) AS content_hash, source FROM documents), a AS (SELECT DISTINCT sha256(text) AS content_hash, source FROM documents WHERE source LIKE '%2' AND doc_id % 3 > 0), t AS (SELECT DISTINCT source FROM a)
SELECT c.source, c.content_hash, CASE WHEN t.source IS NOT NULL THEN a.source IS NOT NULL ELSE c.source NOT LIKE '%1' END AS is_active FROM c LEFT JOIN t USING (source) LEFT JOIN a USING (source, content_hash) WHERE c.source NOT LIKE '%3'""")
def table_changes(s: SparkSession, d: str) -> DataFrame:
    """A stored table of the documents, after an insertion that is repeated, the soft delete
    of the sources in 1, a second ingestion of those in 2 and a rebuild of those in 3."""
    rows = read_table(s, d, "documents").select("source", F.sha2("text", 256).alias("content_hash"), F.lit(1).alias("version"), F.lit(True).alias("is_active"), "doc_id")
    table = managed.chunk_table(scratch(s, "chunks"), "content_hash string, source string, version int, is_active boolean", buckets=8)
    managed.insert(table, rows)
    managed.insert(table, rows)
    managed.deactivate(table, rows.filter("source like '%1'"))
    managed.ingest_again(table, rows.filter("source like '%2' and doc_id % 3 > 0"))
    managed.rebuild(table, rows.limit(0), "%3")
    return table.read(s).select("source", "content_hash", "is_active")


@query("SELECT user_id AS task_id, arg_max(event_type, (epoch_us(ts), event_type)) AS status, max(epoch_us(ts)) AS updated_at FROM events GROUP BY 1")
def task_status(s: SparkSession, d: str) -> DataFrame:
    e = read_table(s, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_at"))
    return catalog.latest_status(e)


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 100")
def task_history(s: SparkSession, d: str) -> DataFrame:
    return catalog.newest(read_table(s, d, "events"), "ts", "event_id", 100).select("event_id")


# -- text ------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT doc_id, text, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS u, length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS a, length(regexp_replace(text, '[^\x09-\x0D\x1C-\x20]', '', 'g')) AS w FROM documents),
e AS (SELECT doc_id, text, u / 1.5::DOUBLE + a / 4.0::DOUBLE + (length(text) - u - a - w) / 2.0::DOUBLE + w / 5.0::DOUBLE AS part FROM c)
SELECT doc_id, greatest(1, floor(part + greatest(1.0::DOUBLE, part * 0.05::DOUBLE)))::BIGINT AS mixed, greatest(1, length(text) // 4)::BIGINT AS quarter, greatest(1, length(text) // 3)::BIGINT AS third FROM e""")
def token_estimate(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read_table(s, d, "documents").select("doc_id", T.token_estimate(t).alias("mixed"), T.length_tokens(t).alias("quarter"), T.length_tokens(t, 3).alias("third"))


@query(r"""WITH m AS (SELECT doc_id, regexp_replace(text, '([.!?;])\s+([A-ZÀ-Ỹa-zà-ỹ\d])', '\1' || chr(1) || '\2', 'g') AS t FROM documents),
p AS (SELECT doc_id, regexp_replace(unnest(string_split_regex(t, chr(1) || '|\n\n')), '^\s+|\s+$', '', 'g') AS s FROM m)
SELECT doc_id, count(*) AS n, sum(length(s))::BIGINT AS chars FROM p WHERE s <> '' GROUP BY 1""")
def sentence_split_stats(s: SparkSession, d: str) -> DataFrame:
    p = read_table(s, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def whitespace_clean(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents").select("doc_id", T.clean_whitespace(F.col("text")).alias("text"))


@query(r"SELECT page_id, regexp_replace(html, '(?i)<\s*(script|iframe|object|embed|form|meta|link|base)\b', '', 'g') AS html FROM pages")
def html_sanitize(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("html"))


@query(r"SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1) AS host, (regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1) IN ('example.org') OR ends_with(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '.example.org') OR ends_with(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '.com')) AS allowed FROM pages")
def url_domain_allow(s: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return read_table(s, d, "pages").select("page_id", host.alias("host"), T.allowed_host(F.col("url"), ["example.org", "com"]).alias("allowed"))


@query(r"""WITH a AS (SELECT page_id, replace(html, 'href="/', 'href="https://x.org/') AS html FROM pages),
u AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=["'](https?://[^"'\s>]+)', 1)) AS url, generate_subscripts(regexp_extract_all(html, '(?i)href=["'](https?://[^"'\s>]+)', 1), 1) AS i FROM a)
SELECT page_id, url, min(i)::BIGINT AS first FROM u GROUP BY 1, 2""".replace("""["']""", """["'']""").replace("""[^"'""", """[^"''"""))
def url_citations(s: SparkSession, d: str) -> DataFrame:
    pages = read_table(s, d, "pages").select("page_id", F.replace("html", F.lit('href="/'), F.lit('href="https://x.org/')).alias("html"))
    all_ = F.regexp_extract_all("html", F.lit(r"(?i)href=[\"'](https?://[^\"'\s>]+)"), F.lit(1))
    u = pages.select("page_id", F.explode(T.hrefs(F.col("html"))).alias("url"), all_.alias("all"))
    return u.select("page_id", "url", F.array_position("all", F.col("url")).alias("first"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(text), 'àáâäãèéêëìíîïòóôöõùúûüñç', 'aaaaaeeeeiiiiooooouuuunc'), '[^a-z0-9\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def slugs(s: SparkSession, d: str) -> DataFrame:
    plain = F.translate(F.lower("text"), "àáâäãèéêëìíîïòóôöõùúûüñç", "aaaaaeeeeiiiiooooouuuunc")
    return read_table(s, d, "documents").select("doc_id", T.slugify(plain).alias("slug"))


@query(r"SELECT doc_id, regexp_replace(replace(replace(text, '.', '\.'), '-', '\-'), '\\([-.*\[\]_])', '\1', 'g') AS text FROM documents")
def markdown_unescape(s: SparkSession, d: str) -> DataFrame:
    escaped = F.replace(F.replace("text", F.lit("."), F.lit("\\.")), F.lit("-"), F.lit("\\-"))
    return read_table(s, d, "documents").select("doc_id", T.unescape_markdown(escaped).alias("text"))


_MIXED = "CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || text WHEN 1 THEN 'Năm 2026' || chr(10) || '-start-' || chr(10) || text ELSE text END"


def _mixed() -> F.Column:
    t = F.col("text")
    return F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\ntitle: x\n---\n"), t)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Năm 2026\n-start-\n"), t)).otherwise(t)


@query(rf"SELECT doc_id, CASE WHEN starts_with(ltrim({_MIXED}), '---') THEN 'yaml' WHEN contains({_MIXED}, '-start-') THEN 'legacy' ELSE 'none' END AS format, length(regexp_replace({_MIXED}, '(?s)\A---\s*\n.*?\n---\s*\n', ''))::BIGINT AS body_chars FROM documents")
def header_format(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents").select("doc_id", T.header_format(_mixed()).alias("format"), F.length(T.strip_frontmatter(_mixed())).cast("long").alias("body_chars"))


_LEGACY = "'Ký 31/12/2019 tại trường' || chr(10) || 'Ngày hiệu lực: 0' || (1 + doc_id % 9) || '/02/20' || (20 + doc_id % 9) || chr(10) || 'Văn bản số: ' || doc_id || '/QĐ' || chr(10) || (CASE doc_id % 3 WHEN 0 THEN 'trình độ tiến sĩ' WHEN 1 THEN 'THẠC SĨ' ELSE 'khác' END) || ' năm 20' || (20 + doc_id % 9) || chr(10) || '-start-' || chr(10)"


@query(rf"""WITH x AS (SELECT doc_id, {_LEGACY} AS head, text FROM documents)
SELECT doc_id, epoch_us(strptime(regexp_extract(head, 'Ngày hiệu lực:\s*(\d{{2}}/\d{{2}}/\d{{4}})', 1), '%d/%m/%Y'))::BIGINT AS valid_from, array_to_string(list_filter(list_transform(string_split(split_part(head, '-start-', 1), chr(10)), lambda l: trim(l)), lambda l: l <> '' AND NOT starts_with(l, 'Ngày hiệu lực:') AND NOT starts_with(l, 'Văn bản số:')), chr(10)) AS header_context, CASE doc_id % 3 WHEN 0 THEN 'tien_si' WHEN 1 THEN 'thac_si' END AS program_level, regexp_extract(head, 'năm (\d{{4}})', 1) AS academic_year, regexp_extract(head, 'Văn bản số: ([^\n]+)', 1) AS doc_number, length(regexp_replace(text, '^\s+|\s+$', '', 'g'))::BIGINT AS chars FROM x""")
def header_legacy(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    level = F.when(k % 3 == 0, "trình độ tiến sĩ").when(k % 3 == 1, "THẠC SĨ").otherwise("khác")
    head = F.concat(F.lit("Ký 31/12/2019 tại trường\nNgày hiệu lực: 0"), 1 + k % 9, F.lit("/02/20"), 20 + k % 9, F.lit("\nVăn bản số: "), k, F.lit("/QĐ\n"), level, F.lit(" năm 20"), 20 + k % 9, F.lit("\n-start-\n"))
    h = headers.legacy_header(F.concat(head, F.col("text")))
    return read_table(s, d, "documents").select("doc_id", F.unix_micros(h["valid_from"]).alias("valid_from"), h["header_context"].alias("header_context"), h["program_level"].alias("program_level"), h["academic_year"].alias("academic_year"), h["doc_number"].alias("doc_number"), F.length(h["content"]).cast("long").alias("chars"))


@query(rf"""WITH x AS (SELECT doc_id, doc_id % 4 AS k, {_LEGACY} || replace(text, '.', '\.') AS old, regexp_replace(replace(text, '.', '\.'), '\\([-.*\[\]_])', '\1', 'g') AS body, '20' || (20 + doc_id % 9) AS year, CASE doc_id % 3 WHEN 0 THEN 'trình độ tiến sĩ năm 20' WHEN 1 THEN 'THẠC SĨ năm 20' ELSE 'khác năm 20' END || (20 + doc_id % 9) AS last FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'already_yaml' WHEN 1 THEN 'no_header' ELSE 'converted' END AS status, CASE WHEN k > 1 THEN concat_ws(chr(10), '---', 'doc_type: ' || CASE k WHEN 2 THEN 'maudon' ELSE 'thongtinchung' END, 'doc_id: mau-don-' || doc_id, 'title: "' || last || '"',
 'effective_date: ' || year || '-02-0' || (1 + doc_id % 9), 'doc_number: "' || doc_id || '/QĐ"', CASE doc_id % 3 WHEN 0 THEN 'program_level: tien_si' WHEN 1 THEN 'program_level: thac_si' END, 'academic_year: "' || year || '"', CASE doc_id % 3 WHEN 0 THEN 'keywords: [tiến sĩ, NCS, nghiên cứu sinh]' WHEN 1 THEN 'keywords: [thạc sĩ, cao học, tuyển sinh]' END, '---',
 'Ký 31/12/2019 tại trường', last, '-start-', body) END AS new_text FROM x""")
def header_rewrite(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    level = F.when(k % 3 == 0, "trình độ tiến sĩ").when(k % 3 == 1, "THẠC SĨ").otherwise("khác")
    head = F.concat(F.lit("Ký 31/12/2019 tại trường\nNgày hiệu lực: 0"), 1 + k % 9, F.lit("/02/20"), 20 + k % 9, F.lit("\nVăn bản số: "), k, F.lit(" / QĐ\n"), level, F.lit(" năm 20"), 20 + k % 9, F.lit("\n\\-start\\-\n"))
    text = F.replace("text", F.lit("."), F.lit("\\."))
    made = F.when(k % 4 == 0, F.concat(F.lit("---\ntitle: x\n---\n-start-\n"), text)).when(k % 4 == 1, text).otherwise(F.concat(head, text))
    path = F.concat(F.lit("data/"), F.when(k % 4 == 2, "maudon").otherwise("x"), F.lit("/Mẫu đơn "), k, F.lit(".md"))
    return rewriting.converted(read_table(s, d, "documents").select("doc_id", path.alias("path"), made.alias("text"))).select("doc_id", "status", "new_text")


_FORM = "CASE doc_id % 4 WHEN 0 THEN '---' || chr(10) || 'title: a....b' || chr(10) || '---' || chr(10) ELSE '' END || replace(replace(replace(text, '. ', ':.....' || chr(10) || ' ..  .' || chr(10)), ', ', ' ……x'), ' a', chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || 'a   ')"
_SHORT = "line"
for _p, _r in ((r"\.{{3,}}", "___"), ("…+", "___"), (r":\s*___", ": ___"), (r"___\s*(\S)", r"___ \1"), ("  +", " "), (r"\s+$", "")):
    _SHORT = f"regexp_replace({_SHORT}, '{_p.replace('{{', '{').replace('}}', '}')}', '{_r}', 'g')"


@query(f"""WITH x AS (SELECT doc_id, string_split({_FORM}, chr(10)) AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM x),
m AS (SELECT *, trim(line) = '---' AS mark, sum(CASE WHEN trim(line) = '---' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM u),
k AS (SELECT doc_id, i, CASE WHEN mark OR n = 1 THEN line ELSE {_SHORT} END AS line FROM m WHERE mark OR n = 1 OR NOT regexp_matches(trim(line), '^[.… ]+$')),
b AS (SELECT *, trim(line) = '' AS blank, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM k),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, blank, j - r ORDER BY j) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, blank ORDER BY j) AS r FROM b))
SELECT doc_id, string_agg(line, chr(10) ORDER BY j) AS text FROM g WHERE NOT blank OR nth <= 2 GROUP BY 1""")
def form_placeholders(s: SparkSession, d: str) -> DataFrame:
    k, t, r = F.col("doc_id"), F.col("text"), F.replace
    form = r(r(r(t, F.lit(". "), F.lit(":.....\n ..  .\n")), F.lit(", "), F.lit(" ……x")), F.lit(" a"), F.lit("\n\n\n\n\na   "))
    form = F.concat(F.when(k % 4 == 0, "---\ntitle: a....b\n---\n").otherwise(""), form)
    return read_table(s, d, "documents").select("doc_id", headers.compress_placeholders(form).alias("text"))


# -- chunking --------------------------------------------------------------------------

_MD = "regexp_replace(CASE WHEN doc_id % 5 = 0 THEN text ELSE '# T' || doc_id || chr(10) || replace(text, chr(10), chr(10) || (CASE doc_id % 4 WHEN 0 THEN '## ' WHEN 1 THEN '```' || chr(10) || '# ' WHEN 2 THEN '##### ' ELSE '### ' END)) END, '\\n+$', '')"


def _markdown(s: SparkSession, d: str) -> DataFrame:
    k, t = F.col("doc_id"), F.col("text")
    mark = F.when(k % 4 == 0, "## ").when(k % 4 == 1, "```\n# ").when(k % 4 == 2, "##### ").otherwise("### ")
    md = F.when(k % 5 == 0, t).otherwise(F.concat(F.lit("# T"), k, F.lit("\n"), F.replace(t, F.lit("\n"), F.concat(F.lit("\n"), mark))))
    return read_table(s, d, "documents").select("doc_id", F.regexp_replace(md, r"\n+\z", "").alias("text"))


_LINES = rf"""md AS (SELECT doc_id, string_split({_MD.replace("\\\\", "\\")}, chr(10)) AS l FROM documents),
ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM md),
fc AS (SELECT *, coalesce(sum(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_code FROM ln),
hd AS (SELECT *, CASE WHEN NOT in_code AND regexp_matches(trim(line), '^#{{1,4}}\s+.+$') THEN length(regexp_extract(trim(line), '^(#+)', 1)) END AS level FROM fc)"""


@query(f"WITH {_LINES} SELECT doc_id, line_no, in_code FROM fc WHERE in_code OR starts_with(ltrim(line), '```')")
def code_fence_state(s: SparkSession, d: str) -> DataFrame:
    f = chunking.fences(chunking.lines(_markdown(s, d)))
    return f.filter("in_code or startswith(ltrim(line), '```')").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "in_code")


@query(rf"WITH {_LINES} SELECT doc_id, line_no, level::INT AS level, trim(regexp_extract(trim(line), '^#+\s+(.+)$', 1)) AS heading FROM hd WHERE level IS NOT NULL")
def heading_levels(s: SparkSession, d: str) -> DataFrame:
    h = chunking.headings(chunking.fences(chunking.lines(_markdown(s, d))))
    return h.filter("level is not null").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "level", "heading")


@query(rf"""WITH {_LINES}, nb AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS seq FROM hd),
sc AS (SELECT doc_id, seq, coalesce(max(level), 0) AS level, regexp_replace(string_agg(CASE WHEN level IS NULL THEN line ELSE '' END, chr(10) ORDER BY line_no), '^\s+|\s+$', '', 'g') AS body FROM nb GROUP BY 1, 2),
k AS (SELECT * FROM sc WHERE seq > 0 OR body <> '')
SELECT doc_id, seq, level::INT AS level, length(body)::BIGINT AS chars, coalesce((SELECT max(p.seq) FROM k p WHERE p.doc_id = k.doc_id AND p.seq < k.seq AND p.level < k.level), -1) AS parent_seq FROM k""")
def section_tree(s: SparkSession, d: str) -> DataFrame:
    h = chunking.headings(chunking.fences(chunking.lines(_markdown(s, d))))
    return chunking.tree(chunking.sections(h)).select("doc_id", "seq", "level", F.length("body").cast("long").alias("chars"), F.coalesce("parent_seq", F.lit(-1)).alias("parent_seq"))


@query()
def parent_chunks(s: SparkSession, d: str) -> DataFrame:
    h = chunking.headings(chunking.fences(chunking.lines(_markdown(s, d))))
    return chunking.parent_chunks(chunking.sections(h))


@query()
def ingest_chunks(s: SparkSession, d: str) -> DataFrame:
    docs = _markdown(s, d).join(read_table(s, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    return chunking.hierarchy(docs, providers.with_embeddings)


@query()
def ingest_chunks_fallback(s: SparkSession, d: str) -> DataFrame:
    return chunking.hierarchy(_markdown(s, d), None)


_BARE = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CLEAN = _BARE.format(r"regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')".replace("{{", "{").replace("}}", "}"))
_SENTENCES = rf"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?;])\s+([A-ZÀ-Ỹa-zà-ỹ\d])', '\1' || chr(1) || '\2', 'g'), chr(1) || '|\n\n'), lambda x: {_BARE.format('x')}), lambda x: x <> '')"
#: Groups, as a fold over lists of one group of one item each.
_GROUPS = "list_reduce(list_transform({items}, lambda x: [[x]]), lambda a, b: CASE WHEN {closed} THEN a || [{carried}b[1]] ELSE a[:-2] || [a[-1] || b[1]] END)"
_EACH = "SELECT doc_id, i::INT AS chunk_index, len(g)::INT AS total, {content} AS content FROM (SELECT doc_id, g, unnest(range(1, len(g) + 1)) AS i FROM g)"


@query(f"""WITH t AS (SELECT doc_id, {_CLEAN} AS text FROM documents), s AS (SELECT doc_id, {_SENTENCES} AS s FROM t),
g AS (SELECT doc_id, {_GROUPS.format(items="s", closed="list_sum(list_transform(a[-1], lambda y: length(y))) + length(b[1][1]) > 2800", carried="a[-1][-2:] || ")} AS g FROM s WHERE len(s) > 0)
{_EACH.format(content="array_to_string(g[i], ' ')")}""")
def fallback_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_texts(read_table(s, d, "documents"))


@query(rf"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(list_filter(l, lambda x: starts_with(x, '|'))) >= 2 AND len(list_filter(l, lambda x: regexp_matches(x, '^\|[\s\-:|]+\|'))) > 0 THEN [{{'t': {_BARE.format("text")}, 'h': true}}]
 ELSE flatten(list_transform({_SENTENCES}, lambda x: CASE WHEN length(x) > 600 THEN list_transform(list_filter(list_transform(range(0, (length(x) - 1) // 300 + 1), lambda i: {_BARE.format("substr(x, i * 300 + 1, 300)")}), lambda p: p <> ''), lambda p: {{'t': p, 'h': true}}) ELSE [{{'t': x, 'h': false}}] END)) END AS s FROM l),
g AS (SELECT doc_id, {_GROUPS.format(items="s", closed="b[1][1].h OR a[-1][1].h OR list_sum(list_transform(a[-1], lambda y: length(y.t))) + length(b[1][1].t) > 300", carried="")} AS g FROM s WHERE len(s) > 0)
{_EACH.format(content="array_to_string(list_transform(g[i], lambda y: y.t), ' ')")}""")
def base_blocks(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_texts(read_table(s, d, "documents"), chunking.base_blocks)


_NAMES = ["KẾ TOÁN", "QUẢN TRỊ KINH DOANH (ứng dụng)", "Tài chính – Ngân hàng", "XYZ"]
_PROGRAM = ", ".join(f"'{n}'" for n in _NAMES)
_HEADINGS = "|".join(structured.SECTION_HEADINGS)


@query(rf"""WITH f AS (SELECT doc_id, 'd' || doc_id || '.txt' AS source, CASE doc_id % 3 WHEN 0 THEN 'thac_si' WHEN 1 THEN 'tien_si' ELSE 'unknown' END AS program_level, text AS body, [{_PROGRAM}][doc_id % 4 + 1] AS n FROM documents),
t AS (SELECT *, {_BARE.format("CASE WHEN doc_id % 5 = 0 THEN replace(body, '. ', '.' || chr(10) || '  ' || chr(10)) ELSE '**CHƯƠNG TRÌNH ĐÀO TẠO NGÀNH ' || n || '**' || chr(10) || replace(body, '. ', '.' || chr(10) || chr(10)) || chr(10) || 'Điều kiện xét tuyển  ' || chr(10) || left(body, 200) || chr(10) || '**CHUẨN ĐẦU RA**' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE ' ' END END")} AS text FROM f),
h AS (SELECT *, regexp_extract_all(text, '(?mi)^(?:\*\*)?({_HEADINGS})(?:\*\*)?\s*\r?$', 1) AS h, string_split_regex(text, '(?mi)^(?:\*\*)?({_HEADINGS})(?:\*\*)?\s*\r?$') AS b FROM t),
s AS (SELECT source, program_level, list_filter(CASE WHEN len(h) = 0 THEN [{{'heading': '(Toàn văn)', 'body': text}}] ELSE list_transform(range(1, len(h) + 1), lambda i: {{'heading': {_BARE.format("h[i]")}, 'body': {_BARE.format("b[i + 1]")}}}) END, lambda x: x.body <> '') AS s,
 CASE WHEN doc_id % 5 = 0 THEN '(Toàn Văn)' ELSE ['Kế Toán', 'Quản Trị Kinh Doanh', 'Tài chính – Ngân hàng', 'Xyz'][doc_id % 4 + 1] END AS program_name, CASE program_level WHEN 'thac_si' THEN 'Thạc sĩ' WHEN 'tien_si' THEN 'Tiến sĩ' ELSE program_level END AS label FROM h),
p AS (SELECT *, CASE program_level || program_name WHEN 'thac_siKế Toán' THEN '8340301' WHEN 'thac_siQuản Trị Kinh Doanh' THEN '8340101' WHEN 'tien_siQuản Trị Kinh Doanh' THEN '9340101' WHEN 'thac_siTài chính – Ngân hàng' THEN '8340201' WHEN 'tien_siTài chính – Ngân hàng' THEN '9340201' END AS code,
 CASE program_name WHEN 'Kế Toán' THEN ' (KT, kt, Kế toán)' WHEN 'Quản Trị Kinh Doanh' THEN ' (QTKD, qtkd, Quản trị KD)' WHEN 'Tài chính – Ngân hàng' THEN ' (TC-NH, TCNH, tc-nh, tcnh, Tài chính Ngân hàng)' ELSE '' END AS short FROM s WHERE len(s) > 0),
e AS (SELECT source, program_level, program_name, code, label, '[Chương trình: ' || label || ' ' || program_name || short || coalesce(' | Mã ngành: ' || code, '') || ']' AS prefix, len(s) AS total, unnest(range(1, len(s) + 1)) AS i, s FROM p),
c AS (SELECT *, s[i].heading AS heading, s[i].body AS body, CASE WHEN length(s[i].body) // 3 > 300 THEN list_reduce(list_transform(list_filter(string_split_regex(s[i].body, '\n(?:[^\S\n]*\n)+'), lambda x: NOT regexp_matches(x, '^\s*$')), lambda x: [x]), lambda a, b: CASE WHEN length(a[-1]) < 50 THEN a[:-2] || [a[-1] || chr(10) || chr(10) || b[1]] ELSE a || b END) ELSE [s[i].body] END AS parts FROM e),
r AS (SELECT *, 'parent' AS chunk_level, i AS chunk_index, total AS n, prefix || chr(10) || heading || chr(10) || chr(10) || body AS content FROM c UNION ALL SELECT * EXCLUDE j, 'child', j, len(parts), prefix || ' — ' || heading || chr(10) || chr(10) || parts[j] FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM c))
SELECT source, chunk_level, chunk_index::INT AS chunk_index, n::INT AS total, label || ' ' || program_name || ' > ' || heading AS section_path, program_name, program_level, code AS program_code, content, sha256(content) AS content_hash, CASE chunk_level WHEN 'parent' THEN len(parts) ELSE 0 END::INT AS n_children FROM r""".replace("[^\\S\\n]", "[ \\t\\f\\r]"))
def structured_chunks(s: SparkSession, d: str) -> DataFrame:
    k, t, r = F.col("doc_id"), F.col("text"), F.replace
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (k % 4 + 1).cast("int"))
    path = F.concat(F.when(k % 3 == 0, "data/Ctrinh Thac Si/").when(k % 3 == 1, "data/Ctrinh Tien Si/").otherwise("data/x/"), F.lit("d"), k, F.lit(".txt"))
    headed = F.concat(F.lit("**CHƯƠNG TRÌNH ĐÀO TẠO NGÀNH "), name, F.lit("**\n"), r(t, F.lit(". "), F.lit(".\n\n")), F.lit("\nĐiều kiện xét tuyển  \n"), F.left(t, F.lit(200)), F.lit("\n**CHUẨN ĐẦU RA**\n"), F.when(k % 2 == 0, "x").otherwise(" "))
    docs = read_table(s, d, "documents").select(F.concat(F.lit("d"), k, F.lit(".txt")).alias("source"), path.alias("path"), F.when(k % 5 == 0, r(t, F.lit(". "), F.lit(".\n  \n"))).otherwise(headed).alias("text"))
    return structured.chunks(docs).select("source", "chunk_level", "chunk_index", "total", "section_path", "program_name", "program_level", "program_code", "content", "content_hash", F.size("children_ids").alias("n_children"))


@query(f"""WITH s AS (SELECT page_id AS doc_id, string_split(html, chr(10)) AS s FROM pages), g AS (SELECT doc_id, {_GROUPS.format(items="s", closed="list_sum(list_transform(a[-1], lambda y: length(y))) + length(b[1][1]) > 20000", carried="")} AS g FROM s)
{_EACH.format(content="array_to_string(g[i], chr(10))")}""")
def html_line_pack(s: SparkSession, d: str) -> DataFrame:
    pages = read_table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return chunking.chunk_texts(pages, chunking.pack_lines)


@query(rf"""WITH p AS (SELECT page_id, page_id AS doc_id, replace(html, '><', '>' || chr(10) || '<') AS html, 'Trang ' || page_id AS title FROM pages), s AS (SELECT *, string_split(html, chr(10)) AS s FROM p),
g AS (SELECT page_id, title, {_GROUPS.format(items="s", closed="list_sum(list_transform(a[-1], lambda y: length(y))) + length(b[1][1]) > 2000", carried="")} AS g FROM s),
q AS (SELECT page_id, title, len(g) AS n, i, 'Tiêu đề: ' || title || ' (Phần ' || i || '/' || len(g) || ')' || chr(10) || chr(10) || 'Nội dung HTML phần này:' || chr(10) || array_to_string(g[i], chr(10)) AS text FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM g)),
w AS (SELECT page_id, title, n, bool_or(contains(text, 'xxx')) AS failed, string_agg({_BARE.format("'first says ' || text")}, chr(10) || chr(10) ORDER BY i) AS body FROM q GROUP BY ALL)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Ban_Nhaps.md' ELSE 'p' || page_id || '.md' END AS file_name, CASE WHEN NOT failed THEN '---' || chr(10) || 'title: "' || title || '"' || chr(10) || 'academic_year: "2026"' || chr(10) || '---' || chr(10) || '-start-' || chr(10) || chr(10) || {_BARE.format("body")} END AS content, n::INT AS n_parts, CASE WHEN failed THEN 'first: bad request' END AS error FROM w""")
def html_compose(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    pages = read_table(s, d, "pages").select("page_id", F.replace("html", F.lit("><"), F.lit(">\n<")).alias("html"), F.concat(F.lit("Trang "), "page_id").alias("title"), F.when(k % 2 == 1, F.concat(F.lit("p"), k)).alias("file_name"), F.lit("").alias("program_level"), F.lit(None).cast("string").alias("program_name"), F.lit("2026").alias("academic_year"), F.lit(None).cast("string").alias("reference_url"))
    return compose.composed(pages, lambda rows: providers.answered(rows, lambda: [providers.StandIn("first", 0, "xxx")], base=0.0), 2000)


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || text || ' |' WHEN doc_id % 3 = 1 THEN '| a |' || chr(10) || text ELSE text END AS text FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM t)
SELECT doc_id, len(list_filter(l, lambda x: starts_with(x, '|'))) >= 2 AND len(list_filter(l, lambda x: regexp_matches(x, '^\\|[\\s\\-:|]+\\|'))) > 0 AS is_table FROM l""".replace("\\\\", "\\"))
def table_detect(s: SparkSession, d: str) -> DataFrame:
    k, t = F.col("doc_id"), F.col("text")
    made = F.when(k % 3 == 0, F.concat(F.lit("| a | b |\n|---|:-:|\n| "), t, F.lit(" |"))).when(k % 3 == 1, F.concat(F.lit("| a |\n"), t)).otherwise(t)
    return read_table(s, d, "documents").select("doc_id", T.is_table(made).alias("is_table"))


@query("""WITH b AS (SELECT label AS doc_id, vec_id AS seq, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT *, lag(e) OVER w AS p FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
s AS (SELECT doc_id, seq, CASE WHEN p IS NULL THEN 1.0 ELSE round(list_cosine_similarity(e, p), 6) END AS similarity, CASE WHEN p IS NULL OR round(list_cosine_similarity(e, p), 6) < 0.1 THEN 1 ELSE 0 END AS cut FROM x)
SELECT doc_id, seq, similarity, sum(cut) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS chunk_no FROM s""")
def semantic_boundaries(s: SparkSession, d: str) -> DataFrame:
    b = read_table(s, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("seq"), "embedding")
    return chunking.boundaries(b, 0.1).select("doc_id", "seq", "similarity", F.col("chunk_no").cast("long").alias("chunk_no"))


# -- dialogue --------------------------------------------------------------------------

_TEEN = "lower(text)"
for _k in sorted(config.TEENCODE, key=len, reverse=True):
    for _ in range(2):  # without look-around, neighbours share their separator
        _TEEN = rf"regexp_replace({_TEEN}, '(^|[^\p{{L}}\p{{N}}_]){_k}($|[^\p{{L}}\p{{N}}_])', '\1{config.TEENCODE[_k]}\2', 'g')"
_RULES = [(1, i, p) for i, p in enumerate(config.BANNED)] + [(2, i, p) for i, p in enumerate(config.INJECTION)]


@query("WITH t AS (SELECT conv_id, turn, text, " + _TEEN + " AS n FROM conversations) SELECT conv_id, turn, CASE WHEN length(text) > 3000 THEN 0 " + " ".join(f"WHEN regexp_matches(n, '(?i){p}') THEN {layer}" for layer, _, p in _RULES) + " ELSE -1 END AS layer FROM t")
def guard_scan(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "conversations").select("conv_id", "turn", T.guard(F.col("text"))["layer"].alias("layer"))


@query(f"SELECT conv_id, turn, {_TEEN} AS text FROM conversations")
def teencode_normalize(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "conversations").select("conv_id", "turn", T.normalize_teencode(F.col("text")).alias("text"))


@query()
def metadata_extract(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "conversations").select("conv_id", "turn", dialogue.metadata(F.col("text")).alias("m")).select("conv_id", "turn", "m.*")


_LABELS = sorted(config.INTENT_ACTIONS) + ["UNHEARD_OF"]
_PICK = "CASE " + " ".join(f"WHEN (conv_id + turn) % {len(_LABELS)} = {i} THEN '{n}'" for i, n in enumerate(_LABELS)) + " END"
_ACT = f"CASE WHEN length(trim(text)) < 5 THEN 'GREET' ELSE CASE {_PICK} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.INTENT_ACTIONS.items()) + " ELSE 'CLARIFY' END END"


@query(f"WITH a AS (SELECT conv_id, turn, {_ACT} AS action FROM conversations) SELECT conv_id, turn, action, CASE WHEN starts_with(action, 'PROCEED_RAG') THEN 'multi_query' WHEN action = 'PROCEED_FORM' THEN 'form' WHEN action = 'PROCEED_CARE' THEN 'care' ELSE 'response' END AS next_node, CASE WHEN action IN ('PROCEED_RAG_UFM_SEARCH', 'PROCEED_RAG_PR_SEARCH') THEN 'rag_search' ELSE 'response' END AS after_rag FROM a")
def intent_route(s: SparkSession, d: str) -> DataFrame:
    at = (F.col("conv_id") + F.col("turn")) % len(_LABELS)
    intent = F.element_at(F.array(*map(F.lit, _LABELS)), (at + 1).cast("int"))
    a = read_table(s, d, "conversations").select("conv_id", "turn", dialogue.action(intent, F.col("text")).alias("action"))
    return a.select("conv_id", "turn", "action", dialogue.next_node(F.lit(True), F.col("action")).alias("next_node"), dialogue.after_rag(F.col("action")).alias("after_rag"))


@query("SELECT doc_id, CASE WHEN length(text) > 3000 THEN 'block' WHEN length(text) >= 2000 THEN 'summarize' WHEN length(text) < 5 THEN 'greet' ELSE 'pass' END AS gate FROM documents")
def request_gate(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents").select("doc_id", dialogue.request_gate(F.col("text")).alias("gate"))


@query("SELECT conv_id, turn, role, CASE WHEN length(text) > 400 THEN left(text, 400) || '...' ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4")
def history_window(s: SparkSession, d: str) -> DataFrame:
    return dialogue.history(read_table(s, d, "conversations")).select("conv_id", "turn", "role", "text")


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Người dùng' ELSE 'Bot' END AS name, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, string_agg(name || ': ' || CASE WHEN length(text) <= 300 THEN text WHEN turn % 3 = 0 THEN left(translate(left(text, 200), 'aeiou', 'AEIOU'), 120) ELSE left(text, 120) || '...' END, chr(10) ORDER BY turn) AS history FROM l WHERE back <= 4 GROUP BY 1""")
def history_prompt(s: SparkSession, d: str) -> DataFrame:
    """Every third turn has a summary: its first 200 characters, vowels in capitals."""
    m = read_table(s, d, "conversations").withColumn("summary", F.when(F.col("turn") % 3 == 0, F.translate(F.left("text", F.lit(200)), "aeiou", "AEIOU")))
    return dialogue.transcript(m)


@query("""SELECT conv_id, turn, coalesce(string_agg(line, chr(10) ORDER BY t), '') AS history FROM (SELECT a.conv_id, a.turn, b.turn AS t, b.role || ': ' || coalesce(b.text, '') AS line, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS back
FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn) WHERE back <= 3 GROUP BY 1, 2""")
def recent_messages(s: SparkSession, d: str) -> DataFrame:
    return dialogue.recent(read_table(s, d, "conversations"), 3).select("conv_id", "turn", F.array_join("history", "\n").alias("history"))


@query("""WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_id % 3 = 0), g AS (SELECT user_id, ts, event_id FROM events WHERE event_id % 3 > 0),
j AS (SELECT g.event_id AS request_id, g.ts, p.ts AS put_ts, p.event_id AS doc, row_number() OVER (PARTITION BY g.event_id ORDER BY p.ts DESC, p.event_id DESC) AS n FROM g LEFT JOIN p ON p.user_id = g.user_id AND (p.ts, p.event_id) < (g.ts, g.event_id))
SELECT request_id, CASE WHEN epoch_us(ts) - epoch_us(put_ts) <= 36000000000 THEN 'd' || doc END AS document FROM j WHERE n = 1""")
def session_lookup(s: SparkSession, d: str) -> DataFrame:
    """Every third event puts a document into its user's session, which lives ten hours."""
    e = read_table(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("request_id"))
    puts = e.filter("request_id % 3 = 0").withColumn("document", F.concat(F.lit("d"), "request_id"))
    return dialogue.session_lookup(puts, e.filter("request_id % 3 > 0"), 36_000)


def _cache_sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = read_table(s, d, "embeddings").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id") * 600))
    ask = e.select(F.col("vec_id").alias("request_id"), F.col("label").alias("action"), F.col("at").alias("asked_at"), "embedding")
    saved = F.col("at") + F.expr("interval 1 second")  # an answer is saved after its own request
    return ask, e.select(F.col("vec_id").alias("entry_id"), F.col("label").alias("action"), saved.alias("saved_at"), "embedding")


@query("""WITH p AS (SELECT r.vec_id AS request_id, c.vec_id AS entry_id, round(list_cosine_similarity(r.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity FROM embeddings r JOIN embeddings c ON r.label = c.label WHERE c.vec_id < r.vec_id AND (r.vec_id - c.vec_id) * 600 - 1 < 86400),
b AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, entry_id) AS n FROM p WHERE similarity > 0) SELECT request_id, entry_id, similarity, similarity >= 0.8 AS hit FROM b WHERE n = 1""")
def cache_lookup(s: SparkSession, d: str) -> DataFrame:
    return dialogue.cache_lookup(*_cache_sides(s, d))


@query("SELECT event_id AS entry_id FROM events WHERE event_id % 4 > 0 ORDER BY ts DESC, event_id DESC LIMIT 200")
def cache_fifo(s: SparkSession, d: str) -> DataFrame:
    e = read_table(s, d, "events").select(F.col("event_id").alias("entry_id"), F.col("ts").alias("saved_at"), (F.col("event_id") % 4).alias("n_results"))
    return dialogue.cache_state(e).select("entry_id")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n_window, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) > 10 AS over FROM events")
def rate_limit_window(s: SparkSession, d: str) -> DataFrame:
    e = read_table(s, d, "events").select("event_id", F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    return dialogue.request_counts(e).select("event_id", "n_window", "over")


@query("SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-15 12:00:00') - floor(epoch(ts)) < 86400 * 3")
def session_ttl(s: SparkSession, d: str) -> DataFrame:
    e = read_table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return dialogue.live(e, F.lit("2024-01-15 12:00:00").cast("timestamp"), 3 * 86400).select("event_id")


@query(r"SELECT conv_id, turn, len(regexp_extract_all(text, '[^.!?,;:\n]*[.!?,;:\n]+\s*|[^.!?,;:\n]+'))::BIGINT AS n_pieces FROM conversations")
def sse_chunks(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "conversations").select("conv_id", "turn", F.size(T.sse_pieces(F.col("text"))).cast("long").alias("n_pieces"))


@query(r"""SELECT event_id, nullif(regexp_extract('Here: ```json' || chr(10) || props || '```', '(\{[^{}]*\})', 1), '') AS object FROM events""")
def json_extract(s: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("Here: ```json\n"), F.col("props"), F.lit("```"))
    return read_table(s, d, "events").select("event_id", T.first_object(made).alias("object"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def embedding_norms(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


# -- queries and answers of models -----------------------------------------------------

_DEFAULTS = ", ".join(f"'{x}'" for x in config.SITES)
_ASK = "CASE (conv_id + turn) % 4 WHEN 0 THEN text || ' học phí và KÝ TÚC XÁ' WHEN 1 THEN text || ' hồ sơ 2025' ELSE text END"
_NAMED = ", ".join(f"CASE WHEN contains(lower(q), '{w}') THEN '{d}' END" for w, d in answers.DOMAINS)


def _ask() -> F.Column:
    k, t = (F.col("conv_id") + F.col("turn")) % 4, F.col("text")
    return F.when(k == 0, F.concat(t, F.lit(" học phí và KÝ TÚC XÁ"))).when(k == 1, F.concat(t, F.lit(" hồ sơ 2025"))).otherwise(t)


@query(rf"""WITH a AS (SELECT conv_id, turn, {_ASK} AS q FROM conversations), f AS (SELECT *, list_filter([{_NAMED}, 'ufm.edu.vn', {_DEFAULTS}], lambda x: x IS NOT NULL) AS d FROM a),
u AS (SELECT *, list_filter(d, lambda x, i: list_position(d, x) = i)[:3] AS sites, CASE WHEN regexp_matches(q, '20[2-3][0-9]') THEN q ELSE q || ' năm 2025 2026' END AS anchored FROM f)
SELECT conv_id, turn, anchored, array_to_string(sites, ',') AS sites, anchored || ' ' || array_to_string(list_transform(sites, lambda x: 'site:' || x), ' OR ') AS search,
 regexp_replace(replace(upper(replace(left(q, 50), 'ß', 'SS')), ' ', '_'), '[^\p{{L}}\p{{N}}_]', '', 'g') AS slug, left(q, 200) AS preview FROM u""")
def search_strings(s: SparkSession, d: str) -> DataFrame:
    q = read_table(s, d, "conversations").select("conv_id", "turn", _ask().alias("q"))
    q = q.withColumn("anchored", answers.with_year(F.col("q"), 2026)).withColumn("sites", answers.domains(F.col("q"), config.SITES))
    search = answers.search_string(F.col("anchored"), F.col("sites"))
    return q.select("conv_id", "turn", "anchored", F.array_join("sites", ",").alias("sites"), search.alias("search"), answers.log_slug(F.col("q")).alias("slug"), answers.preview(F.col("q")).alias("preview"))


_PRESS = ", ".join(f"'{x}'" for x in config.PRESS_SITES)


@query(rf"""WITH a AS (SELECT conv_id, turn, {_ASK} AS q, turn % 2 = 0 AS school, CASE (conv_id + turn) % 3 WHEN 0 THEN ['a ' || turn, 'b 2031', 'c'] WHEN 1 THEN ['một'] ELSE [] END AS own, CASE conv_id % 3 WHEN 0 THEN 'báo ' || conv_id ELSE NULL END AS press FROM conversations),
f AS (SELECT *, list_filter([{_NAMED}, 'ufm.edu.vn', {_DEFAULTS}], lambda x: x IS NOT NULL) AS d FROM a),
t AS (SELECT *, CASE WHEN school THEN list_filter(d, lambda x, i: list_position(d, x) = i)[:3] ELSE [{_PRESS}] END AS sites, CASE WHEN school THEN CASE WHEN len(own) > 0 THEN array_to_string(own[:2], ' | ') ELSE q END ELSE coalesce(press, q) END AS asked FROM f),
y AS (SELECT *, CASE WHEN regexp_matches(asked, '20[2-3][0-9]') THEN asked ELSE asked || ' năm 2025 2026' END AS terms FROM t)
SELECT conv_id, turn, terms, array_to_string(sites, ',') AS sites, terms || ' ' || array_to_string(list_transform(sites, lambda x: 'site:' || x), ' OR ') AS search FROM y""")
def web_searches(s: SparkSession, d: str) -> DataFrame:
    q = read_table(s, d, "conversations").select("conv_id", "turn", _ask().alias("q"))
    three = (F.col("conv_id") + F.col("turn")) % 3
    raw = F.when(three == 0, F.concat(F.lit("1. a "), "turn", F.lit('\n-"b 2031"\n\n*c'))).when(three == 1, "một\n").otherwise("")
    press = answers.press_query(F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(' "1. báo '), "conv_id", F.lit('" '))).otherwise(" '' "))
    act = F.when(F.col("turn") % 2 == 0, "PROCEED_RAG_UFM_SEARCH").otherwise("PROCEED_RAG_PR_SEARCH")
    w = answers.web_search(act, F.col("q"), answers.search_queries(raw), press, 2026)
    return q.select("conv_id", "turn", w["terms"].alias("terms"), F.array_join(w["sites"], ",").alias("sites"), w["search"].alias("search"))


_LISTED = "'1. ' || replace(text, '. ', chr(10) || '2) ') || chr(10) || ' - x' || chr(10) || '• ' || text"


@query(rf"""WITH r AS (SELECT doc_id, {_LISTED} AS raw FROM documents), v AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(raw, '^\s+|\s+$', '', 'g'), chr(10)),
 lambda l: regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '^\s+|\s+$', '', 'g'), '^\s*[0-9]+[.)\]]\s*', ''), '^\s*[-•]\s*', ''), '^\s+|\s+$', '', 'g')), lambda l: length(l) > 5) AS v FROM r)
SELECT doc_id, len(v)::BIGINT AS n, sha256(array_to_string(v, chr(10))) AS variants FROM v""")
def variant_lists(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    raw = F.concat(F.lit("1. "), F.replace(t, F.lit(". "), F.lit("\n2) ")), F.lit("\n - x\n• "), t)
    v = read_table(s, d, "documents").select("doc_id", answers.variants(raw).alias("v"))
    return v.select("doc_id", F.size("v").cast("long").alias("n"), F.sha2(F.array_join("v", "\n"), 256).alias("variants"))


@query("""SELECT event_id, event_id % 4 <> 0 AS passed, CASE event_id % 4 WHEN 0 THEN 'why' || event_id WHEN 1 THEN 'ok' ELSE '' END AS critique,
 CASE WHEN event_id % 4 < 2 THEN event_id::VARCHAR END AS event, CASE WHEN event_id % 4 < 2 AND event_id <> 0 THEN 1 ELSE 0 END::BIGINT AS n_fields FROM events""")
def model_answers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("So: ```json\n{\"passed\": false, \"critique\": \" why"), k, F.lit(" \", \"id\": "), k, F.lit("}\n```")))
        .when(k % 4 == 1, F.concat(F.lit('{"passed": true, "critique": "ok", "id": '), k, F.lit("} and more")))
        .when(k % 4 == 2, F.lit("passed: true, no object"))
        .otherwise(F.lit("{broken"))
    )
    fields = F.map_filter(answers.form_fields(F.regexp_extract(raw, r"(\{[^}]*\})", 1)), lambda n, v: n == "id")
    v = answers.verdict(raw)
    return read_table(s, d, "events").select("event_id", v["passed"].alias("passed"), v["critique"].alias("critique"), F.element_at(answers.answer_object(raw), "id").alias("event"), F.size(fields).cast("long").alias("n_fields"))


@query(r"""SELECT doc_id, concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 3 > 0 THEN '[DỮ LIỆU NỘI BỘ]' || chr(10) || text END, CASE WHEN doc_id % 2 = 0 THEN '[DỮ LIỆU TỪ WEB]' || chr(10) || source END,
 CASE WHEN doc_id % 2 = 0 THEN '[NGUỒN TRÍCH DẪN]' || chr(10) || '- [a](http://a)' || chr(10) || '- [b](http://b)' END) AS context,
 doc_id % 3 > 0 AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 50 AND doc_id % 5 = 0 AS enough, CASE WHEN doc_id % 7 = 0 THEN left(text, 1200) || '...' WHEN length(trim(source || text)) >= 1200 THEN left(trim(source || text), 1197) || '...' ELSE source || regexp_replace(text, '\s+$', '') END AS short FROM documents""")
def merged_contexts(s: SparkSession, d: str) -> DataFrame:
    k, t = F.col("doc_id"), F.col("text")
    links = F.array(*[F.struct(F.lit(x).alias("text"), F.lit(f"http://{x}").alias("url")) for x in "ab"])
    inner = F.when(k % 3 > 0, t).otherwise("")
    said = F.when(k % 5 == 0, " yes, it does").otherwise("No")
    short = answers.shortened(t, F.when(k % 7 == 0, "  ").otherwise(F.concat("source", t)))
    return read_table(s, d, "documents").select("doc_id", answers.merged_context(inner, F.when(k % 2 == 0, F.col("source")), links).alias("context"), answers.is_enough(inner, said).alias("enough"), short.alias("short"))


@query(f"""WITH s AS (SELECT q.vec_id - q.vec_id % 20 AS query_id, c.vec_id AS chunk_id, max({_COS}) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 IN (0, 1) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, score, rank::INT AS rank FROM r WHERE rank <= 7""")
def variant_max(s: SparkSession, d: str) -> DataFrame:
    both = read_table(s, d, "embeddings").filter("vec_id % 20 < 2").select(F.col("vec_id").alias("query_id"), "embedding")
    top = retrieval.vector_topk(_corpus(s, d), both)  # a chunk among the best over all variants is among the best of one
    return answers.best_over_variants(top.withColumn("query_id", F.col("query_id") - F.col("query_id") % 20))


@query("""WITH n AS (SELECT sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings WHERE embedding IS NOT NULL), b AS (SELECT least(floor(n * 10), 20)::INT AS bin, count(*) AS c FROM n GROUP BY 1)
SELECT count(*) AS n, round(avg(n), 6) AS avg, round(min(n), 6) AS min, round(max(n), 6) AS max, round(stddev_pop(n), 4) AS stddev, (SELECT string_agg(bin || ':' || c, ',' ORDER BY bin) FROM b) AS distribution FROM n""")
def embedding_shape(s: SparkSession, d: str) -> DataFrame:
    return answers.vector_shape(read_table(s, d, "embeddings"))


@query(f"WITH {_CHUNKS} SELECT chunk_id, content, created_at FROM chunks WHERE source = (SELECT min(source) FROM documents) AND is_active")
def document_detail(s: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(s, d)
    first = chunks.agg(F.min("source")).first()[0]
    return answers.document_detail(chunks, first).select("chunk_id", "content", "created_at")


@query(f"WITH {_LOGS} SELECT file_name, status, log_id FROM logs WHERE file_name NOT IN ('src1', 'src3')")
def log_removal(s: SparkSession, d: str) -> DataFrame:
    return answers.without_logs(_logs(s, d), s.createDataFrame([("src1",), ("src3",)], "file_name string"))


@query("""WITH t AS (SELECT event_id AS task_id, CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' ELSE 'pending' END AS status FROM events)
SELECT task_id, CASE WHEN task_id % 2 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN task_id % 2 = 0 THEN 'Bị hủy bởi Admin' END AS message FROM t""")
def task_cancel(s: SparkSession, d: str) -> DataFrame:
    k = F.col("task_id")
    t = read_table(s, d, "events").select(F.col("event_id").alias("task_id")).withColumn("status", F.when(k % 3 == 0, "completed").when(k % 3 == 1, "running").otherwise("pending"))
    return answers.cancelled(t.withColumn("message", F.lit(None).cast("string")), t.filter("task_id % 2 = 0").select("task_id"))


@query("SELECT count(*) AS size, count(*) FILTER (epoch(TIMESTAMP '2024-01-15 12:00:00') - floor(epoch(ts)) < 86400) AS alive, 200 AS max_size, 0.8::DOUBLE AS threshold, 86400 AS ttl_seconds FROM events")
def cache_statistics(s: SparkSession, d: str) -> DataFrame:
    e = read_table(s, d, "events").select(F.col("ts").cast("timestamp").alias("saved_at"))
    return answers.cache_statistics(e, F.lit("2024-01-15 12:00:00").cast("timestamp"))


@query("""SELECT doc_id, source || '|' || least(doc_id % 4 + 1, 3) || '|' || CASE WHEN doc_id % 4 = 0 THEN 'none' ELSE 'c' || (least(doc_id % 4 + 1, 3) - 1) END AS draft, true AS passed,
CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'c' || (least(doc_id % 4 + 1, 3) - 1) END AS critique, least(doc_id % 4 + 1, 3)::INT AS rounds FROM documents""")
def verify_loop(s: SparkSession, d: str) -> DataFrame:
    """Drafts that pass in the first to fourth round, of which three are made."""
    draft = lambda r: r.withColumn("draft", F.concat_ws("|", "source", "round", F.coalesce("critique", F.lit("none"))))
    check = lambda r: r.withColumn("passed", F.col("round") > F.col("doc_id") % 4).withColumn("said", F.concat(F.lit("c"), "round"))
    return loops.refined(read_table(s, d, "documents").select("doc_id", "source"), draft, check, 2).drop("source")


def _chain() -> list[providers.StandIn]:
    return [providers.StandIn("first", 1, " der "), providers.StandIn("second", 0, " le ")]


@query("""SELECT conv_id, turn, CASE WHEN NOT contains(text, ' der ') THEN 'first says ' || text WHEN NOT contains(text, ' le ') THEN 'second says ' || text END AS answer, CASE WHEN NOT contains(text, ' der ') THEN 'first' WHEN NOT contains(text, ' le ') THEN 'second' END AS provider,
contains(text, ' der ') AS failed FROM conversations""")
def provider_answers(s: SparkSession, d: str) -> DataFrame:
    """Two providers, of which the first fails once on each text and for good on some."""
    a = providers.answered(read_table(s, d, "conversations"), _chain, base=0.0)
    return a.select("conv_id", "turn", "answer", "provider", F.contains(F.coalesce("error", F.lit("")), F.lit("bad request")).alias("failed"))


_ACTIONS = ["GREET", "CLARIFY", "BLOCK_FALLBACK", "PROCEED_RAG"]
_REFUSALS = {"TAN_CONG_HE_THONG": "Không được. ", "CAU_HOI_LAC_DE": " Lạc đề."}
_REFUSED = "CASE conv_id % 3 WHEN 0 THEN 'TAN_CONG_HE_THONG' WHEN 1 THEN 'CAU_HOI_LAC_DE' ELSE 'KHAC' END"


@query(f"""WITH x AS (SELECT conv_id, turn, (conv_id + turn) % 4 AS k, {_REFUSED} AS intent FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'Chào!' || chr(10) || '---' || chr(10) || 'Liên hệ' WHEN 1 THEN 'Sao ạ?' || chr(10) || '---' || chr(10) || 'Liên hệ' WHEN 2 THEN CASE intent WHEN 'TAN_CONG_HE_THONG' THEN 'Không được.' WHEN 'CAU_HOI_LAC_DE' THEN 'Lạc đề.' ELSE 'Xin lỗi.' END || chr(10) || 'Liên hệ' END AS response,
CASE k WHEN 0 THEN 'greet_template' WHEN 1 THEN 'clarify_template' WHEN 2 THEN 'intent_block' END AS source FROM x""")
def instant_responses(s: SparkSession, d: str) -> DataFrame:
    c, k = F.col("conv_id"), (F.col("conv_id") + F.col("turn")) % 4
    act = F.element_at(F.array(*map(F.lit, _ACTIONS)), (k + 1).cast("int"))
    intent = F.when(c % 3 == 0, "TAN_CONG_HE_THONG").when(c % 3 == 1, "CAU_HOI_LAC_DE").otherwise("KHAC")
    r = responses.instant(act, intent, c, ["Chào!"], ["Sao ạ?"], _REFUSALS, "Xin lỗi.", "Liên hệ")
    return read_table(s, d, "conversations").select("conv_id", "turn", r["response"].alias("response"), r["source"].alias("source"))


@query("WITH t AS (SELECT conv_id, turn, text, " + _TEEN + " AS n FROM conversations), g AS (SELECT *, CASE WHEN length(text) > 3000 THEN 0 " + " ".join(f"WHEN regexp_matches(n, '(?i){p}') THEN {layer}" for layer, _, p in _RULES) + """ ELSE -1 END AS layer FROM t)
SELECT conv_id, turn, layer < 0 AS passed, CASE WHEN layer >= 0 THEN least(layer, 1) END::INT AS layer, CASE WHEN layer = 0 THEN lower(left(text, 200)) ELSE n END AS normalized, CASE layer WHEN 0 THEN 'dài' WHEN 1 THEN 'cấm' WHEN 2 THEN 'tiêm' END || chr(10) || 'Liên hệ' AS response, CASE WHEN layer >= 0 THEN 'fast_scan' END AS source FROM g""")
def fast_scan(s: SparkSession, d: str) -> DataFrame:
    b = responses.blocked(F.col("text"), {0: "dài", 1: "cấm", 2: "tiêm"}, "Liên hệ")
    return read_table(s, d, "conversations").select("conv_id", "turn", b.alias("b")).select("conv_id", "turn", "b.*")


@query("""WITH c AS (SELECT page_id, list_filter([url, 'https://www.google.com/url?q=' || url, replace(url, 'example', 'pdt.ufm'), 'https://a.ufm.edu.vn/' || page_id, NULL], lambda u: u IS NOT NULL) AS u FROM pages),
k AS (SELECT page_id, unnest(u) AS url, generate_subscripts(u, 1) AS i FROM c) SELECT page_id, string_agg(url, ' ' ORDER BY i) AS urls FROM k WHERE NOT contains(url, 'www.google.com/url') AND regexp_matches(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '(^|\\.)(ufm\\.edu\\.vn|example\\.com)$') GROUP BY 1""")
def citation_filter(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    urls = F.array(u, F.concat(F.lit("https://www.google.com/url?q="), u), F.replace(u, F.lit("example"), F.lit("pdt.ufm")), F.concat(F.lit("https://a.ufm.edu.vn/"), "page_id"), F.lit(None).cast("string"))
    kept = responses.shown(F.transform(urls, lambda x: F.struct(x.alias("url"))), ["ufm.edu.vn", "example.com"])
    return read_table(s, d, "pages").select("page_id", F.array_join(F.transform(kept, lambda c: c["url"]), " ").alias("urls"))


@query("""WITH x AS (SELECT event_id AS request_id, event_id % 5 AS k FROM events), f AS (SELECT request_id, unnest(CASE k WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [2, 9] ELSE [0] END) AS n, unnest(CASE k WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [1, 2] ELSE [1] END) AS position FROM x)
SELECT request_id, position::INT AS position, CASE WHEN n IN (1, 2) THEN 'f' || n ELSE 'don_chung' END AS id, CASE n WHEN 1 THEN 'Đơn một' WHEN 2 THEN 'f2' WHEN 3 THEN 'Tự soạn' WHEN 9 THEN 'Mô tả 9' ELSE 'Mẫu đơn theo yêu cầu' END AS name, CASE WHEN n IN (1, 2) THEN 'f' || n || '.md' END AS template_file FROM f""")
def form_selection(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    four = '{"forms": [{"filename": "f1.md", "description": "x"}, {"filename": "f2.md"}, {"filename": "NONE", "description": "Tự soạn"}, {"filename": "f1.md"}]}'
    raw = F.when(k == 0, f"```json\n{four}\n```").when(k == 1, '{"forms": [{"filename": "f2.md"}, {"filename": "gone.md", "description": "Mô tả 9"}]}').when(k == 2, '{"forms": []}').when(k == 3, "no form fits")
    files = s.createDataFrame([("f1.md", '---\ntitle: "Đơn một"\n---\n-start-\nx'), ("f2.md", "no header")], "source string, text string")
    return responses.selected_forms(read_table(s, d, "events").select(F.col("event_id").alias("request_id"), raw.alias("raw")), responses.form_titles(files))


@query("""WITH x AS (SELECT doc_id, doc_id % 5 AS l, doc_id % 6 AS p, doc_id % 7 AS o FROM documents)
SELECT doc_id, CASE WHEN o = 0 THEN 'dai_hoc' ELSE CASE l WHEN 0 THEN 'thac_si' WHEN 1 THEN 'tien_si' WHEN 2 THEN 'thac_si' END END AS program_level,
CASE WHEN o = 1 THEN 'Kế Toán' ELSE CASE p WHEN 0 THEN 'Marketing' WHEN 1 THEN 'Kế Toán' WHEN 2 THEN 'Luật Kinh Tế' WHEN 3 THEN 'Quản Trị Kinh Doanh' WHEN 4 THEN 'không rõ' END END AS program_name FROM x""")
def header_normalize(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    pick = lambda n, values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % n + 1).cast("int"))
    level, program = pick(5, ["thac_si", "NCS khóa 3", "Cao học", "mầm non", None]), pick(6, [" marketing ", "KẾ TOÁN", "Ngành Luật Kinh Tế mới", "quản trị kinh doanh", "không rõ", None])
    level, program = headers.normalize(level, program, F.when(k % 7 == 0, "dai_hoc"), F.when(k % 7 == 1, "Kế Toán"))
    return read_table(s, d, "documents").select("doc_id", level.alias("program_level"), program.alias("program_name"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS chunk_index, count(*) OVER (PARTITION BY source) AS total_chunks_in_section FROM documents")
def parent_reindex(s: SparkSession, d: str) -> DataFrame:
    return catalog.reindexed(read_table(s, d, "documents").select("doc_id", "source", F.col("doc_id").alias("seq"))).select("doc_id", "chunk_index", "total_chunks_in_section")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 5")
def last_turns(s: SparkSession, d: str) -> DataFrame:
    return responses.last_turns(read_table(s, d, "conversations"), 5).select("conv_id", "turn")


_LOOSE = f"CASE (conv_id + turn) % 3 WHEN 0 THEN {_PICK} WHEN 1 THEN lower(replace({_PICK}, '_', '-')) ELSE 'no such ' || {_PICK} END"


@query(f"WITH i AS (SELECT conv_id, turn, {_LOOSE} AS i FROM conversations), n AS (SELECT *, replace(replace(upper(i), ' ', '_'), '-', '_') AS n FROM i) SELECT conv_id, turn, n IN ({', '.join(repr(x) for x in sorted(config.INTENT_ACTIONS))}) AS valid, CASE WHEN n IN ({', '.join(repr(x) for x in sorted(config.INTENT_ACTIONS))}) THEN n ELSE 'KHONG_XAC_DINH' END AS intent FROM n")
def intent_validate(s: SparkSession, d: str) -> DataFrame:
    at, k = (F.col("conv_id") + F.col("turn")) % len(_LABELS), (F.col("conv_id") + F.col("turn")) % 3
    name = F.element_at(F.array(*map(F.lit, _LABELS)), (at + 1).cast("int"))
    loose = F.when(k == 0, name).when(k == 1, F.lower(F.translate(name, "_", "-"))).otherwise(F.concat(F.lit("no such "), name))
    v = answers.valid_intent(loose)
    return read_table(s, d, "conversations").select("conv_id", "turn", v["valid"].alias("valid"), v["intent"].alias("intent"))


_COVERS = rf"""w AS (SELECT item_id AS query_id, list_distinct({_TERMS.format("text")}) AS t FROM benchmark), d AS (SELECT doc_id AS chunk_id, {_TERMS.format("text")} AS t FROM {{docs}}),
m AS (SELECT query_id, chunk_id, w.t AS q, d.t AS t FROM w, d WHERE len(w.t) > 0 AND list_has_all(d.t, w.t)),
o AS (SELECT query_id, chunk_id, len(q) AS n, term, pos, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS i FROM (SELECT query_id, chunk_id, q, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM m) WHERE list_contains(q, term)),
lt AS (SELECT a.query_id, a.chunk_id, a.n, a.i, a.pos, b.term, max(b.i) AS last, max(b.pos) AS place FROM o a JOIN o b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.i <= a.i GROUP BY ALL),
en AS (SELECT query_id, chunk_id, i, pos, min(last) AS first, min(place) AS begin FROM lt GROUP BY query_id, chunk_id, n, i, pos HAVING count(*) = n),
mc AS (SELECT *, coalesce(lag(first) OVER (PARTITION BY query_id, chunk_id ORDER BY i), 0) AS done FROM en),
cd AS (SELECT query_id, chunk_id, round(sum(0.1::DOUBLE / (1 + (pos - begin) - (i - first))), 6) AS score FROM mc WHERE first > done GROUP BY 1, 2)"""


@query(f"WITH {_COVERS.replace('{docs}', 'documents')} SELECT query_id, chunk_id, score FROM cd")
def cover_density(s: SparkSession, d: str) -> DataFrame:
    return text_index.cover_density(*_text_index(s, d, places=True), k=None)


@query(f"WITH {_COVERS.replace('{docs}', 'documents')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cd) SELECT query_id, chunk_id, score, rank::INT AS rank FROM r WHERE rank <= 5")
def cover_density_topk(s: SparkSession, d: str) -> DataFrame:
    return text_index.cover_density(*_text_index(s, d, places=True))


_HYBRID = f"""WITH {_CHUNKS}, live AS (SELECT chunk_id AS doc_id, content AS text FROM chunks WHERE is_active), {_COVERS.replace('{docs}', 'live')},
tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cd),
v AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {_COS} AS score FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings c JOIN chunks k ON k.chunk_id = c.vec_id WHERE k.is_active),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM v),
l AS (SELECT query_id, list_no, 0 AS kind, CASE WHEN list_no = 0 THEN 1.2 ELSE 1.0 END AS weight, chunk_id, rank, score FROM vr, (SELECT unnest([0, 1]) AS list_no) WHERE rank <= 7 UNION ALL SELECT query_id, 1048576, 1, 1.0, chunk_id, rank, score FROM tr WHERE rank <= 5),
f AS (SELECT query_id, chunk_id, round(sum(weight::DOUBLE / (60 + rank)), 9) AS rrf, min((list_no, rank)) AS first, min(kind) AS kind, max(score) FILTER (kind = 0) AS cosine FROM l GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, chunk_id) AS rank FROM f),
p AS (SELECT query_id, CASE WHEN chunk_level = 'child' AND parent_id IS NOT NULL THEN parent_id ELSE chunk_id END AS parent_id, min(rank) AS best FROM fr JOIN chunks USING (chunk_id) GROUP BY 1, 2),
pp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best) AS position FROM p),
pc AS (SELECT query_id, position, content FROM pp JOIN chunks ON chunk_id = pp.parent_id WHERE position <= 4 AND is_active),
b AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pc),
e AS (SELECT *, CASE WHEN length(content) <= 5000 - before THEN content WHEN 5000 - before > 100 THEN left(content, (5000 - before)::BIGINT) || '...' END AS emitted FROM b),
x AS (SELECT query_id, string_agg(emitted, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS context FROM e WHERE emitted IS NOT NULL GROUP BY 1),
n AS (SELECT query_id, count(*) FILTER (kind = 0) AS n_vector, count(*) FILTER (kind = 1) AS n_text FROM l GROUP BY 1),
g AS (SELECT query_id, count(*) AS n_chunks, max(cosine)::DOUBLE AS top_cosine FROM f GROUP BY 1)
SELECT item_id AS query_id, coalesce(context, '') AS context, coalesce(n_chunks, 0) AS n_chunks, top_cosine, coalesce(n_vector, 0) AS n_vector, coalesce(n_text, 0) AS n_text FROM benchmark LEFT JOIN g ON g.query_id = item_id LEFT JOIN n ON n.query_id = item_id LEFT JOIN x ON x.query_id = item_id"""


@query(_HYBRID)
def hybrid_retrieval(s: SparkSession, d: str) -> DataFrame:
    e = read_table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    chunks = _chunks(s, d).join(e.withColumnRenamed("doc_id", "chunk_id"), "chunk_id", "left")
    asked = read_table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(e.select(F.col("doc_id").alias("query_id"), "embedding"), "query_id", "left")
    both = asked.withColumn("variant", F.lit(0)).unionByName(asked.withColumn("variant", F.lit(1)))
    return retrieval.hybrid(chunks, both)
