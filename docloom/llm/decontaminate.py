"""Benchmark decontamination with a broadcast hash set of test n-grams.

Each benchmark item gives its windows of n consecutive words (an item of fewer words is
one window). Training texts are split into words once; every window of theirs is hashed
inside the generated code and probed against the broadcast set; a hit is verified on the
words themselves. Nothing but hits and one row per document is shuffled. The set is
broadcast only while its measured size is under a bound; beyond it the same join sorts.

Built of DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import free_name, with_row_key

#: Fixed values of the contract: what separates words, and what makes them.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words in a text whose capitals are still there.
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most bytes of windows that are broadcast, and keys that documents without a hit meet under.
BROADCAST_BYTES, MARKERS = 64 << 20, 1024


def words(text: Column) -> Column:
    """Normalised words; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _hash(m: int) -> Column:
    """Hash of the m words from position i (from 1)."""
    return F.xxhash64(F.lit(m), *[F.get("w", F.col("i") + (j - 1)) for j in range(m)])


def test_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """m, key, gram, items: each different window, of m words, and the items that hold it."""
    split = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    at = split.withColumn("m", F.least(F.size("w"), F.lit(n))).withColumn("i", F.explode(F.expr("sequence(1, size(w) - m + 1)")))
    gram = at.select("m", "item_id", F.expr("slice(w, i, m)").alias("w"))
    grams = gram.groupBy("m", "w").agg(F.collect_set("item_id").alias("items")).withColumn("i", F.lit(1))
    key = F.coalesce(*[F.when(F.col("m") == m, _hash(m)) for m in range(1, n + 1)])
    return grams.select("m", key.alias("key"), F.array_join("w", " ").alias("gram"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_hit (words inside any
    occurrence of a window), n_items, items_sha256, contaminated (n_hit > 0 and share *
    n_hit >= n_words), hits (word ranges [from, to) of the hit words, by position).

    A null or empty text has no words and no hits; a null benchmark text gives no
    window, a null item_id is not counted as an item though its words are hit. Repeated
    rows give repeated results. Empty tables: no rows, or no hits. Other columns are not
    read, whatever their names.
    """
    return _flagged(with_row_key(docs.select("doc_id", "text")), benchmark, n, share).drop("_row")


def _flagged(keyed: DataFrame, benchmark: DataFrame, n: int, share: int) -> DataFrame:
    windows = test_windows(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"), n)
    count, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("gram") + 200), F.lit(0))).first()
    lengths = sorted(r[0] for r in windows.select("m").distinct().collect())  # at most n
    marker = windows.sparkSession.range(MARKERS).select(F.lit(0).alias("m"), F.col("id").alias("key"), F.lit("").alias("gram"), F.array().cast("array<string>").alias("items"))
    table = windows.unionByName(marker)
    table = F.broadcast(table) if size <= BROADCAST_BYTES else table
    split = keyed.select("_row", "doc_id", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    # position 0 is a marker that each document sends, so that one pass gives both words and
    # hits; it has one of MARKERS keys, so that beyond a broadcast no task gets all documents
    shortest = min(lengths, default=n)
    at = split.withColumn("i", F.explode(F.expr(f"sequence(0, greatest(0, n_words - {shortest - 1}))")))
    if len(lengths) > 1:
        at = at.withColumn("width", F.explode(F.array(*map(F.lit, lengths)))).filter(f"(i = 0 and width = {shortest}) or (i > 0 and i + width - 1 <= n_words)")
        key = F.coalesce(*[F.when(F.col("width") == m, _hash(m)) for m in lengths])
    else:
        at = at.withColumn("width", F.lit(shortest))
        key = _hash(shortest)
    probed = at.withColumn("key", F.when(F.col("i") == 0, F.pmod(F.xxhash64("_row"), F.lit(MARKERS))).otherwise(key))
    if size > BROADCAST_BYTES:
        probed = probed.withColumn("w", F.when(F.col("i") > 0, F.expr("slice(w, i, width)")))
        same = F.expr("array_join(w, ' ') = gram")
    else:
        same = F.expr("array_join(slice(w, i, m), ' ') = gram")
    met = probed.join(table, "key").filter(((F.col("i") == 0) & (F.col("m") == 0)) | ((F.col("i") > 0) & (F.col("m") == F.col("width")) & same))
    found = met.groupBy("_row", "doc_id", "n_words").agg(F.collect_set(F.when(F.col("i") > 0, F.struct("i", "m"))).alias("at"), F.collect_set(F.when(F.col("i") > 0, F.col("items"))).alias("items"))
    merged = F.expr(
        "aggregate(array_sort(at), cast(array() as array<struct<from: int, to: int>>), (ranges, x) -> "
        "if(size(ranges) > 0 and element_at(ranges, -1).to >= x.i - 1, "
        "concat(slice(ranges, 1, size(ranges) - 1), array(struct(element_at(ranges, -1).from as from, greatest(element_at(ranges, -1).to, x.i + x.m - 1) as to))), "
        "concat(ranges, array(struct(x.i - 1 as from, x.i + x.m - 1 as to)))))"
    )
    named = F.array_sort(F.array_remove(F.array_distinct(F.flatten("items")), ""))
    out = found.withColumn("hits", merged).withColumn("items", named).withColumn("n_hit", F.expr("aggregate(hits, 0L, (s, r) -> s + r.to - r.from)"))
    return out.select("_row", "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = 13, share: int = 20) -> DataFrame:
    """docs without what is contaminated: remove="documents" drops contaminated
    documents, remove="spans" takes the hit words (and what separates them from the word
    before) out of every text that has any. All columns and all other rows stay.

    Rows are judged one by one: repeated rows fare alike, rows that share a doc_id don't
    count together, a null or wordless text is never contaminated. Hits that overlap are
    taken out once. An empty benchmark takes nothing, an empty table gives no rows."""
    row, mark = free_name(docs, "_row"), free_name(docs, "_hits")
    keyed = with_row_key(docs, row)
    flags = _flagged(keyed.select(F.col(row).alias("_row"), "doc_id", "text"), benchmark, n, share)
    if remove == "documents":
        return keyed.join(flags.filter("contaminated").select(F.col("_row").alias(row)), row, "left_anti").select(*docs.columns)
    marked = keyed.join(flags.filter("n_hit > 0").select(F.col("_row").alias(row), F.col("hits").alias(mark)), row, "left")
    units = F.expr(f"filter(regexp_extract_all(text, r'[{BETWEEN}]*[^{BETWEEN}]+', 0), (u, i) -> not exists({mark}, h -> i >= h.from and i < h.to))")
    tail = F.regexp_extract("text", rf"[{BETWEEN}]+\z", 0)
    return marked.withColumn("text", F.when(F.col(mark).isNull(), F.col("text")).otherwise(F.concat(F.array_join(units, ""), tail))).select(*docs.columns)
