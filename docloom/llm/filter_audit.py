"""Which filter removes what, in which order: an audit of five filters over a corpus.

A relational word pipeline. Texts are dealt out by row once; there they are exploded into
words, counted by (row, word) and then by row, without another shuffle. The other flags
come from a second, narrow pass and are outer-joined; a text equal to an earlier one is
found by a join on (doc_id, hash), which no group of copies makes hot. What is left of the
corpus is one row per part and set of failures, turned into 32 conditional counts, and
every figure of all 120 orders is a sum over these.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import with_row_key

FILTERS = "ABCDE"
#: Fixed value of the contract: what separates words.
SEPARATORS = r"[\x20\x09-\x0D]+"
_MASKS = 1 << len(FILTERS)
#: Arrays whose entry m + 1 counts the documents that fail just the filters of mask m.
_COUNTED = ("n", "good", "toxic")


@dataclass(frozen=True)
class Limits:
    """When a document fails: A under `words` words; B under `distinct` percent of them
    different; C over `capitals` percent of its characters A to Z; D any of `symbols`."""

    words: int = 200
    distinct: int = 50
    capitals: int = 3
    symbols: str = "[#$%&*|]"


def word_counts(keyed: DataFrame) -> DataFrame:
    """_row, n_words, n_distinct of keyed (_row, text); rows without words are missing.
    The texts are dealt out by _row before they are exploded, so both aggregations find
    their rows in place. A text's words are counted in one task, as the text is one row."""
    words = keyed.repartition("_row").select("_row", F.explode(F.split("text", SEPARATORS)).alias("word")).filter("word <> ''")
    each = words.groupBy("_row", "word").agg(F.count("*").alias("n"))
    return each.groupBy("_row").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def flags(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """_row, doc_id, part, n_words, n_distinct and the failures A to E of each row of docs
    (doc_id, text, lang).

    A null text counts as empty, a null lang is the part ''. E: the whole text is also
    that of a smaller doc_id, anywhere in docs; a row without doc_id has none smaller and
    is none, and rows that share doc_id and text don't fail by one another. Repeated rows
    are rows of their own. An empty table gives no rows. Very long texts are counted
    whole; other columns are not read, whatever their names.
    """
    keyed = with_row_key(docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    narrow = keyed.select(
        "_row", "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.sha2("text", 256).alias("_hash"),
        (100 * capitals.cast("long") > limits.capitals * F.length("text").cast("long")).alias("C"), F.rlike("text", F.lit(limits.symbols)).alias("D"),
    )
    first = narrow.groupBy("_hash").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    other = narrow.join(first, ["doc_id", "_hash"], "left").withColumn("E", F.col("_first").isNull() & F.col("doc_id").isNotNull())
    both = other.join(word_counts(keyed.select("_row", "text")), "_row", "full_outer")
    n, d = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    return both.select("_row", "doc_id", "part", n.alias("n_words"), d.alias("n_distinct"), (n < limits.words).alias("A"), (100 * d < limits.distinct * n).alias("B"), "C", "D", "E")


def failure_counts(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """part and, for each set of failures (bit i: the i-th of FILTERS), how many rows of
    flagged have just that: all in n, those labelled good and toxic in good and toxic
    (arrays of 32 counts). A doc_id that labels (doc_id, quality, toxic) holds more than
    once is good, or toxic, if any of its rows says so; null labels say nothing."""
    marks = labels.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    mask = sum((F.when(F.col(f), F.lit(1 << i)).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    rows = flagged.select("doc_id", "part", mask.cast("int").alias("mask")).join(marks, "doc_id", "left")
    sets = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("is_good").alias("good"), F.count_if("is_toxic").alias("toxic"))
    counts = [F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(_MASKS)]).alias(c) for c in _COUNTED]
    return sets.groupBy("part").agg(*counts)


def _total(counts: str, holds: str, term: str = "{0}[m]") -> Column:
    """Sum of term over the masks m for which holds; as it stands, of their counts."""
    return F.expr(f"aggregate(filter(sequence(0, {_MASKS - 1}), m -> {holds}), 0L, (s, m) -> s + {term.format(counts)})")


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part of counts (failure_counts), order of the filters and step in it.
    kept and removed: after and by this step; redundant: failing its filter, removed
    before; unique_fails: failing that filter alone; good_lost, toxic_lost: of the removed;
    shapley: what the filter removes, summed over all orders at whatever step (of k
    failures each comes first in one k-th of the orders)."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = counts.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = F.expr(f"1 << (locate(substr(filter_order, step, 1), '{FILTERS}') - 1)")
    earlier = F.expr(f"aggregate(sequence(0, step - 1), 0, (b, i) -> if(i = 0, b, b | 1 << (locate(substr(filter_order, i, 1), '{FILTERS}') - 1)))")
    steps = steps.withColumn("bit", bit.cast("int")).withColumn("earlier", earlier.cast("int"))
    here = "(m & bit) <> 0 and (m & earlier) = 0"
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        _total("n", "(m & (bit | earlier)) = 0").alias("kept"), _total("n", here).alias("removed"), _total("n", "(m & bit) <> 0 and (m & earlier) <> 0").alias("redundant"),
        F.expr("n[bit]").alias("unique_fails"), _total("good", here).alias("good_lost"), _total("toxic", here).alias("toxic_lost"),
        _total("n", "(m & bit) <> 0", f"{{0}}[m] * ({len(orders)} div bit_count(m))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The interactions of the five filters over docs (doc_id, text, lang), by lang, with
    what labels (doc_id, quality, toxic) says of the removed. See flags, failure_counts
    and interactions for nulls, repeated rows and ties; without documents there are no
    parts and no rows, without labels nothing good or toxic is lost."""
    return interactions(failure_counts(flags(docs, limits), labels))
