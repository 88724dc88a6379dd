"""MinHash near-duplicate documents with odd sketches.

1. Each text's set of 5-word shingles gives MinHash samples; they band the documents
   and are folded into an odd sketch: a bitmap whose bits are the parities of the
   samples that fall on them. The population count of two sketches' XOR grows with the
   number of differing samples and is most precise where similarity is high.
2. Documents of equal sets are one class; only class representatives go on.
3. For representatives that share a band bucket with another, the shingles that no other
   such representative holds are counted. They bound a set's overlap with any other, so
   that a much edited copy is seen to link with nothing before it meets a whole group.
4. In each bucket every representative meets the bucket's leader, the one of fewest
   shingles of its own, which stands nearest to what the others were made from. Of the
   leaders so met it keeps the one of highest estimated similarity, and that pair is
   confirmed on the full sets. Connected components follow.
5. Where buckets still span several components, what they connect is one group. Groups
   are split into blocks that meet pair by pair; a task compares its rows across
   components, sketches first and then full sets, and returns edges of a spanning
   forest, never its pairs. So no candidate pair between components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import chunks, components, free_name, mix, text_buffers, window_hashes, with_row_key, words_of, written

_U = np.uint64
SKETCH_WORDS = 4  # of 64 bits
#: Rows, and shingles, of a block that a task compares with another.
BLOCK_ROWS, BLOCK_SHINGLES = 192, 2_000_000


class Params:
    """similarity is a ratio (num, den). bands x rows samples: a pair of 0.85 shares no
    band with probability 4e-7, one of 0.8 with 3e-5. A candidate is let go where its
    estimated similarity is under `least`: five standard errors of the samples, and the
    sketch's own spread, below the ratio."""

    def __init__(self, shingle: int = 5, num: int = 85, den: int = 100, bands: int = 20, rows: int = 4, errors: float = 5.0) -> None:
        self.shingle, self.num, self.den, self.bands, self.rows = shingle, num, den, bands, rows
        self.samples, size = bands * rows, 64 * SKETCH_WORDS
        j = num / den
        differ = min(self.samples, self.samples * (1 - j) + errors * math.sqrt(self.samples * j * (1 - j)))
        odd = 1 - math.exp(-4 * differ / size)  # share of the bits that differ, of a half
        self.most_bits = min(size // 2 - 1, math.ceil(size / 2 * odd + errors / 2 * math.sqrt(size / 4 * odd)))
        self.least = self.estimate(self.most_bits, math.log)

    def estimate(self, bits, log):  # noqa: ANN001, ANN201  numbers, arrays or columns alike
        """Similarity from the sketch bits that differ: each differing sample toggles two."""
        size = 64 * SKETCH_WORDS
        return 1 + log(1 - 2 * bits / size) * (size / (4 * self.samples))


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of rows: the first row, and each row's sorted set of shingle hashes. A
    text of fewer than k words, but not none, is one shingle."""
    data, offsets = text_buffers(column)
    for at, to in chunks(offsets):
        words, _, _, bounds = words_of(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower=True)
        windows = window_hashes(words, k)
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= k:
                s = np.sort(windows[a : b - k + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            else:
                out.append(window_hashes(words[a:b], b - a) if b > a else words[:0])
        yield at, out


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """For each row: n_shingles, class_hi/class_lo (128 bits over the set), bands
    (array of longs) and the odd sketch s0..s3."""
    k = p.bands * p.rows
    rng = np.random.Generator(np.random.PCG64(31))
    odd = rng.integers(0, 1 << 63, k, dtype=np.uint64) * _U(2) + _U(1)
    add = rng.integers(0, 1 << 63, k, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in shingle_sets(batch.column("text"), p.shingle):
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                flat = np.concatenate([sets[i] for i in full]) if len(full) else np.zeros(0, _U)
                first = np.concatenate(([0], np.cumsum(n[full])[:-1])).astype(np.int64) if len(full) else np.zeros(0, np.int64)
                hi, lo = np.zeros(len(n), _U), np.zeros(len(n), _U)
                samples = np.zeros((k, len(n)), _U)
                sketch = np.zeros((SKETCH_WORDS, len(n)), _U)
                if len(full):
                    hi[full] = np.add.reduceat(mix(flat ^ _U(0x5851F42D4C957F2D)), first)
                    lo[full] = np.add.reduceat(mix(flat + _U(0x14057B7EF767814F)), first)
                    for j in range(k):
                        samples[j, full] = least = np.minimum.reduceat(flat * odd[j] + add[j], first)
                        bit = mix(least ^ add[j])
                        word = (bit >> _U(6)) & _U(SKETCH_WORDS - 1)
                        for w in range(SKETCH_WORDS):
                            sketch[w, full] ^= np.where(word == w, _U(1) << (bit & _U(63)), _U(0))
                bands = np.zeros((len(n), p.bands), _U)
                for b in range(p.bands):
                    h = np.full(len(n), b + 1, _U)
                    for j in range(b * p.rows, (b + 1) * p.rows):
                        h = mix(h * _U(0x9E3779B97F4A7C15) + samples[j])
                    bands[:, b] = h
                part = batch.slice(at, len(n))
                bounds = pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, p.bands, 0)))).astype(np.int32))
                columns = {name: part.column(name) for name in part.schema.names if name != "text"}
                columns |= {"n_shingles": pa.array(n), "class_hi": pa.array(hi.view(np.int64)), "class_lo": pa.array(lo.view(np.int64)), "bands": pa.ListArray.from_arrays(bounds, pa.array(bands[full].reshape(-1).view(np.int64)))}
                columns |= {f"s{w}": pa.array(sketch[w].view(np.int64)) for w in range(SKETCH_WORDS)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(sign, f"{kept}, n_shingles long, class_hi long, class_lo long, bands array<long>, " + ", ".join(f"s{w} long" for w in range(SKETCH_WORDS)))


def _bits(a: str, b: str) -> F.Column:
    total = F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0")))
    for w in range(1, SKETCH_WORDS):
        total = total + F.bit_count(F.col(f"{a}.s{w}").bitwiseXOR(F.col(f"{b}.s{w}")))
    return total


def _similarity(a: str, b: str, p: Params) -> F.Column:
    """Estimated similarity of two rows; sketches that differ in half of their bits say none."""
    bits = F.least(_bits(a, b), F.lit(32 * SKETCH_WORDS - 1))
    return p.estimate(bits, F.log)


def _near(a: str, b: str, p: Params) -> F.Column:
    """Sizes, shingles of their own and sketches allow the similarity. What one set has
    alone is in the union and not in the overlap."""
    x, y = (F.col(f"{c}.n_shingles") - F.col(f"{c}.own") for c in (a, b))
    overlap = F.least(x, y)
    union = F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles") - overlap
    return (overlap * p.den >= union * p.num) & (_similarity(a, b, p) >= p.least - 1e-9)


def _sets(texts: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """rep, shingles (array of longs) of the wanted ones of texts (rep, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found in shingle_sets(batch.column("text"), p.shingle):
                bounds = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.sort(s.view(np.int64)) for s in found])))
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(at, len(found)), cells], names=["rep", "shingles"])

    return written(texts.join(wanted, "rep", "left_semi").mapInArrow(sets, "rep long, shingles array<long>"), "shingle-sets")


def _confirm(pairs: DataFrame, full: DataFrame, p: Params) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have the similarity."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = (c.values.to_numpy() for c in (x, y))
                common = _overlap(u, v)
                ok.append(p.den * common >= p.num * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(full.toDF("a", "x"), "a")
    return left.join(full.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def _overlap(u: np.ndarray, v: np.ndarray) -> int:
    at = np.searchsorted(u, v)
    return int((u[np.minimum(at, len(u) - 1)] == v).sum())


def _block(a: pd.DataFrame, b: pd.DataFrame, same: bool, p: Params) -> pd.DataFrame:
    """Edges of a spanning forest of the links between components among a and b."""
    bits = sum(np.bitwise_count(a[f"s{w}"].to_numpy()[:, None].view(_U) ^ b[f"s{w}"].to_numpy()[None, :].view(_U)).astype(np.int16) for w in range(SKETCH_WORDS))
    na, nb = (x["n_shingles"].to_numpy() for x in (a, b))
    overlap = np.minimum((na - a["own"].to_numpy())[:, None], (nb - b["own"].to_numpy())[None, :])
    similarity = p.estimate(np.minimum(bits, 32 * SKETCH_WORDS - 1), np.log)
    may = (similarity >= p.least - 1e-9) & (overlap * p.den >= (na[:, None] + nb[None, :] - overlap) * p.num) & (a["component"].to_numpy()[:, None] != b["component"].to_numpy()[None, :])
    if same:
        may &= np.tri(len(a), k=-1, dtype=bool).T
    sa, sb = a["shingles"].tolist(), b["shingles"].tolist()
    ids = np.unique(np.concatenate((a["component"], b["component"])))
    ca, cb = (np.searchsorted(ids, x["component"].to_numpy()) for x in (a, b))
    label = np.arange(len(ids))
    edges = []
    for i, j in zip(*np.nonzero(may), strict=True):
        x, y = label[ca[i]], label[cb[j]]
        if x != y:  # else some links found here already join the two
            common = _overlap(sa[i], sb[j])
            if p.den * common >= p.num * (len(sa[i]) + len(sb[j]) - common):
                edges.append((a["rep"].iat[i], b["rep"].iat[j]))
                label[label == y] = x
    return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)


def _across(open_: DataFrame, full: DataFrame, p: Params) -> DataFrame:
    """Edges between the components of rows (band, rep, component, own and sketch) that
    hold wherever two rows of one connected group of buckets have the similarity."""
    first = open_.groupBy("band").agg(F.min("rep").alias("a"))
    group = components(open_.select("band", F.col("rep").alias("b")).join(first, "band").select("a", "b")).toDF("rep", "group")
    rows = open_.drop("band").distinct().join(group, "rep").join(full, "rep")
    rows = written(rows, "group-rows")
    parts = rows.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    dealt = rows.join(parts, "group").withColumn("own_part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("i", F.least("own_part", "other")).withColumn("j", F.greatest("own_part", "other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        a, b = pdf[pdf["own_part"] == i], pdf[pdf["own_part"] == j]
        return _block(a.reset_index(drop=True), b.reset_index(drop=True), bool(i == j), p)

    return dealt.groupBy("group", "i", "j").applyInPandas(compare, "a long, b long")


def _placed(docs: DataFrame, p: Params) -> DataFrame:
    """docs without text, with n_shingles and component_id; doc_id must be a long."""
    signed = written(signatures(docs, p), "signatures")
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    key = ["class_hi", "class_lo"]
    reps = usable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), *[F.any_value(f"s{w}").alias(f"s{w}") for w in range(SKETCH_WORDS)])
    reps = written(reps, "classes")
    sketches = reps.select("rep", "n_shingles", *[f"s{w}" for w in range(SKETCH_WORDS)])
    # one row of each class's bands: that of its smallest document
    banded = usable.select(*key, "doc_id", "bands").join(reps.select(*key, F.col("rep").alias("doc_id")), [*key, "doc_id"], "left_semi")
    bands = banded.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first < last").select("band")
    buckets = written(bands.join(shared, "band").distinct(), "buckets")
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("rep"), "text")
    full = _sets(texts, buckets.select("rep").distinct(), p)
    # a shingle of one set alone can't be in an overlap, which must be num / den of the set
    single = full.select("rep", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("rep").alias("rep"), F.count("*").alias("n")).filter("n = 1")
    own = full.select("rep", F.size("shingles").alias("n")).join(single.groupBy("rep").agg(F.count("*").alias("own")), "rep", "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
    able = written(own.filter(p.den * (F.col("n") - F.col("own")) >= p.num * F.col("n")).groupBy("rep").agg(F.min("own").alias("own")), "linkable")
    buckets = written(buckets.join(able, "rep"), "linkable-buckets")
    sketches = written(sketches.join(able, "rep"), "linkable-sketches")
    leads = buckets.groupBy("band").agg(F.min(F.struct("own", "rep")).alias("lead"), F.max("rep").alias("last"), F.min("rep").alias("first")).filter("first < last").select("band", F.col("lead.rep").alias("lead"))
    met = buckets.join(leads, "band").filter("rep <> lead").select("rep", "lead").distinct()
    met = met.join(sketches.withColumnRenamed("rep", "lead"), "lead").alias("x").join(sketches.alias("y"), "rep").filter(_near("x", "y", p))
    star = met.select("rep", "lead", (-_similarity("x", "y", p)).alias("away")).groupBy("rep").agg(F.min(F.struct("away", "lead")).alias("best")).select(F.col("best.lead").alias("a"), F.col("rep").alias("b"))
    star = written(star, "star-pairs")
    edges = written(_confirm(star, full, p), "star-links")
    first = components(edges)
    # buckets that span components: pairs across them
    placed = buckets.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band")
    open_ = written(placed.drop("own").join(mixed, "band", "left_semi").join(sketches, "rep"), "open-buckets")
    more = _across(open_, full, p)
    final = components(edges.unionByName(more))
    of_class = reps.select(*key, "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    out = signed.join(of_class, key, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.withColumn("component_id", component).drop("component", "bands", *key, *[f"s{w}" for w in range(SKETCH_WORDS)])


def near_duplicates(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text).

    A null text, or one without words, has the empty set and links with nothing. Rows
    that share a doc_id count as one document with the links of all of them. A row with
    a null doc_id links with nothing: component_id is null and kept is true. Ties go to
    the smaller id; other columns are not read; an empty table gives no rows.
    """
    placed = _placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), p or Params())
    return placed.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def keep_one(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """The rows of docs, with all their columns, of which one stays of each component: of
    the smallest doc_id, and there the first. Rows are documents of their own, whether
    they share a doc_id or not: equal ones are one component, unlike ones both stay. Rows
    without words stay, and those with a null doc_id. An empty table gives no rows."""
    row = free_name(docs, "_row")
    keyed = with_row_key(docs, row)
    of = _placed(keyed.filter("doc_id is not null").select(F.col(row).alias("doc_id"), "text"), p or Params())
    placed = of.filter("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id")
    named = written(keyed.select(row, "doc_id").join(placed, row).select(F.col(row).alias("r"), "doc_id", "component_id"), "near-components")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "r")).alias("w"), F.count("*").alias("n")).filter("n > 1").select("component_id", F.col("w.r").alias("first"))
    gone = named.join(first, "component_id").filter("r <> first").select(F.col("r").alias(row))
    return keyed.join(gone, row, "left_anti").select(*docs.columns)
