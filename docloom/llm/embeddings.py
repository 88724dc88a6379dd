"""Embedding near-duplicates with randomised-rotation binary codes.

Each unit vector is rotated at random and stored as a code, once: the signs of its
coordinates as bits; a correction factor, the inner product f of the rotated vector and
its code; and the rotated vector again in steps of BITS bits, laid out as bit planes.
For a query q the product <q, code> / f estimates <q, vector> without bias, and lies with
high probability within width * sqrt((1 - f^2) / f^2) / sqrt(d - 1) of it; <q, code> is a
few population counts of planes and bits. A pair is open while the upper bounds of both
directions reach the threshold. Tasks that hold codes alone name the vectors of open
pairs; only these are fetched, and only their open pairs are computed again, in double
precision from the stored components. Only those results link.

Which pairs meet: the rotated vector's largest coordinates by size name its cells (its
signed axis in each block of coordinates), the largest its home; a pair meets where one
of the two is at home and the other visits. Several rotations are tables of their own.
Every vector is indexed in all of them. Equal vectors are one class and meet others as
one. A cell of many vectors is split into blocks that meet pair by pair, so the work of a
hot cell spreads over tasks, and a task returns per vector a count and one edge of a
spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import components, with_row_key, written

#: Vectors that one task compares with as many others.
BLOCK = 2048
#: Vectors for which a cell is laid out, about.
CELL = 5000
#: Pairs looked at in one step once they are listed.
PAIRS = 1 << 17
#: Bits of each coordinate of the rotated vector as a query.
BITS = 4
#: Tables, and cells that a vector visits in each, by the number of blocks of coordinates.
#: A pair of cosine 0.9 in 64 dimensions meets with probability 0.993 (1 and 2 blocks)
#: and 0.995 (3), one of 0.95 with more than 0.999; 8, 24 and 64 copies of a code of
#: (1 + BITS) * d / 8 bytes and five numbers.
TABLES, VISITS = {1: 2, 2: 3, 3: 4}, {1: 4, 2: 8, 3: 16}
CODE = ["code", "planes", "f", "low", "step", "total"]


def layout(n: int, d: int) -> int:
    """Blocks of coordinates for n vectors. Cells number (2d / blocks) ** blocks, so that
    they follow the number of vectors; tables and visits make up for what more blocks miss."""
    blocks = 1
    while blocks < 3 and n > CELL * (2 * d // blocks) ** blocks and d >= 8 * (blocks + 1):
        blocks += 1
    return blocks


def _rotation(d: int, seed: int) -> np.ndarray:
    g = np.random.Generator(np.random.PCG64([d, seed])).standard_normal((d, d))
    q, r = np.linalg.qr(g)
    return q * np.sign(np.diag(r))


def _cells(rotated: np.ndarray, blocks: int, visits: int) -> np.ndarray:
    """Cells of each row, home first: the combinations of one axis per block whose
    coordinates are largest in sum."""
    codes, sizes = [], []
    for part in np.array_split(np.arange(rotated.shape[1]), blocks):
        x = rotated[:, part]
        top = np.argsort(-np.abs(x), axis=1, kind="stable")[:, : min(4, len(part))]
        sizes.append(np.take_along_axis(np.abs(x), top, 1))
        codes.append(2 * top + (np.take_along_axis(x, top, 1) < 0))
    width = 2 * rotated.shape[1]
    choices = list(product(*[range(c.shape[1]) for c in codes]))
    cells = np.stack([sum(codes[b][:, i] * width**b for b, i in enumerate(c)) for c in choices], 1)
    size = np.stack([sum(sizes[b][:, i] for b, i in enumerate(c)) for c in choices], 1)
    return np.take_along_axis(cells, np.argsort(-size, axis=1, kind="stable")[:, :visits], 1).astype(np.int64)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    full = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    full[:, : bits.shape[1]] = bits
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def encode(unit: np.ndarray) -> dict[str, np.ndarray]:
    """The stored code of each unit vector: bits and factor, and the query form."""
    d = unit.shape[1]
    r = unit @ _rotation(d, 0)
    low = r.min(axis=1, keepdims=True)
    step = (r.max(axis=1, keepdims=True) - low) / (2**BITS - 1)
    level = np.rint(np.divide(r - low, step, out=np.zeros_like(r), where=step > 0)).astype(np.int64)
    planes = np.concatenate([_words((level >> b) & 1 > 0) for b in range(BITS)], axis=1)
    return {"code": _words(r >= 0), "planes": planes, "f": np.abs(r).sum(axis=1) / np.sqrt(d), "low": low[:, 0], "step": step[:, 0], "total": (low + step * level).sum(axis=1)}


def estimate(q: dict[str, np.ndarray], x: dict[str, np.ndarray], d: int) -> np.ndarray:
    """Estimated inner products of the query forms of q with the codes of x, row by row,
    or of all with all where their arrays are laid out to meet so (_all)."""
    words = x["code"].shape[-1]
    ones = sum(np.bitwise_count(x["code"][..., w]).astype(np.uint16) for w in range(words))
    hits = sum((np.bitwise_count(q["planes"][..., b * words + w] & x["code"][..., w]).astype(np.uint16) << np.uint16(b)) for b in range(BITS) for w in range(words))
    positive = q["low"] * ones + q["step"] * hits
    return (2 * positive - q["total"]) / (np.float32(np.sqrt(d)) * x["f"])


def upper(q: dict[str, np.ndarray], x: dict[str, np.ndarray], d: int, width: float) -> np.ndarray:
    """Upper confidence bounds of the inner products: of the code, and of the query's steps."""
    f = x["f"]
    code = np.maximum(1 - f * f, 0) / (f * f) / max(d - 1, 1)
    steps = q["step"] / f
    return estimate(q, x, d) + width * np.sqrt(code + steps * steps / 12) + 1e-5


def _all(coded: dict[str, np.ndarray], axis: int) -> dict[str, np.ndarray]:
    return {c: np.expand_dims(v, axis) for c, v in coded.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    out = {c: pdf[c].to_numpy(np.float32) for c in ("f", "low", "step", "total")}
    return out | {c: np.frombuffer(b"".join(pdf[c]), np.uint64).reshape(len(pdf), -1) for c in ("code", "planes")}


def _open(a: pd.DataFrame, b: pd.DataFrame, same: bool, d: int, threshold: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a and b that meet here and whose bounds leave them open."""
    ca, cb = _codes(a), _codes(b)
    home_a, home_b = a["home"].to_numpy(bool), b["home"].to_numpy(bool)
    i, j = np.nonzero((home_a[:, None] | home_b[None, :]) & (upper(_all(ca, 1), _all(cb, 0), d, width) >= threshold))
    if same:
        i, j = i[i < j], j[i < j]
    keep = [upper({c: v[j[at : at + PAIRS]] for c, v in cb.items()}, {c: v[i[at : at + PAIRS]] for c, v in ca.items()}, d, width) >= threshold for at in range(0, len(i), PAIRS)]
    ok = np.concatenate([*keep, np.zeros(0, bool)])
    return i[ok], j[ok]


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    i, j = int(pdf["bi"].iat[0]), int(pdf["bj"].iat[0])
    a = pdf[pdf["own"] == i].reset_index(drop=True)
    return a, a if i == j else pdf[pdf["own"] == j].reset_index(drop=True), i == j


def _compare(a: pd.DataFrame, b: pd.DataFrame, same: bool, d: int, dtype: np.dtype, threshold: float, width: float) -> pd.DataFrame:
    """Links between the rows of a and of b (or within a) that are counted here."""
    i, j = _open(a, b, same, d, threshold, width)
    ua, ub = (_unit(np.frombuffer(b"".join(x["value"]), dtype).reshape(-1, d)) for x in (a, b))
    keep = [np.einsum("nd,nd->n", ua[i[at : at + (PAIRS)]], ub[j[at : at + (PAIRS)]]) >= threshold for at in range(0, len(i), PAIRS)]  # in bounded pieces
    if keep:
        ok = np.concatenate(keep)
        i, j = i[ok], j[ok]
    # a pair that meets in several cells counts in the first table, and there in the smaller cell
    table, cell = int(a["table"].iat[0]), int(a["cell"].iat[0])
    ca, cb = (np.stack(x["cells"].to_list()).reshape(len(x), int(a["tables"].iat[0]), -1) for x in (a, b))
    here = np.ones(len(i), bool)
    for t in range(table + 1):
        for at in range(0, len(i), PAIRS):
            x, y = ca[i[at : at + (PAIRS)], t], cb[j[at : at + (PAIRS)], t]
            in_b = (x == y[:, :1]).any(axis=1)  # x comes to the home of y
            in_a = (y == x[:, :1]).any(axis=1)
            part = slice(at, at + (PAIRS))
            if t < table:
                here[part] &= ~(in_a | in_b)
            else:
                first = np.where(in_a & in_b, np.minimum(x[:, 0], y[:, 0]), np.where(in_a, x[:, 0], y[:, 0]))
                here[part] &= first == cell
    i, j = i[here], j[here]
    rows, size = a["_row"].to_numpy(), a["size"].to_numpy()
    if not same:
        rows, size, j = np.concatenate((rows, b["_row"])), np.concatenate((size, b["size"])), j + len(a)
    n = np.bincount(i, size[j], len(rows)) + np.bincount(j, size[i], len(rows))
    label = np.arange(len(rows))
    while True:  # labels of the components among these rows
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = n > 0
    return pd.DataFrame({"_row": rows[linked], "n": n[linked].astype(np.int64), "link": rows[label[linked]]})


def links(vectors: DataFrame, threshold: float = 0.9, width: float = 4.0) -> DataFrame:
    """Partial counts and forest edges (_row, n, link) of vectors (_row, size, embedding),
    where size is the number of equal vectors that a row stands for."""
    kind = vectors.schema["embedding"].dataType.elementType
    dtype = np.dtype(np.float32 if isinstance(kind, T.FloatType) else np.float64)
    usable = vectors.select("_row", "size", F.size("embedding").alias("d"), F.col("embedding").cast("array<float>" if dtype == np.float32 else "array<double>").alias("embedding"))
    blocks = {r["d"]: layout(r["count"], r["d"]) for r in usable.groupBy("d").count().collect()}  # one row per dimension

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("d").to_numpy()
            for d in np.unique(dims):
                mine = pa.array(np.flatnonzero(dims == d))
                x = batch.column("embedding").take(mine).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                unit = _unit(x)
                tables, visits = TABLES[blocks[int(d)]], VISITS[blocks[int(d)]]
                cells = np.concatenate([_cells(unit @ _rotation(int(d), t + 1), blocks[int(d)], visits) for t in range(tables)], 1)
                bounds = np.arange(len(x) + 1, dtype=np.int32) * cells.shape[1]
                coded = encode(unit)
                columns = [coded[c] if coded[c].ndim == 1 else pa.array([v.tobytes() for v in coded[c]], pa.binary()) for c in CODE]
                values = pa.array([v.tobytes() for v in np.ascontiguousarray(x, dtype)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d, np.int32)), batch.column("_row").take(mine), batch.column("size").take(mine), *map(pa.array, columns), pa.array(np.full(len(x), tables, np.int32)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(cells.ravel())), values], names=["d", "_row", "size", *CODE, "tables", "cells", "value"])

    schema = "d int, _row long, size long, code binary, planes binary, f double, low double, step double, total double, tables int, cells array<long>, value binary"
    coded = written(usable.mapInArrow(index, schema), "vector-codes")
    key = ["d", "table", "cell"]
    visit = coded.select("d", "_row", *CODE, (F.size("cells") / F.col("tables")).cast("int").alias("visits"), F.posexplode("cells").alias("at", "cell"))
    visit = visit.withColumn("table", F.floor(F.col("at") / F.col("visits")).cast("int")).withColumn("home", F.col("at") % F.col("visits") == 0).drop("at", "visits")
    counts = visit.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"), F.count("*").alias("n"), F.count_if("home").alias("homes")).filter("homes > 0 and n > 1").drop("homes", "n")
    dealt = visit.join(counts, key).withColumn("own", F.pmod(F.xxhash64("_row"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("g", "other")

    def wanted(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(pdf)
        if not len(a) or not len(b):
            return pdf.loc[[], ["d", "table", "cell", "bi", "bj", "_row", "own", "home"]]
        i, j = _open(a, b, same, int(pdf["d"].iat[0]), threshold, width)
        held = np.union1d(a["_row"].to_numpy()[i], b["_row"].to_numpy()[j])
        return pdf.loc[np.isin(pdf["_row"].to_numpy(), held), ["d", "table", "cell", "bi", "bj", "_row", "own", "home"]]

    named = dealt.groupBy(*key, "bi", "bj").applyInPandas(wanted, "d int, table int, cell long, bi int, bj int, _row long, own int, home boolean")
    fetched = written(named, "vectors-of-open-pairs").join(coded.drop("d"), "_row")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(pdf)
        if not len(a) or not len(b):
            return pd.DataFrame({"_row": pd.Series(dtype=np.int64), "n": pd.Series(dtype=np.int64), "link": pd.Series(dtype=np.int64)})
        return _compare(a, b, same, int(pdf["d"].iat[0]), dtype, threshold, width)

    return fetched.groupBy(*key, "bi", "bj").applyInPandas(compare, "_row long, n long, link long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, width: float = 4.0) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding).

    A vector that is null, empty, zero or holds a null or non-finite component links
    with nothing; vectors of different lengths don't link. Repeated rows are vectors of
    their own and link as such. A row with a null vec_id is counted by its links, and
    takes the smallest id of its component, or null. Other columns are not read; an
    empty table gives no rows.
    """
    keyed = with_row_key(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    able = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))") & F.expr("exists(embedding, x -> x <> 0)")
    same = [F.when(able, F.xxhash64("embedding")).alias("h1"), F.when(able, F.xxhash64("embedding", F.lit(7))).alias("h2")]
    named = written(keyed.select("_row", "vec_id", *same), "vector-classes")
    classes = written(named.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("_row").alias("rep"), F.count("*").alias("size")), "vector-representatives")
    reps = keyed.select("_row", "embedding").join(classes.select(F.col("rep").alias("_row"), "size"), "_row")
    found = written(links(reps, threshold, width), "vector-links")
    counts = found.groupBy("_row").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("_row").alias("a"), F.col("link").alias("b"))).withColumnRenamed("node", "_row")
    of = classes.withColumnRenamed("rep", "_row").join(counts, "_row", "left").join(parts, "_row", "left")
    of = of.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "_row").alias("component"))
    rows = named.join(of, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "_row").alias("component"))
    rows = written(rows, "vector-components")
    least = rows.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return rows.join(least, "component").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
