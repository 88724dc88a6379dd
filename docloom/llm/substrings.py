"""Repeated spans by de Bruijn compaction.

Token k-mers are the edges of a de Bruijn graph whose paths are the documents. A path of
``window`` words is a repeated span if it also starts in a document with a smaller id.

1. Edges are compacted where they are read: each window has a minimizer, the k-mer of
   least hash in it, and neighbouring windows with one minimizer are one path (minimizer,
   content, document) of about (window - k) / 2 windows. No k-mer is listed alone.
2. Joined on the minimizer, a path of one content wherever it stands has no branch inside.
   At its coordinates in every document that holds it, its source too, the words
   themselves are digested (128 bits of a cryptographic hash); only paths whose digests
   all agree are taken as one.
3. Such paths follow each other. Where all documents agree on what follows a path and
   what precedes the next, the two don't branch either and are linked; joins compact each
   chain of links to one long path, known by its head and its number of paths. What a
   document repeats is then a few heads.
4. Where contents differ the graph branches inside the path. Only those paths are opened
   into windows, which are joined again by two 64-bit hashes of their content.
5. The repeated paths' and windows' coordinates are laid over the texts; words that they
   cover are removed.

Rows are combined before each shuffle, so a passage that a third of all documents share
is one row per task. Texts without shared paths are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import chunks, components, mix, range_hashes, text_buffers, window_hashes, with_row_key, words_of, written

_U = np.uint64


class Paths:
    """Words, windows and compacted paths of a run of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, k: int) -> None:
        self.window, self.k = window, k
        self.words, self.starts, self.ends, self.bounds = words_of(data, offsets, lower=False)
        kmers = window_hashes(self.words, k)
        width = window - k + 1
        self.n = max(0, len(kmers) - width + 1)
        least, at = kmers, np.arange(len(kmers))
        span = 1
        while span < width and self.n:  # the leftmost minimum of each `width` k-mers, by doubling
            step = min(span, width - span)
            size = len(least) - step
            right = least[step:] < least[:size]
            least = np.where(right, least[step:], least[:size])
            at = np.where(right, at[step:], at[:size])
            span += step
        self.seed, self.at = least[: self.n], at[: self.n]

    def windows(self, i: int) -> tuple[int, int]:
        """First window of text i and the one after its last."""
        a, b = int(self.bounds[i]), int(self.bounds[i + 1])
        return a, max(a, b - self.window + 1)

    def paths(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First windows, ends (exclusive) and minimizers of text i's compacted paths."""
        a, b = self.windows(i)
        if a == b:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
        at = self.at[a:b]
        first = a + np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        return first, np.append(first[1:], b), self.seed[first]


def _each(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Paths]]:
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for a, b in chunks(offsets):
            part = data[offsets[a] : offsets[b]]
            yield batch.slice(a, b - a), part, Paths(part, offsets[a : b + 1] - offsets[a], window, k)


def _sha(part: np.ndarray, paths: Paths, i: int, keep: np.ndarray | None = None) -> str:
    a, b = int(paths.bounds[i]), int(paths.bounds[i + 1])
    if a == b:
        return hashlib.sha256().hexdigest()
    text = part[paths.starts[a] : paths.ends[b - 1]].tobytes().split()
    if keep is not None:
        text = [w for w, k in zip(text, keep, strict=True) if k]
    return hashlib.sha256(b" ".join(text)).hexdigest()


def _digest(part: np.ndarray, paths: Paths, a: int, b: int) -> bytes:
    """128 bits of the words a to b, however they are spaced."""
    words = part[paths.starts[a] : paths.ends[b - 1]].tobytes().split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def remove_repeats(docs: DataFrame, window: int = 50, k: int = 25, spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs (doc_id, text); with
    spans=True also removed, the removed word ranges as start:end, comma-joined.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. A null text has no words. A row with a null
    doc_id has no place in the order: nothing is removed from it or because of it. Rows
    with one doc_id don't remove each other's words. Other columns are not read; an
    empty table gives no rows. Memory is one Arrow batch, or one text, and its arrays.
    """
    keyed = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part, p in _each(batches, window, k):
            ids = batch.column("doc_id")
            seeds, contents, sha, sizes = [], [], [], [0]
            first = [p.paths(i) for i in range(len(ids))]
            a, b, s = (np.concatenate(x) for x in zip(*first, strict=True))
            content = range_hashes(p.words, a, b + window - 1) + mix((p.at[a] - a).astype(_U) + _U(1))
            at = 0
            for i in range(len(ids)):
                n = len(first[i][0])
                if n and ids[i].is_valid:
                    _, own = np.unique(content[at : at + n], return_index=True)
                    seeds.append(s[at : at + n][own])
                    contents.append(content[at : at + n][own])
                    sizes.append(len(own))
                else:
                    sizes.append(0)
                at += n
                sha.append(_sha(part, p, i))
            none = np.zeros(0, _U)
            bounds = pa.array(np.cumsum(sizes).astype(np.int32))
            seeds, contents = (pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([*x, none]).view(np.int64))) for x in (seeds, contents))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), ids, pa.array(np.diff(p.bounds)), _strings(sha), seeds, contents], names=["_row", "doc_id", "n_words", "sha", "seeds", "contents"])

    scanned = written(keyed.select("_row", "doc_id", "text").mapInArrow(scan, "_row long, doc_id long, n_words long, sha string, seeds array<long>, contents array<long>"), "paths")
    listed = scanned.select("_row", "doc_id", F.explode(F.arrays_zip("seeds", "contents")).alias("p")).select("_row", "doc_id", F.col("p.seeds").alias("seed"), F.col("p.contents").alias("content"))
    seeds = listed.groupBy("seed").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min("content").alias("c0"), F.max("content").alias("c1"))
    shared = seeds.filter("source < last").select("seed", (F.col("c0") != F.col("c1")).alias("branches"))
    marks = listed.join(shared, "seed").groupBy("_row").agg(F.collect_set(F.when(~F.col("branches"), F.col("seed"))).alias("solid"), F.collect_set(F.when(F.col("branches"), F.col("seed"))).alias("open"))
    marked = written(keyed.join(marks, "_row"), "marked-texts")

    def solid_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part, p in _each(batches, window, k):
            for i in range(batch.num_rows):
                first, end, seed = p.paths(i)
                seed = seed.view(np.int64)
                solid = np.isin(seed, _cell(batch.column("solid"), i))
                at = np.flatnonzero(solid)
                if not len(at):
                    continue
                around = np.concatenate(([0], np.where(solid, seed, 0), [0]))  # 0: no path, or one that branches
                digests = np.frombuffer(b"".join(_digest(part, p, first[n], end[n] + window - 1) for n in at), np.int64).reshape(-1, 2)
                same = [pa.array(np.full(len(at), batch.column(c)[i].as_py())) for c in ("_row", "doc_id")]
                yield pa.RecordBatch.from_arrays([*same, *map(pa.array, (seed[at], around[at], around[at + 2], digests[:, 0], digests[:, 1]))], names=["_row", "doc_id", "seed", "before", "after", "d1", "d2"])

    solid = marked.filter(F.size("solid") > 0).select("_row", "doc_id", "text", "solid").mapInArrow(solid_paths, "_row long, doc_id long, seed long, before long, after long, d1 long, d2 long")
    solid = written(solid, "solid-paths")
    ends = [f(c).alias(f"{c}_{n}") for c in ("before", "after", "d1", "d2") for n, f in (("lo", F.min), ("hi", F.max))]
    judged = written(solid.groupBy("seed").agg(*ends, F.min("doc_id").alias("source")), "judged-paths")
    sure = judged.filter("d1_lo = d1_hi and d2_lo = d2_hi")
    ahead = sure.filter("after_lo = after_hi and after_lo <> 0").select("seed", F.col("after_lo").alias("next"))
    behind = sure.filter("before_lo = before_hi and before_lo <> 0").select(F.col("before_lo").alias("seed"), F.col("seed").alias("next"))
    linked = written(ahead.join(behind, ["seed", "next"]), "path-links")
    chains = components(linked, "seed", "next").withColumnRenamed("node", "seed")
    of = sure.select("seed", "source").join(chains, "seed", "left").withColumn("chain", F.coalesce("component", "seed"))
    sizes = of.groupBy("chain").agg(F.count("*").alias("paths"))
    heads = of.join(linked.select(F.col("next").alias("seed")), "seed", "left_anti").join(sizes, "chain").select("seed", "source", "paths")
    repeats = solid.select("_row", "doc_id", "seed").join(heads, "seed").filter("doc_id > source").groupBy("_row").agg(F.collect_set(F.struct("seed", "paths")).alias("heads"))
    doubtful = solid.join(judged.filter("d1_lo <> d1_hi or d2_lo <> d2_hi").select("seed"), "seed").groupBy("_row").agg(F.collect_set("seed").alias("doubt"))

    def open_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, p in _each(batches, window, k):
            hi = window_hashes(p.words, window)
            lo = window_hashes(mix(p.words ^ _U(0x2545F4914F6CDD1D)), window)
            for i in range(batch.num_rows):
                a, b = p.windows(i)
                wanted = _cell(batch.column("open"), i)
                if a < b and len(wanted):
                    at = a + np.flatnonzero(np.isin(p.seed[a:b].view(np.int64), wanted))
                    _, own = np.unique(hi[at], return_index=True)
                    at = at[own]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch.column("_row")[i].as_py())), pa.array(np.full(len(at), batch.column("doc_id")[i].as_py())), pa.array(hi[at].view(np.int64)), pa.array(lo[at].view(np.int64))], names=["_row", "doc_id", "hi", "lo"])

    branching = marked.join(doubtful, "_row", "left").withColumn("open", F.concat("open", F.coalesce("doubt", F.array().cast("array<bigint>"))))
    opened = written(branching.filter(F.size("open") > 0).select("_row", "doc_id", "text", "open").mapInArrow(open_paths, "_row long, doc_id long, hi long, lo long"), "open-windows")
    sources = opened.groupBy("hi", "lo").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).filter("source < last").select("hi", "lo", "source")
    repeated = opened.join(sources, ["hi", "lo"]).filter("doc_id > source").groupBy("_row").agg(F.collect_list(F.struct("hi", "lo")).alias("repeated"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part, p in _each(batches, window, k):
            hi = window_hashes(p.words, window).view(np.int64)
            lo = window_hashes(mix(p.words ^ _U(0x2545F4914F6CDD1D)), window).view(np.int64)
            removed, sha, ranges = [], [], []
            for i in range(batch.num_rows):
                a, b = p.windows(i)
                hit = np.zeros(b - a, bool)
                first, end, seed = p.paths(i)
                heads = batch.column("heads")[i].values
                if heads is not None and len(heads):
                    names, paths = (heads.field(c).to_numpy() for c in ("seed", "paths"))
                    order = np.argsort(names)
                    at = np.flatnonzero(np.isin(seed.view(np.int64), names))
                    last = at + paths[order][np.searchsorted(names[order], seed.view(np.int64)[at])] - 1
                    for x, y in zip(first[at] - a, end[np.minimum(last, len(end) - 1)] - a, strict=True):
                        hit[x:y] = True
                windows = batch.column("repeated")[i].values
                if windows is not None and len(windows):
                    high, low = (windows.field(c).to_numpy() for c in ("hi", "lo"))
                    at = np.flatnonzero(np.isin(hi[a:b], high))
                    held = set(zip(high.tolist(), low.tolist(), strict=True))
                    hit[at] |= np.array([x in held for x in zip(hi[a:b][at].tolist(), lo[a:b][at].tolist(), strict=True)], bool)
                cover = np.zeros(int(p.bounds[i + 1]) - a + 1, np.int64)
                at = np.flatnonzero(hit)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                sha.append(_sha(part, p, i, ~gone))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                ranges.append(",".join(f"{x}:{y}" for x, y in edge.reshape(-1, 2)))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(removed, pa.int64()), _strings(sha), _strings(ranges)], names=["_row", "n_removed", "cut_sha", "removed"])

    gone = repeats.join(repeated, "_row", "full_outer")
    done = marked.select("_row", "text").join(gone, "_row").select("_row", "text", "heads", "repeated").mapInArrow(cut, "_row long, n_removed long, cut_sha string, removed string")
    out = scanned.select("_row", "doc_id", "n_words", "sha").join(done, "_row", "left")
    columns = ["doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256")]
    return out.select(*columns, *([F.coalesce("removed", F.lit("")).alias("removed")] if spans else []))


def _cell(column: pa.Array, i: int) -> np.ndarray:
    cell = column[i].values
    return cell.to_numpy(zero_copy_only=False) if cell is not None and len(cell) else np.zeros(0, np.int64)
