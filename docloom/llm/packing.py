"""Best-fit packing of tokenized documents into sequences of a fixed size.

Method: best-two-fit. Bins are filled greedily (largest first, then the largest piece
that still fits); then the smallest piece of a bin is taken out and replaced by the two
unpacked pieces that fit the widened gap more tightly, if there are any.

Only lengths matter to a bin, so the plan is made over the histogram of lengths, which
has at most ``size`` entries however many documents there are. A bin's pattern of
lengths is used as often as the histogram allows, so that each step exhausts a length
or leaves fewer of it than one bin takes; the plan stays a few thousand rows. Pieces
then get their places by a distributed numbering within each length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import with_row_key, written

#: Rows that one numbering task takes, about.
NUMBERED_ROWS = 100_000


class Encoder:
    """Text -> its ids, uint32.

    The file is one of the tokenizers library (byte-level BPE, ids in the order of the
    merges); tiktoken encodes by its vocabulary, which gives the same ids several times
    faster (the tests compare the two). Strings of special tokens count as those
    tokens, as is that library's default.
    """

    _pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, tokenizer_file: str) -> None:
        import tiktoken

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._bpe = tiktoken.Encoding("from-file", pat_str=self._pattern, mergeable_ranks=ranks, special_tokens=special)

    def text(self, text: str) -> np.ndarray:
        return self._bpe.encode_to_numpy(text, allowed_special="all")


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer_file: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each
    document's pieces. A document is its ids and end_id; a longer one than size is cut
    from its end, so that its first piece takes the rest."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(tokenizer_file) or _encoders.setdefault(tokenizer_file, Encoder(tokenizer_file))
        for batch in batches:
            source, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(map(pa.StringScalar.as_py, batch.column("text"))):
                ids = enc.text(text or "").astype("<u4").tobytes() + end
                n, at, p = len(ids) // 4, 0, 0
                while at < n:
                    to = at + ((n - at) % size or size)
                    source.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at, p = to, p + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths (longest first) and how many bins use each."""
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    out = []

    def spend(pattern: list[int]) -> int:
        need = Counter(pattern)
        times = min(left[n] // c for n, c in need.items())
        for n, c in need.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
                lengths.remove(n)
        return times

    def largest(room: int, used: Counter) -> int | None:
        """The largest length of at most room that the histogram still has."""
        i = bisect_right(lengths, room) - 1
        while i >= 0 and left[lengths[i]] <= used[lengths[i]]:
            i -= 1
        return lengths[i] if i >= 0 else None

    while lengths:
        pattern, used, room = [], Counter(), size
        while room and (n := largest(room, used)):
            pattern.append(n)
            used[n] += 1
            room -= n
        if room and len(pattern) > 1:  # replace the smallest piece by the best two
            small = pattern[-1]
            gap = room + small
            used[small] -= 1
            best = (small, None)
            for i in range(bisect_right(lengths, gap - 1) - 1, -1, -1):
                a = lengths[i]
                if 2 * a < best[0] or best[0] == gap:
                    break
                if left[a] <= used[a]:
                    continue
                used[a] += 1
                b = largest(min(a, gap - a), used)
                used[a] -= 1
                if b and a + b > best[0]:
                    best = (a + b, (a, b))
            pattern.pop()
            pattern.extend(best[1] or (small,))
        out.append((tuple(sorted(pattern, reverse=True)), spend(pattern)))
    return out


def places(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) for each place of each pattern."""
    out, next_rank, sequence = [], Counter(), 0
    for pattern, times in plan(histogram, size):
        offset = 0
        for n in pattern:
            out.append((n, next_rank[n], times, sequence, offset))
            next_rank[n] += times
            offset += n
        sequence += times
    return out


def ranked(df: DataFrame, key: str, order: list[str], rank: str = "rank") -> DataFrame:
    """Numbers the rows of each key from 0 without a key's rows meeting in one task:
    keys are split over buckets, numbered there, and offset by the buckets' counts."""
    n = max(1, -(-df.count() // NUMBERED_ROWS)) * 4
    split = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    offsets = split.groupBy(key, "_bucket").count().withColumn("_before", F.sum("count").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("count")).drop("count")
    inside = split.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1)
    return inside.join(offsets, [key, "_bucket"]).withColumn(rank, F.col("_before") + F.col("_at")).drop("_bucket", "_before", "_at")


def pack(docs: DataFrame, tokenizer_file: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece.

    A null or empty text is the end id alone. Repeated rows are packed each; a null
    doc_id stays null; other columns are not read; an empty table gives no rows.
    The pieces (no texts, no ids) are written once; the histogram has at most `size`
    rows and the plan a few thousand, so that both may go through the driver.
    """
    cut = written(pieces(with_row_key(docs.select("doc_id", "text")), tokenizer_file, size, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    spark = docs.sparkSession
    spots = spark.createDataFrame(places(histogram, size), "length long, first long, n long, sequence long, offset long")
    by_length = spots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "n", "sequence", "offset"))).alias("spots"))
    numbered = ranked(with_row_key(cut), "length", ["_row"])  # rows that repeat go to buckets of their own
    found = numbered.join(F.broadcast(by_length), "length").withColumn("spot", F.expr("spots[array_size(filter(spots, s -> s.first <= rank)) - 1]"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("spot.sequence + rank - spot.first").alias("sequence_id"), F.col("spot.offset").alias("offset"))
