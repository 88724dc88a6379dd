"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a vector of shard loads. Again and again the two partial
partitions of largest spread are combined, oppositely ordered: the heaviest shard of one
meets the lightest of the other. One group of equal texts starts as one load and zeros.

Differencing is a sequence, so it runs twice: within buckets of bounded size, in
parallel, and then over the buckets' own load vectors, in as many rounds as it takes
until one is left. What a round leaves per bucket is one vector of loads, and what the
rounds decide per bucket is one permutation of its shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import with_row_key, written
from docloom.llm.packing import ranked

#: Groups, or load vectors, that one task differences.
BUCKET = 8192
FAN_IN = 512


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines load vectors (n x k). Returns the shard of each vector's entries
    (n x k, a permutation per row) and the loads of the shards."""
    n, k = vectors.shape
    order = np.argsort(vectors, axis=1, kind="stable")
    loads = [row[o] for row, o in zip(vectors, order, strict=True)]  # ascending
    heap = [(-int(v[-1] - v[0]), i) for i, v in enumerate(loads)]
    heapq.heapify(heap)
    # where[i]: for what was combined into i, the node it came from and how its places were dealt
    children: dict[int, list[tuple[int, np.ndarray]]] = {}
    live = dict(enumerate(loads))
    node = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = live.pop(a) + live.pop(b)[::-1]
        o = np.argsort(total, kind="stable")
        place = np.empty(k, np.int64)
        place[o] = np.arange(k)
        children[node] = [(a, place), (b, place[::-1])]
        live[node] = total[o]
        heapq.heappush(heap, (-int(total[o[-1]] - total[o[0]]), node))
        node += 1
    root = heap[0][1]
    shard_of_place: dict[int, np.ndarray] = {root: np.arange(k)}
    result = np.empty((n, k), np.int64)
    for at in range(root, -1, -1):  # children have smaller numbers
        shards = shard_of_place.pop(at, None)
        if shards is None:
            continue
        for child, place in children.get(at, ()):
            shard_of_place[child] = shards[place]
        if at < n:
            result[at, order[at]] = shards
    return result, live[root]


def _loads(shards: int) -> list[str]:
    return [f"l{i}" for i in range(shards)]


def assign(groups: DataFrame, shards: int) -> DataFrame:
    """shard of each group, from (group, size): size a long. Groups without rows: none."""
    spark = groups.sparkSession
    n = groups.count()
    buckets = max(1, -(-n // BUCKET))
    loads = _loads(shards)
    load_schema = ", ".join(f"{c} long" for c in loads)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "group"], ascending=False, ignore_index=True)
        v = np.zeros((len(pdf), shards), np.int64)
        v[:, -1] = pdf["size"]
        return pd.DataFrame({"bucket": pdf["bucket"], "group": pdf["group"], "size": pdf["size"], "place": difference(v)[0][:, -1].astype(np.int32)})

    placed = groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets))).groupBy("bucket").applyInPandas(first, f"bucket long, group {groups.schema['group'].dataType.simpleString()}, size long, place int")
    placed = written(placed, "shard-groups")
    sums = placed.groupBy("bucket").agg(*[F.sum(F.when(F.col("place") == i, F.col("size")).otherwise(0)).alias(c) for i, c in enumerate(loads)])
    # bucket_place -> place one level up, until one bucket is left
    maps = []
    level, left = sums, buckets
    while left > 1:
        left = -(-left // FAN_IN)

        def combine(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("bucket", ignore_index=True)
            dealt, total = difference(pdf[loads].to_numpy(np.int64))
            return pd.DataFrame([(b, up, s.tolist(), total.tolist()) for b, up, s in zip(pdf["bucket"], pdf["up"], dealt, strict=True)], columns=["bucket", "up", "dealt", "total"])

        done = written(level.withColumn("up", F.pmod(F.col("bucket"), F.lit(left))).groupBy("up").applyInPandas(combine, "bucket long, up long, dealt array<int>, total array<long>"), "shard-level")
        maps.append(done.select("bucket", "up", "dealt"))
        level = done.groupBy("up").agg(F.any_value("total").alias("total")).select(F.col("up").alias("bucket"), *[F.col("total")[i].alias(c) for i, c in enumerate(loads)])
    out = placed
    for m in maps:
        out = out.join(m, "bucket").select(F.col("up").alias("bucket"), "group", F.col("dealt")[F.col("place")].alias("place"))
    return out.select("group", F.col("place").cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs.

    Law: ``bytes``. Rows of equal text are a group and stay together; a null text counts
    as empty (size 16, checksum 0). Repeated rows are rows of one group; a null doc_id
    stays null; other columns are not read; an empty table gives no rows. A group's rows
    are summed before the shuffle, and slots are numbered by buckets within a shard.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("group"))
    sized = written(with_row_key(sized), "sized")
    groups = sized.groupBy("group").agg(F.sum("size").alias("size"))
    dealt = sized.join(assign(groups, shards), "group").drop("group")
    numbered = ranked(dealt, "shard", ["doc_id", "_row"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
