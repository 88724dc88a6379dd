"""Running sums over groups of any size, in two levels.

A window keeps a group in one task. Here rows are dealt out by ranges of (group, order),
summed within each range, and what stands in earlier ranges is added as an offset: only
groups that cross a border need one, so there are at most two offsets per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.tables import materialized


def running(rows: DataFrame, key: str, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """rows with sums (name: column) over the rows of the same key that come earlier, null
    values as 0. order tells any two rows of a key apart, or equal ones stand in any order.
    Null is a key like others. Keep wide columns out of rows and join them after."""
    dealt = materialized(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{n}") for n, c in sums.items()])
    totals = dealt.groupBy("_range", key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{n}_all") for n, c in sums.items()])
    crossing = totals.join(totals.groupBy(key).agg(F.count("*").alias("_ranges")).filter("_ranges > 1").withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = crossing.select(F.col("_range").alias("_r"), F.col(key).alias("_key"), *[F.coalesce(F.sum(f"_{n}_all").over(earlier), F.lit(0)).alias(f"_{n}_off") for n in sums])
    met = local.join(F.broadcast(offsets), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return met.select(*rows.columns, *[(F.col(f"_{n}") + F.coalesce(f"_{n}_off", F.lit(0))).alias(n) for n in sums])


def numbered(rows: DataFrame, key: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """rows with their number in their key's order, from 1."""
    one = running(rows.withColumn("_one", F.lit(1).cast("long")), key, order, {name: "_one"})
    return one.withColumn(name, F.col(name) + 1).drop("_one")
