"""A bounded loop over rows: what passes leaves, the rest goes round again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import config
from docloom.sources.tables import materialized


def refined(rows: DataFrame, draft: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame], max_loops: int = config.LOOPS) -> DataFrame:
    """rows with draft, passed, critique and rounds: each row's last draft.

    draft gets rows with round (from 1) and critique (of the round before; null at first)
    and adds draft; check gets these and adds passed and said. Rows that passed leave the
    loop. After max_loops checks a last draft is made and taken as it is, passed and
    unchecked. A null verdict has passed, so that nothing goes round for lack of one.

    Each round is written before it is divided, so neither draft nor check runs twice for
    a row, and only rows still open are read again; the loop ends early when none is."""
    names = {"draft", "passed", "critique", "rounds", "round", "said"} & {c.lower() for c in rows.columns}
    if names:
        raise ValueError(f"rows has columns {sorted(names)} already")
    own, left, done = rows.columns, rows.withColumn("critique", F.lit(None).cast("string")), []
    for n in range(1, max_loops + 2):
        drafted = draft(left.withColumn("round", F.lit(n)))
        if n > max_loops:
            done.append(drafted.withColumn("passed", F.lit(True)).withColumn("said", F.lit("")))
            break
        judged = materialized(check(drafted).withColumn("passed", F.coalesce("passed", F.lit(True))))
        done.append(judged.filter("passed"))
        left = judged.filter("not passed").select(*own, F.col("said").alias("critique"))
        if left.isEmpty():
            break
    out = [d.select(*own, "draft", "passed", F.coalesce("critique", F.lit("")).alias("critique"), F.col("round").alias("rounds")) for d in done]
    return reduce(DataFrame.unionByName, out)
