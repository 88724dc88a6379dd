"""Fill-in-middle texts: a document's middle moved behind its end.

A text is cut at two token ranks by a matcher that holds one match at a time. The first
pass counts the tokens; the ranks follow from the count and the document's hash; the
second pass advances the same lazy matcher to both ranks and stops there. No token is
kept, so beside its text a document takes constant memory. The matcher is a pandas
function that returns three numbers a text; all strings are cut and joined by column
functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.llm.common import free_name

#: Fixed values of the contract: tokens, marks and the seed of the choice.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "42:"


def cuts(text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """Number of tokens of text, and where, in characters, the prefix and the middle end:
    behind the smaller and the larger of h1 and h2 modulo one more than that number."""
    find = re.compile(TOKEN).finditer
    n = sum(1 for _ in find(text))
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = [0, 0]
    matches = find(text)
    done = 0
    for i, rank in enumerate((first, second)):
        end = at[i - 1] if i else 0
        while done < rank:
            end = next(matches).end()
            done += 1
        at[i] = end
    return n, at[0], at[1]


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("n", "first", "second")]))
def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, h1, h2 in batches:
        yield pd.DataFrame([cuts(*row) for row in zip(text, h1, h2, strict=True)], columns=["n", "first", "second"])


def _part(digest: Column, i: int) -> Column:
    """The i-th group of eight hex digits as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null
    where plain) and output beside their own columns; these names must be free.

    `rate` percent of the documents are transformed, `spm` percent of those with the
    suffix first; the hash of a doc_id decides, so repeated rows fare alike and runs
    repeat. A null doc_id is hashed as the empty string. A null or empty text, and one
    that holds a mark, stays plain (a null one is empty). Prefix, middle or suffix may be
    empty, where ranks tie or fall on an end. Texts are cut whole, whatever their length.
    An empty table gives no rows; other columns are carried along.
    """
    clash = {c.lower() for c in docs.columns} & {"n", "form", "prefix_chars", "middle_chars", "output"}
    if clash:
        raise ValueError(f"docs has columns {sorted(clash)} already")
    text, digest, at = (free_name(docs, c) for c in ("_text", "_digest", "_cuts"))
    made = docs.withColumn(text, F.coalesce("text", F.lit(""))).withColumn(digest, F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    made = made.withColumn(at, _cuts(text, _part(F.col(digest), 0), _part(F.col(digest), 1)))
    t, c = F.col(text), F.col(at)
    marked = F.contains(t, F.lit(PREFIX)) | F.contains(t, F.lit(SUFFIX)) | F.contains(t, F.lit(MIDDLE))
    plain = (t == "") | marked | (_part(F.col(digest), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_part(F.col(digest), 3) % 100 < spm, "spm").otherwise("psm")
    first, second = c["first"].cast("int"), c["second"].cast("int")
    prefix, middle, suffix = F.left(t, first), F.substring(t, first + 1, second - first), F.substring(t, second + 1, F.length(t))
    made = made.withColumn("n", c["n"]).withColumn("form", form)
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(t)
    cut = F.col("form") != "plain"
    made = made.withColumn("prefix_chars", F.when(cut, c["first"])).withColumn("middle_chars", F.when(cut, c["second"] - c["first"])).withColumn("output", output)
    return made.drop(text, digest, at)


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of. A part never holds a mark, nor can the end of one
    and the beginning of a mark give an earlier one, so the first mark of a kind divides."""
    second, third = F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.lit(MIDDLE)
    body = F.substring(output, 4, F.length(output))
    x = F.instr(body, second)  # 1 + the length of what stands first
    y = F.instr(body, third)
    one, two, three = F.left(body, x - 1), F.substring(body, x + 3, y - x - 3), F.substring(body, y + 3, F.length(body))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of
    the text restored from output and form, of transform's rows."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
