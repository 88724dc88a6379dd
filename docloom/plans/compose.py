"""HTML pages composed into Markdown documents by a converting provider."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import chunking
from docloom.operators.answers import stripped
from docloom.sources.tables import materialized

#: What a part is asked with, and the name of a document without one.
PROMPT, DRAFT_NAME = "Tiêu đề: {} (Phần {}/{})\n\nNội dung HTML phần này:\n{}", "Ban_Nhaps.md"
FIELDS = ["title", "program_level", "program_name", "academic_year", "reference_url"]


def unfenced(text: Column) -> Column:
    """A text without a code fence around it."""
    return stripped(F.regexp_replace(F.regexp_replace(stripped(text), r"\A```[a-zA-Z]*\n", ""), r"\n```\z", ""))


def composed(pages: DataFrame, ask: Callable[[DataFrame], DataFrame], most: int = 20_000) -> DataFrame:
    """page_id, file_name, content, n_parts, error of pages (page_id, html, title,
    file_name, program_level, program_name, academic_year, reference_url).

    The HTML is cut into groups of whole lines of at most `most` characters; ask adds answer
    (and error) to rows with text, one for each group. A page of which one group has no
    answer has no content, but the reasons. Groups are dealt out over the tasks, so a long
    page waits for its slowest group alone; answers are written once before they are
    joined. Empty and null fields are left out of the frontmatter; null HTML is empty."""
    parts = chunking.chunk_texts(pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), lambda t: chunking.pack_lines(t, most))
    asked = parts.join(pages.select(F.col("page_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title")), "doc_id")
    pieces = PROMPT.split("{}")
    prompt = F.concat(F.lit(pieces[0]), "title", F.lit(pieces[1]), "chunk_index", F.lit(pieces[2]), "total", F.lit(pieces[3]), "content")
    said = materialized(ask(asked.select("doc_id", "chunk_index", prompt.alias("text"))))
    whole = said.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", unfenced(F.col("answer")).alias("part")))).alias("p"),
        F.count("*").cast("int").alias("n_parts"), F.count_if(F.col("answer").isNull()).alias("failed"), F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("error"),
    )
    body = unfenced(F.array_join(F.transform("p", lambda x: x["part"]), "\n\n"))
    head = F.concat_ws("\n", F.lit("---"), *[F.when((F.coalesce(F.col(c), F.lit("")) != "") | F.lit(c == "title"), F.concat(F.lit(f'{c}: "'), F.coalesce(F.col(c), F.lit("")), F.lit('"'))) for c in FIELDS], F.lit("---\n-start-"))
    name = F.coalesce(F.nullif(F.trim("file_name"), F.lit("")), F.lit(DRAFT_NAME))
    made = pages.join(whole.withColumnRenamed("doc_id", "page_id"), "page_id")
    return made.select("page_id", F.when(name.endswith(".md"), name).otherwise(F.concat(name, F.lit(".md"))).alias("file_name"), F.when(F.col("failed") == 0, F.concat(head, F.lit("\n\n"), body)).alias("content"), "n_parts", F.when(F.col("failed") > 0, F.col("error")).alias("error"))
