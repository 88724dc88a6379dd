"""Headers in front of old documents, as YAML frontmatter, and what the rewrite says of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import config
from docloom.functions import text as T
from docloom.operators import headers
from docloom.operators.answers import stripped

#: Folders that tell a document's kind, words of titles that come first, and
#: keywords by level.
KINDS, DEFAULT_KIND = ["thongtinchung", "maudon"], "thongtinchung"
TITLE_WORDS = ["mẫu đơn", "đơn đăng ký", "đơn dự tuyển", "giấy cam đoan", "đề cương", "phiếu đăng ký", "lý lịch", "phụ lục"]
KEYWORDS = {"thac_si": ["thạc sĩ", "cao học", "tuyển sinh"], "tien_si": ["tiến sĩ", "NCS", "nghiên cứu sinh"], "dai_hoc": ["đại học", "tuyển sinh"]}
STATUSES = {"yaml": "already_yaml", "none": "no_header", "legacy": "converted"}


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def metadata(text: Column, path: Column) -> Column:
    """Struct of what an old header (all before -start-) and the path say of a document:
    doc_type, doc_id, title, effective_date, doc_number, program_level, academic_year,
    keywords."""
    parts = F.split(path, "/")
    head = stripped(F.split(text, "-start-", 2)[0])
    low = F.lower(head)
    bare = F.transform(F.split(head, "\\r?\\n"), lambda s: stripped(F.regexp_replace(stripped(F.regexp_replace(stripped(s), "^#+", "")), r"^\*+|\*+\z", "")))
    titles = F.filter(bare, lambda s: (s != "") & ~F.lower(s).startswith("ngày hiệu lực") & ~F.lower(s).startswith("văn bản"))
    special = F.filter(titles, lambda s: reduce(lambda a, w: a | F.contains(F.lower(s), F.lit(w)), TITLE_WORDS, F.lit(False)))
    level = F.coalesce(*[F.when(low.rlike(f"(?u){p}"), name) for p, name in config.LEGACY_LEVELS])
    keywords = F.coalesce(*[F.when(level == k, F.array(*map(F.lit, words))) for k, words in KEYWORDS.items()], F.array().cast("array<string>"))
    return F.struct(
        F.coalesce(F.when(F.get(parts, F.size(parts) - 2).isin(KINDS), F.get(parts, F.size(parts) - 2)), F.lit(DEFAULT_KIND)).alias("doc_type"),
        T.slugify(F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*\z", "")).alias("doc_id"),
        F.coalesce(F.try_element_at(special, F.lit(1)), F.try_element_at(titles, F.lit(-1))).alias("title"),
        F.date_format(F.try_to_timestamp(_found(head, r"Ngày hiệu lực:\s*(\d{2}/\d{2}/\d{4})"), F.lit("dd/MM/yyyy")), "yyyy-MM-dd").alias("effective_date"),
        F.regexp_replace(stripped(_found(head, r"Văn bản\s*[Ss]ố:\s*(.+)")), r"\s*/\s*", "/").alias("doc_number"),
        level.alias("program_level"), _found(low, r"năm\s+(\d{4})").alias("academic_year"), keywords.alias("keywords"),
    )


def frontmatter(meta: Column) -> Column:
    """The YAML block of metadata(); what is null or empty is left out."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    title = F.coalesce(F.replace(meta["title"], F.lit('"'), F.lit('\\"')), meta["doc_id"])
    keywords = F.when(F.size(meta["keywords"]) > 0, F.concat(F.lit("["), F.array_join(meta["keywords"], ", "), F.lit("]")))
    return F.concat_ws(
        "\n", F.lit("---"), line("doc_type", meta["doc_type"]), line("doc_id", meta["doc_id"]), line("title", quoted(title)), line("effective_date", meta["effective_date"]),
        line("doc_number", quoted(meta["doc_number"])), line("program_level", meta["program_level"]), line("academic_year", quoted(meta["academic_year"])), line("keywords", keywords), F.lit("---"),
    )


def converted(docs: DataFrame) -> DataFrame:
    """docs (path, text) with status (already_yaml, no_header or converted), meta and
    new_text: the frontmatter, what else the old header says, and the body behind -start-.
    meta and new_text are null where nothing is converted. A null text has no header."""
    clean = docs.withColumn("_text", T.unescape_markdown(F.coalesce("text", F.lit(""))))
    form = T.header_format(F.col("_text"))
    old = form == "legacy"
    made = clean.withColumn("status", F.coalesce(*[F.when(form == k, v) for k, v in STATUSES.items()])).withColumn("meta", F.when(old, metadata(F.col("_text"), F.col("path"))))
    split = F.split("_text", "-start-", 2)
    kept = F.filter(F.split(stripped(split[0]), "\\r?\\n"), lambda s: ~stripped(s).rlike(r"(?iu)^(?:$|Ngày hiệu lực:|Văn bản\s*[Ss]ố:)"))
    between = F.nullif(stripped(F.array_join(kept, "\n")), F.lit(""))
    new = F.concat(F.concat_ws("\n", frontmatter(F.col("meta")), between, F.lit("-start-")), split[1])
    return made.withColumn("new_text", F.when(old, new)).drop("_text")


def compressed(docs: DataFrame) -> DataFrame:
    """docs (text) with new_text, its placeholders short, and saved, dots_before,
    dots_after: characters saved, and characters of three dots and more in a row."""
    dots = lambda c: F.aggregate(F.regexp_extract_all(c, F.lit(r"(\.{3,})"), F.lit(1)), F.lit(0), lambda s, x: s + F.length(x))
    made = docs.withColumn("new_text", headers.compress_placeholders(F.coalesce("text", F.lit(""))))
    text = F.coalesce("text", F.lit(""))
    return made.withColumn("saved", F.length(text) - F.length("new_text")).withColumn("dots_before", dots(text)).withColumn("dots_after", dots(F.col("new_text")))
