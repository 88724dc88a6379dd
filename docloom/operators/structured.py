"""Parents and children of structured program texts, with context in front of each.

A text falls apart at headings that stand alone on a line. Each section is a parent, and
its paragraphs are the children if it is long; every chunk opens with the program that the
first heading names, its abbreviations and its code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import answers, chunking, headers

#: Headings of structured program texts.
SECTION_HEADINGS = [
    r"CHƯƠNG TRÌNH ĐÀO TẠO[^*\r\n.,\"]*", r"GIỚI THIỆU CHƯƠNG TRÌNH[^*\r\n.,\"]*", "ĐIỀU KIỆN XÉT TUYỂN", "CƠ HỘI NGHỀ NGHIỆP",
    r"CHÍNH SÁCH ƯU ĐÃI?\s*HỌC PHÍ", "MỤC TIÊU ĐÀO TẠO", "CHUẨN ĐẦU RA", "PHƯƠNG THỨC TUYỂN SINH",
]
#: Folders that tell a program's level, levels as they are written, what a
#: text without headings is called, and how many tokens of three characters make it long.
FOLDERS = {"Ctrinh Thac Si": "thac_si", "Ctrinh Tien Si": "tien_si"}
LEVEL_NAMES = {"thac_si": "Thạc sĩ", "tien_si": "Tiến sĩ", "dai_hoc": "Đại học"}
WHOLE, LONG_TOKENS = "(Toàn văn)", 300

_HEADING = rf"(?iumd)^(?:\*\*)?({'|'.join(SECTION_HEADINGS)})(?:\*\*)?\s*\r?$"


def level_of(path: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(path, F.lit(folder)), level) for folder, level in FOLDERS.items()], F.lit("unknown"))


def sections(text: Column) -> Column:
    """Array of (heading, body) of a text, sections without a body left out; one of the
    whole text where there is no heading. What stands before the first heading goes."""
    bare = answers.stripped(text)
    found = F.regexp_extract_all(bare, F.lit(_HEADING), F.lit(1))
    bodies = F.slice(F.split(bare, _HEADING), F.lit(2), F.greatest(F.size(found), F.lit(1)))
    named = F.zip_with(found, bodies, lambda h, b: F.struct(F.regexp_replace(answers.stripped(h), r"^\*+|\*+\z", "").alias("heading"), answers.stripped(b).alias("body")))
    whole = F.array(F.struct(F.lit(WHOLE).alias("heading"), bare.alias("body")))
    return F.filter(F.when(F.size(found) > 0, named).otherwise(whole), lambda s: s["body"] != "")


def children(body: Column) -> Column:
    """Paragraphs of a long body, else the body itself."""
    return F.when(F.floor(F.length(body) / 3) > LONG_TOKENS, chunking.paragraphs(body)).otherwise(F.array(body))


def prefix(level: Column, name: Column) -> Column:
    """[Chương trình: level name (abbreviations) | Mã ngành: code], as far as known."""
    short, code = answers.abbreviations(name), headers.program_code(level, name)
    more = F.concat(F.coalesce(F.concat(F.lit(" ("), short, F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" | Mã ngành: "), code), F.lit("")))
    return F.concat(F.lit("[Chương trình: "), _label(level), F.lit(" "), name, more, F.lit("]"))


def _label(level: Column) -> Column:
    return F.coalesce(*[F.when(level == k, v) for k, v in LEVEL_NAMES.items()], level)


def chunks(docs: DataFrame, year: str = "2026") -> DataFrame:
    """Parents and children of docs (source, path, text): chunk_id, parent_id, chunk_level,
    source, version, chunk_index (from 1), total, section_path, section_name, program_name,
    program_level, program_code, academic_year, content, content_hash, children_ids,
    is_active. Ids are hashes of the source and the chunk's place. A null or blank text has
    no chunks. One row a document, until its sections are exploded: nothing is shuffled."""
    read = docs.select("source", level_of(F.col("path")).alias("program_level"), sections(F.coalesce("text", F.lit(""))).alias("s")).filter("size(s) > 0")
    read = read.withColumn("program_name", answers.program_name(F.element_at("s", 1)["heading"])).withColumn("total", F.size("s"))
    read = read.withColumn("prefix", prefix(F.col("program_level"), F.col("program_name"))).withColumn("program_code", headers.program_code(F.col("program_level"), F.col("program_name")))
    each = read.select("*", F.posexplode("s").alias("at", "section")).drop("s").select("*", "section.*").drop("section")
    each = each.withColumn("section_path", F.concat(_label(F.col("program_level")), F.lit(" "), "program_name", F.lit(" > "), "heading"))
    each = each.withColumn("own_id", F.sha2(F.concat_ws("#", "source", F.lit("section"), "at"), 256)).withColumn("parts", children(F.col("body")))
    each = each.withColumn("ids", F.transform("parts", lambda _, i: F.sha2(F.concat_ws("#", F.col("own_id"), i), 256)))
    none, text = F.lit(None).cast("string"), lambda *p: F.concat(*p).alias("content")
    chunk = lambda i, up, kind, at, n, content, kids: F.struct(i.alias("chunk_id"), up.alias("parent_id"), F.lit(kind).alias("chunk_level"), at.alias("chunk_index"), n.alias("total"), content, kids.alias("children_ids"))
    parent = chunk(F.col("own_id"), none, "parent", F.col("at") + 1, F.col("total"), text("prefix", F.lit("\n"), "heading", F.lit("\n\n"), "body"), F.col("ids"))
    kids = F.transform("parts", lambda p, i: chunk(F.element_at("ids", i + 1), F.col("own_id"), "child", i + 1, F.size("parts"), text(F.col("prefix"), F.lit(" — "), F.col("heading"), F.lit("\n\n"), p), F.array().cast("array<string>")))
    rows = each.withColumn("c", F.explode(F.concat(F.array(parent), kids)))
    return rows.select(
        "c.chunk_id", "c.parent_id", "c.chunk_level", "source", F.lit(1).alias("version"), "c.chunk_index", "c.total", "section_path", F.col("heading").alias("section_name"),
        "program_name", "program_level", "program_code", F.lit(year).alias("academic_year"), "c.content", F.sha2("c.content", 256).alias("content_hash"), "c.children_ids", F.lit(True).alias("is_active"),
    )
