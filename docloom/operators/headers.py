"""Document headers: YAML frontmatter, the legacy form, and their normal form."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import config
from docloom.functions import text as T

#: Fixed values of the header specification.
DOC_TYPES, PROGRAM_LEVELS = {"thongtinchung", "maudon"}, {"dai_hoc", "thac_si", "tien_si", "chung"}
FIELD_CHARS, TITLE_CHARS = 2000, 3000

FIELDS = "doc_type string, doc_id string, title string, doc_number string, parent_doc_id string, source_url string, program_level string, academic_year string, valid_from timestamp, keywords array<string>, header_context string"
RESULT = f"{FIELDS}, content string, errors array<string>, warnings array<string>"


def _text(value: object, most: int = FIELD_CHARS) -> str | None:
    return (str(value).strip()[:most] or None) if value is not None else None


def _effective(value: object) -> dt.datetime | None:
    """A header's date: ISO or d/m/Y text, or what YAML made of it; no date is None."""
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    if not value or not isinstance(value, str):
        return None
    try:
        return dt.datetime.fromisoformat(value).replace(tzinfo=None)
    except ValueError:
        return dt.datetime.strptime(value, "%d/%m/%Y")


def parse_yaml_header(text: str) -> dict | None:
    """Fields, body, errors and warnings of a text with YAML frontmatter, None of another
    text. An empty block has no fields. With an error the fields before it are there."""
    import yaml

    m = re.match(r"---\s*\n(.*?)\n---\s*\n", text, re.S)
    if not m:
        return None
    out: dict = {"content": text, "errors": [], "warnings": [], "keywords": []}
    clean = lambda **more: out | more | {"content": re.sub("(?i)" + config.DANGEROUS_TAG, "", out["content"])}
    if re.search(r"[&*]\w+", m[1]):
        return clean(errors=["anchor or alias"])
    try:
        fields = yaml.safe_load(m[1]) or {}
    except yaml.YAMLError:
        return clean(errors=["invalid yaml"])
    if not isinstance(fields, dict):
        return clean(errors=["not a mapping"])
    for name, value in fields.items():
        if isinstance(value, str) and any(re.search(p, value) for p in config.HEADER_INJECTION):
            out["warnings"].append(f"injection in {name}")
            for p in config.HEADER_INJECTION:
                value = re.sub(p, "", value)
            fields[name] = value.strip()
    head, marker, body = text[m.end() :].partition("-start-")
    out["content"] = (body if marker else head).strip()
    if marker:
        out["header_context"] = head.strip() or None
    else:
        out["warnings"].append("no -start- marker")
    kind, key = _text(fields.get("doc_type"), len(str(fields))), _text(fields.get("doc_id"), len(str(fields)))
    if kind and kind not in DOC_TYPES:
        return clean(errors=["bad doc_type"])
    out["doc_type"] = kind
    if key and not re.fullmatch(r"[A-Za-z0-9_-]+", key):
        return clean(errors=["bad doc_id"])
    out["doc_id"], out["title"] = _text(key), _text(fields.get("title"), TITLE_CHARS)
    try:
        out["valid_from"] = _effective(fields.get("effective_date"))
    except ValueError:
        return clean(errors=["bad effective_date"])
    level, url = _text(fields.get("program_level")), _text(fields.get("source_url") or fields.get("reference_url") or fields.get("url"))
    if level and level not in PROGRAM_LEVELS:
        out["warnings"].append("bad program_level")
    out["program_level"] = level if level in PROGRAM_LEVELS else None
    out |= {name: _text(fields.get(name)) for name in ("academic_year", "doc_number", "parent_doc_id")}
    if isinstance(words := fields.get("keywords"), list):
        out["keywords"] = [str(w)[:FIELD_CHARS] for w in words if w]
    fine = bool(url) and url.startswith(("http://", "https://")) and ".." not in url
    if url and not fine:
        out["warnings"].append("bad source_url")
    out["source_url"] = url if fine else None
    return clean()


def yaml_headers(docs: DataFrame) -> DataFrame:
    """docs (source, text) with the fields of parse_yaml_header, texts in NFC. A text
    without YAML frontmatter comes back as its content alone; headers() reads both forms."""
    import unicodedata

    names = [p.split()[0] for p in RESULT.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [unicodedata.normalize("NFC", t or "") for t in pdf["text"]]
            rows = [parse_yaml_header(t) or {"content": t, "errors": [], "warnings": [], "keywords": []} for t in texts]
            out = pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)
            out["valid_from"] = pd.to_datetime(out["valid_from"])
            out.insert(0, "source", pdf["source"].to_numpy())
            yield out

    return docs.select("source", "text").mapInPandas(parse, f"source string, {RESULT}")


def legacy_header(text: Column) -> dict[str, Column]:
    """Columns of the legacy form: everything before -start- is header. Its date is the one
    after its label; its context is every other line but the number's."""
    has = F.instr(text, "-start-") > 0
    head, body = F.substring_index(text, "-start-", 1), F.substring(text, F.instr(text, "-start-") + 7, 2**31 - 1)
    date = F.regexp_extract(head, r"Ngày hiệu lực:\s*(\d{2}/\d{2}/\d{4})", 1)
    level = F.coalesce(*[F.when(F.lower(head).rlike(f"(?u){p}"), name) for p, name in config.LEGACY_LEVELS])
    lines = F.transform(F.split(head, r"\r\n|\r|\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+\z", ""))
    rest = F.filter(lines, lambda s: (s != "") & ~F.lower(s).startswith("ngày hiệu lực:") & ~F.lower(s).startswith("văn bản số:"))
    return {
        "valid_from": F.when(has, F.try_to_timestamp(F.nullif(date, F.lit("")), F.lit("dd/MM/yyyy"))),
        "program_level": F.when(has, level),
        "academic_year": F.when(has, F.nullif(F.regexp_extract(F.lower(head), r"(?u)năm\s+(\d{4})", 1), F.lit(""))),
        "doc_number": F.when(has, F.nullif(F.trim(F.regexp_extract(head, r"Văn bản số:\s*([^\n]+)", 1)), F.lit(""))),
        "header_context": F.when(has, F.nullif(F.array_join(rest, "\n"), F.lit(""))),
        "content": T.strip_tags(F.when(has, F.regexp_replace(body, r"^\s+|\s+\z", "")).otherwise(text)),
    }


def headers(docs: DataFrame) -> DataFrame:
    """docs (source, text) with format and the fields of either header form: YAML
    frontmatter where a text opens with it, else the legacy form, else content alone."""
    is_yaml = F.col("text").rlike(r"(?s)\A---\s*\n.*?\n---\s*\n")
    columns = legacy_header(F.col("text"))
    other = docs.filter(~F.coalesce(is_yaml, F.lit(False))).select("source", F.when(F.instr("text", "-start-") > 0, "legacy").otherwise("none").alias("format"), *[c.alias(n) for n, c in columns.items()])
    return yaml_headers(docs.filter(is_yaml)).withColumn("format", F.lit("yaml")).unionByName(other, allowMissingColumns=True)


def normalize(level: Column, program: Column, override_level: Column, override_program: Column) -> tuple[Column, Column]:
    """Override, else the header's value on its canonical spelling, else as it stands."""
    canon_level = F.coalesce(F.when(level.isin(*PROGRAM_LEVELS), level), T.first_match(level, config.LEVELS))
    key = F.lower(F.trim(program))
    exact = F.coalesce(*[F.when(key == n.lower(), n) for n, _ in config.PROGRAMS])
    part = F.coalesce(*[F.when(F.contains(key, F.lit(n.lower())) | F.contains(F.lit(n.lower()), key), n) for n, _ in config.PROGRAMS])
    return F.coalesce(override_level, canon_level), F.coalesce(override_program, exact, part, program)


def program_code(level: Column, name: Column) -> Column:
    """Code of a program, its dashes and blanks normalised."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[–—]", "-"), r"\s*-\s*", " - ")
    return F.coalesce(*[F.when((level == lv) & (F.regexp_replace(key, r"\s+", " ") == n), code) for (lv, n), code in config.PROGRAM_CODES.items()])


def frontmatter(fields: dict[str, Column], body: Column) -> Column:
    """A document with YAML frontmatter from columns; missing fields are left out."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{n}: "), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))) for n, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n-start-\n"), body)


def compress_placeholders(text: Column) -> Column:
    """Dotted blanks of forms to ___ with one blank around them; lines of dots alone go,
    runs of blanks shrink to one, at most two empty lines stay. YAML frontmatter, all
    between the first line --- and the second, stays as it is."""
    strip = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+\z", "")

    def short(line: Column) -> Column:
        for pattern, put in ((r"\.{3,}", "___"), ("…+", "___"), (r"(?U):\s*___", ": ___"), (r"(?U)___\s*(\S)", "___ $1"), ("  +", " "), (r"(?U)\s+\z", "")):
            line = F.regexp_replace(line, pattern, put)
        return line

    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  a value made once, however often f names it

    def cut(part: Column) -> Column:
        return F.transform(part["lines"], lambda s, i: F.when((strip(s) == "---") | ((part["first"] > 0) & (i + 1 > part["first"]) & (i + 1 < part["last"])), s).when(~strip(s).rlike(r"^[.… ]+$"), short(s)))

    def framed(bare: Column) -> Column:
        first = F.array_position(bare, F.lit("---"))
        second = F.array_position(F.slice(bare, F.when(first > 0, first + 1).otherwise(1).cast("int"), F.size(bare)), F.lit("---"))
        last = F.when(second > 0, first + second).otherwise(F.size(bare) + 1)
        return bind(F.struct(F.split(text, "\n").alias("lines"), first.alias("first"), last.alias("last")), cut)

    kept = bind(F.transform(F.split(text, "\n"), strip), framed)
    joined = F.concat(F.array_join(F.filter(kept, lambda s: s.isNotNull()), "\n"), F.lit("\n"))
    blank = F.regexp_replace(joined, r"(?m)^([^\S\n]*\n[^\S\n]*\n)(?:[^\S\n]*\n)+", "$1")
    return F.regexp_replace(blank, r"\n\z", "")
