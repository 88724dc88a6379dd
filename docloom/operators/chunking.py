"""Cutting documents into parent and child chunks.

What a window can say about lines (headings, fences, the section tree) is said with
windows. Greedy packing is a fold over the array of a text's sentences or lines. Parents
alone, whose short sections wait for the next emitted one, are cut in an Arrow-batched
function over one document's sections at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.config import ChunkLimits
from docloom.functions import text as T
from docloom.sources.tables import materialized

LIMITS = ChunkLimits()

# -- lines, headings, tree: windows ----------------------------------------------------


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def fences(rows: DataFrame) -> DataFrame:
    """Adds in_code: an odd number of fence lines stand before the line."""
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    fence = F.when(F.ltrim("line").startswith("```"), 1).otherwise(0)
    return rows.withColumn("in_code", F.coalesce(F.sum(fence).over(before), F.lit(0)) % 2 == 1)


def headings(rows: DataFrame) -> DataFrame:
    """Adds level, heading and rest; level is null where a line is no heading."""
    s = F.trim("line")
    hashes, title = F.regexp_extract(s, r"^(#{1,6})\s+(.+)$", 1), F.regexp_extract(s, r"^(#{1,6})\s+(.+)$", 2)
    bold = r"^\*\*((?:\d+[.)])+\s*[^(*)]+?)\*\*(.*)$"
    name = F.regexp_replace(F.trim(F.regexp_extract(s, bold, 1)), ":+$", "")
    parts = F.size(F.filter(F.split(F.regexp_extract(name, r"^([\d.)]+)", 1), r"[.)]"), lambda x: F.trim(x) != ""))
    depth = F.lit(LIMITS.heading_depth)
    marked, numbered = (F.length(hashes) > 0) & (F.length(hashes) <= depth), (F.length(hashes) == 0) & (name != "")
    if "in_code" in rows.columns:
        marked, numbered = marked & ~F.col("in_code"), numbered & ~F.col("in_code")
    level = F.when(marked, F.length(hashes)).when(numbered, F.least(parts + 1, depth))
    return rows.withColumn("level", level.cast("int")).withColumn("heading", F.when(marked, F.trim(title)).when(numbered, name)).withColumn("rest", F.when(numbered, F.trim(F.regexp_extract(s, bold, 2))))


def sections(rows: DataFrame, preamble: str = "Giới thiệu") -> DataFrame:
    """doc_id, seq, level, heading, body of the sections of headings(); text before the
    first heading is section 0 of level 0, if there is any."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    numbered = rows.withColumn("seq", F.count("level").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.when(F.col("level").isNull(), F.col("line")).otherwise(F.coalesce("rest", F.lit("")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", part.alias("part")))), lambda x: x["part"]), "\n")
    out = numbered.groupBy("doc_id", "seq").agg(F.max("level").alias("level"), F.max("heading").alias("heading"), F.regexp_replace(joined, r"^\s+|\s+\z", "").alias("body"))
    out = out.withColumn("heading", F.when(F.col("seq") == 0, preamble).otherwise(F.col("heading"))).withColumn("level", F.coalesce("level", F.lit(0)))
    return out.filter("seq > 0 or body <> ''")


def tree(secs: DataFrame) -> DataFrame:
    """Adds parent_seq: the nearest section before of a lower level (null at the top)."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == lv, F.col("seq"))).over(w) for lv in range(LIMITS.heading_depth)]
    lower = [F.when(F.col("level") > lv, c) for lv, c in enumerate(last)]
    return secs.withColumn("parent_seq", F.greatest(*lower))


# -- packing ---------------------------------------------------------------------------


def packed(items: Iterable[str], most: int, gap: int = 0, carry: int = 0) -> Iterator[list[str]]:
    """Groups of items in order, each closed before the item that would pass `most`
    (`gap` is added per item); the last `carry` items of a group open the next."""
    group: list[str] = []
    size = 0
    for item in items:
        if group and size + len(item) + gap > most:
            yield group
            group = group[-carry:] if carry else []
            size = sum(len(x) + gap for x in group)
        group.append(item)
        size += len(item) + gap
    if group:
        yield group


_SENTENCE = re.compile(r"(?<=[.!?;])\s+(?=[A-ZÀ-Ỹa-zà-ỹ\d])")


def sentences(text: str) -> list[str]:
    return [p for s in _SENTENCE.split(text) for x in s.split("\n\n") if (p := x.strip())]


def is_table(text: str) -> bool:
    rows = [x for x in map(str.strip, text.split("\n")) if x]
    return sum(x.startswith("|") for x in rows) >= 2 and any(re.match(r"\|[\s\-:|]+\|", x) for x in rows)


def split_table(table: str, most: int) -> list[str]:
    """Parts of a table by rows, each with what stands before its rows: any text, the
    header and the separator. Without a separator, or of under three lines: whole."""
    rows = table.strip().split("\n")
    at = next((i for i, r in enumerate(rows) if re.match(r"\s*\|[\s\-:|]+\|\s*$", r)), None)
    if len(rows) < 3 or at is None or at == 0:
        return [table]
    head = "\n".join(rows[: at + 1])
    room = max(200, most - len(head) - 2)
    return ["\n".join((head, *part)) for part in packed(rows[at + 1 :], room, gap=1)] or [table]


def blocks_of(content: str) -> list[str]:
    """Paragraphs by empty lines; runs of table lines stand alone."""
    out, run, kind = [], [], False

    def close() -> None:
        text = "\n".join(run).strip()
        if text:
            out.extend([text] if kind else [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()])

    for line in content.split("\n"):
        table = line.strip().startswith("|")
        if table != kind:
            close()
            run, kind = [], table
        run.append(line)
    close()
    return out


def split_parent(content: str, most: int) -> list[str]:
    """Parts of at most about `most` characters; tables and sentences stay whole."""
    if len(content) <= most:
        return [content]
    parts: list[str] = []
    small: list[str] = []

    def close() -> None:
        parts.extend("\n\n".join(g) for g in packed(small, most, gap=2))
        small.clear()

    for block in blocks_of(content):
        if len(block) <= most:
            small.append(block)
            continue
        close()
        parts.extend(split_table(block, most) if is_table(block) else (" ".join(g) for g in packed(sentences(block), most)))
    close()
    return parts


# -- parents ---------------------------------------------------------------------------


def context_prefix(path: str, source: str, header: str | None = None) -> str:
    head = [header] if header else []
    return "\n".join([*head, f"[Nguồn: {source}]", f"[Mục: {path}]", "", ""]) if path else "\n".join([*head, f"[Nguồn: {source}]", "", ""])


class _Siblings:
    """Sections under one parent: what waits to be merged, and what was emitted here."""

    def __init__(self, path: list[str]) -> None:
        self.path, self.text, self.names, self.emitted = path, "", [], []

    def wait(self, text: str, name: str | None) -> None:
        self.text = f"{self.text}\n\n{text}".strip() if self.text else text
        if name:
            self.names.append(name)


def _parents(rows: list[tuple[int, str, str]], source: str, limits: ChunkLimits = LIMITS) -> list[dict]:
    """parents() with the content in two parts: head, the path that its prefix names, and
    tail. All parts of a section share one head, which can be as long as the document.

    A leaf's short body, a heading without body and an inner section's short body wait
    for the next emitted sibling; what still waits at the end of a level joins its last
    chunk if both fit. Names of merged sections are joined by &.
    """
    children = [i + 1 < len(rows) and rows[i + 1][0] > rows[i][0] for i in range(len(rows))]

    def emit(level: _Siblings, name: str, body: str) -> None:
        path = " > ".join([*level.path, name])
        prefix = context_prefix(path, source)
        texts = split_parent(body, max(limits.part, limits.parent - len(prefix)))
        for i, t in enumerate(texts, 1):
            label = f"[Phần {i}/{len(texts)}]\n" if len(texts) > 1 else ""
            level.emitted.append({"section_path": path, "section_name": name, "part": i, "parts": len(texts), "head": path, "tail": label + t})

    def flush(level: _Siblings) -> None:
        if not level.text:
            return
        name = " & ".join(level.names) or "Phần bổ sung"
        last = level.emitted[-1] if level.emitted else None
        if last and len(context_prefix(last["head"], source)) + len(last["tail"]) + len(level.text) <= limits.parent:
            last["tail"] += "\n\n" + level.text
            last["section_name"] += " & " + name
            last["section_path"] = " > ".join([*level.path, last["section_name"]])
        else:
            emit(level, name, level.text)

    stack: list[tuple[int, _Siblings]] = [(-1, _Siblings([]))]  # (level of the parent, its children)
    for i, (depth, heading, body) in enumerate(rows):
        while stack[-1][0] >= depth:
            _, done = stack.pop()
            flush(done)
            stack[-1][1].emitted.extend(done.emitted)
        level = stack[-1][1]
        inner = children[i]
        if body and len(body) >= (limits.parent_body if inner else limits.leaf_body):
            name = " & ".join([*level.names, heading]) if level.text else heading
            emit(level, name, f"{level.text}\n\n{body}" if level.text else body)
            level.text, level.names = "", []
        elif body or not inner:
            level.wait(body or heading, heading)
        if inner:
            stack.append((depth, _Siblings([*level.path, heading])))
    while len(stack) > 1:
        _, done = stack.pop()
        flush(done)
        stack[-1][1].emitted.extend(done.emitted)
    flush(stack[0][1])
    return stack[0][1].emitted


def parents(rows: list[tuple[int, str, str]], source: str, limits: ChunkLimits = LIMITS) -> list[dict]:
    """Parent chunks of sections (level, heading, body) in document order."""
    return [{k: v for k, v in c.items() if k not in ("head", "tail")} | {"content": context_prefix(c["head"], source) + c["tail"]} for c in _parents(rows, source, limits)]


#: Characters of parents that a task holds as Python objects before it hands them on.
HELD_CHARS = 1 << 20


def _gathered(secs: DataFrame) -> DataFrame:
    return secs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "level", "heading", "body"))).alias("s"))


def parent_chunks(secs: DataFrame) -> DataFrame:
    """Parent chunks of sections() rows (doc_id, seq, level, heading, body), numbered
    through each document. A document's sections are gathered: a document is bounded. One
    document at a time becomes Python objects, however many an Arrow batch brings."""
    docs = _gathered(secs)
    kind = secs.schema["doc_id"].dataType.simpleString()
    columns = "chunk_index int, total int, section_path string, section_name string, part int, parts int, content string"
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), *((n, pa.int32() if n in ("chunk_index", "total", "part", "parts") else pa.string()) for n in names[1:])])
            rows, held = [], 0
            for doc, s in zip(batch.column("doc_id"), batch.column("s"), strict=True):
                doc = doc.as_py()
                found = parents([(x["level"], x["heading"], x["body"]) for x in s.as_py()], str(doc))
                rows += [{"doc_id": doc, "chunk_index": i, "total": len(found)} | c for i, c in enumerate(found, 1)]
                held += sum(len(c["content"]) for c in found)
                if held > HELD_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.mapInArrow(cut, f"doc_id {kind}, {columns}")


def folded_parents(secs: DataFrame) -> DataFrame:
    """parent_chunks() as a row for each document that has any, about as long as the
    document: doc_id, source (as prefixes name it), paths (each once) and chunks (path and
    head: places in paths; name: how many characters at the path's end; part, parts, tail).
    What children are cut from is inner, or the tail where that is null; composed is its
    composed form, where that differs."""
    kind = secs.schema["doc_id"].dataType.simpleString()
    numbers, strings = ("path", "name", "head", "part", "parts"), ("tail", "inner", "composed")
    chunk = pa.struct([*((n, pa.int32()) for n in numbers), *((n, pa.string()) for n in strings)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("source", pa.string()), ("paths", pa.list_(pa.string())), ("chunks", pa.list_(chunk))])
            for doc, s in zip(batch.column("doc_id"), batch.column("s"), strict=True):
                doc = doc.as_py()
                paths: dict[str, int] = {}
                place = lambda path, paths=paths: paths.setdefault(path, len(paths))
                chunks = []
                for c in _parents([(x["level"], x["heading"], x["body"]) for x in s.as_py()], str(doc)):
                    path, head, tail = c["section_path"], c["head"], c["tail"]
                    inner = None
                    if doc is None or path != head or not path:  # else the prefix is the one that children get
                        whole = context_prefix(head, str(doc)) + tail
                        inner = (whole if doc is None else whole.removeprefix(f"[Nguồn: {doc}]\n[Mục: {path}]\n\n")).strip(" ")
                    text = tail.strip(" ") if inner is None else inner
                    composed = unicodedata.normalize("NFC", text)
                    chunks.append((place(path), len(c["section_name"]), place(head), c["part"], c["parts"], tail, inner, composed if composed != text else None))
                if chunks:
                    fields = [dict(zip((*numbers, *strings), c, strict=True)) for c in chunks]
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "source": str(doc), "paths": list(paths), "chunks": fields}], schema)

    fields = ", ".join([*(f"{n}: int" for n in numbers), *(f"{n}: string" for n in strings)])
    return _gathered(secs).mapInArrow(cut, f"doc_id {kind}, source string, paths array<string>, chunks array<struct<{fields}>>")


# -- children --------------------------------------------------------------------------


def packs(items: Column, most: int, gap: int = 0, carry: int = 0) -> Column:
    """packed() of an array of strings, as an array of groups. The fold is over lengths
    alone and keeps where groups begin; items are made and sliced once."""
    return F.element_at(F.transform(F.array(items), lambda bound: _packs(bound, most, gap, carry)), 1)


def _packs(items: Column, most: int, gap: int, carry: int) -> Column:
    state = lambda starts, size: F.struct(starts.alias("starts"), size.alias("size"))
    lengths = F.transform(items, lambda x, i: F.struct((i + 1).alias("at"), (F.length(x) + gap).alias("n")))

    def add(s: Column, x: Column) -> Column:
        start = F.element_at(s["starts"], -1)
        first = F.greatest(start, x["at"] - carry)  # a group opens with the last `carry` of the one before
        carried = sum((F.when(x["at"] - k >= start, F.length(F.get(items, x["at"] - k - 1)) + gap).otherwise(0) for k in range(1, carry + 1)), F.lit(0))
        full = (x["at"] > start) & (s["size"] + x["n"] > most)
        return F.when(full, state(F.concat(s["starts"], F.array(x["at"], first)), carried + x["n"])).otherwise(state(s["starts"], s["size"] + x["n"]))

    # starts: 1, then for each further group the item that closed the one before, and its first
    folded = F.aggregate(lengths, state(F.array(F.lit(1)), F.lit(0)), add, lambda s: F.concat(s["starts"], F.array(F.size(items) + 1)))
    cut = lambda bounds: F.transform(F.sequence(F.lit(1), F.size(bounds) - 1, F.lit(2)), lambda k: F.slice(items, F.element_at(bounds, k), F.element_at(bounds, k + 1) - F.element_at(bounds, k)))
    groups = F.element_at(F.transform(F.array(folded), cut), 1)
    return F.when(F.size(items) > 0, groups).otherwise(F.array().cast("array<array<string>>"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is made once however often use reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _joined(groups: Column, by: str) -> Column:
    return F.transform(groups, lambda g: F.array_join(g, by))


def fallback(text: Column, most: int = LIMITS.fallback, carry: int = LIMITS.overlap_sentences) -> Column:
    """Sentences packed up to `most` characters; a chunk opens with the last `carry`
    sentences of the one before."""
    return _joined(packs(T.sentences(T.clean_whitespace(text)), most, carry=carry), " ")


def base_blocks(text: Column, limits: ChunkLimits = LIMITS) -> Column:
    """Blocks of about limits.block characters; a table is one, a long sentence is cut."""
    bare = F.regexp_replace(text, r"^\s+|\s+\z", "")
    found = T.sentences(text)
    strings = F.array().cast("array<string>")
    pieces = lambda s: F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limits.block).cast("int")), lambda i: F.regexp_replace(F.substring(s, i * limits.block + 1, F.lit(limits.block)), r"^\s+|\s+\z", "")), lambda p: p != "")
    state = lambda done, run: F.struct(done.alias("done"), run.alias("run"))
    # the joined run is as long as its sentences and a blank between each two; the limit is on the sentences
    size = lambda s: F.length(s["run"]["text"]) - s["run"]["n"] + 1

    def add(s: Column, x: Column) -> Column:
        run = lambda text, n: F.struct(text.alias("text"), n.alias("n"))
        done = F.concat(s["done"], F.when(s["run"]["n"] > 0, F.array(s["run"]["text"])).otherwise(strings))
        return (
            F.when(F.length(x) > limits.hard_block, state(F.concat(done, pieces(x)), run(F.lit(""), F.lit(0))))
            .when((s["run"]["n"] > 0) & (size(s) + F.length(x) > limits.block), state(done, run(x, F.lit(1))))
            .otherwise(state(s["done"], run(F.when(s["run"]["n"] > 0, F.concat(s["run"]["text"], F.lit(" "), x)).otherwise(x), s["run"]["n"] + 1)))
        )

    start = state(strings, F.struct(F.lit("").alias("text"), F.lit(0).alias("n")))
    folded = F.aggregate(F.when(F.size(found) > 0, found).otherwise(F.array(text)), start, add, lambda s: F.concat(s["done"], F.when(s["run"]["n"] > 0, F.array(s["run"]["text"])).otherwise(strings)))
    return F.when(bare == "", strings).when(T.is_table(text), F.array(bare)).otherwise(folded)


def merged_blocks(blocks: Column, limits: ChunkLimits = LIMITS, overlap: int = 1, least_tokens: int = 70, most_tokens: int = 800) -> Column:
    """Array of (content, truncated): the chunks of blocks (array of content, chunk_no; in
    order, numbers from 1 without gaps). Each opens with the last `overlap` blocks of the
    one before (one at least), is cut at limits.child, and a small one joins its
    predecessor if both stay within most_tokens."""
    groups = F.transform(F.sequence(F.lit(1), F.array_max(F.transform(blocks, lambda b: b["chunk_no"])).cast("int")), lambda n: F.transform(F.filter(blocks, lambda b: b["chunk_no"] == n), lambda b: b["content"]))
    o, strings = max(1, overlap), F.array().cast("array<string>")
    before = lambda all_, i: F.when(i > 0, F.element_at(all_, i)).otherwise(strings)
    last = lambda g: F.slice(g, F.greatest(F.size(g) - o + 1, F.lit(1)), F.lit(o))
    whole = _bound(groups, lambda all_: F.transform(all_, lambda g, i: F.trim(F.array_join(F.concat(last(before(all_, i)), g), " "))))
    cut = F.transform(whole, lambda t: F.struct(F.left(t, F.lit(limits.child)).alias("content"), (F.length(t) > limits.child).alias("truncated")))

    def add(out: Column, x: Column) -> Column:
        at = F.element_at(out, -1)
        tokens = T.token_estimate(x["content"])
        small = (F.size(out) > 0) & (tokens < least_tokens) & (T.token_estimate(at["content"]) + tokens <= most_tokens)
        both = F.struct(F.concat(at["content"], F.lit(" "), x["content"]).alias("content"), (at["truncated"] | x["truncated"]).alias("truncated"))
        return F.when(small, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(both))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(cut, F.array().cast("array<struct<content:string,truncated:boolean>>"), add)


def paragraphs(text: Column, least: int = 50) -> Column:
    """Paragraphs by empty lines; one shorter than `least` absorbs the next."""
    found = F.filter(F.split(text, r"\n(?:[^\S\n]*\n)+"), lambda p: ~p.rlike(r"\A\s*\z"))

    def add(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        return F.when((F.size(out) > 0) & (F.length(last) < least), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(last, F.lit("\n\n"), p)))).otherwise(F.concat(out, F.array(p)))

    return F.aggregate(found, F.array().cast("array<string>"), add)


def pack_lines(text: Column, most: int = 20_000) -> Column:
    """Groups of whole lines of at most `most` characters each, line ends not counted, or
    of one line."""
    return _joined(packs(F.split(text, "\n"), most), "\n")


def chunk_texts(docs: DataFrame, cut: Callable[[Column], Column] = fallback) -> DataFrame:
    """doc_id, chunk_index, total, content of docs (doc_id, text) by one of the cutters."""
    cuts = docs.select("doc_id", cut(F.coalesce("text", F.lit(""))).alias("c")).withColumn("total", F.size("c"))
    return cuts.select("doc_id", "total", F.posexplode("c").alias("at", "content")).select("doc_id", (F.col("at") + 1).alias("chunk_index"), "total", "content")


def boundaries(blocks: DataFrame, threshold: float) -> DataFrame:
    """Rows (doc_id, seq, embedding) with similarity to the block before, and the number
    of the chunk they fall into: a new one wherever similarity is under the threshold."""
    from docloom.functions.vectors import cosine

    w = Window.partitionBy("doc_id").orderBy("seq")
    sim = F.round(cosine(F.col("embedding"), F.lag("embedding").over(w)), 6)
    cut = blocks.withColumn("similarity", F.when(F.lag("seq").over(w).isNull(), 1.0).otherwise(sim)).withColumn("is_cut", F.when(F.lag("seq").over(w).isNull() | (F.col("similarity") < threshold), 1).otherwise(0))
    return cut.withColumn("chunk_no", F.sum("is_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))


#: Fixed value: a block opens a new chunk where its similarity to the one before is lower.
SIMILARITY = 0.57


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Texts in Unicode's composed form, which Spark has no function for."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _blocks(text: Column) -> Column:
    return _bound(T.clean_whitespace(text), lambda t: base_blocks(t))


def _cuts(composed: DataFrame, embed: Callable[[DataFrame], DataFrame], threshold: float = SIMILARITY) -> DataFrame:
    """doc_id and nos of composed texts (doc_id, text): for each of its base blocks the
    number of the chunk it falls into. Blocks' texts are not shuffled."""
    blocks = embed(chunk_texts(composed, _blocks).withColumnRenamed("chunk_index", "seq"))
    numbered = boundaries(blocks, threshold).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_no"))).alias("b"))
    return numbered.select("doc_id", F.transform("b", lambda b: b["chunk_no"]).alias("nos"))


def semantic_chunks(texts: DataFrame, embed: Callable[[DataFrame], DataFrame], threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, chunk_index, total, content, truncated of texts (doc_id, text): base blocks,
    cut where neighbours' embeddings drop apart, merged. embed adds embedding to rows with
    content. A text without words has no chunks."""
    composed = texts.select("doc_id", nfc("text").alias("text"))
    blocks = embed(chunk_texts(composed, _blocks).withColumnRenamed("chunk_index", "seq"))
    numbered = boundaries(blocks, threshold).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content", "chunk_no"))).alias("b"))
    merged = numbered.select("doc_id", merged_blocks(F.col("b")).alias("c")).withColumn("total", F.size("c"))
    return merged.select("doc_id", "total", F.posexplode("c").alias("at", "c")).select("doc_id", (F.col("at") + 1).alias("chunk_index"), "total", "c.content", "c.truncated")


def hierarchy(docs: DataFrame, embed: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Parents and children of docs (doc_id, text, and columns that all chunks inherit):
    chunk_id, parent_id, chunk_level, doc_id, chunk_index, total, section_path,
    section_name, content, truncated, children_ids, then the inherited columns.

    Parents follow the headings; children are cut inside a parent by meaning, or by
    sentences alone where embed is None, and open with the parent's context prefix. Ids
    are hashes of the document and the chunk's place. A text without words has no chunks."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    folded = folded_parents(sections(headings(fences(lines(docs.select("doc_id", "text").filter("trim(text) <> ''"))))))
    bare = F.coalesce("c.inner", F.trim("c.tail"))
    if embed is None:
        of = lambda c: F.transform(fallback(F.col("text")), lambda t: F.struct(t.alias("content"), F.lit(False).alias("truncated")))
    else:
        folded = materialized(folded, compact=True)  # two readers
        each = folded.select("doc_id", F.posexplode("chunks").alias("at", "c"))
        bare = F.coalesce("c.composed", bare)
        cuts = _cuts(each.select(F.struct("doc_id", "at").alias("doc_id"), bare.alias("text")), embed)
        cuts = cuts.groupBy(F.col("doc_id.doc_id").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("doc_id.at", "nos"))).alias("cuts"))
        of = lambda c: F.when(c.isNotNull(), _bound(F.arrays_zip(_blocks(F.col("text")).alias("content"), c.alias("chunk_no")), lambda b: merged_blocks(b)))
    if rest:
        beside = docs.select("doc_id", *[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)])
        folded = folded.join(beside if embed is None else beside.join(cuts, F.col("doc_id") == F.col("of"), "left"), "doc_id")
    elif embed is not None:
        folded = folded.join(cuts, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    # what repeats a path is made last, row by row: neither written nor shuffled
    kept, inherited = ["cuts"] * (embed is not None), [f"_{i}" for i in range(len(rest))]
    each = folded.select("doc_id", *inherited, *kept, "source", "paths", F.size("chunks").alias("total"), F.posexplode("chunks").alias("at", "c"))
    each = each.withColumn("section_path", F.get("paths", F.col("c.path"))).withColumn("head", F.get("paths", F.col("c.head"))).drop("paths")
    head = F.concat(F.lit("[Nguồn: "), "source", F.when(F.col("head") != "", F.concat(F.lit("]\n[Mục: "), "head")).otherwise(""), F.lit("]\n\n"))
    index = F.col("at") + 1
    named = each.select("doc_id", *inherited, "total", index.alias("chunk_index"), F.sha2(F.concat_ws("#", "doc_id", index), 256).alias("id"), "section_path", F.right("section_path", "c.name").alias("section_name"), F.concat(head, "c.tail").alias("content"), bare.alias("text"), *(F.element_at(c, F.col("at")).alias("nos") for c in kept))
    named = named.withColumn("prefix", F.concat(F.lit("[Nguồn: "), F.col("doc_id").cast("string"), F.lit("]\n[Mục: "), F.col("section_path"), F.lit("]\n\n")))
    named = named.withColumn("cut", F.coalesce(of(F.col("nos") if kept else None), F.array().cast("array<struct<content:string,truncated:boolean>>"))).drop("text", "nos")
    ids = F.transform(F.sequence(F.lit(1), F.size("cut")), lambda i: F.sha2(F.concat_ws("#", "id", i), 256))
    named = named.withColumn("ids", F.when(F.size("cut") > 0, ids).otherwise(F.array().cast("array<string>")))
    rows = named.select("*", F.explode(F.sequence(F.lit(0), F.size("cut"))).alias("n")).withColumn("child", F.get("cut", F.col("n") - 1)).drop("cut")
    parent = F.col("n") == 0
    pick = lambda one, other, name: F.when(parent, one).otherwise(other).alias(name)
    with_prefix = F.when(F.startswith("child.content", F.col("prefix")), F.col("child.content")).otherwise(F.concat("prefix", "child.content"))
    every = rows.select(
        pick(F.col("id"), F.get("ids", F.col("n") - 1), "chunk_id"), pick(F.lit(None), F.col("id"), "parent_id"), pick(F.lit("parent"), F.lit("child"), "chunk_level"), "doc_id", pick(F.col("chunk_index"), F.col("n"), "chunk_index"),
        pick(F.col("total"), F.size("ids"), "total"), "section_path", "section_name", pick(F.col("content"), with_prefix, "content"), pick(F.lit(False), F.col("child.truncated"), "truncated"),
        pick(F.col("ids"), F.array().cast("array<string>"), "children_ids"), *[F.col(f"_{i}").alias(c) for i, c in enumerate(rest)],
    )
    return every.select("doc_id", *[c for c in every.columns if c != "doc_id"]) if rest else every
