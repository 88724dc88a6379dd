"""Cutters in column functions, tables that change in place, and the drivers over them."""

import random
from collections import Counter

import plain_chunking
import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking, structured
from docloom.plans import ingestion, providers
from docloom.sources import managed

# -- cutters ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    words = ["Câu", "dài", "x", "Học phí", "a.", "b!", "c?", "|", "Đại học;", "w" * 90]
    out = ["", "  \n ", None, "| a |\n|---|\n| b |", "x" * 1300 + ". End", ". ".join(["Ngắn"] * 400), "a\n\n\n\n  b\n\n" + "c " * 40 + "\n \nd", "\n\nx"]
    for _ in range(120):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", ". ", "\n", "\n\n", "\n \n", "  "]) for _ in range(rng.randrange(400))))
    rows = list(enumerate(out))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("name", ["fallback", "base_blocks", "pack_lines", "paragraphs"])
def test_cutters(texts, name):
    rows, df = texts
    cut = getattr(plain_chunking, name)
    want = {(i, k, len(found), x) for i, t in rows for found in [cut(t or "")] for k, x in enumerate(found, 1)}
    got = [(r.doc_id, r.chunk_index, r.total, r.content) for r in chunking.chunk_texts(df, getattr(chunking, name)).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("most", [1, 40, 300])
def test_lines_are_packed(texts, most):
    rows, df = texts
    want = {(i, k, x) for i, t in rows for k, x in enumerate(plain_chunking.pack_lines(t or "", most), 1)}
    assert {(r.doc_id, r.chunk_index, r.content) for r in chunking.chunk_texts(df, lambda t: chunking.pack_lines(t, most)).collect()} == want


def test_merging(spark):
    rng = random.Random(2)
    cases = [([rng.choice(["ngắn.", "Câu này dài hơn một chút. " * 4, "x" * 900, "y" * 2600]) for _ in range(n)], [k == 0 or rng.random() < 0.5 for k in range(n)]) for n in (1, 2, 3, 5, 9) for _ in range(12)]
    rows = [(i, [(x, sum(starts[: k + 1])) for k, x in enumerate(blocks)]) for i, (blocks, starts) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, b array<struct<content:string,chunk_no:bigint>>")
    got = {r.i: [tuple(x) for x in r.c] for r in df.select("i", chunking.merged_blocks(F.col("b")).alias("c")).collect()}
    assert got == {i: plain_chunking.merge_blocks(*case) for i, case in enumerate(cases)}


def test_structured_chunks(spark):
    long = "\n\n".join(["Mục " + "nội dung " * 12] * 12)
    text = f"bìa\n**CHƯƠNG TRÌNH ĐÀO TẠO THẠC SĨ NGÀNH TC-NH (ứng dụng)**\nGiới thiệu.\n\nĐiều kiện xét tuyển \n{long}\n\nngắn\n\n* gạch\nCHUẨN ĐẦU RA\n \n"
    df = spark.createDataFrame([("a.txt", "x/Ctrinh Thac Si/a.txt", text), ("b.txt", "x/b.txt", " không đề mục "), ("c.txt", "x/c.txt", None), ("d.txt", "x", "  ")], "source string, path string, text string")
    got = sorted(structured.chunks(df, "2030").collect(), key=lambda r: (r.source, r.section_name, r.chunk_level == "child", r.chunk_index))
    assert [(r.source, r.section_name, r.chunk_level, r.chunk_index, r.total) for r in got if r.section_name != "Điều kiện xét tuyển"] == [
        ("a.txt", "CHƯƠNG TRÌNH ĐÀO TẠO THẠC SĨ NGÀNH TC-NH (ứng dụng)", "parent", 1, 2), ("a.txt", "CHƯƠNG TRÌNH ĐÀO TẠO THẠC SĨ NGÀNH TC-NH (ứng dụng)", "child", 1, 1),
        ("b.txt", "(Toàn văn)", "parent", 1, 1), ("b.txt", "(Toàn văn)", "child", 1, 1),
    ]
    kids = [r for r in got if r.section_name == "Điều kiện xét tuyển" and r.chunk_level == "child"]
    body = f"{long}\n\nngắn\n\n* gạch"
    assert [r.content for r in kids] == [f"[Chương trình: Thạc sĩ Tc-Nh] — Điều kiện xét tuyển\n\n{p}" for p in plain_chunking.paragraphs(body)]
    by_id = {r.chunk_id: r for r in got}
    assert len(by_id) == len(got) and all(by_id[r.parent_id].section_path == r.section_path and r.chunk_id in by_id[r.parent_id].children_ids for r in got if r.parent_id)
    assert {r.academic_year for r in got} == {"2030"} and {(r.source, r.program_level, r.program_name) for r in got} == {("a.txt", "thac_si", "Tc-Nh"), ("b.txt", "unknown", "(Toàn Văn)")}
    b = next(r for r in got if r.source == "b.txt")
    assert b.content == "[Chương trình: unknown (Toàn Văn)]\n(Toàn văn)\n\nkhông đề mục"


# -- tables ----------------------------------------------------------------------------

SCHEMA = "content_hash string, source string, version int, content string, is_active boolean"


@pytest.fixture
def chunks(tmp_path):
    return managed.chunk_table(str(tmp_path / "chunks"), SCHEMA, buckets=4)


def made(spark, *rows):
    return spark.createDataFrame([(h, s, 1, f"{h} of {s}", True) for h, s in rows], SCHEMA)


def state(table, spark):
    return Counter((r.content_hash, r.source, r.is_active) for r in table.read(spark).collect())


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_changes_of_a_table(spark, chunks, tmp_path):
    sources = [f"s{i}" for i in range(12)]
    assert state(chunks, spark) == Counter() and managed.deactivate(chunks, made(spark, ("h", "s1"))) == 0
    first = [(h, s) for s in sources for h in "ab"]
    assert managed.insert(chunks, made(spark, *first, *first[:5])) == 24
    assert managed.insert(chunks, made(spark, *first, ("c", "s1"))) == 1
    before = files_of(tmp_path)
    assert managed.deactivate(chunks, spark.createDataFrame([("s1",), ("nobody",)], "source string")) == 3
    assert managed.deactivate(chunks, spark.createDataFrame([("s1",)], "source string")) == 0
    kept = [f for f, t in files_of(tmp_path).items() if before.get(f) == t]
    assert kept, "buckets of other sources aren't written"
    want = Counter({(h, s, s != "s1"): 1 for h, s in [*first, ("c", "s1")]})
    assert state(chunks, spark) == want
    assert managed.ingest_again(chunks, made(spark, ("a", "s1"), ("d", "s1"), ("a", "s2"))) == {"retired": 1, "restored": 1, "inserted": 1}
    want[("a", "s1", False)] -= 1
    want[("b", "s2", True)] -= 1
    want.update([("a", "s1", True), ("d", "s1", True), ("b", "s2", False)])
    assert state(chunks, spark) == +want
    assert managed.ingest_again(chunks, made(spark, ("a", "s1"), ("d", "s1"), ("a", "s2"))) == {"retired": 0, "restored": 0, "inserted": 0}


def test_rebuilds(spark, chunks):
    managed.insert(chunks, made(spark, *[("a", f"ThS {i}.txt") for i in range(9)], ("a", "m.md"), ("b", "NCS x.txt")))
    assert managed.rebuild(chunks, made(spark, ("n", "ThS 1.txt")), *ingestion.STRUCTURED_LIKE) == {"deleted": 10, "inserted": 1}
    assert state(chunks, spark) == Counter([("a", "m.md", True), ("n", "ThS 1.txt", True)])
    assert managed.rebuild(chunks, made(spark, ("z", "q"), ("z", "q"))) == {"deleted": 2, "inserted": 1}
    assert state(chunks, spark) == Counter([("z", "q", True)])
    assert chunks.delete(spark, F.col("source") == "q") == 1 and state(chunks, spark) == Counter()
    assert managed.rebuild(chunks, made(spark)) == {"deleted": 0, "inserted": 0}


def test_ledger(spark, tmp_path):
    ledger = managed.ledger_table(str(tmp_path / "l"), buckets=3)
    at = lambda *rows: spark.createDataFrame(rows, "file_hash string, file_name string, status string, chunks_count long, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    assert managed.record(ledger, at(*[(f"h{i}", f"f{i}", "pending", 0, "2026-01-01 00:00:00") for i in range(7)])) == 7
    assert managed.record(ledger, at(("h1", "other name", "completed", 5, "2026-01-02 00:00:00"))) == 1
    r = {x.file_hash: x for x in ledger.read(spark).collect()}
    assert len(r) == 7 and (r["h1"].file_name, r["h1"].status, r["h1"].chunks_count, str(r["h1"].created_at), str(r["h1"].updated_at)) == ("f1", "completed", 5, "2026-01-01 00:00:00", "2026-01-02 00:00:00")
    assert managed.forget(ledger, spark.createDataFrame([("f1",), ("f2",), ("f9",)], "file_name string")) == 2
    assert {x.file_hash for x in ledger.read(spark).collect()} == {"h0", "h3", "h4", "h5", "h6"}


# -- drivers ---------------------------------------------------------------------------


@pytest.fixture
def corpus(tmp_path):
    md, txt = tmp_path / "md", tmp_path / "x" / "Ctrinh Thac Si"
    md.mkdir()
    txt.mkdir(parents=True)
    (md / "a.md").write_text("# Học phí\n" + "Học phí năm nay là bao nhiêu thì đây. " * 20)
    (md / "b.md").write_text("# B\n" + "Nội dung khác hẳn ở trang này nhé. " * 9)
    (txt / "ThS KT.txt").write_text("CHƯƠNG TRÌNH ĐÀO TẠO NGÀNH KẾ TOÁN\r\nGiới thiệu ngành.\r\nCHUẨN ĐẦU RA\r\nChuẩn.")
    return tmp_path, str(md), [str(txt)]


def snapshot(spark, store):
    rows = spark.read.parquet(f"{store}/chunks").drop("bucket", "embedding").collect()
    ledger = spark.read.parquet(f"{store}/ledger").select("file_name", "status", "chunks_count").collect()
    return Counter(map(tuple, rows)), Counter(map(tuple, ledger))


def test_ingest_all_twice_and_after_a_crash(spark, corpus, monkeypatch):
    top, md, txt = corpus
    store, other = str(top / "store"), str(top / "other")
    embedded = []
    embed = lambda df: embedded.append(df.count()) or providers.with_embeddings(df)
    first = ingestion.ingest_all(spark, md, txt, store, "2026-02-03 04:05:06", embed)
    assert first["markdown"].files == {"insert": 2} and first["structured"].files == {"insert": 1} and first["structured"].rows["inserted"] == 4
    done = snapshot(spark, store)
    assert sum(done[0].values()) == sum(r.rows["inserted"] for r in first.values()) and {n for n, *_ in done[1]} == {"a.md", "b.md", "ThS KT.txt"}
    assert spark.read.parquet(f"{store}/chunks").filter("embedding is null").count() == 0
    again = ingestion.ingest_all(spark, md, txt, store, "2026-03-03 04:05:06", embed)
    assert [r.files for r in again.values()] == [{"skip": 2}, {"skip": 1}] and snapshot(spark, store) == done and embedded[-2:] == [0, 0]

    with monkeypatch.context() as m:  # breaks off between chunks and ledger
        m.setattr(managed, "record", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError, match="gone"):
            ingestion.ingest_all(spark, md, txt, other, "2026-02-03 04:05:06", embed)
    assert "ThS KT.txt" not in {r.source for r in spark.read.parquet(f"{other}/chunks").collect()}  # the second part didn't start
    ingestion.ingest_all(spark, md, txt, other, "2026-02-03 04:05:06", embed)
    assert snapshot(spark, other) == done


def test_changed_and_single_files(spark, corpus):
    top, md, txt = corpus
    store = str(top / "store")
    ingestion.ingest_all(spark, md, txt, store, "2026-02-03 04:05:06")
    (top / "md" / "a.md").write_text("# Học phí\n" + "Nay học phí đã khác trước rất nhiều rồi. " * 20)
    report = ingestion.ingest_file(spark, f"{md}/a.md", store, "2026-02-04 04:05:06")
    assert report.files == {"update": 1} and report.rows["retired"] == report.rows["inserted"] > 0
    live = [r for r in spark.read.parquet(f"{store}/chunks").filter("is_active").collect()]
    assert all("đã khác" in r.content for r in live if r.source == "a.md") and any(r.source == "b.md" for r in live)
    assert ingestion.ingest_file(spark, f"{txt[0]}/ThS KT.txt", store, "2026-02-04 04:05:06").files == {"skip": 1}
    rebuilt = ingestion.ingest_all(spark, md, txt, store, "2026-02-05 04:05:06", rebuild=True)
    rows = spark.read.parquet(f"{store}/chunks").collect()
    assert all(r.is_active for r in rows) and len(rows) == sum(r.rows["inserted"] for r in rebuilt.values())
