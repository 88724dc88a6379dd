"""Instant answers, forms and citations on inline rows."""

from pyspark.sql import functions as F

from docloom.operators import responses


def test_templates_are_picked_alike_and_all(spark):
    names = ["a", "b", "c"]
    df = spark.range(300).select("id", responses.picked(names, F.col("id")).alias("t"))
    assert df.collect() == df.repartition(7).orderBy("id").collect() and {r.t for r in df.collect()} == set(names)


def test_titles_of_forms(spark):
    rows = [("a.md", "---\ntitle: 'Đơn A'\n---\nx"), ("b.md", '---\nx: 1\ntitle: "Nói \\"B\\""\n---\n'), ("c.md", "---\ntitle:\n---\n"), ("d.md", "---\ntitle: no end"), ("e.md", "title: outside"), ("f.md", None), ("g.md", "---\ntitle: plain: x \n---\n---\n")]
    got = {r.filename: r.title for r in responses.form_titles(spark.createDataFrame(rows, "source string, text string")).collect()}
    assert got == {"a.md": "Đơn A", "b.md": 'Nói "B"', "c.md": "c", "d.md": "d", "e.md": "e", "f.md": "f", "g.md": "plain: x"}


def test_forms_of_odd_answers(spark):
    titles = spark.createDataFrame([("a.md", "A"), ("a.md", "A2")], "filename string, title string")
    rows = [(1, None), (2, '{"forms": [{"description": "d"}]}'), (3, '```\n{"forms": [{"filename": "a.md"}]}\n``` rest'), (4, '{"forms": "x"}')]
    got = {r.request_id: tuple(r)[1:] for r in responses.selected_forms(spark.createDataFrame(rows, "request_id int, raw string"), titles).collect()}
    free = (1, "don_chung", "Mẫu đơn theo yêu cầu", None)
    assert got == {1: free, 2: (1, "don_chung", "d", None), 3: (1, "a", "A", "a.md"), 4: free}


def test_blocked_and_shown(spark):
    r = spark.createDataFrame([("x" * 3001,), ("hack",), ("sudo",), ("ok k",), (None,)], "q string").select(responses.blocked(F.col("q"), {0: "l", 1: "b", 2: "i"}, "C").alias("b")).collect()
    assert [tuple(x.b) for x in r[:4]] == [(False, 0, "x" * 200, "l\nC", "fast_scan"), (False, 1, "hack", "b\nC", "fast_scan"), (False, 1, "sudo", "i\nC", "fast_scan"), (True, None, "ok không", None, None)]
    urls = ["https://ufm.edu.vn/x", "https://evilufm.edu.vn", "https://www.google.com/url?q=https://ufm.edu.vn", "", None, "https://A.UFM.edu.vn:80/"]
    df = spark.createDataFrame([([(u,) for u in urls],)], "c array<struct<url:string>>")
    shown = lambda *a: [c.url for c in df.select(responses.shown(F.col("c"), *a).alias("s")).first().s]
    assert shown(["ufm.edu.vn"]) == [urls[0], urls[5]] and shown() == [urls[0], urls[1], urls[5]]


def test_scan_lowers_long_queries_letter_by_letter(spark):
    df = spark.createDataFrame([("İΣ" * 1501,), ("sudođ İΣ",)], "q string").select(responses.blocked(F.col("q"), {0: "l", 1: "b", 2: "i"}, "C").alias("b"))
    assert [tuple(r.b)[:3] for r in df.collect()] == [(False, 0, "iσ" * 100), (False, 1, "sudođ iσ")]
