"""The sink of one file per row, and the drivers that rewrite folders through it."""

import pytest

from docloom.plans import rewrites
from docloom.sources import files
from docloom.sources.file_sink import write_files

LEGACY = 'Ngày hiệu lực: 15/01/2026\nVăn bản số: 186 / TB\n# Trường\n## **Mẫu đơn "A"** \ntrình độ thạc sĩ năm 2026\n\\-start-\nThân bài 1\\. x\n'


def test_one_file_per_row(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("first")
    rows = [("sub/a.md", "second"), ("new/ä b.md", "x\ny"), ("empty.md", None)]
    df = spark.createDataFrame(rows, "name string, text string").repartition(3)
    write_files(df, str(tmp_path))
    write_files(df.filter("name = 'sub/a.md'").selectExpr("name", "'third' as text"), str(tmp_path))
    held = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert held == {"sub/a.md": "third", "sub/a.md.bak": "first", "new/ä b.md": "x\ny", "empty.md": ""}
    assert {r.path.removeprefix(f"file:{tmp_path}/"): r.text for r in files.markdown_files(spark, str(tmp_path)).collect()} == {k: v for k, v in held.items() if k.endswith(".md") and v}  # an empty file is no row of Spark's text source


@pytest.mark.parametrize("bad", [[("ok.md", "x"), ("../out.md", "x")], [("ok.md", "x"), ("ok.md", "y")], [("ok.md", "x"), ("", "y")]])
def test_a_failure_leaves_nothing(spark, tmp_path, bad):
    target = tmp_path / "t"
    target.mkdir()
    (target / "ok.md").write_text("before")
    with pytest.raises(Exception, match=r"no place|same name"):
        write_files(spark.createDataFrame(bad, "name string, text string").repartition(2), str(target))
    assert {p.name: p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {"ok.md": "before"} and [p.name for p in target.iterdir()] == ["ok.md"]


def test_headers_are_rewritten_once(spark, tmp_path):
    for kind in ("maudon", "x"):
        (tmp_path / kind).mkdir()
    (tmp_path / "maudon" / "Đơn xin.md").write_text(LEGACY)
    (tmp_path / "x" / "b.md").write_text("---\ntitle: t\n---\n-start-\nB")
    (tmp_path / "x" / "c.md").write_text("không đầu")
    (tmp_path / "x" / "d.md").write_text("-start-thân")
    counts = {"converted": 2, "already_yaml": 1, "no_header": 1}
    assert rewrites.normalize_headers(spark, str(tmp_path)) == counts
    assert (tmp_path / "maudon" / "Đơn xin.md").read_text() == LEGACY
    assert rewrites.normalize_headers(spark, str(tmp_path), write=True) == counts
    assert (tmp_path / "maudon" / "Đơn xin.md").read_text() == (
        '---\ndoc_type: maudon\ndoc_id: don-xin\ntitle: "Mẫu đơn \\"A\\""\neffective_date: 2026-01-15\ndoc_number: "186/TB"\nprogram_level: thac_si\nacademic_year: "2026"\n'
        'keywords: [thạc sĩ, cao học, tuyển sinh]\n---\n# Trường\n## **Mẫu đơn "A"** \ntrình độ thạc sĩ năm 2026\n-start-\nThân bài 1. x\n'
    )
    assert (tmp_path / "maudon" / "Đơn xin.md.bak").read_text() == LEGACY
    assert (tmp_path / "x" / "d.md").read_text() == '---\ndoc_type: thongtinchung\ndoc_id: d\ntitle: "d"\n---\n-start-thân'
    assert (tmp_path / "x" / "c.md").read_text() == "không đầu" and not (tmp_path / "x" / "c.md.bak").exists()
    assert rewrites.normalize_headers(spark, str(tmp_path), write=True) == {"already_yaml": 3, "no_header": 1}


def test_forms_are_compressed(spark, tmp_path):
    (tmp_path / "a.md").write_text("Tôi tên là:......... tại .....\n")
    (tmp_path / "b.md").write_text("không có gì\n")
    report = rewrites.compress_forms(spark, str(tmp_path))
    new = (tmp_path / "a.md").read_text()
    assert report == {"files": 2, "changed": 1, "saved": 31 - len(new), "dots_before": 14, "dots_after": 0} and "..." not in new
    assert (tmp_path / "a.md.bak").read_text() == "Tôi tên là:......... tại .....\n" and not (tmp_path / "b.md.bak").exists()
    assert rewrites.compress_forms(spark, str(tmp_path))["changed"] == 0


def test_export_and_config(spark, tmp_path):
    import json

    from docloom.operators import catalog

    schema = "chunk_id string, parent_id string, chunk_level string, chunk_index int, program_level string, program_name string, section_name string, embedding array<double>, content string"
    rows = [("p", None, "parent", 1, "x", "N", "s", [3.0, 4.0] + [0.0] * 8, "P"), ("b", "p", "child", 2, "x", "N", "t", None, "B"), ("a", "p", "child", 1, "x", "N", "s", None, "A")]
    chunks = spark.createDataFrame(rows, schema)
    files.export_json(catalog.trees(chunks), str(tmp_path / "out"), catalog.program_summary(chunks))
    read = lambda name: [json.loads(line) for f in (tmp_path / "out" / name).glob("*.json") for line in f.read_text().splitlines()]
    (tree,), (summary,) = read("chunks"), read("summary")
    assert tree["embedding"] == {"dims": 10, "first": [3.0, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], "norm": 5.0} and [c["chunk_id"] for c in tree["children"]] == ["a", "b"]
    assert summary == {"program_level": "x", "program_name": "N", "parents": 1, "children": 2, "sections": "s|t", "total": 3}
    (tmp_path / "c.yaml").write_text("a:\n  - 1\nb: ä\n")
    (tmp_path / "d.json").write_text('{"x": {"y": 1}}')
    (tmp_path / "e.yaml").write_text("- 1\n")
    load = lambda name: files.config_file(spark, str(tmp_path / name))
    assert load("c.yaml") == {"a": [1], "b": "ä"} and load("d.json") == {"x": {"y": 1}} and load("e.yaml") == {} == load("none.yaml")
