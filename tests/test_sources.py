import io
import zipfile

from docsieve.operators import report
from docsieve.plans import pipeline
from docsieve.sources import files, writers


def xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Employee Full Name</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c></row><row><c r="B3"><v>7</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def pptx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<p:sld xmlns:p="p" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>Hello </a:t></a:r><a:r><a:t>there</a:t></a:r></a:p></p:sld>')
    return out.getvalue()


def folder(tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("b.txt", "mail a@b.org")
        z.writestr("skip.bin", "x")
        z.writestr("nested.zip", b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes("é 10.0.0.1".encode())
    (tmp_path / "latin.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "sub" / "z.zip").write_bytes(inner.getvalue())
    (tmp_path / "s.xlsx").write_bytes(xlsx())
    (tmp_path / "p.pptx").write_bytes(pptx())
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "note.md").write_text("not read")
    return str(tmp_path)


def test_all_formats(spark, tmp_path):
    rows = {r.file_name: r for r in files.read_texts(spark, folder(tmp_path)).collect()}
    assert set(rows) == {"a.TXT", "latin.txt", "z.zip", "s.xlsx", "p.pptx", "bad.xlsx"}
    assert rows["latin.txt"].text == "é" and rows["a.TXT"].text == "é 10.0.0.1"
    assert rows["z.zip"].text == "--- File: b.txt ---\nmail a@b.org" and rows["z.zip"].extracted_files == ["b.txt"]
    assert rows["s.xlsx"].text == "--- Sheet: One ---\nEmployee Full Name | n\nAnn\n7"
    assert rows["p.pptx"].text == "--- Slide 1 ---\nHello there"
    assert not rows["bad.xlsx"].success and "BadZipFile" in rows["bad.xlsx"].error


def test_native_text_reader_and_workbook(spark, tmp_path):
    path = folder(tmp_path)
    assert {r.file_name: r.text for r in files.read_plain(spark, path).collect()}["latin.txt"] == "é"
    assert [tuple(r) for r in files.read_workbook(spark, f"{path}/s.xlsx").collect()] == [("Ann", None), (None, "7")]
    assert files.archive_members(spark, path).select("name").first()[0] == "b.txt"


def test_pipeline_and_reports(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    results = pipeline.run(spark, folder(src), output=str(tmp_path / "out"), presentation=True)
    rows = {r.file_name: r for r in results.collect()}
    assert rows["a.TXT"].cleaned_text == "é [IP_ADDRESS]" and rows["a.TXT"].risk_level == "MEDIUM"
    assert not rows["bad.xlsx"].success
    assert pipeline.final_summary(results).first().successful == 5
    assert any((tmp_path / "out").iterdir())
    assert zipfile.is_zipfile(tmp_path / "out" / "security_report.pptx")
    assert [r.path.rpartition("/")[2] for r in files.list_files(spark, str(src)).collect()] == ["a.TXT", "bad.xlsx", "latin.txt", "p.pptx", "s.xlsx", "z.zip"]


def test_workflows(spark, tmp_path):
    texts = files.read_texts(spark, folder(tmp_path))
    assert "cleaned_text" not in pipeline.process(texts, "analyze").columns
    assert "key_findings" not in pipeline.process(texts, "cleanse").columns


def test_header_only_csv(spark, tmp_path):
    writers.write_csv(spark.createDataFrame([], report.RESULTS), str(tmp_path / "c"))
    assert "file_name" in (tmp_path / "c" / "part-00000.csv").read_text()


def test_client_names():
    assert files.client_names('{"client_names": ["B", "a"]}') == files.client_names('["a", "b"]') == ["a", "b"]


def test_profiles(spark, tmp_path):
    path = folder(tmp_path)
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (5).to_bytes(4, "big") + b"\x08\x02\0\0\0")
    (tmp_path / "j.jpg").write_bytes(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x05\0\x07\x03" + b"\0" * 20)
    rows = {r.path.rpartition("/")[2]: r for r in files.profiles(spark, path).collect()}
    assert rows["i.png"].profile == {"width": 7, "height": 5, "channels": 3} == rows["j.jpg"].profile
    assert rows["z.zip"].profile == {"members": 1} and rows["p.pptx"].profile["slides"] == 1 and rows["s.xlsx"].profile["cells"] == 4
    assert rows["bad.xlsx"].error


def test_redacted_workbook(spark, tmp_path):
    from docsieve.functions import catalogs as C

    df = spark.createDataFrame([("Ann <1>", "a"), (None, "b")], "`Employee Full Name` string, note string")
    writers.write_workbook(df, str(tmp_path / "w.xlsx"), C.SENSITIVE_SHEET, C.SHEET_REPLACEMENTS)
    assert [tuple(r) for r in files.read_workbook(spark, str(tmp_path / "w.xlsx")).collect()] == [("[REDACTED NAME]", "a"), (None, "b")]
    writers.write_workflow(spark, str(tmp_path / "flow.txt"))
    assert "[score risk]" in (tmp_path / "flow.txt").read_text()


def test_word_lines(spark):
    from docsieve.operators import blocks

    w = spark.createDataFrame([(1, 2, "b", 90.0, 3, 4), (1, 1, "a", 90.0, 1, 2), (1, 3, " ", 90.0, 0, 0), (1, 4, "low", 0.0, 0, 0)], "image int, seq int, text string, conf double, left int, top int")
    assert blocks.word_lines(w, "image").first().text == "[1, 2] a\n[3, 4] b"


def test_archive_as_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "b.txt").write_text("mail a@b.org")  # what the archive's member holds
    (row,) = pipeline.run(spark, folder(tmp_path / "in"), members=True).collect()
    (alone,) = pipeline.run(spark, str(tmp_path / "b.txt")).collect()
    assert row.path.endswith("z.zip!b.txt")
    assert (row.file_name, row.file_type, row.cleaned_text, row.risk_level, row.pii_types) == ("b.txt", "txt", alone.cleaned_text, alone.risk_level, alone.pii_types)


def test_redacted_presentation(spark, tmp_path):
    from pyspark.sql import functions as F

    from docsieve.operators import pii
    from docsieve.sources import office, presentations

    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    p = "http://schemas.openxmlformats.org/presentationml/2006/main"
    body = lambda kind, *texts: f"<{kind}:txBody>" + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts) + f"</{kind}:txBody>"
    slide = lambda *parts: f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{"".join(parts)}</p:spTree></p:cSld></p:sld>'
    with zipfile.ZipFile(tmp_path / "t.pptx", "w") as z:
        z.writestr("ppt/slides/slide2.xml", slide(f"<p:sp>{body('p', 'clean')}</p:sp>"))
        z.writestr("ppt/slides/slide1.xml", slide(f"<p:sp>{body('p', 'ask 10.0.0.1 at', 'or 10.0.0.2 now')}</p:sp>", f"<p:graphicFrame><a:tbl><a:tr><a:tc>{body('a', 'at 10.1.1.9 or')}</a:tc><a:tc>{body('a', 'n')}</a:tc></a:tr></a:tbl></p:graphicFrame>"))
        z.writestr("ppt/other.bin", b"kept")
    (tmp_path / "bad.pptx").write_bytes(b"no zip")
    rows = {r.path.rpartition("/")[2]: r for r in presentations.redact_presentations(spark, str(tmp_path)).collect()}
    assert rows["bad.pptx"].error and rows["bad.pptx"].content is None
    got = rows["t.pptx"]
    assert (got.total_slides, got.total_shapes, got.slides_with_pii, got.shapes_with_pii) == (2, 3, 1, 2)
    texts = spark.createDataFrame([("ask 10.0.0.1 at\nor 10.0.0.2 now",), ("at 10.1.1.9 or",)], "text string")
    want = [r for (r,) in texts.select(pii.detect(F.col("text"))).collect()]
    assert got.total_pii_instances == sum(map(len, want)) == sum(got.pii_by_type.values())
    assert got.pii_by_type.keys() == {f.type for fs in want for f in fs}
    first, second = office.slides(bytes(got.content))
    assert not any("10." in s for s in first) and "n" in first and second == ["clean"]
    with zipfile.ZipFile(io.BytesIO(bytes(got.content))) as z:
        assert z.read("ppt/other.bin") == b"kept" and z.read("ppt/slides/slide1.xml").count(b"FF0000") == 2
    presentations.write_redacted(spark, str(tmp_path / "t.pptx"), str(tmp_path / "out.pptx"))
    assert office.slides((tmp_path / "out.pptx").read_bytes()) == [first, second]
