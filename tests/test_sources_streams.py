import io
import json
import os
import zipfile

from pyspark.sql import functions as F

from quirework.operators import steps
from quirework.sources import files
from quirework.streaming import streams


def docx(paragraphs, table):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' if s else f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for s, t in paragraphs)
    t = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in table) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p}{t}</w:body></w:document>')
        z.writestr("word/media/pic.png", b"x")
    return out.getvalue()


def xlsx(rows):
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{c}</t></is></c>' for j, c in enumerate(r) if c) + "</row>" for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}"><sheets><sheet name="First"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_export_folder(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (deep / "t.csv").write_text('Name,Content,Created time\n"N, 1","Body ""x""",2024\n,,\n')
    (tmp_path / "t_all.csv").write_text("Name,Content,Created time\nskip,skip,skip\n")
    (tmp_path / "p.html").write_text("<html><title>T &amp; U</title><nav>no</nav><article><h1>Head</h1><p>Text <b>bold</b></p><script>no()</script></article></html>")
    (tmp_path / "q.html").write_text("<p>nothing marked</p>")
    (tmp_path / "n.md").write_text("# Title *x*\nbody")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "d.docx").write_bytes(docx([("Heading1", "Top"), (None, "Para")], [["a", "b"], ["c", "d"]]))
    (tmp_path / "e.docx").write_bytes(b"not a zip")
    (tmp_path / "w.xlsx").write_bytes(xlsx([["x", None, "z"], ["1", "2", "3"]]))
    got = {(r.kind, r.title, r.body, r.error is not None) for r in files.export(spark, str(tmp_path)).collect()}
    assert ("csv", "N, 1", 'Body "x"', False) in got
    assert ("csv", "Untitled", "", False) in got and not any(t == "skip" for _, t, _, _ in got)
    assert ("html", "T & U", "Head\nText\nbold", False) in got and ("html", "q", "", False) in got
    assert ("markdown", "Title *x*", "# Title *x*\nbody", False) in got and ("markdown", "bad", None, True) in got
    parts = {(r.part, r.text) for r in files.docx_parts(spark, str(tmp_path)).collect()}
    assert {("heading", "Top"), ("table", "a\tb"), ("table", "c\td"), ("image", "pic.png")} <= parts and any(p == "error" for p, _ in parts)
    assert {r.title: r.body for r in files.docx_documents(spark, str(tmp_path)).collect()} == {"d": "Top\nPara", "e": None}
    assert [(r.sheet, r.row, r.cells) for r in files.workbook_rows(spark, str(tmp_path)).orderBy("row").collect()] == [("First", 1, ["x", None, "z"]), ("First", 2, ["1", "2", "3"])]
    meta = {r.name: r.file_type for r in files.file_metadata(spark, str(tmp_path)).collect()}
    assert meta["d.docx"] == "docx"
    one = spark.createDataFrame([("a.PDF", 10), ("b.exe", 10), ("c.md", 99_999_999)], "p string, n long")
    assert [r[0] for r in one.select(files.upload_status(F.col("p"), F.col("n"))).collect()] == ["ok", "type_not_allowed", "too_large"]
    assert [r[0] for r in one.select(files.route(F.col("p"))).collect()] == [None, None, "page"]
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "c binary")
    assert [r[0] for r in raw.select(files.decoded(F.col("c"))).collect()] == ["é", "é"]


LINES = ['{"message": "m", "level": 3, "extra": {"a": 1}}', "", "{bad", "[1]", '{"level": 3}', '{"message": 4, "level": 3}', '{"message": "' + "x" * 50 + '", "level": 1}']
WANT = ["ok", "blank", "syntax", "syntax", "missing:message", "type:message", "size:message"]


def test_log_lines_batch_and_stream(spark, tmp_path):
    required = {"message": "string", "level": "number"}
    df = spark.createDataFrame([(i, line) for i, line in enumerate(LINES)] + [(99, None)], "n int, value string")
    got = df.select("n", files.log_status(F.col("value"), required, {"message": 20}).alias("s")).orderBy("n").collect()
    assert [r.s for r in got] == [*WANT, "blank"]
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(LINES))
    streams.run_once(streams.log_lines(spark, str(folder), required), str(tmp_path / "out"), str(tmp_path / "cp"))
    seen = spark.read.parquet(str(tmp_path / "out")).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in seen}["ok"] == 2
    files.save_json_lines(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "json"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).first()[0]) == {"a": 1, "b": "x"}


def test_streams_equal_batches(spark, data, tmp_path):
    source = tmp_path / "steps"
    facts = steps.facts(spark.read.parquet(os.path.join(data, "processing_steps.parquet")))
    facts.orderBy("ts").coalesce(1).write.parquet(str(source))
    stream = streams.event_stream(spark, str(source), facts.schema.simpleString().replace("struct<", "").rstrip(">").replace(":", " "))
    streams.run_once(streams.trend_buckets(stream, "30 days", "4000 days"), str(tmp_path / "trend"), str(tmp_path / "cp1"))
    bad = facts.where(F.col("status").isin(*steps.BAD) & F.col("ts").isNotNull())
    # the stream gives out the windows that its watermark has closed
    out = {(r.start, r.step_name): r.n for r in spark.read.parquet(str(tmp_path / "trend")).collect()}
    batch = {(r.s, r.step_name): r.n for r in bad.groupBy(F.window("ts", "30 days").start.alias("s"), "step_name").agg(F.count("*").alias("n")).collect()}
    assert all(batch[k] == n for k, n in out.items())
    alerts = stream.where(F.col("status").isin(*steps.BAD)).select(F.col("step_name").alias("key"), F.unix_seconds("ts").alias("seconds"), F.concat_ws("/", "doc_id", "seq").alias("message"))
    streams.run_once(streams.cooled(alerts, 86400), str(tmp_path / "alerts"), str(tmp_path / "cp2"))
    rows = bad.select(F.col("step_name").alias("key"), F.unix_seconds("ts").alias("seconds"), F.concat_ws("/", "doc_id", "seq").alias("message"))
    want = {tuple(r) for r in steps.cooled(rows, "key", "seconds", "message", 86400).collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "alerts")).collect()} == want


def test_threshold_alerts(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.07), (3, 0.0), (4, None)], "id int, v double")
    got = {r.id: (r.severity, list(r.channels)) for r in streams.threshold_alerts(df, F.col("v"), 0.05, 0.1).collect()}
    assert got == {1: ("critical", ["email", "webhook"]), 2: ("warning", ["webhook"])}
