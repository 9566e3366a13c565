"""Readers of exported folders: CSV, HTML, Markdown, word processing and spreadsheet files, logs.

Every reader gives rows; a file or line that cannot be read becomes a row with
``error`` instead of an exception.  Files are listed and split by Spark; what
needs a parser runs in Arrow batches over whole files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "path string, title string, body string, error string"
# Accepted upload types and the greatest size in bytes.
UPLOAD_TYPES = ("pdf", "docx", "doc", "xlsx", "xls", "csv", "txt", "md", "json")
UPLOAD_LIMIT = 10 * 1024 * 1024
KINDS = {"csv": "table", "xlsx": "table", "xls": "table", "docx": "text", "doc": "text", "html": "page", "htm": "page", "md": "page", "txt": "page"}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, modificationTime, length, content)`` of all files below ``folder``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def file_metadata(spark: SparkSession, folder: str) -> DataFrame:
    rows = files(spark, folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return rows.select(name.alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), suffix(F.col("path")).alias("file_type"))


def upload_status(path: Column, size: Column) -> Column:
    return F.when(size > UPLOAD_LIMIT, "too_large").when(~suffix(path).isin(*UPLOAD_TYPES), "type_not_allowed").otherwise("ok")


def route(path: Column) -> Column:
    """The kind of reader for a file, or null."""
    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.try_element_at(table, suffix(path))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text, or as Latin-1 where they are not valid UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def text_documents(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """``(path, title, body, error)`` of plain texts in UTF-8 or Latin-1, the title being the file name; Spark's binary reader gives no row for an empty file."""
    rows = files(spark, folder, pattern)
    return rows.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("title"), decoded(F.col("content")).alias("body"), F.lit(None).cast("string").alias("error"))


def csv_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all ``*.csv`` below ``folder`` but ``*_all.csv``, all columns as text, with ``source_path``.

    Quotes inside a quoted field are doubled.  A row whose number of fields differs
    from the header fails the read.
    """
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("mode", "FAILFAST")
    rows = reader.option("escape", '"').option("multiLine", True).csv(folder)
    return rows.withColumn("source_path", F.col("_metadata.file_path")).where(~F.col("source_path").endswith("_all.csv"))


def csv_documents(rows: DataFrame) -> DataFrame:
    """Rows of an exported table in the common document shape; missing columns and null cells get defaults."""
    cell = lambda c, d: F.coalesce(F.col(f"`{c}`"), F.lit(d)) if c in rows.columns else F.lit(d)
    return rows.select(
        F.col("source_path").alias("path"),
        cell("Name", "Untitled").alias("title"),
        cell("Content", "").alias("body"),
        cell("Created time", None).cast("string").alias("timestamp_utc"),
        cell("Last edited time", None).cast("string").alias("last_modified_utc"),
        F.lit(None).cast("string").alias("error"),
    )


class _Page(HTMLParser):
    """Title and text of the first article, main or page body."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.best, self.depth, self.rank, self.open_ = [], {}, None, {}, {}, []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "meta", "link", "input"):
            return
        kind = tag if tag in ("article", "main") else "body" if tag == "div" and "page-body" in (dict(attrs).get("class") or "") else None
        self.open_.append((tag, kind if kind and kind not in self.text else None))
        if self.open_[-1][1]:
            self.text[kind] = []

    def handle_endtag(self, tag):
        for i in range(len(self.open_) - 1, -1, -1):
            if self.open_[i][0] == tag:
                del self.open_[i:]
                return

    def handle_data(self, data):
        if any(t in ("script", "style") for t, _ in self.open_):
            return
        if self.open_ and self.open_[-1][0] == "title":
            self.title.append(data)
        elif data.strip():
            for _, kind in self.open_:
                if kind:
                    self.text[kind].append(data.strip())


def parse_html(content: str) -> tuple[str | None, str]:
    page = _Page()
    page.feed(content)
    title = "".join(page.title).strip() or None
    body = next((page.text[k] for k in ("article", "main", "body") if k in page.text), [])
    return title, "\n".join(body)


def parse_markdown(content: str) -> tuple[str | None, str]:
    first = content.split("\n", 1)[0]
    return (re.sub(r"^[# ]+", "", first).strip() or None) if content.startswith("# ") else None, content


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parse_docx(raw: bytes) -> dict:
    """Text, headings of three levels, tables and image names of a word processing file."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        images = sorted(n.rsplit("/", 1)[1] for n in z.namelist() if n.startswith("word/media/"))
    body = root.find(f"{_W}body")
    line = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t"))
    paragraphs, headings = [], []
    for p in body.findall(f"{_W}p"):
        paragraphs.append(line(p))
        style = p.find(f"{_W}pPr/{_W}pStyle")
        m = re.fullmatch(r"(?i)heading ?([1-3])", style.get(f"{_W}val", "")) if style is not None else None
        if m:
            headings.append((int(m[1]), line(p)))
    tables = [[["\n".join(line(p) for p in c.iter(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")] for t in body.findall(f"{_W}tbl")]
    return {"text": "\n".join(paragraphs), "headings": headings, "tables": tables, "images": images}


def parse_xlsx(raw: bytes) -> list[tuple[str, int, list[str | None]]]:
    """``(sheet, row, cells)`` of all sheets."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        for n, sheet in enumerate(sheets, 1):
            part = f"xl/worksheets/sheet{n}.xml"
            if part not in names:
                continue
            for r in ElementTree.fromstring(z.read(part)).iter(f"{_S}row"):
                cells: list[str | None] = []
                for c in r.findall(f"{_S}c"):
                    letters = re.match(r"[A-Z]*", c.get("r", "")).group()
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    cells += [None] * (max(at, len(cells) + 1) - 1 - len(cells))
                    v = c.find(f"{_S}v")
                    if c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{_S}t")))
                    elif v is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
                out.append((sheet, int(r.get("r", len(out) + 1)), cells))
    return out


def _parsed(rows: DataFrame, parse: Callable[[bytes], tuple[str | None, str]]) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    title, body = parse(raw)
                    out.append((path, title or stem, body, None))
                except Exception as e:  # a file that cannot be read is a row with its error
                    out.append((path, stem, None, f"{type(e).__name__}: {e}"[:200]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(4)], names=["path", "title", "body", "error"])

    return rows.select("path", "content").mapInArrow(run, DOCUMENT)


def html_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(files(spark, folder, "*.html"), lambda raw: parse_html(raw.decode("utf-8", "replace")))


def markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(files(spark, folder, "*.md"), lambda raw: parse_markdown(raw.decode("utf-8")))


def docx_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(files(spark, folder, "*.docx"), lambda raw: (None, parse_docx(raw)["text"]))


def docx_parts(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, part, level, pos, text)``: headings, table rows and images of word processing files."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    doc = parse_docx(raw)
                except Exception as e:
                    out.append((path, "error", None, 0, str(e)[:200]))
                    continue
                out += [(path, "heading", level, i, t) for i, (level, t) in enumerate(doc["headings"])]
                out += [(path, "table", n, i, "\t".join(r)) for n, t in enumerate(doc["tables"]) for i, r in enumerate(t)]
                out += [(path, "image", None, i, n) for i, n in enumerate(doc["images"])]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["path", "part", "level", "pos", "text"])

    return files(spark, folder, "*.docx").select("path", "content").mapInArrow(run, "path string, part string, level int, pos int, text string")


def workbook_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, sheet, row, cells, error)`` of all spreadsheet files."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out += [(path, s, r, c, None) for s, r, c in parse_xlsx(raw)]
                except Exception as e:
                    out.append((path, None, None, None, str(e)[:200]))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["path", "sheet", "row", "cells", "error"])

    return files(spark, folder, "*.xlsx").select("path", "content").mapInArrow(run, "path string, sheet string, row int, cells array<string>, error string")


def table_profile(df: DataFrame, required: list[str]) -> DataFrame:
    """One row: number of rows and columns and the column names; missing required columns raise."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.agg(F.count("*").alias("row_count")).select("row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(",".join(df.columns)).alias("columns"))


def export(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of an exported folder: tables, pages and notes."""
    parts = [csv_documents(csv_tree(spark, folder)), html_documents(spark, folder), markdown_documents(spark, folder)]
    out = parts[0].withColumn("kind", F.lit("csv"))
    for kind, part in zip(("html", "markdown"), parts[1:]):
        out = out.unionByName(part.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    return out


def log_status(line: Column, required: dict[str, str], longest: dict[str, int] | None = None) -> Column:
    """The first failing check of a JSON log line: ``blank``, ``syntax``, ``missing:<f>``, ``type:<f>``, ``size:<f>`` or ``ok``.

    ``required`` gives the type of each field: string, number, boolean or object.
    """
    v = F.try_parse_json(line)
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    types = {
        "string": lambda k: k == "STRING",
        "number": lambda k: k.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | k.startswith("DECIMAL"),
        "boolean": lambda k: k == "BOOLEAN",
        "object": lambda k: k.startswith("OBJECT"),
    }
    out = F.when(F.btrim(F.coalesce(line, F.lit(""))) == "", "blank").when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "syntax")
    for f in required:
        out = out.when(F.try_variant_get(v, f"$.{f}", "variant").isNull(), f"missing:{f}")
    for f, t in required.items():
        out = out.when(~types[t](kind(f)), f"type:{f}")
    for f, n in (longest or {}).items():
        out = out.when(F.length(F.try_variant_get(v, f"$.{f}", "string")) > n, f"size:{f}")
    return out.otherwise("ok")


def save(df: DataFrame, path: str, by: str | None = None, mode: str = "append") -> None:
    """Appends rows as Parquet, partitioned by a column where one is named; later rows win on reading (``latest``)."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def save_json_lines(df: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").option("maxRecordsPerFile", per_file).text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines in the columns of ``schema``, with ``corrupt``: the text of a line that does not parse, whose columns are null."""
    return spark.read.schema(f"{schema}, corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)


def save_history(rows: DataFrame, path: str) -> None:
    """Appends changes or tags, partitioned by ``source_type``."""
    save(rows, path, "source_type")


def read_history(spark: SparkSession, path: str, source_type: str, source_id: str | None = None) -> DataFrame:
    """The stored changes or tags of a type of source, or of one source; only that type's folder is read."""
    rows = spark.read.parquet(path).where(F.col("source_type") == source_type)
    return rows if source_id is None else rows.where(F.col("source_id") == source_id)
