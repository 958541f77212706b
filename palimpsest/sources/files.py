"""Spreadsheets, word documents and HTML files, read through Spark's own file source.

A file is one row of `binaryFile`, parsed where it was read with the standard library, so any store that Spark reads
will do. Spreadsheet rows leave the task in batches.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.normalise import cell

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BATCH = 5000
ROWS = "path string, sheet string, row int, data map<string,string>, links map<string,string>"


def column_number(name: str) -> int:
    """A is 0, Z 25, AA 26."""
    n = 0
    for c in name.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        return ["".join(t.text or "" for t in e.iter(f"{_NS}t")) for _, e in ElementTree.iterparse(f) if e.tag == f"{_NS}si"]


def sheet_rows(content: bytes):
    """(sheet, row number from 1, cells by column number, link targets by column number) of a workbook's first sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _texts(book)
        sheets = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        if not sheets:
            return
        name, links = sheets[0], {}
        related = name.replace("worksheets/", "worksheets/_rels/") + ".rels"
        targets = {}
        if related in book.namelist():
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read(related))}
        tree = ElementTree.fromstring(book.read(name))
        for h in tree.iter(f"{_NS}hyperlink"):
            links[h.get("ref")] = targets.get(h.get(_REL)) or h.get("location")
        for i, row in enumerate(tree.iter(f"{_NS}row")):
            cells, where = {}, {}
            for at, c in enumerate(row.iter(f"{_NS}c")):
                ref = c.get("r") or ""
                letters = re.match("[A-Z]+", ref)
                k = column_number(letters[0]) if letters else at
                v = c.find(f"{_NS}v")
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif c.get("t") == "s" and v is not None:
                    text = shared[int(v.text)]
                else:
                    text = v.text if v is not None and v.text else ""
                cells[k] = text
                if links.get(ref):
                    where[k] = links[ref]
            yield name, int(row.get("r") or i + 1), cells, where


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """ROWS of all .xlsx files under the path but locked ones (~$...): the first row has the names, blank ones are col_N.

    Cells are strings with line ends as spaces. A row is numbered as in the sheet, so data start at 2. A file that can't
    be read has no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for files_ in batches:
            for where, content in zip(files_.path, files_.content, strict=True):
                names, out = None, []
                try:
                    for sheet, number, cells, links in sheet_rows(bytes(content)):
                        if names is None:
                            names = {k: cells.get(k, "").strip().lower() or f"col_{k + 1}" for k in range(max(cells, default=-1) + 1)}
                            continue
                        named = {names.get(k, f"col_{k + 1}"): v for k, v in cells.items()}
                        out.append((where, sheet, number, named, {names.get(k, f"col_{k + 1}"): v for k, v in links.items()}))
                        if len(out) == BATCH:
                            yield pd.DataFrame(out, columns=["path", "sheet", "row", "data", "links"])
                            out = []
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, IndexError, KeyError):
                    out = []
                if out:
                    yield pd.DataFrame(out, columns=["path", "sheet", "row", "data", "links"])

    rows = files.where(~F.col("path").rlike(r"/~\$[^/]*$")).select("path", "content").mapInPandas(run, ROWS)
    return rows.withColumn("data", F.transform_values("data", lambda k, v: cell(v)))


def link_of(data: Column, links: Column, name: str) -> Column:
    """A cell's link target, else its text."""
    return F.coalesce(F.nullif(links[name], F.lit("")), data[name])


def first_of(data: Column, *names: str) -> Column:
    """The first non-empty cell of these names."""
    return F.coalesce(*(F.nullif(F.trim(data[n]), F.lit("")) for n in names))


def required(table: DataFrame, names: list[str]) -> DataFrame:
    """The table with empty strings for null ones; ValueError if a column is missing."""
    if missing := [n for n in names if n not in table.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return table.fillna("", [f.name for f in table.schema.fields if f.dataType.simpleString() == "string"])


def word_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all .docx files: tabs, breaks and paragraphs as \\t and \\n; null for a file that can't be read."""

    def run(batches):
        for files in batches:
            out = []
            for content in files.content:
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        out.append(z.read("word/document.xml").decode("utf-8", "replace"))
                except (zipfile.BadZipFile, KeyError):
                    out.append(None)
            yield pd.DataFrame({"path": files.path, "xml": out})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, xml string").select("path", xml_text(F.col("xml")).alias("text"))


def xml_text(x: Column) -> Column:
    """The text of a word document's XML; entities are decoded with &amp; first."""
    x = F.regexp_replace(F.regexp_replace(x, "<w:tab[^>]*/>", "\t"), "<w:(br|cr)[^>]*/>|</w:p>", "\n")
    x = F.regexp_replace(x, "<[^>]*>", "")
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return F.trim(x)


def decoded(content: bytes) -> str:
    """HTML as text: by its mark, else as UTF-8, else by the charset it declares at its beginning, else cp1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        pass
    found = re.search(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-]+)", content[:4096], re.I)
    name = found[1].decode().lower() if found else "cp1252"
    name = {"latin-1": "cp1252", "iso-8859-1": "cp1252", "ansi": "cp1252"}.get(name, name)
    try:
        return content.decode(name, "replace")
    except LookupError:
        return content.decode("cp1252", "replace")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of all .htm and .html files."""

    def run(batches):
        for files in batches:
            yield pd.DataFrame({"path": files.path, "html": [decoded(bytes(c)) for c in files.content]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, html string")
