"""Files as tables: discovery, validation, and parsing by kind; failures are rows, not exceptions."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported suffixes and their types.
KINDS = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".html": "text/html",
    ".htm": "text/html",
    ".csv": "text/csv",
}
LARGEST = 100 << 20
# Fixed value: what a heading of Markdown is.
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def detect_kind(name: Column) -> Column:
    """The type of a file by its suffix; null for others."""
    return F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[suffix(name)]


def discover(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``(path, name, length, content, kind, file_hash, error)`` of the supported files of a folder; Spark's listing leaves out empty files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    rows = rows.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).withColumn("kind", detect_kind(F.col("name"))).where("kind is not null")
    error = F.when(F.col("length") <= 0, "File is empty").when(F.col("length") > LARGEST, "File too large")
    return rows.select("path", "name", "length", "content", "kind", F.sha2("content", 256).alias("file_hash"), error.alias("error"))


def table_text(table: Column) -> Column:
    """An array of rows of cells as text: the first row, 40 dashes, the others; empty for none, null cells are empty."""
    lines = F.transform(table, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "))
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.when(F.size(table) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(F.lit("-" * 40)), rest), "\n")).otherwise("")


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pos, level, title, offset)`` of each heading, offset in characters; null texts have none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = [(k, i, len(m[1]), m[2], m.start()) for k, v in zip(rows["key"], rows["text"]) if v for i, m in enumerate(_HEADING.finditer(v))]
            yield pd.DataFrame(out, columns=["key", "pos", "level", "title", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, pos int, level int, title string, offset int").withColumnRenamed("key", key)


def row_text(rows: DataFrame, key: str) -> DataFrame:
    """Each row as ``column: value | column: value`` of its non-empty values."""
    parts = (F.concat(F.lit(f"{c}: "), F.nullif(F.col(c).cast("string"), F.lit(""))) for c in rows.columns)
    return rows.select(key, F.concat_ws(" | ", *parts).alias("text"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def _docx(data: bytes) -> tuple[str, str | None]:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        words = lambda e: "".join(t.text or "" for t in e.iter(f"{space}t"))
        inside = {id(p) for tbl in body.iter(f"{space}tbl") for p in tbl.iter(f"{space}p")}
        lines = [words(p) for p in body.iter(f"{space}p") if id(p) not in inside]
        for tbl in body.iter(f"{space}tbl"):
            first, *rest = ([words(c) for c in row.iter(f"{space}tc")] for row in tbl.iter(f"{space}tr"))
            lines.append("\n".join([" | ".join(first), "-" * 40, *(" | ".join(r) for r in rest)]))
        title = None
        if "docProps/core.xml" in z.namelist():
            core = ElementTree.fromstring(z.read("docProps/core.xml"))
            title = next((e.text for e in core if e.tag.endswith("}title")), None)
    return "\n\n".join(line for line in lines if line.strip()), title


def _csv(data: bytes) -> tuple[str, str | None]:
    rows = pd.read_csv(io.BytesIO(data), dtype=str, keep_default_na=False).to_dict("records")
    return "\n\n".join(" | ".join(f"{k}: {v}" for k, v in r.items() if v) for r in rows), None


def _html(data: bytes) -> tuple[str, str | None]:
    from quillstone.operators.chunking import _Text

    parser = _Text()
    parser.feed(data.decode("utf-8", "replace"))
    parser.close()
    return "\n".join(parser.out), " ".join(parser.title) or None


def _plain(data: bytes) -> tuple[str, str | None]:
    text = data.decode("utf-8-sig", "replace")
    heading = _HEADING.search(text)
    return text, heading[2].strip() if heading else None


PARSERS = {".txt": _plain, ".md": _plain, ".html": _html, ".htm": _html, ".csv": _csv, ".docx": _docx}


def parse(found: DataFrame) -> DataFrame:
    """``(path, name, file_hash, kind, title, text, error)``: each discovered file's text, or why there is none.

    PDF needs a parser that isn't part of this package; such files get an error row.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for name, data, error in zip(rows["name"], rows["content"], rows["error"]):
                text = title = None
                parser = PARSERS.get("." + name.rsplit(".", 1)[-1].lower())
                if not error:
                    if parser is None:
                        error = "No parser for this file type"
                    else:
                        try:
                            text, title = parser(bytes(data))
                        except Exception as e:  # noqa: BLE001 - a broken file is a row
                            error = f"Parse failed: {type(e).__name__}"
                out.append((title, text, error))
            yield rows[["path", "name", "file_hash", "kind"]].assign(title=[o[0] for o in out], text=[o[1] for o in out], error=[o[2] for o in out])

    return found.select("path", "name", "file_hash", "kind", "content", "error").mapInPandas(run, "path string, name string, file_hash string, kind string, title string, text string, error string")
