"""Chunks of documents, and the text steps that no built-in expression covers."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstone.functions import text as T

# Patterns that decide where texts are cut.
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
SKIPPED = {"script", "style", "nav", "footer", "header"}


@F.pandas_udf(StringType())
def normalize_unicode(text: pd.Series) -> pd.Series:
    """NFKC."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All entities of HTML."""
    return text.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.title, self.inside, self.titled = [], [], 0, False

    def handle_starttag(self, tag, attrs):
        self.inside += tag in SKIPPED
        self.titled |= tag == "title"

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.inside:
            self.inside -= 1
        if tag == "title":
            self.titled = False

    def handle_data(self, data):
        if data.strip() and not self.inside:
            self.out.append(data.strip())
            if self.titled:
                self.title.append(data.strip())


def html_to_text(pages: DataFrame, key: str, content: str) -> DataFrame:
    """``(key, title, text)``: text nodes by line, without scripts, styles, navigation, header and footer."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for value in rows["content"]:
                parser = _Text()
                parser.feed(value or "")
                parser.close()
                out.append((" ".join(parser.title) or None, "\n".join(parser.out)))
            yield pd.DataFrame({"key": rows["key"], "title": [o[0] for o in out], "text": [o[1] for o in out]})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInPandas(run, f"key {kind}, title string, text string").withColumnRenamed("key", key)


def sections(text: str) -> list[tuple[str | None, str]]:
    """``(heading, text)`` of each part between headings; the heading's own line is left out, empty parts too."""
    out, last, title = [], 0, None
    for m in [*_HEADING.finditer(text), None]:
        part = text[last : m.start() if m else len(text)].strip()
        if part:
            out.append((title, part))
        if m:
            title, last = m[2].strip(), m.end()
    return out


def packed(parts: list[str], most: int) -> list[str]:
    """Neighbours joined by a blank while they fit; what is too long alone stays as it is."""
    out: list[list[str]] = []
    size = 0
    for p in parts:
        n = len(p.split())
        if out and size + n <= most:
            out[-1].append(p)
            size += n
        else:
            out.append([p])
            size = n
    return [" ".join(p) for p in out]


def chunks_of(text: str, target: int, most: int, overlap: int) -> list[tuple[str | None, str]]:
    """Headings, paragraphs, sentences of oversized ones; small pieces merged up to the target, then the overlap put before."""
    pieces: list[tuple[str | None, str]] = []
    for title, part in sections(text):
        for paragraph in filter(None, (p.strip() for p in _PARAGRAPH.split(part))):
            whole = len(paragraph.split()) <= most
            pieces += [(title, p) for p in ([paragraph] if whole else packed(_SENTENCE.split(paragraph), most))]
    merged: list[tuple[str | None, str]] = []
    size = 0
    for title, p in pieces:
        n = len(p.split())
        if merged and size + n <= target:
            merged[-1] = (merged[-1][0], merged[-1][1] + "\n\n" + p)
            size += n
        else:
            merged.append((title, p))
            size = n
    if overlap <= 0:
        return merged
    tails = [""] + [" ".join(p.split()[-overlap:]) for _, p in merged[:-1]]
    return [(title, f"{tail}\n\n{p}" if tail else p) for tail, (title, p) in zip(tails, merged)]


def chunk(docs: DataFrame, key: str, text: str, target: int = 512, most: int = 1024, overlap: int = 50) -> DataFrame:
    """``(key, chunk_index, chunk_id, content, token_count, section)``; null and blank texts have no chunks.

    The id is the SHA-256 of document id, index and content; tokens are words.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = [(k, i, c, len(c.split()), s) for k, v in zip(rows["key"], rows["text"]) if v and v.strip() for i, (s, c) in enumerate(chunks_of(v, target, most, overlap))]
            yield pd.DataFrame(out, columns=["key", "chunk_index", "content", "token_count", "section"])

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, chunk_index int, content string, token_count int, section string")
    return made.select(F.col("key").alias(key), "chunk_index", chunk_id(F.col("key"), F.col("chunk_index"), F.col("content")).alias("chunk_id"), "content", "token_count", "section")


def chunk_id(document, index, content):
    return F.sha2(F.concat(document.cast("string"), F.lit(":"), index.cast("string"), F.lit(":"), content), 256)


def fixed_windows(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` words, each after the last ``overlap`` words before it; expressions only."""
    words = F.filter(F.split(F.col(text), T.WS + "+"), lambda w: w != "")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key), words.alias("w")).where(F.size("w") > 0)
    rows = rows.select(key, "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))).alias("chunk_index"))
    begin = F.greatest(F.col("chunk_index") * size - overlap, F.lit(0))
    rows = rows.select(key, "chunk_index", F.array_join(F.slice("w", begin + 1, F.col("chunk_index") * size + size - begin), " ").alias("content"))
    return rows.withColumn("chunk_id", chunk_id(F.col(key), F.col("chunk_index"), F.col("content")))
