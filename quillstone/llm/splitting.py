"""Cutting oversized texts at natural boundaries, with overlap between the pieces.

Recursive bisection: a text over the limit is cut at the strongest boundary near
its middle, and the halves are cut again while they hold more words than the limit
minus the overlap; then each piece gets the last words of the one before. A task
sees whole texts one by one, so texts spread over the cluster by Spark's scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.plans.broadcasting import broadcast_if_small

#: Words are separated by runs of these bytes.
SPACES = np.isin(np.arange(256), list(b" \t\n\r"))
SENTENCE_ENDS = np.isin(np.arange(256), list(b".!?"))
CLAUSE_ENDS = np.isin(np.arange(256), list(b",;:"))
CLOSERS = np.isin(np.arange(256), list(b")]\"'"))
#: Strength of a boundary: before a heading, at a blank line, a line end, a sentence end, a clause end, any word end.
HEADING, BLANK, LINE, SENTENCE, CLAUSE, WORD = 5, 4, 3, 2, 1, 0


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words begin and end."""
    space = np.concatenate(([True], SPACES[data], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def strengths(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Strength of the boundary before each word but the first (entry 0 stands for it, and is unused)."""
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    feeds = np.zeros(len(begins), np.int64)
    feeds[1:] = lines[begins[1:]] - lines[ends[:-1]]
    last = np.zeros(len(begins), np.uint8)
    last[1:] = data[ends[:-1] - 1]
    inner = np.zeros(len(begins), np.uint8)
    inner[1:] = data[np.maximum(ends[:-1] - 2, 0)]
    ended = SENTENCE_ENDS[last] | CLOSERS[last] & SENTENCE_ENDS[inner]
    strength = np.where(ended, SENTENCE, np.where(CLAUSE_ENDS[last], CLAUSE, WORD))
    strength[feeds == 1] = LINE
    strength[feeds > 1] = BLANK
    strength[(feeds > 0) & (data[begins] == ord("#"))] = HEADING
    return strength


def bisect(strength: np.ndarray, size: int, most: int) -> list[int]:
    """Cuts (word numbers) of ``size`` words so that no part has more than ``most``."""
    cuts, todo = [], [(0, size)]
    while todo:
        begin, end = todo.pop()
        n = end - begin
        if n <= most:
            continue
        # the middle half, so that halves shrink whatever the boundaries are
        low, high = begin + max(1, n // 4), end - max(1, n // 4)
        near = strength[low : high + 1]
        middle = (begin + end) / 2
        best = np.flatnonzero(near == near.max()) + low
        cut = int(best[np.argmin(np.abs(best - middle))])
        cuts.append(cut)
        todo += [(begin, cut), (cut, end)]
    return sorted(cuts)


def pieces_of(text: str, most: int, overlap: int) -> list[tuple[int, int, str]]:
    """``(words, words repeated from the piece before, text)`` of each piece; none for a blank text."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    begins, ends = spans(data)
    if not len(begins):
        return []
    if len(begins) <= most:
        return [(len(begins), 0, text)]
    shared = max(0, min(overlap, most - 1))
    cuts = [0, *bisect(strengths(data, begins, ends), len(begins), most - shared), len(begins)]
    out = []
    for k in range(len(cuts) - 1):
        first = max(0, cuts[k] - shared) if k else 0
        out.append((cuts[k + 1] - first, cuts[k] - first, raw[begins[first] : ends[cuts[k + 1] - 1]].decode("utf-8", "surrogatepass")))
    return out


def split(docs: DataFrame, key: str, text: str, most: str, overlap: str) -> DataFrame:
    """Pieces ``(key, piece_no, n_words, n_repeated, piece)`` of each text, numbered from 0.

    A text within the limit, or without a limit (null or below 1), is one piece as it
    is; null, empty and blank texts have none. Each further piece begins with the last
    ``overlap`` words of the one before (all of its words if it has fewer); null or
    negative overlap is 0, and an overlap of the limit or more counts as the limit less
    one. Rows are cut one by one, so repeated keys give repeated pieces. Other columns
    play no part, whatever their names.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("piece_no", T.IntegerType()), T.StructField("n_words", T.IntegerType()),
        T.StructField("n_repeated", T.IntegerType()), T.StructField("piece", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, columns = [], ([], [], [], [])
            for i, (value, limit, repeat) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                if value is None:
                    continue
                limit = limit if limit and limit > 0 else len(value) + 1
                for k, row in enumerate(pieces_of(value, limit, repeat or 0)):
                    at.append(i)
                    for column, cell in zip(columns, (k, *row)):
                        column.append(cell)
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            cells = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([keys, *cells], schema.names)

    source = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in ((key, "k"), (text, "t"), (most, "m"), (overlap, "o"))))
    return source.mapInArrow(run, schema)


def registry_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of each registry content under the limits of its chunking settings (null settings: 1)."""
    rules = (
        spark.read.parquet(f"{root}/chunking_settings.parquet")
        .where(F.col("settings_id").isNotNull())
        .groupBy("settings_id")
        .agg(F.min(F.struct("max_size", "overlap")).alias("rule"))
    )
    docs = spark.read.parquet(f"{root}/doc_registry.parquet").select("rec_id", "content", F.coalesce("settings_id", F.lit(1)).alias("settings_id"))
    ruled = docs.join(broadcast_if_small(rules), "settings_id", "left").select("rec_id", "content", "rule.max_size", "rule.overlap")
    return split(ruled, "rec_id", "content", "max_size", "overlap")


def p4_pieces(spark: SparkSession, root: str) -> DataFrame:
    return registry_pieces(spark, root)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Records that had to be cut: those with a second piece."""
    return registry_pieces(spark, root).where("piece_no = 1").select("rec_id")
