"""Broadcasting only what has been measured.

A join side is broadcast when its rows and bytes, counted no further than the
bounds, are within them; beyond them the ordinary shuffle join runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS, MAX_BYTES = 100_000, 64 << 20


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a value; nested values count 16 an entry."""
    column = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return 16 * F.coalesce(F.size(column), F.lit(0))
    return F.lit(8)


def small_enough(df: DataFrame, most: int = MAX_ROWS, most_bytes: int = MAX_BYTES) -> bool:
    """Whether ``df`` has at most ``most`` rows and about ``most_bytes``; reads at most one row more than that."""
    width = sum((_width(f.name, f.dataType) for f in df.schema), F.lit(8))
    found = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return found.n <= most and found.bytes <= most_bytes


def broadcast_if_small(df: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    return F.broadcast(df) if small_enough(df, most) else df
