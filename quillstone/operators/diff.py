"""Differences between two copies of a dataset, row by row and field by field.

Both copies are reduced to one row per key (the latest) with map-side combining, so
a key with a third of all rows stays cheap, and cogrouped by hash bucket as Arrow
tables. Within a bucket the keys are aligned by sorted search and the columns are
compared by null-aware masks; only differing cells leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one side that a bucket holds on average.
BUCKET_ROWS = 5_000
#: Buckets that a task compares, one after the other.
BUCKETS_A_TASK = 8


def latest(df: DataFrame, key: str, fields: dict[str, Column], order: Column | None) -> DataFrame:
    """One row per non-null key: the greatest ``order``, ties by a hash of the fields."""
    row = F.struct(*(value.alias(name) for name, value in fields.items()))
    by = F.struct(*([order] if order is not None else []), F.xxhash64(*fields.values()))
    return (
        df.where(F.col(f"`{key}`").isNotNull())
        .groupBy(F.col(f"`{key}`").alias("key"))
        .agg(F.max_by(row, by).alias("row"))
        .select("key", "row.*")
    )


def comparable(df: DataFrame, name: str) -> Column:
    """The column itself, or for nested types a canonical JSON text."""
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(column)))
    return F.to_json(column) if isinstance(kind, (T.ArrayType, T.StructType)) else column


def _differs(left: pa.ChunkedArray, right: pa.ChunkedArray) -> np.ndarray:
    unequal = pc.fill_null(pc.not_equal(left, right), False)
    if pa.types.is_floating(left.type):
        unequal = pc.and_not(unequal, pc.fill_null(pc.and_(pc.is_nan(left), pc.is_nan(right)), False))
    return pc.or_(unequal, pc.xor(pc.is_null(left), pc.is_null(right))).to_numpy()


def _sorted(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    table = table.take(pc.sort_indices(table, sort_keys=[("key", "ascending")]))
    return table, table["key"].to_numpy(zero_copy_only=False)


def _align(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each left key its place among the right ones, and whether it is there."""
    at = np.searchsorted(right, left)
    there = at < len(right)
    there[there] = right[at[there]] == left[there]
    return at, there


def differences(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: list[str],
    left_order: Column | None = None,
    right_order: Column | None = None,
    left_required: Column | None = None,
    missing_left: str = "missing_left",
    missing_right: str = "missing_right",
) -> DataFrame:
    """Rows ``(key, diff, left, right)``: one per absent row and per differing cell.

    ``diff`` is ``missing_left``, ``missing_right`` or a field's name; the values are
    given as text. With ``left_required`` (a boolean over the left copy) a left row
    that isn't required may be absent on the right. Equal means equal bytes or
    numbers; null equals only null, NaN equals NaN. Null keys are ignored, of several
    rows of a key the latest counts (ties: by a hash of the fields, so the choice does
    not depend on the order of rows). An empty copy makes every row of the other one
    missing. Columns that aren't named play no part, whatever their names.
    """
    kinds = left.schema[key].dataType, right.schema[key].dataType
    if kinds[0] != kinds[1]:
        raise ValueError(f"the keys have different types: {kinds}")
    required = F.lit(True) if left_required is None else F.coalesce(left_required, F.lit(False))
    a = latest(left, key, {"required": required} | {f"f{i}": comparable(left, f) for i, f in enumerate(fields)}, left_order)
    b = latest(right, key, {f"f{i}": comparable(right, f) for i, f in enumerate(fields)}, right_order)
    buckets = max(1, -(-max(left.count(), right.count()) // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    schema = T.StructType([T.StructField("key", kinds[0])] + [T.StructField(n, T.StringType()) for n in ("diff", "left", "right")])
    target = pa.schema([pa.field("key", _arrow(kinds[0]))] + [pa.field(n, pa.string()) for n in ("diff", "left", "right")])

    def compare(mine: pa.Table, other: pa.Table) -> pa.Table:
        mine, keys = _sorted(mine)
        other, other_keys = _sorted(other)
        at, there = _align(keys, other_keys)
        parts = []

        def emit(key_column, diff, x=None, y=None):
            n = len(key_column)
            if n:
                none = pa.nulls(n, pa.string())
                cells = [none if v is None else pc.cast(v, pa.string()) for v in (x, y)]
                parts.append(pa.table([pc.cast(key_column, target.field("key").type), pa.array([diff] * n, pa.string()), *cells], schema=target))

        if len(keys):
            absent = ~there & mine["required"].to_numpy(zero_copy_only=False).astype(bool)
            emit(mine["key"].filter(pa.array(absent)), missing_right)
        if len(other_keys):
            _, known = _align(other_keys, keys)
            emit(other["key"].filter(pa.array(~known)), missing_left)
        if there.any():
            mine, other = mine.filter(pa.array(there)), other.take(pa.array(at[there]))
            for i, name in enumerate(fields):
                x, y = mine[f"f{i}"], other[f"f{i}"]
                cells = pa.array(_differs(x, y))
                emit(mine["key"].filter(cells), name, x.filter(cells), y.filter(cells))
        return pa.concat_tables(parts) if parts else target.empty_table()

    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // BUCKETS_A_TASK))  # so that tasks don't grow with the data
    mine, other = (side.withColumn("bucket", bucket).repartition(tasks, "bucket").groupBy("bucket") for side in (a, b))
    return mine.cogroup(other).applyInArrow(compare, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """The chunk table against the search index: absent rows and differing fields."""
    from quillstone.sources.tables import table

    chunks = table(spark, root, "chunks").select("id", "document_id", "chunk_index", "content", "created_at", F.coalesce("indexed", F.lit(False)).alias("indexed"))
    index = table(spark, root, "index_chunks").select("id", "document_id", "chunk_index", "content", "created_at", F.lit(True).alias("indexed"))
    found = differences(
        chunks, index, "id", ["document_id", "chunk_index", "content", "indexed"],
        left_order=F.col("created_at"), right_order=F.col("created_at").try_cast("timestamp"),
        left_required=F.col("indexed"), missing_left="missing_in_chunks", missing_right="missing_in_index",
    )
    return found.select(F.col("key").alias("id"), "diff")


P2_FOUND = """
WITH c AS (SELECT id, document_id, chunk_index, content, coalesce(indexed, false) AS indexed FROM chunks WHERE id IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1),
     x AS (SELECT id, document_id, chunk_index, content FROM index_chunks WHERE id IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY try_cast(created_at AS timestamptz) DESC NULLS LAST) = 1)
SELECT id, 'missing_in_index' AS diff FROM c ANTI JOIN x USING (id) WHERE indexed
UNION ALL SELECT id, 'missing_in_chunks' FROM x ANTI JOIN c USING (id)
UNION ALL SELECT c.id, 'indexed' FROM c JOIN x USING (id) WHERE NOT c.indexed
UNION ALL SELECT c.id, 'document_id' FROM c JOIN x USING (id) WHERE c.document_id IS DISTINCT FROM x.document_id
UNION ALL SELECT c.id, 'chunk_index' FROM c JOIN x USING (id) WHERE c.chunk_index IS DISTINCT FROM x.chunk_index
UNION ALL SELECT c.id, 'content' FROM c JOIN x USING (id) WHERE c.content IS DISTINCT FROM x.content
"""
