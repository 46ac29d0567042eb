"""The most similar vectors of every vector, by shifted space-filling curves.

Each curve is a Hilbert ordering of a randomly rotated, projected and shifted copy
of the vectors, range-partitioned and sorted by Spark. Similar vectors lie close to
each other on at least some of the curves, so each row is compared with the rows in
a window after it on every curve; the best of all curves are merged per row.

Distant nearest neighbours are hardly ever close on a curve. For those each vector goes
to several cells around centroids instead, is compared with all vectors of its cells,
and the best of all cells are merged per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.plans.grouping import groups
from quillstone.plans.staging import drop, stage

DIMENSIONS = 48
#: Slack of the coarse (8-bit) cosine against the exact one.
SLACK = 0.01
#: Curves, dimensions and bits of a curve's grid, rows compared after each row on a curve.
CURVES, AXES, BITS, WINDOW = 8, 10, 6, 16
SEED = 20_240_108
#: Cells each vector goes to, vectors a cell to fit centroids on, rounds of fitting, rows compared with a cell at a time.
COPIES, FIT, ROUNDS, ROWS = 6, 20, 6, 512


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Right length, all finite and not null, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer grid cells (rows x axes), as uint64.

    The axes are turned into the transposed index by undoing excess work from the top
    bit down (the published transform for any number of axes), then bits interleave.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= turn
    place = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << one | (x[i] >> np.uint64(b)) & one
    return place


def curve(unit: np.ndarray, number: int, axes: int = AXES, bits: int = BITS) -> np.ndarray:
    """Places of unit vectors on curve ``number``: project, squash to [0, 1), shift, walk."""
    rng = np.random.default_rng(SEED + number)
    basis = np.linalg.qr(rng.standard_normal((unit.shape[1], axes)))[0]
    spread = unit @ basis * np.sqrt(unit.shape[1])  # about standard normal in each axis
    level = 1 / (1 + np.exp(-1.702 * spread))
    shift = rng.random(axes)
    cells = ((level + shift) / 2 * (1 << bits)).astype(np.int64).clip(0, (1 << bits) - 1)
    return hilbert(cells, bits)


def coarse(unit: np.ndarray) -> np.ndarray:
    """Unit vectors as 8-bit integers, scaled by their largest entry."""
    top = np.abs(unit).max(axis=1, keepdims=True)
    return np.rint(unit / top * 127).astype(np.int8)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _bytes(rows: np.ndarray) -> pa.Array:
    kind = pa.binary(rows.shape[1])
    return pa.FixedSizeBinaryArray.from_buffers(kind, len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def places(vectors: DataFrame, curves: int) -> DataFrame:
    """``(curve, place, uid, code)``: each vector on each curve, with its coarse form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column(1), DIMENSIONS)
            code = _bytes(coarse(unit))
            for c in range(curves):
                place = curve(unit, c).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), c, np.int32)), pa.array(place), batch.column(0), code], ["curve", "place", "uid", "code"])

    return vectors.select("uid", "unit").mapInArrow(run, "curve int, place long, uid long, code binary")


def _window(uid: np.ndarray, number: np.ndarray, code: np.ndarray, window: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the best ``k`` among the rows up to ``window`` away on its curve, if coarsely at least ``least``."""
    n = len(uid)
    x = code.astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.full((n, 2 * window), -2, np.float32)
    for o in range(1, min(window, n - 1) + 1):
        s = np.einsum("ij,ij->i", x[:-o], x[o:])
        s[number[:-o] != number[o:]] = -2
        near[:-o, o - 1] = s
        near[o:, window + o - 1] = s
    some = np.flatnonzero(near.max(axis=1) >= least)
    near = near[some]
    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
    row, col = np.nonzero(np.take_along_axis(near, best, 1) >= least)
    offset = best[row, col]
    other = some[row] + np.where(offset < window, offset + 1, window - 1 - offset)
    return uid[some[row]], uid[other]


def candidates(placed: DataFrame, k: int, least: float, window: int) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, met in a window of some curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(-1, DIMENSIONS)
            now = [batch.column(1).to_numpy(), batch.column(0).to_numpy(), code]
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now)]
            a, b = _window(*now, window, k, least)
            held = [p[-window:] for p in now]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    lined = placed.repartitionByRange("curve", "place", "uid").sortWithinPartitions("curve", "place", "uid")
    return lined.select("curve", "uid", "code").mapInArrow(run, "a long, b long").distinct()


def fine(unit: np.ndarray) -> np.ndarray:
    """Unit vectors as 16-bit integers, scaled by their largest entry."""
    top = np.abs(unit).max(axis=1, keepdims=True)
    return np.rint(unit / top * 32767).astype(np.int16)


def centroids(base: DataFrame) -> np.ndarray:
    """Spherical k-means, about the square root of the number of vectors as cells, on the vectors of the smallest key hashes."""
    cells = int(np.ceil(np.sqrt(base.count())))
    taken = base.orderBy(F.xxhash64("key"), "key").limit(cells * FIT).select("unit").toArrow().column("unit").combine_chunks()
    x = _matrix(taken, DIMENSIONS).astype(np.float32)
    at = x[:cells].copy()
    for _ in range(ROUNDS if len(x) else 0):
        own = (x @ at.T).argmax(axis=1)
        total = np.zeros_like(at)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        at = np.where(size > 0, total / np.where(size > 0, size, 1), at)
    return at


def _best(x: np.ndarray, rows: slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the ``k`` most similar rows of ``x`` to each of ``rows``, itself left out."""
    own = np.arange(rows.start, min(rows.stop, len(x)))
    s = x[own] @ x.T
    s[np.arange(len(own)), own] = -2
    k = min(k, len(x) - 1)
    parts = 16
    if len(x) >= 4 * parts * k:  # the k best lie in the k parts with the greatest maxima
        width = -(-len(x) // parts)
        s = np.pad(s, ((0, 0), (0, parts * width - len(x))), constant_values=-2)
        top = np.argpartition(-s.reshape(len(own), parts, width).max(axis=1), k - 1, axis=1)[:, :k]
        place = (top[:, :, None] + width * np.arange(parts)).reshape(len(own), -1)
    else:
        place = np.broadcast_to(np.arange(len(x)), s.shape)
    near = np.take_along_axis(s, place, 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(place, best, 1), np.take_along_axis(near, best, 1)


def cell_pairs(base: DataFrame, k: int, copies: int) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, of which one is among the ``k`` most similar of the other in the cells they share."""
    shared = base.sparkSession.sparkContext.broadcast(centroids(base))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        n = min(copies, len(at))
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column(1), DIMENSIONS)
            code = _bytes(fine(unit).view(np.uint8).reshape(len(unit), -1))
            cell = np.argpartition(-(unit @ at.T), n - 1, axis=1)[:, :n].astype(np.int32)
            for c in cell.T:
                yield pa.RecordBatch.from_arrays([pa.array(c), batch.column(0), code], ["cell", "uid", "code"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            number, uids = table.column(0).to_numpy(), table.column(1).to_numpy()
            code = np.frombuffer(b"".join(table.column(2).to_pylist()), np.int16).reshape(-1, DIMENSIONS)
            ends = [*np.flatnonzero(np.diff(number)) + 1, len(number)]
            for start, end in zip([0, *ends], ends):
                uid, x = uids[start:end], code[start:end].astype(np.float32)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for i in range(0, len(uid) if len(uid) > 1 else 0, ROWS):
                    place, near = _best(x, slice(i, i + ROWS), k)
                    ends_of = pa.array(np.arange(len(place) + 1, dtype=np.int32) * place.shape[1])
                    lists = (pa.ListArray.from_arrays(ends_of, pa.array(v.ravel())) for v in (uid[place], near))
                    yield pa.RecordBatch.from_arrays([pa.array(uid[i : i + ROWS]), *lists], ["a", "b", "near"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            b, near = (table.column(c).combine_chunks() for c in (1, 2))
            a = np.repeat(table.column(0).to_numpy(), np.diff(b.offsets.to_numpy()))
            b, near = b.flatten().to_numpy(), near.flatten().to_numpy()
            order = np.lexsort((-near, b, a))
            order = order[np.concatenate(([True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))]
            order = order[np.lexsort((b[order], -near[order], a[order]))]
            first = np.concatenate(([0], np.flatnonzero(np.diff(a[order])) + 1))
            rank = np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)]))
            order = order[rank < k]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[order], b[order])), pa.array(np.maximum(a[order], b[order]))], ["a", "b"])

    placed = base.select("uid", "unit").mapInArrow(assign, "cell int, uid long, code binary")
    met = placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b array<bigint>, near array<float>")
    met = stage(met, "met")
    pairs = stage(met.repartition("a").sortWithinPartitions("a").mapInArrow(merge, "a long, b long").distinct(), "pairs")
    drop(met)
    return pairs


@F.pandas_udf(T.DoubleType())
def _cosine(x, y):
    import pandas as pd

    return pd.Series(np.einsum("ij,ij->i", np.stack(x).astype(np.float64), np.stack(y).astype(np.float64)) if len(x) else [], dtype="float64")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _unit(x):
    import pandas as pd

    if not len(x):
        return pd.Series([], dtype=object)
    m = np.stack(x).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # very large and very small entries keep their squares finite
    return pd.Series(list((m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)))


def neighbours(
    vectors: DataFrame, key: str = "id", vector: str = "embedding", k: int = 5, least: float = 0.0,
    curves: int = CURVES, window: int = WINDOW, order: Column | None = None, copies: int = 0,
) -> DataFrame:
    """Rows ``(key, rank, neighbour, cosine)``: up to ``k`` others of at least cosine ``least``.

    Of several rows of a key the one with the greatest ``order`` stands for it. Null keys and
    unusable vectors (null, of a wrong length, holding null, NaN or infinity, all zero) are
    neither queries nor neighbours; the norm does not matter. Equal cosines are ranked by key.
    Equal vectors under different keys are ordinary neighbours. The result is approximate: a
    pair is found if it meets in a window of at least one curve, surely for equal vectors
    unless more than ``window`` rows share a place; every cosine given is exact. With
    ``copies`` cells are searched instead of curves, each vector in so many: a pair is found
    if it shares one, which distant nearest neighbours do too.
    """
    column = F.col(f"`{vector}`").cast("array<float>")
    one = (
        vectors.where(F.col(f"`{key}`").isNotNull())
        .groupBy(F.col(f"`{key}`").alias("key"))
        .agg(F.max_by(F.struct(column.alias("v")), F.struct(*([order] if order is not None else []), F.xxhash64(column))).alias("r"))
        .select("key", F.col("r.v").alias("v"))
        .where(usable(F.col("v")))
    )
    base = stage(one.select(F.monotonically_increasing_id().alias("uid"), "key", _unit("v").alias("unit")), "vectors")
    pairs = cell_pairs(base, k, copies) if copies else candidates(places(base, curves), k + 3, least - SLACK, window)
    unit = base.select("uid", "unit")
    met = (
        pairs.join(unit.select(F.col("uid").alias("a"), F.col("unit").alias("x")), "a")
        .join(unit.select(F.col("uid").alias("b"), F.col("unit").alias("y")), "b")
        .select("a", "b", _cosine("x", "y").alias("cosine"))
        .where(F.col("cosine") >= least)
    )
    if copies:  # the vectors' shuffle files go before the ranking writes its own
        met = stage(met, "cosines")
        drop(pairs)
    both = met.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "cosine").select("p.*", "cosine")
    names = base.select("uid", "key")
    named = both.join(names.select(F.col("uid").alias("b"), F.col("key").alias("neighbour")), "b").groupBy("a").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbour"))), 1, k).alias("best")
    )
    return (
        named.join(names.select(F.col("uid").alias("a"), "key"), "a")
        .select("key", F.posexplode("best").alias("rank", "n"))
        .select(F.col("key").alias(key), (F.col("rank") + 1).alias("rank"), F.col("n.neighbour").alias("neighbour"), (-F.col("n.far")).alias("cosine"))
    )


def p6_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The nearest neighbours of each usable chunk embedding, however distant."""
    index = spark.read.parquet(f"{root}/index_chunks.parquet").select("id", "embedding", "created_at")
    return neighbours(index, k=5, least=-2, order=F.col("created_at").try_cast("timestamp"), copies=COPIES)  # below any cosine


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    index = spark.read.parquet(f"{root}/index_chunks.parquet").select("id", "embedding", "created_at")
    near = neighbours(index, k=5, least=0.95, order=F.col("created_at").try_cast("timestamp"))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
