"""Search for whole batches of queries: BM25, vectors, fusion, hybrid, reranking.

Ranked lists are rows ``(query_id, id, score, rank)``, rank from 1, by score descending
and then id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.plans.broadcasting import MAX_ROWS, broadcast_if_small
from quillstone.plans.staging import stage

K1, B = 1.5, 0.75
RRF_K = 60
#: Vectors in one block of a block-by-block product.
BLOCK = 2048
#: Numbers of a query matrix that is broadcast (64 MB), and of a block of scores in a task.
MAX_CELLS, CELLS = 8_000_000, 2_000_000


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """``scores`` with ``rank``, cut at ``k`` a query (Spark limits each group before the shuffle)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def query_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """``(query_id, term, qtf)``; a repeated term counts as often as it occurs."""
    return queries.select("query_id", F.explode(T.tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(id, term, tf)`` of documents with unique ``id``."""
    return docs.select("id", F.explode(T.tokens(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, text: str = "text", query: str = "query", k1: float = K1, b: float = B, keep: Column | None = None) -> DataFrame:
    """Scores of all documents for all queries, in two scans.

    The first counts the query terms' documents. In the second each task scores whole
    documents against the weights, if these are measured to be few, and keeps its best
    ``k`` a query, so only those are shuffled; else, or without ``k``, weights and tokens are
    joined. ``keep`` filters candidates but not the corpus statistics. Documents without
    tokens (null or empty) count in the statistics; queries without tokens have no results.
    """
    terms = query_terms(queries, query)
    sized = docs.withColumn("tokens", F.coalesce(T.tokens(F.col(text)), F.array().cast("array<string>")))
    marker = F.array(F.lit(""))  # no token is empty: counts documents and tokens
    wanted = terms.select("term").distinct().unionByName(terms.sparkSession.createDataFrame([("",)], "term string"))
    seen = sized.select(F.size("tokens").alias("dl"), F.explode(F.concat(F.array_distinct("tokens"), marker)).alias("term")).join(broadcast_if_small(wanted), "term", "left_semi")
    counted = seen.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("dl"))
    counted = stage(counted, "terms")
    whole = counted.where("term = ''").first()
    n_docs, avgdl = (whole.df, whole.dl / whole.df) if whole else (0, 0.0)
    weights = terms.join(broadcast_if_small(counted), "term").where("term != ''").select("query_id", "term", (F.col("qtf") * idf(F.lit(n_docs), F.col("df"))).alias("w"))
    flag = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    candidates = sized.where(flag).select("id", "tokens").where(F.size("tokens") > 0)
    few = weights.limit(MAX_ROWS + 1).toArrow() if k is not None else None
    if few is not None and len(few) <= MAX_ROWS:
        found = _scored(candidates, few, queries.schema["query_id"].dataType.simpleString(), k, lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / max(avgdl, 1e-10))))
        return ranked(found, k)
    tf, dl = F.col("tf"), F.col("dl")
    posted = candidates.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(broadcast_if_small(counted.select("term")), "term", "left_semi")
    posted = posted.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    part = F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / max(avgdl, 1e-10)))
    scores = posted.join(weights, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return ranked(scores, k)


def _scored(docs: DataFrame, weights: pa.Table, query_kind: str, k: int, share: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``(query_id, id, score)``: each task's best ``k`` documents ``(id, tokens)`` of each query."""
    asked = weights.column("query_id").combine_chunks().dictionary_encode()
    named = weights.column("term").combine_chunks().dictionary_encode()
    of, at = asked.indices.to_numpy(), named.indices.to_numpy()
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(len(named.dictionary) + 1))
    shared = docs.sparkSession.sparkContext.broadcast((asked.dictionary, {w: i for i, w in enumerate(named.dictionary.to_pylist())}, ends, of[order], weights.column("w").to_numpy()[order]))
    n = len(asked.dictionary)
    width = max(1, CELLS // max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, place, ends, of, w = shared.value
        best = Best(n, k)
        for batch in batches:
            for start in range(0, batch.num_rows if n else 0, width):
                part = batch.slice(start, width)
                lists = part.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                words = lists.flatten().dictionary_encode()
                number = np.array([place.get(x, -1) for x in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
                doc = np.repeat(np.arange(part.num_rows), sizes)[number >= 0]
                cell, tf = np.unique(doc * len(place) + number[number >= 0], return_counts=True)
                doc, term = cell // max(1, len(place)), cell % max(1, len(place))
                value = share(tf.astype(np.float64), sizes[doc].astype(np.float64))
                times = ends[term + 1] - ends[term]
                row = np.arange(times.sum()) + np.repeat(ends[term] - (np.cumsum(times) - times), times)
                score = np.bincount(of[row] * part.num_rows + np.repeat(doc, times), w[row] * np.repeat(value, times), n * part.num_rows)
                best.add(np.round(score, 6).reshape(n, part.num_rows), part.column(0), 0.0)
        yield from best.rows(names)

    return docs.mapInArrow(run, f"query_id {query_kind}, id {docs.schema['id'].dataType.simpleString()}, score double")


class Best:
    """The best ``k`` of each of ``n`` queries so far, by score and then id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, scores: np.ndarray, ids: pa.Array, above: float) -> None:
        """``scores`` (queries x rows) of the rows ``ids``; only those greater than ``above`` count."""
        if scores.shape[1] > self.k:  # ties with the k-th stay for the ids to decide
            least = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
            scores = np.where(scores >= least[:, None], scores, -np.inf)
        query, row = np.nonzero(scores > above)
        self.query, self.score = np.concatenate((self.query, query)), np.concatenate((self.score, scores[query, row]))
        new = ids.take(pa.array(row, pa.int64()))
        self.ids = new if self.ids is None else pa.concat_arrays([self.ids, new])
        if len(self.query) > 4 * self.n * self.k:
            self.cut()

    def cut(self) -> None:
        order = np.lexsort((self.ids.to_numpy(zero_copy_only=False), -self.score, self.query))
        query = self.query[order]
        kept = order[np.arange(len(order)) - np.searchsorted(query, query) < self.k]
        self.query, self.score, self.ids = self.query[kept], self.score[kept], self.ids.take(pa.array(kept, pa.int64()))

    def rows(self, names: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.ids is not None and len(self.ids):
            self.cut()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(self.query)), self.ids, pa.array(self.score)], ["query_id", "id", "score"])


def _blocks(vectors: DataFrame, count: int, name: str, *columns: str) -> DataFrame:
    """Vectors packed by hash into blocks of about BLOCK rows."""
    n = max(1, -(-count // BLOCK))
    return vectors.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list(F.struct("id", "v", *columns)).alias(name))


def vector_search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = None, normalise_query: bool = False, same: str | None = None,
) -> DataFrame:
    """Exact inner products of query vectors with normalised stored ones.

    ``vectors`` is ``(id, v)``, ``queries`` ``(query_id, v)``. Queries measured to be few are
    one broadcast matrix, multiplied in the scan; others are packed, and each pair of
    blocks is one product. Only the best ``k`` a query leave a task. Queries are taken as they
    are (unless ``normalise_query``), zero vectors score 0; null vectors and those of another
    length than the queries' are no candidates; the threshold is applied to the best ``k``, after
    the cut. With ``same`` only rows whose column of that name equals the query's are candidates,
    null being equal to none.
    """
    label = F.col(same).cast("string") if same else F.lit("")
    columns = F.col("v").cast("array<double>").alias("v"), label.alias("label")
    asked = queries.where("v is not null").select(F.col("query_id").cast("long").alias("id"), *columns).where("label is not null")
    one = asked.agg(F.max(F.size("v")).alias("size"), F.count("*").alias("n")).first()
    size, n_asked = one.size or 0, one.n
    asked = asked.where(F.size("v") == size)
    stored = vectors.where(F.size("v") == size).select(F.col("id").cast("long").alias("id"), *columns).where("label is not null")

    def product(q: np.ndarray, q_labels: list, c: np.ndarray, c_labels: list) -> np.ndarray:
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-10)
        if normalise_query:
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-10)
        s = np.round(q @ c.T, 6)
        return s if same is None else np.where(np.array(q_labels, object)[:, None] == np.array(c_labels, object), s, -np.inf)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, labels = shared.value
        best = Best(len(q), k)
        width = max(1, CELLS // max(1, len(q)))
        for batch in batches:
            for start in range(0, batch.num_rows if len(q) else 0, width):
                part = batch.slice(start, width)
                best.add(product(q, labels, _matrix(part.column(1), size), part.column(2).to_pylist()), part.column(0), -np.inf)
        yield from best.rows(pa.array(ids))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ours, theirs in zip(batch.column(0), batch.column(1)):
                c, q = ours.values, theirs.values
                best = Best(len(q), k)
                best.add(product(_matrix(q.field("v"), size), q.field("label").to_pylist(), _matrix(c.field("v"), size), c.field("label").to_pylist()), c.field("id"), -np.inf)
                yield from best.rows(q.field("id"))

    schema = "query_id long, id long, score double"
    if n_asked * size <= MAX_CELLS:
        rows = asked.toArrow()
        shared = vectors.sparkSession.sparkContext.broadcast((rows.column("id").to_numpy(), _matrix(rows.column("v").combine_chunks(), size), rows.column("label").to_pylist()))
        scores = stored.mapInArrow(scan, schema)
    else:
        packed, asked = _blocks(stored, stored.count(), "c", "label"), _blocks(asked, n_asked, "q", "label")
        spread = packed.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, -(-n_asked // BLOCK)) - 1).cast("long"))))
        scores = spread.repartition("c_block", "q_block").join(asked, "q_block").select("c", "q").mapInArrow(blocks, schema)
    top = ranked(scores, k)
    return top if threshold is None else top.where(F.col("score") >= threshold)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def rrf(lists: DataFrame, k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ``(query_id, retriever, id, rank)``: the sum of weight / (k + rank)."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("retriever") == name, F.lit(float(w))).otherwise(weight)
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum(weight / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"))
    return ranked(fused)


def score_fusion(lists: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Sum of weighted scores, each list of a query scaled to 0..1 (0 if all are equal)."""
    own = Window.partitionBy("query_id", "retriever")
    low, high = F.min("score").over(own), F.max("score").over(own)
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("retriever") == name, F.lit(float(w))).otherwise(weight)
    scaled = lists.withColumn("s", weight * (F.col("score") - low) / F.when(high == low, 1.0).otherwise(high - low))
    return ranked(scaled.groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score")))


def fuse(lists: DataFrame, strategy: str = "rrf", k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """Fusion where a query has several non-empty lists; its single list as it is, raw scores included."""
    if strategy not in ("rrf", "score"):
        raise ValueError(f"unknown fusion strategy: {strategy}")
    own = Window.partitionBy("query_id")
    marked = stage(lists.withColumn("single", F.min("retriever").over(own) == F.max("retriever").over(own)), "lists")
    several = marked.where("not single").drop("single")
    fused = rrf(several, k, weights) if strategy == "rrf" else score_fusion(several, weights)
    return ranked(marked.where("single").select("query_id", "id", "score")).unionByName(fused)


def union_lists(**lists: DataFrame) -> DataFrame:
    out = None
    for name, rows in lists.items():
        one = rows.select("query_id", F.lit(name).alias("retriever"), "id", "score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def search(mode: str, top_k: int = 10, keyword: DataFrame | None = None, vector: DataFrame | None = None, strategy: str = "rrf") -> DataFrame | None:
    """Results of a mode from ranked lists; null if the mode's list is missing, as without a backend."""
    if mode == "bm25":
        return keyword
    if mode == "vector":
        return vector
    if mode != "hybrid":
        raise ValueError(f"unknown mode: {mode}")
    there = {n: x for n, x in (("bm25", keyword), ("vector", vector)) if x is not None}
    return fuse(union_lists(**there), strategy).where(F.col("rank") <= top_k) if there else None


def merge_variants(results: DataFrame, k: int) -> DataFrame:
    """Of the results of a query's variants ``(query_id, variant, id, score)`` the best score of each id."""
    return ranked(results.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def jaccard(x: Column, y: Column) -> Column:
    """Share of common elements of two arrays' sets; 0 if both are empty."""
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(0.0)


def rerank(results: DataFrame, queries: DataFrame, docs: DataFrame, k: int, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Results scored anew by ``scorer(query, text)``, by default the overlap of their words; a query without text keeps its order."""
    scorer = scorer or (lambda q, t: F.round(jaccard(T.words(q), T.words(t)), 6))
    joined = results.join(queries.select("query_id", "query"), "query_id").join(docs.select("id", F.col("text").alias("_text")), "id")
    blank = F.col("query").isNull() | (F.col("query") == "")
    scored = joined.withColumn("score", F.when(blank, -F.col("rank").cast("double")).otherwise(F.coalesce(scorer(F.col("query"), F.col("_text")), F.lit(0.0))))
    return ranked(scored.select("query_id", "id", "score"), k)
