"""The document registry as tables: upserts, incremental plans, deletes, lookups, versions.

Writers return the new table; ``publish`` writes a version and switches the pointer, so
readers see the old or the new one whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.ranking import placed


def upsert_documents(stored: DataFrame, incoming: DataFrame, key: str = "id", kept: tuple[str, ...] = ("created_at",), order: Column | None = None) -> DataFrame:
    """Incoming rows replace stored ones of their key, except for the columns ``kept``.

    Of several incoming rows the one with the greatest ``order`` counts (else the greatest in
    all its columns, so the result doesn't depend on the order of rows). Stored rows have one
    row a key; null keys match nothing.
    """
    others = [c for c in stored.columns if c != key]
    rank = F.struct(*([order] if order is not None else []), *others)
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("_new"))
    rows = stored.join(last, key, "full_outer")
    new = lambda c: F.col(f"_new.{c}")
    value = lambda c: F.coalesce(F.col(c), new(c)) if c in kept else F.when(F.col("_new").isNotNull(), new(c)).otherwise(F.col(c))
    return rows.select(*(F.col(c) if c == key else value(c).alias(c) for c in stored.columns))


def upsert_chunks(stored: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Content, token count and indexed flag come from the incoming row, the place in the document stays."""
    updated = ("content", "token_count", "indexed")
    return upsert_documents(stored, incoming, key, tuple(c for c in stored.columns if c != key and c not in updated))


def plan_ingest(stored: DataFrame, incoming: DataFrame, source: str, digest: str) -> DataFrame:
    """``incoming`` with ``action``: unchanged (its hash is stored), changed (its source is, with another hash) or new."""
    hashes = stored.where(F.col(digest).isNotNull()).select(F.col(digest)).distinct().withColumn("_same", F.lit(True))
    sources = stored.where(F.col(source).isNotNull()).select(F.col(source)).distinct().withColumn("_known", F.lit(True))
    rows = incoming.join(hashes, digest, "left").join(sources, source, "left")
    return rows.withColumn("action", F.when(F.col("_same"), "unchanged").when(F.col("_known"), "changed").otherwise("new")).drop("_same", "_known")


def delete_documents(documents: DataFrame, chunks: DataFrame, gone: DataFrame, key: str = "id", foreign: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents ``gone`` and their chunks."""
    ids = gone.select(F.col(key)).distinct()
    return documents.join(ids, key, "left_anti"), chunks.join(ids.withColumnRenamed(key, foreign), foreign, "left_anti")


def matching(documents: DataFrame, **parts: str) -> DataFrame:
    """Documents whose columns hold the parts, as LIKE patterns; without a usable part the first 100 by id."""
    known = {"crawl_group": "source_url", "source_url": "source_url", "filename": "filename", "mime_type": "mime_type"}
    usable = {known[k]: v for k, v in parts.items() if k in known and v}
    if not usable:
        return documents.orderBy("id").limit(100)
    out = documents
    for column, v in usable.items():
        out = out.where(F.col(column).like(f"%{v}%"))
    return out


def lookup(documents: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Documents whose ``column`` (id, file_hash) is among the wanted ones; null is never found."""
    return documents.join(wanted.select(column).distinct(), column, "left_semi").select(*documents.columns)


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with their ``place`` (from 1) in their document: by chunk_index, then id."""
    return placed(chunks, "document_id", [F.asc_nulls_first("chunk_index"), F.asc("id")]).drop("total")


def cases_of(cases: DataFrame, category: str | None = None, difficulty: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """Evaluation cases of a category, difficulty or among ids."""
    for column, value in (("category", category), ("difficulty", difficulty)):
        if value is not None:
            cases = cases.where(F.col(column) == value)
    return cases if ids is None else cases.where(F.col("id").isin(ids))


def page(documents: DataFrame, offset: int, limit: int) -> DataFrame:
    """Newest first; equal times by id."""
    return documents.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def chunk_totals(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored and counted chunks of each document."""
    counted = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count_distinct("id").alias("n_chunks"), F.count_if("indexed").alias("n_indexed"), F.sum("token_count").alias("tokens"))
    return documents.join(counted, "id", "left").fillna(0, ["n_chunks", "n_indexed"])


def validate_file(name: Column, size: Column, kinds: dict[str, str], most: int = 100 << 20) -> Column:
    """The first failing check's message, or null."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return (
        F.when(name.isNull() | (name == ""), "File not found").when(size.isNull() | (size <= 0), "File is empty")
        .when(size > most, "File too large").when(~suffix.isin(list(kinds)), "Unsupported file type")
    )


def cache_lookup(wanted: DataFrame, cache: DataFrame, text: str, model: str, now: Column | None = None) -> DataFrame:
    """``wanted`` with cache_key and hit; the key covers model and text, expired entries are misses."""
    live = cache if now is None else cache.where(F.col("expires_at") > now)
    key = F.sha2(F.encode(F.concat(F.lit(model + ":"), F.col(text)), "UTF-8"), 256)
    return wanted.withColumn("cache_key", key).join(live.select("cache_key").distinct().withColumn("_hit", F.lit(True)), "cache_key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def dataset_errors(cases: DataFrame) -> DataFrame:
    """``(id, error)`` of evaluation cases: repeated ids, empty queries, nothing to compare with."""
    own = Window.partitionBy("id")
    error = (
        F.when(F.count("*").over(own) > 1, "duplicate id").when(F.coalesce(F.trim("query"), F.lit("")) == "", "empty query")
        .when(F.coalesce(F.trim("expected_answer"), F.lit("")) == "", "no expected answer").when(F.coalesce(F.size("expected_documents"), F.lit(0)) <= 0, "no expected documents")
    )
    return cases.select("id", error.alias("error")).where("error is not null")


def publish(table: DataFrame, root: str, name: str) -> str:
    """Write a version of a table and point its name to it; returns the version's folder."""
    version = f"{root}/{name}/v-{uuid.uuid4().hex}"
    table.write.parquet(version)
    table.sparkSession.createDataFrame([(json.dumps({"path": version}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{name}/_current")
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = json.loads(spark.read.text(f"{root}/{name}/_current").first()[0])["path"]
    return spark.read.parquet(path)
