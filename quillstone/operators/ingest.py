"""Incremental ingest: what is new is cleaned and cut, what it replaces goes, the rest stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import chunking, registry


def cleaned(docs: DataFrame, text: str = "content") -> DataFrame:
    """All cleaning steps in order."""
    c = chunking.normalize_unicode(chunking.unescape(F.col(text)))
    return docs.withColumn(text, T.collapse_blank_lines(T.normalize_whitespace(T.strip_controls(c))))


def chunked(docs: DataFrame, cutter: Callable[[DataFrame], DataFrame] | None = None, clean: bool = True) -> DataFrame:
    """Chunks ``(id, document_id, chunk_index, content, token_count, indexed)`` of documents ``(id, content)``."""
    own = cleaned(docs.select("id", "content")) if clean else docs.select("id", "content")
    made = cutter(own) if cutter else chunking.chunk(own, "id", "content")
    return made.select(F.col("chunk_id").alias("id"), F.col("id").alias("document_id"), "chunk_index", "content", T.word_count(F.col("content")).alias("token_count"), F.lit(False).alias("indexed"))


def ingest(
    documents: DataFrame, chunks: DataFrame, incoming: DataFrame, source: str = "filename", digest: str = "file_hash", order: str = "rec_id",
    cutter: Callable[[DataFrame], DataFrame] | None = None, clean: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(documents, chunks, plan)`` after a batch.

    Incoming documents whose hash is stored are skipped. Of several with one hash, or one
    source, the last by ``order`` is taken. Stored documents of the same source and another hash
    are stale: they go with their chunks. Null sources and hashes match nothing.
    """
    plan = registry.plan_ingest(documents, incoming, source, digest)
    fresh = plan.where("action != 'unchanged'").drop("action")
    for by in (digest, source):
        alone, several = fresh.where(F.col(by).isNull()), fresh.where(F.col(by).isNotNull())
        last = several.groupBy(by).agg(F.max(order).alias(order))
        fresh = alone.unionByName(several.join(last, [by, order], "left_semi"))
    stale = documents.join(fresh.select(source).distinct(), source, "left_semi")
    kept, left = registry.delete_documents(documents, chunks, stale)
    new = chunked(fresh, cutter, clean)
    return kept.unionByName(fresh.select(*documents.columns)), left.unionByName(new.select(*left.columns)), plan


def mark_indexed(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """``chunks`` with those of ``ids (id)`` marked."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return chunks.join(hit, "id", "left").withColumn("indexed", F.coalesce("_hit", "indexed")).select(*chunks.columns)


def count_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``documents`` with the number of their chunks."""
    n = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count_distinct("id").alias("_n"))
    return documents.join(n, "id", "left").withColumn("chunk_count", F.coalesce("_n", F.lit(0)).cast("int")).select(*documents.columns)


def reindex(documents: DataFrame, root: str, name: str, cutter: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Cut all documents anew, write the chunks as a new version and point the name to it; readers see one or the other."""
    return registry.publish(chunked(documents.where("content is not null"), cutter), root, name)
