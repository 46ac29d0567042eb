"""Watching a folder: new files flow through discovery, parsing and the registry's dedup gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators import chunking
from quillstone.operators.ingest import cleaned
from quillstone.sources import files


def watch(spark: SparkSession, folder: str, registry: str, chunks: str, checkpoint: str, target: int = 512, most: int = 1024, overlap: int = 50) -> StreamingQuery:
    """Start a stream that ingests each new file once, whatever its name: documents and chunks of the cleaned texts are appended to two tables.

    A batch repeated after a failure finds its hashes registered and adds nothing twice.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)

    def ingest(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).withColumn("kind", files.detect_kind(F.col("name"))).where("kind is not null")
        rows = rows.withColumn("file_hash", F.sha2("content", 256)).withColumn("error", F.when(F.col("length") <= 0, "File is empty")).dropDuplicates(["file_hash"])
        try:
            rows = rows.join(spark.read.parquet(registry).select("file_hash"), "file_hash", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        parsed = files.parse(rows).persist()
        chunking.chunk(cleaned(parsed.where("error is null"), "text"), "file_hash", "text", target, most, overlap).write.mode("append").parquet(chunks)
        parsed.drop("text").withColumn("batch", F.lit(number)).write.mode("append").parquet(registry)
        parsed.unpersist()

    return source.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_metrics(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and time window; events later than ``late`` are left out. An extension: batch or streaming."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
