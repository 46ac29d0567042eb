"""Stages written to the cluster's shared folder.

A stage cuts the lineage: what several later jobs read is computed once, and a
lost executor costs a read, not the whole chain before it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset: a temporary one in local mode, an error on a cluster, whose machines share none."""
    known = spark.conf.get(SETTING, None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set(SETTING, known)
    return known.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A stage and its number of rows, observed while it is written."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return staged, seen.get["n"]


def drop(*stages: DataFrame) -> None:
    """Delete stages that nothing will read again."""
    for df in stages:
        remove(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def _folder(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def make(spark: SparkSession, path: str) -> None:
    """An empty folder, if there is none."""
    system, path = _folder(spark, path)
    system.mkdirs(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared folder."""
    for root in paths:
        system, path = _folder(spark, root)
        system.delete(path, True)
