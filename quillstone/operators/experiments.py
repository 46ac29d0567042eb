"""Experiments as rows ``(run_id, name, status, tags, metrics, created_at)``: the latest state of each run, lists, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNNING, COMPLETED, FAILED = "running", "completed", "failed"


def latest(states: DataFrame, at: str = "updated_at") -> DataFrame:
    """Of an append-only table the last state of each run; equal times by all columns."""
    others = [c for c in states.columns if c not in ("run_id", at) and not states.schema[c].dataType.simpleString().startswith("map")]
    return states.where("run_id is not null").groupBy("run_id").agg(F.max_by(F.struct(*(c for c in states.columns if c != "run_id")), F.struct(at, *others)).alias("r")).select("run_id", "r.*")


def listed(runs: DataFrame, status: str | None = None, tag: str | None = None, name: str | None = None) -> DataFrame:
    """Runs of a status, with a tag, of a name."""
    if status is not None:
        runs = runs.where(F.col("status") == status)
    if tag is not None:
        runs = runs.where(F.array_contains("tags", tag))
    return runs if name is None else runs.where(F.col("name") == name)


def baselines(runs: DataFrame) -> DataFrame:
    """The newest completed run of each name; equal times by run_id."""
    done = runs.where(F.col("status") == COMPLETED)
    return done.groupBy("name").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"), F.max("created_at").alias("created_at"))


def finished(run: DataFrame, ended: Column, error: Column) -> DataFrame:
    """Running runs with their final status and duration; others stay."""
    over = (F.col("status") == RUNNING) & ended.isNotNull()
    status = F.when(over, F.when(error.isNotNull(), FAILED).otherwise(COMPLETED)).otherwise(F.col("status"))
    took = F.when(over, (F.unix_micros(ended) - F.unix_micros("created_at")) / 1000)
    return run.withColumn("duration_ms", took).withColumn("status", status)


def flattened(runs: DataFrame, metrics: str = "metrics") -> DataFrame:
    """``(run_id, metric, value)`` of ``{category: {key: value}}``: category.key, without null values."""
    rows = runs.select("run_id", F.explode(metrics).alias("category", "m")).select("run_id", "category", F.explode("m").alias("key", "value"))
    return rows.where("value is not null").select("run_id", F.concat_ws(".", "category", "key").alias("metric"), F.col("value").cast("double").alias("value"))


def report(rows: DataFrame, scores: list[str], times: list[str], ok: Column) -> DataFrame:
    """One row: how many succeeded and failed, means of scores to four places and of times to one (half to even)."""
    mean = lambda c, n: F.bround(F.avg(c), n).alias(c)
    return rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("succeeded"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"), *(mean(c, 4) for c in scores), *(mean(c, 1) for c in times))
