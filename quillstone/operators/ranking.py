"""Places in the order of a group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.plans.broadcasting import broadcast_if_small
from quillstone.plans.staging import stage


def placed(rows: DataFrame, key: str, order: list[Column], size: Column | None = None) -> DataFrame:
    """``rows`` with ``place`` (from 1) in the order of their ``key`` and ``total``, the running sum of ``size`` (1).

    Rows are cut into ranges of the whole order; each is numbered by itself and starts from
    the sums of the ranges before it, so no group is held or sorted in one task. Rows with
    equal keys and orders share a range.
    """
    sized = rows.withColumn("_size", F.lit(1) if size is None else size)
    staged = stage(sized.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged.groupBy(key, "_part").agg(F.sum("_size").alias("_words"), F.count("*").alias("_n"))
    start = sums.select(key, "_part", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_words"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    by = Window.partitionBy(key, "_part").orderBy(*order)
    total = F.col("_words") + F.sum("_size").over(by.rowsBetween(Window.unboundedPreceding, 0))
    joined = staged.join(broadcast_if_small(start), [key, "_part"])
    return joined.withColumn("total", total).withColumn("place", F.col("_n") + F.row_number().over(by)).drop("_size", "_part", "_words", "_n")


def nearest_rank(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``(key, n, mean, sd, ...)``: for each name in ``shares`` the value at place int(n * share) of the group's order, counted from 0; nulls don't count."""
    own = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value)
    sums = own.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    lined = placed(own, key, [F.asc(value)]).join(broadcast_if_small(sums), key)
    picks = [F.max(F.when(F.col("place") == F.floor(F.col("n") * s) + 1, F.col(value))).alias(name) for name, s in shares.items()]
    return lined.groupBy(key, "n", "mean", "sd").agg(*picks)
