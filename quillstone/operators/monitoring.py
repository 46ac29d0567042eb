"""Metrics, request limits and breakers over event tables; metadata filters and masks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATES = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def rollup(events: DataFrame, name: str, value: str) -> DataFrame:
    """Count, sum, extremes and mean of each metric."""
    v = F.col(value)
    return events.groupBy(name).agg(F.count(v).alias("n"), F.round(F.sum(v), 4).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"))


def gauges(events: DataFrame, name: str, value: str, ts: str, tie: str) -> DataFrame:
    """The last value of each metric."""
    return events.groupBy(name).agg(F.max_by(value, F.struct(ts, tie)).alias("last"))


def windowed_counts(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Events with the number of the key's events in the window up to each, and whether it exceeds the limit."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    window = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(window)).withColumn("over", F.col("in_window") > limit)


def rate_limit(events: DataFrame, key: str, ts: str, event: str, seconds: int = 60, limit: int = 60) -> DataFrame:
    """``(event, key, allowed)``: a sliding window in which rejected events don't count.

    The fold needs each key's events in order: they are sorted by Spark and streamed, and
    only the last ``limit`` accepted times are held, whatever a key's number of events.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        for rows in parts:
            out = []
            for k, t in zip(rows["key"], rows["at"]):
                if k != last:
                    held, last = [], k
                held = [h for h in held if h > t - seconds * 1_000_000]
                ok = len(held) < limit
                if ok:
                    held.append(t)
                out.append(ok)
            yield pd.DataFrame({"event": rows["event"], "key": rows["key"], "allowed": out})

    rows = events.where(F.col(key).isNotNull()).select(F.col(event).alias("event"), F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    lined = rows.repartition("key").sortWithinPartitions("key", "at", "event")
    return lined.mapInPandas(run, f"event {kinds['event']}, key {kinds['key']}, allowed boolean").withColumnsRenamed({"event": event, "key": key})


def breaker(events: DataFrame, key: str, ts: str, event: str, failed: Column, failures: int = 5, recovery: int = 30, successes: int = 2) -> DataFrame:
    """``(event, key, state)`` of a circuit breaker fed with each key's events in order.

    Closed opens after ``failures`` failures; open lets one through after ``recovery``
    seconds, half open; that closes after ``successes`` successes and opens on a failure.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, bad, good, opened = None, "closed", 0, 0, 0
        for rows in parts:
            out = []
            for k, t, f in zip(rows["key"], rows["at"], rows["failed"]):
                if k != last:
                    last, state, bad, good, opened = k, "closed", 0, 0, 0
                if state == "open" and t - opened >= recovery * 1_000_000:
                    state, good = "half_open", 0
                if state != "open":
                    if f:
                        bad += 1
                        if bad >= failures or state == "half_open":
                            state, opened = "open", t
                    else:
                        good += 1
                        if state == "closed":
                            bad = 0
                        elif good >= successes:
                            state, bad = "closed", 0
                out.append(state)
            yield pd.DataFrame({"event": rows["event"], "key": rows["key"], "state": out})

    rows = events.where(F.col(key).isNotNull()).select(F.col(event).alias("event"), F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.coalesce(failed, F.lit(False)).alias("failed"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    lined = rows.repartition("key").sortWithinPartitions("key", "at", "event")
    return lined.mapInPandas(run, f"event {kinds['event']}, key {kinds['key']}, state string").withColumnsRenamed({"event": event, "key": key})


def metadata_date(metadata: Column) -> Column:
    """The first non-empty of date, created_at and timestamp, in one of three forms, UTC; null if it can't be read."""
    text = F.coalesce(*(F.nullif(metadata[k], F.lit("")) for k in ("date", "created_at", "timestamp")))
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATES))


def metadata_filter(rows: DataFrame, metadata: str, since: str | None = None, until: str | None = None, types: list[str] | None = None, custom: dict[str, str] | None = None) -> DataFrame:
    """Rows whose metadata fit: dates within both ends, type (or document_type) among ``types``, equal custom values; what is missing doesn't fit."""
    m = F.col(metadata)
    keep = F.lit(True)
    if since or until:
        date = metadata_date(m)
        keep = keep & date.isNotNull()
        if since:
            keep = keep & (date >= F.lit(since).cast("timestamp"))
        if until:
            keep = keep & (date <= F.lit(until).cast("timestamp"))
    if types:
        keep = keep & F.coalesce(F.nullif(m["type"], F.lit("")), m["document_type"]).isin(types)
    for k, v in (custom or {}).items():
        keep = keep & (m[k] == v)
    return rows.where(F.coalesce(keep, F.lit(False)))


def mask(metadata: Column, secrets: tuple[str, ...] = ("password", "secret", "token", "api_key", "authorization")) -> Column:
    """Values under keys that name a secret become ***."""
    hit = lambda k: F.rlike(F.lower(k), F.lit("|".join(secrets)))
    return F.transform_values(metadata, lambda k, v: F.when(hit(k), F.lit("***")).otherwise(v))


def mask_json(column: Column, secrets: tuple[str, ...] = ("password", "secret", "token", "api_key", "authorization")) -> Column:
    """JSON text in which string values under keys that name a secret are ***, at any depth; other values stay."""
    return F.regexp_replace(column, rf'(?i)("[^"]*(?:{"|".join(secrets)})[^"]*"\s*:\s*)"(?:[^"\\]|\\.)*"', '$1"***"')


def metric_key(name: Column, labels: Column) -> Column:
    """``name{a=1,b=2}`` with sorted labels."""
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(labels) > 0, F.concat(name, F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(name)


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0, exponential: bool = True, jitter: Column | None = None) -> Column:
    """Seconds to wait before the next attempt; ``jitter`` (0 to 1) halves it at 0."""
    wait = F.least(F.lit(base) * (F.pow(F.lit(2.0), attempt) if exponential else attempt + 1), F.lit(most))
    return wait if jitter is None else wait * (F.lit(0.5) + jitter / 2)
