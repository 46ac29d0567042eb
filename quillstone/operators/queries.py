"""Query processing in one pass: clean, check, classify, rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.synonyms import SYNONYMS

#: Rewrites by name; each gives an array of queries, in this order.
REWRITES = {
    "expansion": lambda q, n: F.array(T.expand_synonyms(q, SYNONYMS)),
    "hyde": lambda q, n: F.array(T.hypothetical(q)),
    "multi_query": lambda q, n: T.multi_query(q, n),
    "step_back": lambda q, n: F.array(T.step_back(q)),
    "terms": lambda q, n: F.array(T.expand_terms(q)),
}


def distinct_queries(original: Column, rewritten: Column) -> Column:
    """The query and its rewrites without surrounding blanks, empty ones and repetitions, in order."""
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(original), rewritten), T.strip), lambda q: q.isNotNull() & (q != "")))


def process(queries: DataFrame, query: str = "query", strategies: tuple[str, ...] = ("multi_query", "step_back"), n: int = 4, least: int = 1, most: int = 500) -> DataFrame:
    """``queries`` with clean, error, query_type, variants and strategies_used.

    Rewrites are made of the clean query, each by itself. An invalid query (null, empty, too
    short or long) has its error, and neither variants nor strategies; a rewrite that gives
    nothing new isn't counted as used.
    """
    unknown = set(strategies) - REWRITES.keys()
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    rows = queries.withColumn("clean", T.preprocess_query(F.col(query)))
    rows = rows.withColumn("error", T.query_error(F.col("clean"), least, most)).withColumn("query_type", T.query_type(F.col("clean")))
    clean, valid = F.col("clean"), F.col("error").isNull()
    none = F.array().cast("array<string>")
    made = {name: F.filter(REWRITES[name](clean, n), lambda q: q.isNotNull() & (q != clean)) for name in REWRITES if name in strategies}
    used = F.filter(F.array(*(F.when(F.size(v) > 0, F.lit(name)) for name, v in made.items())), lambda s: s.isNotNull()) if made else none
    every = F.concat(none, *made.values())
    return rows.withColumn("variants", F.when(valid, distinct_queries(clean, every)).otherwise(none)).withColumn("strategies_used", F.when(valid, used).otherwise(none))
