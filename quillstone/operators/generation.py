"""Contexts, prompts and citations for batches of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators.ranking import placed

#: Words kept free for the context's frame.
FRAME = 20
# The frame of a prompt.
SYSTEM = "You are a helpful assistant. Answer the question using only the provided context."
CITE = " Cite sources using [n] markers."


def distinct_content(rows: DataFrame, keep: str = "score") -> DataFrame:
    """The first of equal contents of a query, by score and then id."""
    order = Window.partitionBy("query_id", F.sha2(F.encode("text", "UTF-8"), 256)).orderBy(F.desc(keep), "id")
    return rows.withColumn("_copy", F.row_number().over(order)).where("_copy = 1").drop("_copy")


def within_budget(rows: DataFrame, budget: int, order: str = "score") -> DataFrame:
    """The longest run of rows in order whose words fit the budget, with ``place`` and ``size``."""
    by = Window.partitionBy("query_id").orderBy(F.desc(order), "id")
    sized = rows.withColumn("size", T.word_count(F.col("text")).cast("bigint")).withColumn("place", F.row_number().over(by))
    total = F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("_total", total).where(F.col("_total") <= budget).drop("_total")


def running_budget(rows: DataFrame, budget: int) -> DataFrame:
    """As ``within_budget`` for groups of any size: ``(query_id, id, size, place)`` of those that fit, from ``(query_id, id, score, size)``."""
    lined = placed(rows.select("query_id", "id", "score", "size"), "query_id", [F.desc("score"), F.asc("id")], F.col("size"))
    return lined.where(F.col("total") <= budget).select("query_id", "id", "size", "place")


def contexts(rows: DataFrame, budget: int, style: str = "xml", order: str = "score") -> DataFrame:
    """``(query_id, context, n_sources)`` from ``(query_id, id, score, text)``.

    Sources come by score; with ``order`` "position" by the column of that name. Copies are left out; sources are numbered in order; if the very first exceeds the
    budget it is cut to it. Styles: xml, markdown, plain.
    """
    available = budget - FRAME
    if order == "position":
        rows = rows.withColumn("score", -F.col("position").cast("double"))
    distinct = distinct_content(rows)
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    words = F.filter(F.split("text", T.WS + "+"), lambda w: w != "")
    cut = F.when((F.row_number().over(first) == 1) & (F.size(words) > available), F.array_join(F.slice(words, 1, max(available - 10, 0)), " ")).otherwise(F.col("text"))
    fit = within_budget(distinct.withColumn("text", cut), available)
    n = F.col("place").cast("string")
    line = {
        "xml": F.concat(F.lit('<source id="'), n, F.lit('">'), "text", F.lit("</source>")),
        "markdown": F.concat(F.lit("### Source "), n, F.lit("\n"), F.col("text")),
        "plain": F.concat(F.lit("["), n, F.lit("] "), F.col("text")),
    }[style]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda s: s["line"]), "\n\n")
    wrapped = F.concat(F.lit("<context>\n"), joined, F.lit("\n</context>")) if style == "xml" else joined
    return fit.groupBy("query_id").agg(wrapped.alias("context"), F.count("*").alias("n_sources"))


def prompt(question: Column, context: Column, cite: bool = True) -> Column:
    return F.concat(F.lit(SYSTEM + (CITE if cite else "") + "\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question)


def generate(prompts: DataFrame, model: Callable[[list[str]], list[str]], batch: int = 32) -> DataFrame:
    """``(query_id, answer)`` by a model called on batches in the tasks; a failing call gives a null answer."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            answers: list[str | None] = []
            for i in range(0, len(rows), batch):
                some = rows["prompt"].iloc[i : i + batch].tolist()
                try:
                    answers += model(some)
                except Exception:  # noqa: BLE001 - any backend may fail in its own way
                    answers += [None] * len(some)
            yield pd.DataFrame({"query_id": rows["query_id"], "answer": answers})

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, answer string")


def markers(answer: Column) -> Column:
    """Numbers of the [n] markers in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1))


def with_markers(answer: Column) -> Column:
    """An answer whose sentences cite sources 1, 2, 3, ... in turn."""
    return F.array_join(F.transform(T.sentences(answer), lambda s, i: F.concat(s, F.lit(" ["), (i + 1).cast("string"), F.lit("]"))), " ")


def citations(rows: DataFrame, key: str, answer: str, sources: str) -> DataFrame:
    """``(key, marker, source, snippet)``: each marker of an answer with the source it numbers.

    Numbers beyond the sources have a null source: the answer cites what it wasn't given.
    """
    made = rows.select(key, F.explode(markers(F.col(answer))).alias("marker"), F.col(sources).alias("s"))
    at = F.col("marker").try_cast("int")
    source = F.when(at >= 1, F.get("s", at - 1))
    return made.select(key, F.concat(F.lit("["), "marker", F.lit("]")).alias("marker"), source.alias("source"), F.substring(source, 1, 200).alias("snippet"))


def citation_report(rows: DataFrame, key: str, answer: str, sources: str) -> DataFrame:
    """``(key, inline, footnotes, block, warnings)`` of each answer: its known citations in three formats, and a warning for each occurrence of a marker that numbers no source."""
    a, s = F.col(answer), F.col(sources)
    at = lambda m: F.coalesce(m.try_cast("int"), F.lit(0))
    known = lambda m: (at(m) >= 1) & (at(m) <= F.coalesce(F.size(s), F.lit(0)))
    tag = lambda m: F.concat(F.lit("["), m, F.lit("]"))
    cited = F.filter(markers(a), known)
    source = lambda m: F.coalesce(F.get(s, at(m) - 1), F.lit(""))
    lines = F.transform(cited, lambda m: F.concat(tag(m), F.lit(" *"), source(m), F.lit("* — "), F.substring(source(m), 1, 200)))
    every = F.regexp_extract_all(a, F.lit(r"\[(\d+)\]"), 1)
    return rows.select(
        key,
        F.array_join(F.transform(cited, lambda m: F.concat(tag(m), F.lit(" "), source(m))), ", ").alias("inline"),
        F.array_join(F.transform(cited, lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), source(m))), "\n").alias("footnotes"),
        F.when(F.size(cited) > 0, F.concat(F.lit("**Sources:**\n\n"), F.array_join(lines, "\n"))).otherwise("").alias("block"),
        F.transform(F.filter(every, lambda m: ~known(m)), lambda m: F.concat(F.lit("citation "), tag(m), F.lit(" not found in context"))).alias("warnings"),
    )
