"""Retrieval metrics, text-generation metrics, and comparison of metric tables.

Relevance comes as rows ``(query_id, id)``, results as ``(query_id, id, rank)``; no list
of all relevant ids is ever built, so a query may have any number of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillstone.functions import text as T

KS = (1, 3, 5, 10)
COLUMNS = [f"{m}_{k}" for m in ("precision", "recall", "ndcg") for k in KS] + ["mrr", "hit_rate", "map"]
QUESTION_WORDS = "what who where when why how which".split()


def per_query(asked: DataFrame, found: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row of COLUMNS for each row of ``asked``.

    precision@k divides by the number of results in the cut, recall by the relevant ones;
    both, and every other metric, are 0 where nothing was retrieved or is relevant.
    """
    rel = relevant.select("query_id", "id").distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = found.select("query_id", "id", "rank").join(rel.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").fillna(0, ["hit"])
    so_far = F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank"))
    hits = hits.withColumn("before", so_far)
    in_k = lambda k, c: F.sum(F.when(F.col("rank") <= k, c).otherwise(F.lit(0)))
    gain = F.col("hit") / F.log2(F.col("rank") + 1.0)
    rows = hits.groupBy("query_id").agg(
        F.count("*").alias("size"), *(in_k(k, F.col("hit")).alias(f"hits_{k}") for k in KS), *(in_k(k, gain).alias(f"dcg_{k}") for k in KS),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.col("hit") * F.col("before") / F.col("rank")).alias("ap"),
    )
    joined = asked.join(rows, "query_id", "left").join(n, "query_id", "left").fillna(0, ["n", "size"])
    known = (F.col("n") > 0) & (F.col("size") > 0)
    ideal = lambda k: F.element_at(F.array(*(F.lit(sum(1 / math.log2(i + 2) for i in range(j + 1))) for j in range(k))), F.least(F.col("n"), F.lit(k)).cast("int"))
    value = lambda v: F.round(F.when(known, v).otherwise(F.lit(0.0)), 6)
    out = {f"precision_{k}": value(F.col(f"hits_{k}") / F.least(F.col("size"), F.lit(k))) for k in KS}
    out |= {f"recall_{k}": value(F.col(f"hits_{k}") / F.col("n")) for k in KS}
    out |= {f"ndcg_{k}": value(F.col(f"dcg_{k}") / ideal(k)) for k in KS}
    out |= {"mrr": value(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), "hit_rate": value(F.col("first").isNotNull().cast("double")), "map": value(F.col("ap") / F.col("n"))}
    return joined.select(*asked.columns, *(v.alias(k) for k, v in out.items()))


def means(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in COLUMNS))


def percentiles(rows: DataFrame, columns: tuple[str, ...] = ("mrr", "map", "ndcg_10", "recall_10")) -> DataFrame:
    """Median and 95th percentile, interpolated between neighbours."""
    return rows.agg(*(F.round(F.percentile(c, F.lit(q)), 6).alias(f"{c}_p{int(q * 100)}") for c in columns for q in (0.5, 0.95)))


def question_group(query: Column) -> Column:
    first = F.lower(F.regexp_extract(query, r"^\s*(\S+)\s+\S", 1))
    return F.when(F.coalesce(T.strip(query), F.lit("")) == "", "unknown").when(first.isin(QUESTION_WORDS), F.concat(F.lit("q_"), first)).otherwise("other")


def cli_metrics(asked: DataFrame, found: DataFrame, relevant: DataFrame, top_k: int) -> DataFrame:
    """The report's variant: precision divides by ``top_k``, four decimals."""
    rows = per_query_hits(found, relevant, top_k)
    joined = asked.select("query_id").join(rows, "query_id", "left").fillna(0, ["hits", "n"])
    share = lambda v: F.coalesce(F.bround(v, 4), F.lit(0.0))
    return joined.select(
        "query_id", share(F.when(F.col("n") > 0, F.col("hits") / top_k)).alias("precision"), share(F.when(F.col("n") > 0, F.col("hits") / F.col("n"))).alias("recall"),
        (F.col("hits") > 0).alias("hit"), share(F.lit(1.0) / F.col("first")).alias("mrr"),
    )


def per_query_hits(found: DataFrame, relevant: DataFrame, top_k: int) -> DataFrame:
    rel = relevant.select("query_id", "id").distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = found.join(rel, ["query_id", "id"]).groupBy("query_id").agg(F.count_if(F.col("rank") <= top_k).alias("hits"), F.min("rank").alias("first"))
    return n.join(hits, "query_id", "left")


# Generated text


def overlaps(pairs: DataFrame, most: int = 4) -> DataFrame:
    """``(query_id, la, lr, b1 .. bn)`` of ``(query_id, answer, reference)``: words of both, and n-grams in common as often as in both."""
    worded = pairs.select("query_id", T.words(F.col("answer")).alias("a"), T.words(F.col("reference")).alias("r"))

    def grams(side: str, name: str) -> DataFrame:
        some = F.array(*(F.struct(F.lit(n).alias("n"), T.ngrams(F.col(side), n).alias("g")) for n in range(1, most + 1)))
        rows = worded.select("query_id", F.explode(some).alias("s")).select("query_id", "s.n", F.explode("s.g").alias("g"))
        return rows.groupBy("query_id", "n", "g").agg(F.count("*").alias(name))

    both = grams("a", "x").join(grams("r", "y"), ["query_id", "n", "g"]).groupBy("query_id").agg(
        *(F.sum(F.when(F.col("n") == n, F.least("x", "y")).otherwise(F.lit(0))).alias(f"b{n}") for n in range(1, most + 1))
    )
    sizes = worded.select("query_id", F.size("a").alias("la"), F.size("r").alias("lr"))
    return sizes.join(both, "query_id", "left").fillna(0)


def rouge1() -> Column:
    """F1 of clipped word overlap, over ``overlaps``; 0 if a side is empty."""
    return F.coalesce(F.when(F.col("b1") > 0, 2 * F.col("b1") / (F.col("la") + F.col("lr"))), F.lit(0.0))


def bleu(n: int = 4) -> Column:
    """Geometric mean of clipped n-gram precisions with brevity penalty, over ``overlaps``; orders without n-grams are skipped, any 0 gives 0."""
    la, lr = F.col("la"), F.col("lr")
    logs, fit = F.lit(0.0), (la > 0) & (lr > 0)
    for k in range(1, n + 1):
        both, there = F.col(f"b{k}"), la >= k
        fit = fit & (~there | (both > 0))
        logs = logs + F.when(there & (both > 0), F.log(both / F.greatest(la - (k - 1), F.lit(1)))).otherwise(0.0)
    penalty = F.least(F.lit(1.0), F.exp(1 - lr / F.greatest(la, F.lit(1))))
    return F.when(fit, penalty * F.exp(logs / F.least(F.greatest(la, F.lit(1)), F.lit(n)))).otherwise(0.0)


def word_overlap(x: Column, y: Column) -> Column:
    from quillstone.operators.retrieval import jaccard

    return F.coalesce(jaccard(T.words(x), T.words(y)), F.lit(0.0))


@F.pandas_udf(DoubleType())
def rouge_l(answer, reference):
    """F1 of the longest common subsequence of words (a bit per reference word)."""
    import pandas as pd

    def score(a, r):
        a, r = (a or "").lower().split(), (r or "").lower().split()
        if not a or not r:
            return 0.0
        at: dict[str, int] = {}
        for i, w in enumerate(r):
            at[w] = at.get(w, 0) | 1 << i
        full = (1 << len(r)) - 1
        row = full
        for w in a:
            hit = row & at.get(w, 0)
            row = (row + hit | row - hit) & full
        common = len(r) - row.bit_count()
        return 2 * common / (len(a) + len(r))

    return pd.Series([score(a, r) for a, r in zip(answer, reference)], dtype="float64")


def hallucinated(answer: Column, context: Column) -> Column:
    """Sentences of which more than half the content words are not in the context."""
    known = T.content_words(context)

    def bad(sentence: Column) -> Column:
        own = T.content_words(sentence)
        return (F.size(own) > 0) & (F.size(F.array_except(own, known)) > F.size(own) * 0.5)

    return F.filter(T.sentences(answer), bad)


def hallucination_rate(answer: Column, context: Column) -> Column:
    n = F.size(T.sentences(answer))
    return F.when(n > 0, F.size(hallucinated(answer, context)) / n).otherwise(0.0)


def judge_score(reply: Column) -> Column:
    """First number of a judge's reply, held within 0 and 1; 0 without one."""
    found = F.regexp_extract(reply, r"(\d+\.?\d*)", 1)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nullif(found, F.lit("")).try_cast("double"))), F.lit(0.0))


# Comparison of metrics (rows ``metric, value``)


def compare(baseline: DataFrame, current: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Change of each metric, absent ones as 0; a regression falls by more than the tolerance of the baseline."""
    rows = (
        baseline.select("metric", F.col("value").alias("baseline")).join(current.select("metric", F.col("value").alias("current")), "metric", "full_outer").fillna(0.0, ["baseline", "current"])
    )
    change = F.col("current") - F.col("baseline")
    worse = F.when(F.col("baseline") > 0, change < -tolerance * F.col("baseline")).otherwise(F.col("current") < F.col("baseline"))
    return rows.withColumn("change", F.round(change, 6)).withColumn("regression", worse)


def compare_experiments(baseline: DataFrame, current: DataFrame, lower_is_better: list[str] | None = None) -> DataFrame:
    """Change in percent (100 from 0 to more); what isn't improved is a regression; both 0 is left out."""
    rows = compare(baseline, current).where("baseline != 0 or current != 0").drop("regression", "change")
    b, c = F.col("baseline"), F.col("current")
    percent = F.when(b == 0, F.when(c > 0, 100.0).otherwise(0.0)).otherwise((c - b) / F.abs(b) * 100)
    better = F.when(F.col("metric").isin(lower_is_better or []), c < b).otherwise(c > b)
    return rows.withColumn("change_pct", F.bround(percent, 2)).withColumn("improved", better)


def variance_ranking(values: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` metrics that vary most over runs ``(metric, value)``."""
    return values.groupBy("metric").agg(F.round(F.var_pop("value"), 6).alias("variance"), F.count("*").alias("runs")).orderBy(F.desc("variance"), "metric").limit(k)


_IDEAL = lambda k: "CASE " + " ".join(f"WHEN least(n, {k}) = {j} THEN {sum(1 / math.log2(i + 2) for i in range(j))!r}::DOUBLE" for j in range(1, k + 1)) + " END"
_IN = lambda k, v: f"sum(CASE WHEN rank <= {k} THEN {v} ELSE 0 END)"
#: Over CTEs asked(query_id, ...), found(query_id, id, rank), rel(query_id, id): the CTE metrics.
METRICS_SQL = f"""rels AS (SELECT query_id, count(DISTINCT id) AS n FROM rel GROUP BY query_id),
hits AS (SELECT f.query_id, rank, hit, sum(hit) OVER (PARTITION BY f.query_id ORDER BY rank) AS before FROM (SELECT found.query_id, rank, (r.id IS NOT NULL)::INT AS hit FROM found LEFT JOIN (SELECT DISTINCT query_id, id FROM rel) r ON r.query_id = found.query_id AND r.id = found.id) f),
sums AS (SELECT query_id, count(*) AS size, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(hit * before / rank) AS ap, {', '.join(f'{_IN(k, "hit")} AS hits_{k}, {_IN(k, "hit / log2(rank + 1.0::DOUBLE)")} AS dcg_{k}' for k in KS)} FROM hits GROUP BY query_id),
metrics AS (SELECT a.*, {', '.join(f"coalesce(round(hits_{k} / least(size, {k}), 6), 0.0::DOUBLE) AS precision_{k}, coalesce(round(hits_{k} / n, 6), 0.0::DOUBLE) AS recall_{k}, coalesce(round(dcg_{k} / {_IDEAL(k)}, 6), 0.0::DOUBLE) AS ndcg_{k}" for k in KS)},
 coalesce(round(1.0::DOUBLE / CASE WHEN n > 0 THEN first END, 6), 0.0::DOUBLE) AS mrr, coalesce((n > 0 AND first IS NOT NULL)::DOUBLE, 0.0::DOUBLE) AS hit_rate, coalesce(round(ap / n, 6), 0.0::DOUBLE) AS map
 FROM asked a LEFT JOIN sums USING (query_id) LEFT JOIN rels USING (query_id))"""
PERCENTILES_SQL = "SELECT " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_p{int(q * 100)}" for c in ("mrr", "map", "ndcg_10", "recall_10") for q in (0.5, 0.95)) + " FROM metrics"
GROUP_SQL = f"CASE WHEN coalesce(trim(query), '') = '' THEN 'unknown' WHEN lower(regexp_extract(query, '^\\s*(\\S+)\\s+\\S', 1)) IN ({', '.join(repr(w) for w in QUESTION_WORDS)}) THEN 'q_' || lower(regexp_extract(query, '^\\s*(\\S+)\\s+\\S', 1)) ELSE 'other' END"
CLI_SQL = """SELECT a.query_id, coalesce(round_even(h.hits / 5, 4), 0.0::DOUBLE) AS precision, coalesce(round_even(h.hits / r.n, 4), 0.0::DOUBLE) AS recall, coalesce(h.hits, 0) > 0 AS hit, coalesce(round_even(1.0::DOUBLE / h.first, 4), 0.0::DOUBLE) AS mrr
FROM asked a LEFT JOIN (SELECT query_id, count(*) AS n FROM (SELECT DISTINCT query_id, id FROM rel) GROUP BY query_id) r USING (query_id)
LEFT JOIN (SELECT query_id, sum((rank <= 5)::INT) AS hits, min(rank) AS first FROM found SEMI JOIN rel USING (query_id, id) GROUP BY query_id) h USING (query_id)"""
