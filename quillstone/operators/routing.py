"""Routing of classified queries to a retrieval strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

# Type -> (strategy, top_k, rerank).
ROUTES = {
    "factual": ("hybrid_rerank", 5, True),
    "summarization": ("hybrid", 10, False),
    "comparison": ("hybrid", 10, True),
    "how_to": ("hybrid_rerank", 8, True),
    "general": ("hybrid", 5, False),
}


def route(queries: DataFrame, query: str, routes: dict | None = None, automatic: bool = True, default_top_k: int = 5) -> DataFrame:
    """``queries`` with query_type, complexity, specificity, strategy, top_k and rerank.

    A complex query takes five more results, up to 20, and the hybrid strategy; after
    that a broad one takes three more, at least 10. Not automatic: the type's strategy
    with the default number.
    """
    q = F.col(query)
    rows = queries.withColumns({"query_type": T.query_type(q), "complexity": T.complexity(q), "specificity": T.specificity(q)})
    pick = lambda i: F.create_map(*(F.lit(x) for name, r in (routes or ROUTES).items() for x in (name, r[i])))[F.col("query_type")]
    rows = rows.withColumns({"strategy": pick(0), "top_k": pick(1), "rerank": pick(2)})
    if not automatic:
        return rows.withColumn("top_k", F.lit(default_top_k))
    hard, broad, k = F.col("complexity") == "complex", F.col("specificity") == "broad", F.col("top_k")
    k = F.when(hard, F.least(k + 5, F.lit(20))).otherwise(k)
    return rows.withColumns({"strategy": F.when(hard, "hybrid").otherwise(F.col("strategy")), "top_k": F.when(broad, F.greatest(k + 3, F.lit(10))).otherwise(k)})


_CASE = lambda i, quote: "CASE query_type " + " ".join(f"WHEN '{n}' THEN {quote(r[i])}" for n, r in ROUTES.items()) + " END"
_K = f"CASE WHEN complexity = 'complex' THEN least({_CASE(1, str)} + 5, 20) ELSE {_CASE(1, str)} END"
SQL = f"SELECT id, query, CASE WHEN complexity = 'complex' THEN 'hybrid' ELSE {_CASE(0, repr)} END AS strategy, (CASE WHEN specificity = 'broad' THEN greatest({_K} + 3, 10) ELSE {_K} END)::INTEGER AS top_k, {_CASE(2, str)} AS rerank FROM kinds"
