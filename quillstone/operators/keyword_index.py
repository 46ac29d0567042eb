"""A kept keyword index in a folder: postings and lengths by part, so adding reads nothing and searching tokenises nothing anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import retrieval as R
from quillstone.plans.broadcasting import broadcast_if_small


class KeywordIndex:
    """Documents ``(id, text)``; an id added again replaces what it was, a removed one may come again.

    Every change is a numbered part; a document's last part counts. A part that is written
    again after a failure replaces what it left.
    """

    def __init__(self, spark: SparkSession, path: str, k1: float = R.K1, b: float = R.B):
        self.spark, self.path, self.k1, self.b = spark, path.rstrip("/"), k1, b

    def _rows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def add(self, docs: DataFrame, part: int) -> None:
        tokens = F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>"))
        own = docs.select("id", tokens.alias("tokens"))
        posted = own.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
        posted.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.path}/postings/part={part}")
        own.select("id", F.size("tokens").alias("dl"), F.lit(False).alias("removed")).write.mode("overwrite").parquet(f"{self.path}/lengths/part={part}")

    def remove(self, ids: DataFrame, part: int) -> None:
        ids.select("id", F.lit(0).alias("dl"), F.lit(True).alias("removed")).distinct().write.mode("overwrite").parquet(f"{self.path}/lengths/part={part}")

    def documents(self) -> DataFrame:
        """``(id, part, dl)`` of the documents that are there."""
        last = self._rows("lengths").groupBy("id").agg(F.max_by(F.struct("part", "dl", "removed"), "part").alias("r"))
        return last.where("not r.removed").select("id", "r.part", "r.dl")

    def search(self, queries: DataFrame, k: int | None = 10, query: str = "query", keep: Column | None = None) -> DataFrame:
        """``(query_id, id, score, rank)``, as ``retrieval.bm25`` gives over the documents that are there; only the query terms' postings are read."""
        there = self.documents()
        terms = R.query_terms(queries, query)
        whole = there.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        posted = self._rows("postings").join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi").join(there, ["id", "part"])
        df = posted.groupBy("term").agg(F.count("*").alias("df"))
        weights = terms.join(df, "term").select("query_id", "term", (F.col("qtf") * R.idf(F.lit(whole.n), F.col("df"))).alias("w"))
        tf, dl = F.col("tf"), F.col("dl")
        score = F.col("w") * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / (whole.avgdl or 1.0)))
        found = posted if keep is None else posted.where(F.coalesce(keep, F.lit(False)))
        scores = found.join(broadcast_if_small(weights), "term").groupBy("query_id", "id").agg(F.round(F.sum(score), 6).alias("score")).where("score > 0")
        return R.ranked(scores, k)
