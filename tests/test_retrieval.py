import math

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators import evaluation as E
from quillstone.operators import retrieval as R

DOCS = [(1, "python programming language"), (2, "python is a programming language for data science"), (3, "java programming"), (4, None), (5, "")]


def naive_bm25(docs, query):
    import re

    toks = {i: re.findall("[a-zA-Z0-9]+", (t or "").lower()) for i, t in docs}
    avg = sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, d in toks.items():
        s = 0.0
        for q in re.findall("[a-zA-Z0-9]+", query.lower()):
            tf, df = d.count(q), sum(q in x for x in toks.values())
            if tf:
                s += math.log((len(toks) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
        if s > 0:
            out[i] = round(s, 6)
    return out


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "id int, text string")
    queries = spark.createDataFrame([("a", "python programming"), ("b", "programming programming java"), ("c", ""), ("d", None), ("e", "none")], "query_id string, query string")
    rows = R.bm25(docs, queries, 10).collect()
    for q, text in (("a", "python programming"), ("b", "programming programming java")):
        assert {r.id: r.score for r in rows if r.query_id == q} == naive_bm25(DOCS, text)
    assert {r.query_id for r in rows} == {"a", "b"}
    assert [r.id for r in rows if r.query_id == "a" and r["rank"] == 1] == [1]
    only = R.bm25(docs, queries, 10, keep=F.col("id") == 3).collect()
    assert {r.id for r in only} == {3}
    assert {r.score for r in only if r.query_id == "b"} == {naive_bm25(DOCS, "programming programming java")[3]}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((50, 8))
    v[7] = 0
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    queries = vectors.where("id < 3").withColumnRenamed("id", "query_id")
    found = R.vector_search(vectors, queries, 4).collect()
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
    for q in range(3):
        s = np.round(unit @ v[q], 6)
        want = sorted(range(50), key=lambda i: (-s[i], i))[:4]
        assert [r.id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == want
    assert R.vector_search(vectors.limit(0), queries, 4).count() == 0


def ranked(spark, lists):
    rows = [(q, n, i, float(s), r) for (q, n), ids in lists.items() for r, (i, s) in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "query_id int, retriever string, id string, score double, rank int")


def test_fusion(spark):
    lists = ranked(spark, {(1, "a"): [("d1", 3), ("d2", 2), ("d3", 1)], (1, "b"): [("d2", 9), ("d3", 8), ("d4", 7)], (2, "a"): [("x", 5)]})
    fused = {(r.query_id, r.id): r for r in R.fuse(lists).collect()}
    assert len([k for k in fused if k[0] == 1]) == 4
    assert abs(fused[1, "d2"].score - (1 / 62 + 1 / 61)) < 1e-6 and fused[1, "d2"]["rank"] == 1
    assert fused[2, "x"].score == 5.0
    scaled = {r.id: r.score for r in R.score_fusion(lists.where("query_id = 1")).collect()}
    assert scaled == {"d1": 1.0, "d2": 1.5, "d3": 0.5, "d4": 0.0}
    weighted = {r.id: r["rank"] for r in R.rrf(ranked(spark, {(1, "a"): [("d1", 2), ("d2", 1)], (1, "b"): [("d2", 2), ("d1", 1)]}), weights={"a": 1, "b": 2}).collect()}
    assert weighted["d2"] == 1


def test_metrics(spark):
    found = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "b", 3), (2, "a", 1), (2, "x", 2), (2, "b", 3), (3, "z", 1)], "query_id int, id string, rank int")
    rel = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "b"), (4, "q")], "query_id int, id string")
    asked = spark.createDataFrame([(i,) for i in range(1, 6)], "query_id int")
    rows = {r.query_id: r for r in E.per_query(asked, found, rel).collect()}
    assert abs(rows[1].ndcg_3 - 0.6934) < 1e-3 and rows[1].mrr == 0.5 and rows[1].recall_3 == 1.0
    assert abs(rows[2].map - 5 / 6) < 1e-5
    assert rows[1].precision_5 == round(2 / 3, 6)
    assert all(rows[i].mrr == rows[i].hit_rate == rows[i].precision_1 == 0 for i in (3, 4, 5))


def test_text_metrics(spark):
    pairs = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "a a b", "a c"), (3, "", "x"), (4, "q", "z")], "query_id int, answer string, reference string")
    rows = {r.query_id: r for r in E.overlaps(pairs).select("query_id", E.rouge1().alias("r"), E.bleu().alias("b")).collect()}
    assert rows[1].r == rows[1].b == 1.0
    assert abs(rows[2].r - 2 / 5) < 1e-9 and rows[2].b == 0
    assert rows[3].r == rows[3].b == rows[4].r == rows[4].b == 0
    long = spark.createDataFrame([("a b c d e", "a c e")], "a string, r string").select(E.rouge_l("a", "r").alias("x")).first().x
    assert abs(long - 2 * 3 / 8) < 1e-9
    rate = spark.createDataFrame([("The cat sleeps here. Dragons fly over mountains.", "the cat sleeps here today")], "a string, c string")
    assert rate.select(E.hallucination_rate(F.col("a"), F.col("c")).alias("x")).first().x == 0.5


def test_compare(spark):
    a, b = (spark.createDataFrame(r, "metric string, value double") for r in ([("x", 1.0), ("y", 0.5)], [("x", 0.9), ("z", 1.0)]))
    rows = {r.metric: r for r in E.compare(a, b).collect()}
    assert rows["x"].regression and rows["y"].regression and not rows["z"].regression
    more = {r.metric: r for r in E.compare_experiments(a, b).collect()}
    assert more["z"].change_pct == 100 and more["x"].change_pct == -10 and not more["x"].improved
