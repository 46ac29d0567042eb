"""Composed operators against brute force and at their edges."""

import io
import random
import tempfile
import zipfile
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import experiments as X
from quillstone.operators import generation as G
from quillstone.operators import ingest as I
from quillstone.operators import monitoring as M
from quillstone.operators import queries as Q
from quillstone.operators import ranking, registry
from quillstone.operators import retrieval as R
from quillstone.operators.keyword_index import KeywordIndex
from quillstone.plans import broadcasting, staging
from quillstone.sources import files

WORDS = "cache index query vector chunk score model graph token limit".split()


def texts(n, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, rows[0][1])]


def test_both_plans_of_keyword_search_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i:03}", t) for i, t in texts(150, 1)], "id string, text string").repartition(7)
    asked = spark.createDataFrame([("a", "cache index"), ("b", "limit limit zzz"), ("c", ""), ("d", None)], "query_id string, query string")
    few = sorted(map(tuple, R.bm25(docs, asked, 5).collect()))
    monkeypatch.setattr(R, "MAX_ROWS", 0)
    assert few == sorted(map(tuple, R.bm25(docs, asked, 5).collect())) and len(few) == 10
    assert R.bm25(docs.limit(0), asked, 5).count() == 0 and R.bm25(docs, asked.limit(0), 5).count() == 0


def test_both_plans_of_vector_search_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((90, 6)).round(3)
    rows = [(i, [float(x) for x in r], i % 3 or None) for i, r in enumerate(v)] + [(90, None, 1), (91, [1.0], 1), (92, [0.0] * 6, 1), (93, [float(x) for x in v[4]], 1)]
    stored = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(5)
    asked = stored.where("id < 10").withColumnRenamed("id", "query_id")
    one = [sorted(map(tuple, R.vector_search(stored, asked, 4, same=s).collect())) for s in (None, "label")]
    monkeypatch.setattr(R, "MAX_CELLS", 0)
    assert one == [sorted(map(tuple, R.vector_search(stored, asked, 4, same=s).collect())) for s in (None, "label")]
    unit = np.vstack([v, np.zeros((3, 6)), v[4]])
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-10)
    ids = [i for i in range(94) if i not in (90, 91)]
    for q in range(10):
        s = {i: round(float(v[q] @ unit[i]), 6) for i in ids}
        assert [r[1] for r in sorted((r for r in one[0] if r[0] == q), key=lambda r: r[3])] == sorted(ids, key=lambda i: (-s[i], i))[:4]
    assert {r[0] for r in one[1]} == {i for i in range(10) if i % 3}
    assert R.vector_search(stored.limit(0), asked, 4).count() == R.vector_search(stored, asked.limit(0), 4).count() == 0


def test_kept_index(spark):
    index = KeywordIndex(spark, "file://" + tempfile.mkdtemp(prefix="spark-") + "/k")
    d = spark.createDataFrame(texts(60, 2), "id long, text string")
    asked = spark.createDataFrame([("a", "cache index"), ("b", "vector")], "query_id string, query string")
    index.add(d.where("id < 40"), 0)
    index.add(d.where("id >= 30").withColumn("text", F.when(F.col("id") < 40, F.lit("cache cache")).otherwise(F.col("text"))), 1)
    index.remove(d.where("id < 5").select("id"), 2)
    index.add(d.where("id = 2"), 3)
    index.add(d.where("id = 2"), 3)
    now = d.where("id >= 5 or id = 2").withColumn("text", F.when(F.col("id").between(30, 39), F.lit("cache cache")).otherwise(F.col("text")))
    assert sorted(map(tuple, index.search(asked, 7).collect())) == sorted(map(tuple, R.bm25(now, asked, 7).collect()))


def test_places_of_large_groups(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("ab"), i, rng.randint(0, 9), rng.randint(1, 5)) for i in range(3000)]
    got = ranking.placed(spark.createDataFrame(rows, "k string, id long, o int, s int"), "k", [F.desc("o"), F.asc("id")], F.col("s")).collect()
    for k in ("hot", "a", "b"):
        own, total = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1])), 0
        placed = {r.id: (r.place, r.total) for r in got if r.k == k}
        for place, r in enumerate(own, 1):
            total += r[3]
            assert placed[r[1]] == (place, total)
    budget = spark.createDataFrame(rows, "query_id string, id long, o int, size int").withColumn("score", F.col("o").cast("double"))
    assert sorted(map(tuple, G.running_budget(budget, 40).select("query_id", "id").collect())) == sorted((r.k, r.id) for r in got if r.total <= 40)
    values = spark.createDataFrame([("x", float(i)) for i in range(20)] + [("x", None), ("y", 3.0), (None, 1.0)], "k string, v double")
    ranks = {r.k: r for r in ranking.nearest_rank(values, "k", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert (ranks["x"].p50, ranks["x"].p95, ranks["x"].n, ranks["y"].p95, ranks["y"].sd) == (10.0, 19.0, 20, 3.0, None) and len(ranks) == 2


def test_query_processing(spark):
    rows = spark.createDataFrame([(1, "  how does   caching work? "), (2, ""), (3, None), (4, "x" * 600), (5, "`~")], "id int, query string")
    got = {r.id: r for r in Q.process(rows, strategies=("multi_query", "step_back", "hyde"), n=3).collect()}
    assert got[1].clean == "how does caching work?" and got[1].query_type == "general" and got[1].strategies_used == ["hyde", "multi_query", "step_back"]
    assert got[1].variants[0] == got[1].clean and len(set(got[1].variants)) == len(got[1].variants) == 5
    assert [got[i].error for i in (2, 3, 4, 5)] == ["Query is empty", "Query is empty", "Query is too long", "Query is empty"] and all(not got[i].variants and not got[i].strategies_used for i in (2, 3, 4, 5))
    assert Q.process(rows, strategies=()).where("id = 1").first().variants == ["how does caching work?"]
    with pytest.raises(ValueError):
        Q.process(rows, strategies=("magic",))


def test_citation_report(spark):
    rows = spark.createDataFrame([(1, "A [2]. B [1] [2]. C [3] [3].", ["x", "y"]), (2, "none", ["x"]), (3, "[1]", None)], "id int, answer string, sources array<string>")
    got = {r.id: r for r in G.citation_report(rows, "id", "answer", "sources").collect()}
    assert got[1].inline == "[2] y, [1] x" and got[1].footnotes == "1. y\n2. x" and got[1].warnings == ["citation [3] not found in context"] * 2
    assert got[1].block == "**Sources:**\n\n[2] *y* — y\n[1] *x* — x"
    assert (got[2].inline, got[2].block, got[2].warnings) == ("", "", []) and got[3].warnings == ["citation [1] not found in context"]


def test_ingest(spark):
    schema = "id string, rec_id long, filename string, file_hash string, content string"
    stored = spark.createDataFrame([("a", 1, "f1", "h1", "one two"), ("b", 2, "f2", "h2", "three"), ("n", 3, None, None, "null file")], schema)
    batch = [("c", 4, "f1", "h3", "x &amp;  y\n\n\n\nz"), ("d", 5, "f9", "h2", "same file"), ("e", 6, "f5", "h5", "twice"), ("f", 7, "f6", "h5", "twice again"), ("g", 8, None, None, None), ("i", 9, "f7", "h8", "old"), ("j", 10, "f7", "h9", "new")]
    documents, chunks, plan = I.ingest(stored, I.chunked(stored), spark.createDataFrame(batch, schema))
    assert {r.id for r in documents.collect()} == {"b", "n", "c", "f", "g", "j"}
    assert {r.document_id: r.content for r in chunks.collect()} == {"b": "three", "n": "null file", "c": "x & y\n\nz", "f": "twice again", "j": "new"}
    assert {r.id: r.action for r in plan.collect()} == {"c": "changed", "d": "unchanged", "e": "new", "f": "new", "g": "new", "i": "new", "j": "new"}
    marked = I.mark_indexed(chunks, chunks.where("document_id = 'b'"))
    assert [r.document_id for r in marked.where("indexed").collect()] == ["b"]
    assert {r.id: r.chunk_count for r in I.count_chunks(documents.withColumn("chunk_count", F.lit(9)), chunks).collect()}["g"] == 0
    root = "file://" + tempfile.mkdtemp(prefix="spark-")
    I.reindex(documents, root, "chunks")
    first = registry.current(spark, root, "chunks").count()
    I.reindex(documents.where("id = 'b'"), root, "chunks")
    assert (first, registry.current(spark, root, "chunks").count()) == (5, 1)


def test_upserts(spark):
    stored = spark.createDataFrame([("a", 1, "s"), ("b", 2, None)], "id string, n int, created_at string")
    incoming = spark.createDataFrame([("a", 5, "x"), ("a", 3, "y"), ("b", None, "z"), ("c", 7, "w")], "id string, n int, created_at string")
    got = {r.id: (r.n, r.created_at) for r in registry.upsert_documents(stored, incoming, order=-F.col("n")).collect()}
    assert got == {"a": (3, "s"), "b": (None, "z"), "c": (7, "w")}
    assert {r.id: r.n for r in registry.upsert_documents(stored, incoming).collect()}["a"] == 5


def test_experiments(spark):
    states = spark.sql("""SELECT * FROM VALUES ('r1', 'n', 'running', array('t'), timestamp'2024-01-01 00:00:00', 1), ('r1', 'n', 'completed', array('t'), timestamp'2024-01-01 00:00:00', 2),
        ('r2', 'n', 'completed', array('u'), timestamp'2024-01-02 00:00:00', 1), ('r3', 'n', 'failed', null, timestamp'2024-01-03 00:00:00', 1), ('r4', 'm', 'running', array(), timestamp'2024-01-03 00:00:00', 1) AS t(run_id, name, status, tags, created_at, updated_at)""")
    runs = X.latest(states)
    assert runs.count() == 4 and [r.run_id for r in X.baselines(runs).collect()] == ["r2"]
    assert [r.run_id for r in X.listed(runs, status="completed", tag="t").collect()] == ["r1"] and X.listed(runs, name="m").count() == 1
    done = {r.run_id: (r.status, r.duration_ms) for r in X.finished(runs, F.lit("2024-01-03 00:00:01").cast("timestamp"), F.lit(None)).collect()}
    assert done["r4"] == ("completed", 1000.0) and done["r3"] == ("failed", None)
    nested = spark.sql("SELECT 'r' AS run_id, map('a', map('x', 1.5D, 'y', null), 'b', map('z', 2D)) AS metrics")
    assert sorted(tuple(r) for r in X.flattened(nested).collect()) == [("r", "a.x", 1.5), ("r", "b.z", 2.0)]


def test_tables_sections_and_masks(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    table = F.array(F.array(F.lit("a"), F.lit(None).cast("string")), F.array(F.lit("1"), F.lit("2")))
    assert one(files.table_text(table)) == "a | \n" + "-" * 40 + "\n1 | 2" and one(files.table_text(F.slice(table, 1, 1))) == "a | \n" + "-" * 40
    docs = spark.createDataFrame([(1, "# A\ntext\n### B c\n####### no\n#no"), (2, None), (3, "")], "id int, text string")
    assert [tuple(r) for r in files.markdown_sections(docs, "id", "text").collect()] == [(1, 0, 1, "A", 0), (1, 1, 3, "B c", 9)]
    assert one(M.mask_json(F.lit('{"a":{"Api_key":"x\\"y","n":1},"token":5,"PASSWORD" : "p"}'))) == '{"a":{"Api_key":"***","n":1},"token":5,"PASSWORD" : "***"}'
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda s: f"<w:tc><w:p><w:t>{s}</w:t></w:p></w:tc>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body><w:p><w:t>Hi</w:t></w:p><w:tbl><w:tr>{cell('h')}{cell('k')}</w:tr><w:tr>{cell(1)}{cell(2)}</w:tr></w:tbl></w:body></w:document>")
    assert files._docx(out.getvalue())[0] == "Hi\n\nh | k\n" + "-" * 40 + "\n1 | 2"


def test_bounds_of_broadcasts_and_stages(spark):
    wide = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert broadcasting.small_enough(wide) and not broadcasting.small_enough(wide, 99) and not broadcasting.small_enough(wide, 100, 50_000)
    conf = SimpleNamespace(get=lambda *a: None, set=None)
    with pytest.raises(ValueError):
        staging.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://x:7077")))
    assert T.EXPANSION_STOPWORDS[-1] == "just"
