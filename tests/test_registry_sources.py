import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from quillstone.operators import generation as G
from quillstone.operators import monitoring as M
from quillstone.operators import registry as R
from quillstone.sources import files
from quillstone.streaming import ingest


def test_upserts_and_deletes(spark):
    stored = spark.createDataFrame([("a", "old", 1), ("b", "old", 2)], "id string, filename string, created_at int")
    new = spark.createDataFrame([("b", "new", 9), ("c", "new", 8)], "id string, filename string, created_at int")
    assert {tuple(r) for r in R.upsert_documents(stored, new).collect()} == {("a", "old", 1), ("b", "new", 2), ("c", "new", 8)}
    chunks = spark.createDataFrame([("1", "a", 0, "x", 1, True), ("2", "b", 0, "y", 1, True)], "id string, document_id string, chunk_index int, content string, token_count int, indexed boolean")
    got = {tuple(r) for r in R.upsert_chunks(chunks, spark.createDataFrame([("1", "z", 7, "X", 3, False)], chunks.schema)).collect()}
    assert ("1", "a", 0, "X", 3, False) in got and len(got) == 2
    docs, left = R.delete_documents(stored, chunks, stored.where("id = 'a'"))
    assert [r.id for r in docs.collect()] == ["b"] and [r.id for r in left.collect()] == ["2"]


def test_plan_and_cache(spark):
    stored = spark.createDataFrame([("f1", "h1"), ("f2", "h2")], "source string, h string")
    plan = R.plan_ingest(stored, spark.createDataFrame([("f1", "h1"), ("f2", "h9"), ("f3", "h3"), ("f4", "h2"), (None, None)], "source string, h string"), "source", "h")
    assert {r.source: r.action for r in plan.collect()} == {"f1": "unchanged", "f2": "changed", "f3": "new", "f4": "unchanged", None: "new"}
    cache = spark.createDataFrame([("a",)], "t string").select(F.sha2(F.concat(F.lit("m:"), "t"), 256).alias("cache_key"), F.lit(5).alias("expires_at"))
    wanted = spark.createDataFrame([("a",), ("b",)], "t string")
    assert {r.t: r.hit for r in R.cache_lookup(wanted, cache, "t", "m", F.lit(4)).collect()} == {"a": True, "b": False}
    assert not any(r.hit for r in R.cache_lookup(wanted, cache, "t", "m", F.lit(6)).collect())


def test_versions(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    R.publish(spark.range(3), root, "t")
    assert R.current(spark, root, "t").count() == 3
    R.publish(spark.range(5), root, "t")
    assert R.current(spark, root, "t").count() == 5


def test_dataset_errors(spark):
    rows = [("a", "q", "x", ["f"]), ("b", "", "x", ["f"]), ("c", "q", None, ["f"]), ("d", "q", "x", None), ("e", "q", "x", ["f"]), ("e", "q", "x", ["f"])]
    got = {(r.id, r.error) for r in R.dataset_errors(spark.createDataFrame(rows, "id string, query string, expected_answer string, expected_documents array<string>")).collect()}
    assert got == {("b", "empty query"), ("c", "no expected answer"), ("d", "no expected documents"), ("e", "duplicate id")}


def test_rate_limit_and_breaker(spark):
    events = spark.createDataFrame([(i, "u", t, f) for i, (t, f) in enumerate([(0, 1), (10, 1), (20, 0), (40, 0), (71, 0), (100, 0)])] + [(9, "v", 5, 0), (10, None, 5, 0)], "e int, u string, t int, f int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.e: r.allowed for r in M.rate_limit(events, "u", "ts", "e", 60, 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 9: True}
    states = {r.e: r.state for r in M.breaker(events, "u", "ts", "e", F.col("f") == 1, failures=2, recovery=30, successes=2).collect()}
    assert states == {0: "closed", 1: "open", 2: "open", 3: "half_open", 4: "closed", 5: "closed", 9: "closed"}


def test_metadata(spark):
    rows = spark.createDataFrame([(1, {"date": "2024-01-02"}), (2, {"date": "", "created_at": "2024-01-05 10:00:00"}), (3, {"timestamp": "soon"}), (4, {}), (5, {"type": "pdf", "date": "2024-01-03T00:00:00"}), (6, None)], "id int, m map<string,string>")
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(M.metadata_filter(rows, "m", since="2024-01-02 00:00:00", until="2024-01-05 00:00:00")) == {1, 5}
    assert ids(M.metadata_filter(rows, "m", types=["pdf"])) == {5}
    assert ids(M.metadata_filter(rows, "m", custom={"type": "pdf"})) == {5}
    assert ids(M.metadata_filter(rows, "m")) == {1, 2, 3, 4, 5, 6}
    masked = rows.where("id = 5").select(M.mask(F.create_map(F.lit("API_Token"), F.lit("x"), F.lit("a"), F.lit("b"))).alias("m"), M.metric_key(F.lit("n"), F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("2"))).alias("k")).first()
    assert masked.m == {"API_Token": "***", "a": "b"} and masked.k == "n{a=2,z=1}"


def test_contexts_and_citations(spark):
    rows = spark.createDataFrame([(1, "a", 3.0, "one two"), (1, "b", 2.0, "one two"), (1, "c", 1.0, "three " * 30), (2, "d", 1.0, "w " * 200)], "query_id int, id string, score double, text string")
    got = {r.query_id: r for r in G.contexts(rows, budget=50, style="plain").collect()}
    assert got[1].n_sources == 1 and got[1].context == "[1] one two"
    assert len(got[2].context.split()) == 21
    cited = G.citations(spark.createDataFrame([(1, "x [2] y [1] z [2] [9]", ["p", "q"])], "id int, a string, s array<string>"), "id", "a", "s").collect()
    assert [(r.marker, r.source) for r in cited] == [("[2]", "q"), ("[1]", "p"), ("[9]", None)]
    answers = G.generate(spark.createDataFrame([(1, "p"), (2, "q")], "query_id int, prompt string"), lambda some: [s.upper() for s in some]).collect()
    assert {r.query_id: r.answer for r in answers} == {1: "P", 2: "Q"}


def _files():
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    (folder / "a.txt").write_bytes(b"\xef\xbb\xbfHello there. General text.")
    (folder / "b.md").write_text("# Title\n\nSome words here.")
    (folder / "sub").mkdir()
    (folder / "sub/c.html").write_text("<html><head><title>T</title></head><body><nav>no</nav><p>Yes</p><script>x</script></body></html>")
    (folder / "d.csv").write_text("k,v\n1,\n2,x\n")
    (folder / "e.pdf").write_bytes(b"%PDF")
    (folder / "f.txt").write_bytes(b"")
    (folder / "g.bin").write_bytes(b"x")
    return folder


def test_sources(spark):
    got = {r.name: r for r in files.parse(files.discover(spark, str(_files()))).collect()}
    assert set(got) == {"a.txt", "b.md", "c.html", "d.csv", "e.pdf"}
    assert got["a.txt"].text.startswith("Hello") and got["b.md"].title == "Title" and got["c.html"].text.split() == ["T", "Yes"]
    assert got["d.csv"].text == "k: 1\n\nk: 2 | v: x"
    assert got["e.pdf"].error == "No parser for this file type"


def test_watch_ingests_once(spark):
    folder, out = _files(), tempfile.mkdtemp(prefix="spark-")
    start = lambda: ingest.watch(spark, str(folder), f"{out}/registry", f"{out}/chunks", f"{out}/checkpoint", 20, 40, 0).awaitTermination()
    start()
    n = spark.read.parquet(f"{out}/registry").count()
    (folder / "copy.txt").write_bytes((folder / "a.txt").read_bytes())
    (folder / "new.txt").write_text("Something new.")
    start()
    assert spark.read.parquet(f"{out}/registry").count() == n + 1
    assert spark.read.parquet(f"{out}/chunks").where("content like '%new%'").count() == 1


def test_windowed_metrics(spark):
    events = spark.createDataFrame([(0, "a", 1.0), (1800, "a", 2.0), (4000, "a", 3.0)], "t int, event_type string, value double").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.total for r in ingest.windowed_metrics(events).collect()) == [3.0, 3.0]
