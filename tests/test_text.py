from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.synonyms import SYNONYMS
from quillstone.operators import chunking as C
from quillstone.operators import routing


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


def text(spark, f, value):
    return one(spark, f(F.col("t")), t=value)


def test_tokens_and_stems(spark):
    assert text(spark, T.tokens, "Über-Test: foo_bar 12") == ["ber", "test", "foo", "bar", "12"]
    words = {"running": "runn", "nation": "nation", "cats": "cat", "is": "is", "sing": "sing", "tested": "test", "quickly": "quick", "creation": "crea"}
    assert {w: text(spark, T.stem, w) for w in words} == words


def test_list_sizes():
    assert [len(x) for x in (T.INDEX_STOPWORDS, T.STEP_BACK_STOPWORDS, T.EXPANSION_STOPWORDS, T.CONTENT_STOPWORDS)] == [65, 102, 71, 113]
    assert len(SYNONYMS) == 46


def test_cleaning(spark):
    assert text(spark, T.strip_controls, "a\x00b​c\n\td") == "abc\n\td"
    assert text(spark, T.normalize_whitespace, "  Hello   world  \n x\t y  ") == " Hello world\n x y"
    assert text(spark, T.collapse_blank_lines, "a\n\n\n\n\nb") == "a\n\nb"
    assert text(spark, lambda c: T.collapse_blank_lines(c, 2), "a\n\n\n\nb") == "a\n\n\nb"
    assert text(spark, T.join_broken_lines, "multi-\nline hel\nlo") == "multiline hello"
    assert text(spark, C.normalize_unicode, "Ｈｅｌｌｏ") == "Hello"
    assert text(spark, C.unescape, "&eacute;&lt;") == "é<"
    assert text(spark, T.strip_tags, "<p>a <b>c</b></p><script>x()</script>").split() == ["a", "c"]


def test_sentences_and_ngrams(spark):
    assert text(spark, T.sentences, " One. Two!  Three? four ") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, T.ngrams(F.split("t", " "), 2), t="a b c") == ["a b", "b c"]
    assert one(spark, T.ngrams(F.split("t", " "), 4), t="a b c") == []


def test_query_types_and_routes(spark):
    rows = spark.createDataFrame([(q,) for q in ("What is Python?", "Compare React and Vue", "summarize this", "tutorial for x", "hello", "who knows")], "query string")
    found = {r["query"]: r for r in routing.route(rows, "query").collect()}
    assert [found[q].query_type for q in ("What is Python?", "Compare React and Vue", "summarize this", "tutorial for x", "hello")] == ["factual", "comparison", "summarization", "how_to", "general"]
    assert (found["What is Python?"].strategy, found["What is Python?"].top_k, found["What is Python?"].rerank) == ("hybrid_rerank", 10, True)
    assert (found["Compare React and Vue"].strategy, found["Compare React and Vue"].top_k) == ("hybrid", 18)


def test_rewriting(spark):
    assert text(spark, lambda c: T.expand_synonyms(c, SYNONYMS), "fix the error!") == "fix the error! repair bug"
    assert text(spark, lambda c: T.multi_query(c, 2), "spark sql?") == ["spark sql?", "What is spark sql?"]
    assert text(spark, T.step_back, "how is it") == T.NO_TERMS
    assert text(spark, T.slug, "https://x.org/a/page.html") == "page-html"
    assert text(spark, T.slug, "https://x.org/concepts/") == "concepts"
    assert text(spark, T.crawl_group, "https://docs.x.org/a/b/index.html") == "docs-x-org-a-b"


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "This is sentence one. " * 20), (2, ""), (3, "   "), (4, None), (5, "## A\n\nalpha beta\n\n## B\n\ngamma")], "id int, text string")
    rows = C.chunk(docs, "id", "text", 20, 40, 0).collect()
    assert {r.id for r in rows} == {1, 5}
    assert all(r.token_count <= 40 for r in rows)
    assert [r.section for r in rows if r.id == 5] == ["A"]
    assert len({r.chunk_id for r in rows}) == len(rows)
    tail = [r for r in C.chunk(docs.where("id = 1"), "id", "text", 20, 40, 4).orderBy("chunk_index").collect()]
    assert tail[1].content.split()[:4] == tail[0].content.split()[-4:]
