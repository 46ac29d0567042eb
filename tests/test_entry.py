import __spark_entry__ as entry


def test_names_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= queries.keys()
    assert {"p2_found", "hybrid_search"} <= queries.keys()


def test_flagship_runs(spark):
    found = entry.entry(spark)
    assert found.columns == ["query_id", "id", "score", "rank"]
    assert found.count() > 0


def test_every_core_query_has_a_stable_schema(spark, sf):
    from quillstone import catalogue

    for name in ("metric_rollup", "content_hash", "query_route", "chunk_documents", "rate_limit", "breaker_states", "citations", "html_text", "rerank_lexical", "context_build", "clean_chain"):
        df = catalogue.QUERIES[name](spark, sf)
        assert df.columns and df.count() > 0, name
