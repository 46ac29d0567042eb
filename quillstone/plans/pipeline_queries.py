"""Registered queries of composed operators - query pipelines, ingest, experiments, reports - and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.synonyms import SYNONYMS
from quillstone.operators import chunking as C
from quillstone.operators import evaluation as E
from quillstone.operators import experiments as X
from quillstone.operators import generation as G
from quillstone.operators import ingest as I
from quillstone.operators import monitoring as M
from quillstone.operators import queries as Q
from quillstone.operators import ranking
from quillstone.operators import registry as R
from quillstone.operators.keyword_index import KeywordIndex
from quillstone.plans.registry_queries import HASH, events, registry
from quillstone.plans.retrieval_queries import CASES, big, bm25_sql, cases, docs
from quillstone.plans.staging import shared_dir
from quillstone.plans.text_queries import CLEANED, LOWER, OPENED, SENTENCES, SPACE, TYPE, _asked
from quillstone.sources import files
from quillstone.sources.tables import table


def query_pipeline(spark, root):
    """Clean, check, classify and rewrite the cases' queries and answers."""
    made = Q.process(_asked(spark, root).distinct(), strategies=("multi_query", "step_back"), n=4, most=120)
    return made.select("id", "query", "error", F.array_join("variants", "|").alias("variants"), F.array_join("strategies_used", ",").alias("used"))


def query_expand(spark, root):
    return _asked(spark, root).distinct().select("id", "query", T.expand_synonyms(F.col("query"), SYNONYMS).alias("expanded"))


def citation_checks(spark, root):
    """Answers that cite a source a sentence, and two sources that can't be."""
    rows = table(spark, root, "eval_cases").where("expected_answer is not null").select("id", "expected_documents", F.concat(G.with_markers(F.col("expected_answer")), F.lit(" [0] [99] [99]")).alias("answer"))
    return G.citation_report(rows, "id", "answer", "expected_documents").select("id", "inline", "footnotes", "block", F.array_join("warnings", "|").alias("warnings"))


def bm25_index(spark, root):
    """Search in a kept index, after its German documents have been removed."""
    index = KeywordIndex(spark, f"{shared_dir(spark)}/keywords-{uuid.uuid4().hex}")
    d = docs(spark, root)
    index.add(d, 0)
    index.remove(d.where("lang = 'de'"), 1)
    return big(index.search(cases(spark, root), 10))


def ingest_batch(spark, root):
    """Chunks of each document after the last two batches have come in."""
    digest = F.nullif(F.lower(F.regexp_extract("file_hash", r"([0-9A-Fa-f]{64})", 1)), F.lit("")).alias("file_hash")
    rows = registry(spark, root).select("id", "rec_id", "batch_no", "filename", digest, "content")
    stored, incoming = (rows.where(c).drop("batch_no") for c in ("batch_no < 7", "batch_no >= 7"))
    cutter = lambda d: C.fixed_windows(d, "id", "content", 100, 20)
    _, chunks, _ = I.ingest(stored, I.chunked(stored, cutter, clean=False), incoming, cutter=cutter, clean=False)
    return chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("words"))


def chunk_upkeep(spark, root):
    """Chunk counts of the documents, and how many are marked once the index's chunks are."""
    chunks, d = table(spark, root, "chunks").select("id", "document_id", "indexed"), registry(spark, root).select("id", "chunk_count")
    marked = I.mark_indexed(chunks, table(spark, root, "index_chunks").where("id is not null"))
    n = marked.groupBy(F.col("document_id").alias("id")).agg(F.count_if("indexed").alias("n_indexed"))
    return I.count_chunks(d, chunks).join(n, "id", "left").select("id", "chunk_count", F.coalesce("n_indexed", F.lit(0)).alias("n_indexed"))


def chunk_order(spark, root):
    rows = table(spark, root, "chunks").select("document_id", "chunk_index", "id").distinct()
    return R.ordered_chunks(rows).select("document_id", "id", "chunk_index", F.col("place").cast("bigint").alias("place"))


def hash_lookup(spark, root):
    """Records whose file a record of another batch than the first has, too."""
    rows = registry(spark, root).select("rec_id", "batch_no", "file_hash")
    return R.lookup(rows, rows.where("batch_no > 0 and file_hash is not null"), "file_hash").select("rec_id", "file_hash")


def case_filter(spark, root):
    known = table(spark, root, "eval_cases")
    return R.cases_of(known, difficulty="easy").select("id", "category")


def _runs(spark, root):
    """Each user's events as states of one run."""
    status = F.when(F.col("value") < 1, X.FAILED).when(F.col("value") < 5, X.RUNNING).otherwise(X.COMPLETED)
    return events(spark, root).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), status.alias("status"), F.array("event_type").alias("tags"), F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("updated_at"))


def experiment_baselines(spark, root):
    return X.baselines(X.latest(_runs(spark, root))).withColumn("created_at", F.unix_micros("created_at"))


def experiment_list(spark, root):
    return X.listed(X.latest(_runs(spark, root)), status=X.COMPLETED, tag="purchase").select("run_id", "name")


def metrics_flat(spark, root):
    """Mean quantities by flag and status of each year, from nested metrics to rows."""
    rows = table(spark, root, "lineitem").groupBy(F.year("l_shipdate").alias("run_id"), "l_returnflag", "l_linestatus").agg(F.round(F.avg("l_quantity"), 4).alias("v"))
    inner = rows.groupBy("run_id", "l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "v"))).alias("m"))
    nested = inner.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "m"))).alias("metrics"))
    return X.flattened(nested)


def run_report(spark, root):
    rows = events(spark, root).withColumn("ms", F.col("user_id").cast("double"))
    return X.report(rows, ["value"], ["ms"], F.col("value") >= 1)


def nearest_ranks(spark, root):
    ranks = ranking.nearest_rank(events(spark, root), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return ranks.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


def markdown_sections(spark, root):
    """Headings of the documents, and whether each stands where its offset says."""
    d = docs(spark, root).select("id", "text")
    found = files.markdown_sections(d, "id", "text").join(d, "id")
    return found.select("id", "pos", "level", "title", (F.expr("substring(text, offset + 1, level)") == F.repeat(F.lit("#"), F.col("level"))).alias("fits"))


def table_text(spark, root):
    """The nations of each region as a text table."""
    n = table(spark, root, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    rows = F.concat(F.array(T.strings(["key", "name"])), F.transform("rows", lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"])))
    return n.select("n_regionkey", files.table_text(rows).alias("text"))


def strip_tags(spark, root):
    after = T.strip_tags(F.col("content"))
    return registry(spark, root).select("rec_id", F.md5(F.encode(after, "UTF-8")).alias("cleaned"), F.length(after).cast("bigint").alias("size"), (after != F.col("content")).alias("changed"))


def judge_scores(spark, root):
    return table(spark, root, "eval_cases").select("id", E.judge_score(F.col("expected_answer")).alias("score"))


def metric_keys(spark, root):
    key = M.metric_key(F.lit("events"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type")))
    return events(spark, root).groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def metadata_types(spark, root):
    """Chunks filtered by type and by a custom value."""
    rows = table(spark, root, "index_chunks").select("id", "chunk_index", F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("document_type"), F.when(F.col("chunk_index") % 2 == 0, "page").otherwise("note"))).alias("m"))
    return M.metadata_filter(rows, "m", types=["page", "table"], custom={"lang": "en"}).select("id", "chunk_index")


def mask_nested(spark, root):
    rows = events(spark, root).select("event_id", F.to_json(F.struct(F.struct(F.col("event_type").alias("Api_Key"), F.col("user_id").alias("token_count"), F.lit('a"b').alias("user")).alias("auth"), F.col("props").alias("password"))).alias("j"))
    return rows.select("event_id", M.mask_json(F.col("j")).alias("masked"))


QUERIES = {
    f.__name__: f
    for f in (
        query_pipeline, query_expand, citation_checks, bm25_index, ingest_batch, chunk_upkeep, chunk_order, hash_lookup, case_filter, experiment_baselines, experiment_list,
        metrics_flat, run_report, nearest_ranks, markdown_sections, table_text, strip_tags, judge_scores, metric_keys, metadata_types, mask_nested,
    )
}

_CLEAN = "trim(replace(replace(trim(regexp_replace(query, '\\s+', ' ', 'g')), '`', ''), '~', ''))"
_BARE = "trim(regexp_replace(query, '[?.!]+$', ''))"
_NAMES = f"list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{3,}}') AND lower(w) NOT IN ({', '.join(repr(w) for w in T.STEP_BACK_STOPWORDS)}))[1:5]"
_STEP = f"CASE WHEN len({_NAMES}) > 0 THEN '{T.STEP_BACK}' || array_to_string({_NAMES}, ' ') ELSE '{T.NO_TERMS}' END"
_LIST = f"[query, {', '.join(chr(39) + t.replace('{q}', chr(39) + ' || ' + _BARE + ' || ' + chr(39)) + chr(39) for t in T.TEMPLATES[:3])}, {_STEP}]"
_FIRST = lambda x: f"list_filter({x}, lambda q, i: list_position({x}, q) = i)"
_SYNONYM = "CASE w " + " ".join(f"WHEN {k!r} THEN list_filter({v!r}, lambda s: NOT contains(lower(query), s))[1]" for k, v in SYNONYMS.items()) + " END"
_RUNS = """states AS (SELECT user_id AS run_id, event_type AS name, CASE WHEN value < 1 THEN 'failed' WHEN value < 5 THEN 'running' ELSE 'completed' END AS status, ts AS created_at FROM events),
 runs AS (SELECT run_id, arg_max({'name': name, 'status': status, 'created_at': created_at}, (created_at, name, status)) AS r FROM states WHERE run_id IS NOT NULL GROUP BY run_id)"""
_CITED = f"SELECT id, d, len({SENTENCES('expected_answer')}) AS n FROM (SELECT id, coalesce(expected_documents, []) AS d, expected_answer FROM eval_cases WHERE expected_answer IS NOT NULL)"
_TAGS = f"regexp_replace(regexp_replace(content, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '<[^<>]+>', ' ', 'g')"

SQL = {
    "query_pipeline": f"""WITH {OPENED}, c AS (SELECT id, query AS raw, {_CLEAN} AS query FROM asked), v AS (SELECT id, raw, query, CASE WHEN query = '' THEN 'Query is empty' WHEN length(query) > 120 THEN 'Query is too long' END AS error, {_LIST} AS l, {_STEP} AS s FROM c)
        SELECT id, raw AS query, error, CASE WHEN error IS NULL THEN array_to_string({_FIRST('l')}, '|') ELSE '' END AS variants, CASE WHEN error IS NULL THEN CASE WHEN s = query THEN 'multi_query' ELSE 'multi_query,step_back' END ELSE '' END AS used FROM v""",
    "query_expand": f"""WITH {OPENED}, w AS (SELECT id, query, list_filter(list_transform(list_transform({LOWER.format('query')}, lambda w: trim(w, '.,;:!?')), lambda w: {_SYNONYM}), lambda s: s IS NOT NULL) AS added FROM asked)
        SELECT id, query, CASE WHEN len(added) > 0 THEN query || ' ' || array_to_string(added, ' ') ELSE query END AS expanded FROM w""",
    "citation_checks": f"""WITH c AS ({_CITED}), g AS (SELECT id, d, n, [i FOR i IN generate_series(1, least(n, len(d)))] AS k, list_concat(['citation [' || i || '] not found in context' FOR i IN generate_series(len(d) + 1, n)], ['citation [0] not found in context', 'citation [99] not found in context', 'citation [99] not found in context']) AS w FROM c)
        SELECT id, array_to_string(list_transform(k, lambda i: '[' || i || '] ' || coalesce(d[i], '')), ', ') AS inline, array_to_string(list_transform(k, lambda i: i || '. ' || coalesce(d[i], '')), chr(10)) AS footnotes,
        CASE WHEN len(k) > 0 THEN '**Sources:**' || chr(10) || chr(10) || array_to_string(list_transform(k, lambda i: '[' || i || '] *' || coalesce(d[i], '') || '* — ' || left(coalesce(d[i], ''), 200)), chr(10)) ELSE '' END AS block, array_to_string(w, '|') AS warnings FROM g""",
    "bm25_index": f"WITH {CASES}, {bm25_sql('cases').replace('FROM documents', 'FROM documents WHERE lang IS DISTINCT FROM chr(100) || chr(101)')} SELECT * FROM bm25",
    "ingest_batch": f"""WITH r AS (SELECT id, rec_id, batch_no, filename, {HASH} AS digest, content FROM doc_registry), o AS (SELECT * FROM r WHERE batch_no < 7),
        f0 AS (SELECT * FROM r WHERE batch_no >= 7 AND coalesce(digest NOT IN (SELECT digest FROM o WHERE digest IS NOT NULL), true)),
        f1 AS (SELECT * FROM f0 QUALIFY digest IS NULL OR rec_id = max(rec_id) OVER (PARTITION BY digest)), f2 AS (SELECT * FROM f1 QUALIFY filename IS NULL OR rec_id = max(rec_id) OVER (PARTITION BY filename)),
        a AS (SELECT id, content FROM o WHERE coalesce(filename NOT IN (SELECT filename FROM f2 WHERE filename IS NOT NULL), true) UNION ALL SELECT id, content FROM f2),
        n AS (SELECT id, len(list_filter(string_split_regex(content, '{SPACE}'), lambda x: x != '')) AS n FROM a WHERE content IS NOT NULL)
        SELECT id AS document_id, ((n - 1) // 100 + 1)::BIGINT AS n, (n + 20 * ((n - 1) // 100))::BIGINT AS words FROM n WHERE n > 0""",
    "chunk_upkeep": """WITH m AS (SELECT document_id, count(*) FILTER (indexed OR id IN (SELECT id FROM index_chunks WHERE id IS NOT NULL)) AS n_indexed, count(DISTINCT id)::INTEGER AS n FROM chunks GROUP BY 1)
        SELECT id, coalesce(n, 0)::INTEGER AS chunk_count, coalesce(n_indexed, 0) AS n_indexed FROM doc_registry LEFT JOIN m ON m.document_id = id""",
    "chunk_order": "SELECT document_id, id, chunk_index, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index NULLS FIRST, id) AS place FROM (SELECT DISTINCT document_id, chunk_index, id FROM chunks)",
    "hash_lookup": "SELECT rec_id, file_hash FROM doc_registry WHERE file_hash IN (SELECT file_hash FROM doc_registry WHERE batch_no > 0 AND file_hash IS NOT NULL)",
    "case_filter": "SELECT id, category FROM eval_cases WHERE difficulty = 'easy'",
    "experiment_baselines": f"WITH {_RUNS} SELECT r.name AS name, arg_max(run_id, (r.created_at, run_id)) AS run_id, epoch_us(max(r.created_at)) AS created_at FROM runs WHERE r.status = 'completed' GROUP BY 1",
    "experiment_list": f"WITH {_RUNS} SELECT run_id, r.name AS name FROM runs WHERE r.status = 'completed' AND r.name = 'purchase'",
    "metrics_flat": "SELECT year(l_shipdate)::INTEGER AS run_id, l_returnflag || '.' || l_linestatus AS metric, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY ALL",
    "run_report": "SELECT count(*) AS n, count(*) FILTER (value >= 1) AS succeeded, count(*) FILTER (NOT coalesce(value >= 1, false)) AS failed, round_even(avg(value), 4) AS value, round_even(avg(user_id::DOUBLE), 1) AS ms FROM events",
    "nearest_ranks": "SELECT event_type, n, round(mean, 6) AS mean, round(sd, 6) AS sd, v[(n * 0.5::DOUBLE)::DOUBLE // 1 + 1] AS p50, v[floor(n * 0.95::DOUBLE)::BIGINT + 1] AS p95, v[floor(n * 0.99::DOUBLE)::BIGINT + 1] AS p99 FROM (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, list_sort(list(value) FILTER (value IS NOT NULL)) AS v FROM events WHERE event_type IS NOT NULL GROUP BY 1)".replace("v[(n * 0.5::DOUBLE)::DOUBLE // 1 + 1]", "v[floor(n * 0.5::DOUBLE)::BIGINT + 1]"),
    "markdown_sections": "SELECT id, (unnest(generate_series(1, len(h))) - 1)::INTEGER AS pos, unnest(list_transform(h, lambda x: length(regexp_extract(x, '^(#{1,6})', 1))))::INTEGER AS level, unnest(list_transform(h, lambda x: regexp_extract(x, '^#{1,6}[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+(.+)$', 1))) AS title, true AS fits FROM (SELECT doc_id AS id, regexp_extract_all(text, '(?m)^#{1,6}[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+.+$') AS h FROM documents WHERE text IS NOT NULL)",
    "table_text": "SELECT n_regionkey, 'key | name' || chr(10) || repeat('-', 40) || chr(10) || string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1",
    "strip_tags": CLEANED.format(f"regexp_replace({_TAGS}, '^{SPACE}|{SPACE}$', '', 'g')"),
    "judge_scores": "SELECT id, coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, try_cast(nullif(regexp_extract(expected_answer, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE))), 0.0::DOUBLE) AS score FROM eval_cases",
    "metric_keys": "SELECT 'events{type=' || event_type || ',user=' || user_id || '}' AS key, count(*) AS n FROM events GROUP BY 1",
    "metadata_types": "SELECT id, chunk_index FROM index_chunks WHERE chunk_index % 2 = 0 AND metadata['lang'] = 'en'",
    "mask_nested": """SELECT event_id, '{"auth":{"Api_Key":"***"' || coalesce(',"token_count":' || user_id, '') || ',"user":"a\\"b"}' || CASE WHEN props IS NULL THEN '' ELSE ',"password":"***"' END || '}' AS masked FROM events""",
}
