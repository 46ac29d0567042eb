"""Registered queries over the registry, events and metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import evaluation as E
from quillstone.operators import monitoring as M
from quillstone.operators import registry as R
from quillstone.sources import files
from quillstone.sources.tables import table



def registry(spark, root):
    return table(spark, root, "doc_registry")


def events(spark, root):
    return table(spark, root, "events")


def content_hash(spark, root):
    d = table(spark, root, "documents").where("text is not null")
    return d.groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def incremental_plan(spark, root):
    """What the last two batches bring, against the batches before."""
    rows = registry(spark, root).select("rec_id", "batch_no", "filename", F.nullif(F.lower(F.regexp_extract("file_hash", r"([0-9A-Fa-f]{64})", 1)), F.lit("")).alias("digest"))
    plan = R.plan_ingest(rows.where("batch_no < 7").select("filename", "digest"), rows.where("batch_no >= 7"), "filename", "digest")
    return plan.select("rec_id", "action")


def upsert_registry(spark, root):
    """Later batches upsert the first by file name; the first's creation time stays."""
    rows = registry(spark, root).where("filename is not null").select("filename", "rec_id", "batch_no", "size_bytes", "created_at")
    last = rows.where("batch_no > 0").groupBy("filename").agg(F.max_by(F.struct("rec_id", "batch_no", "size_bytes", "created_at"), "rec_id").alias("r")).select("filename", "r.*")
    first = rows.where("batch_no = 0").groupBy("filename").agg(F.max_by(F.struct("rec_id", "batch_no", "size_bytes", "created_at"), "rec_id").alias("r")).select("filename", "r.*")
    return R.upsert_documents(first, last, "filename").withColumn("created_at", F.unix_micros("created_at"))


def delete_cascade(spark, root):
    """Chunks that stay when the documents of the most common settings go."""
    docs, chunks = registry(spark, root).select("id", "settings_id"), table(spark, root, "chunks").select("id", "document_id", "chunk_index")
    _, left = R.delete_documents(docs, chunks, docs.where("settings_id = 1 or settings_id is null"))
    return left.groupBy("document_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


def documents_page(spark, root):
    return R.page(registry(spark, root).select("id", "filename", "created_at"), 40, 20).withColumn("created_at", F.unix_micros("created_at"))


def find_like(spark, root):
    return R.matching(registry(spark, root).select("id", "filename", "source_url", "mime_type"), filename="-limit", mime_type="html").select("id", "filename")


def chunk_totals(spark, root):
    return R.chunk_totals(registry(spark, root).select("id", "chunk_count"), table(spark, root, "chunks")).select("id", "chunk_count", "n_chunks", "n_indexed", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def crawl_groups(spark, root):
    """Records and slugs of each crawl group; each URL also with a user, port, capitals, query and fragment."""
    url = F.col("source_url")
    dressed = F.concat(F.replace(F.replace(url, F.lit("://www."), F.lit("://user:key@WWW.")), F.lit(".example/"), F.lit(".example:8443/A%20b/")), F.lit("/Page_1.HTML?q=a/b&r=1#top/end"))
    rows = registry(spark, root).select(F.explode(F.array(url, dressed, F.concat(url, F.lit("/index.html/")))).alias("url")).where("url is not null")
    return rows.groupBy(T.crawl_group(F.col("url")).alias("crawl_group")).agg(F.count("*").alias("n"), F.min(T.slug(F.col("url"))).alias("slug"))


def validate_files(spark, root):
    rows = registry(spark, root)
    return rows.select("rec_id", R.validate_file(F.col("filename"), F.col("size_bytes"), files.KINDS, 20_000).alias("error"), files.detect_kind(F.col("filename")).alias("kind"))


def cache_join(spark, root):
    """Which chunk contents are among the index's cached ones."""
    index = table(spark, root, "index_chunks").where("content is not null")
    cache = index.select(F.sha2(F.encode(F.concat(F.lit("m:"), "content"), "UTF-8"), 256).alias("cache_key"))
    wanted = table(spark, root, "chunks").where("content is not null").select("content").distinct()
    return R.cache_lookup(wanted, cache, "content", "m").groupBy("hit").agg(F.count("*").alias("n"))


def csv_row_text(spark, root):
    return files.row_text(table(spark, root, "part"), "p_partkey")


def metadata_filtered(spark, root):
    rows = table(spark, root, "index_chunks").select("id", "document_id", "chunk_index", F.map_concat(F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.create_map(F.lit("timestamp"), F.substring("created_at", 1, 19))).alias("m"))
    return M.metadata_filter(rows, "m", since="2024-01-10 00:00:00", until="2024-01-20 00:00:00").select("id", "document_id", "chunk_index")


def mask_metadata(spark, root):
    rows = events(spark, root).select("event_id", F.create_map(F.lit("api_token"), F.col("user_id").cast("string"), F.lit("props"), F.col("props")).alias("m"))
    return rows.select("event_id", M.mask(F.col("m"))["api_token"].alias("token"), M.mask(F.col("m"))["props"].alias("props"))


def metric_rollup(spark, root):
    return M.rollup(events(spark, root), "event_type", "value")


def metric_gauges(spark, root):
    return M.gauges(events(spark, root), "event_type", "value", "ts", "event_id")


def metric_percentiles(spark, root):
    v = F.col("value")
    return events(spark, root).groupBy("event_type").agg(F.round(F.median(v), 6).alias("p50"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"), F.round(F.stddev_samp(v), 6).alias("sd"))


def rate_limit_window(spark, root):
    rows = M.windowed_counts(events(spark, root), "user_id", "ts", 6 * 3600, 3)
    return rows.groupBy("user_id").agg(F.max("in_window").alias("peak"), F.count_if("over").alias("over"))


def rate_limit(spark, root):
    rows = M.rate_limit(events(spark, root), "user_id", "ts", "event_id", 6 * 3600, 2)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"))


def breaker_states(spark, root):
    rows = M.breaker(events(spark, root), "user_id", "ts", "event_id", F.col("value") < 1, failures=2, recovery=86_400)
    return rows.groupBy("user_id", "state").agg(F.count("*").alias("n"))


def _yearly(spark, root, year):
    rows = table(spark, root, "lineitem").where(F.year("l_shipdate") == year)
    return rows.groupBy(F.concat_ws("/", "l_returnflag", "l_linestatus").alias("metric")).agg(F.round(F.avg("l_quantity"), 4).alias("value"))


def metric_compare(spark, root):
    return E.compare(_yearly(spark, root, 1995), _yearly(spark, root, 1996), 0.001)


def experiment_compare(spark, root):
    return E.compare_experiments(_yearly(spark, root, 1994), _yearly(spark, root, 1997))


def trend_variance(spark, root):
    daily = events(spark, root).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    return E.variance_ranking(daily.select(F.col("event_type").alias("metric"), "value"))


def dataset_stats(spark, root):
    return table(spark, root, "eval_cases").groupBy("category", F.coalesce("difficulty", F.lit("unknown")).alias("difficulty")).agg(F.count("*").alias("n"), F.sum(F.size("expected_documents")).alias("documents"))


def dataset_validate(spark, root):
    return R.dataset_errors(table(spark, root, "eval_cases"))


QUERIES = {
    f.__name__: f
    for f in (
        content_hash, incremental_plan, upsert_registry, delete_cascade, documents_page, find_like, chunk_totals, crawl_groups, validate_files, cache_join,
        csv_row_text, metadata_filtered, mask_metadata, metric_rollup, metric_gauges, metric_percentiles, rate_limit_window, rate_limit, breaker_states,
        metric_compare, experiment_compare, trend_variance, dataset_stats, dataset_validate,
    )
}

HASH = "nullif(lower(regexp_extract(file_hash, '([0-9A-Fa-f]{64})', 1)), '')"
_YEAR = lambda y: f"SELECT concat_ws('/', l_returnflag, l_linestatus) AS metric, round(avg(l_quantity), 4) AS value FROM lineitem WHERE year(l_shipdate) = {y} GROUP BY 1"
_BOTH = lambda a, b: f"rows AS (SELECT coalesce(x.metric, y.metric) AS metric, coalesce(x.value, 0.0::DOUBLE) AS baseline, coalesce(y.value, 0.0::DOUBLE) AS current FROM ({_YEAR(a)}) x FULL JOIN ({_YEAR(b)}) y ON x.metric = y.metric)"
_KINDS = ", ".join(f"'{k}'" for k in files.KINDS)

SQL = {
    "content_hash": "SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "incremental_plan": f"""WITH r AS (SELECT rec_id, batch_no, filename, {HASH} AS digest FROM doc_registry), o AS (SELECT * FROM r WHERE batch_no < 7)
        SELECT rec_id, CASE WHEN digest IN (SELECT digest FROM o WHERE digest IS NOT NULL) THEN 'unchanged' WHEN filename IN (SELECT filename FROM o WHERE filename IS NOT NULL) THEN 'changed' ELSE 'new' END AS action FROM r WHERE batch_no >= 7""",
    "upsert_registry": """WITH r AS (SELECT filename, max_by(rec_id, rec_id) AS rec_id, batch_no > 0 AS late, arg_max(batch_no, rec_id) AS batch_no, arg_max({'v': size_bytes}, rec_id).v AS size_bytes, arg_max({'v': created_at}, rec_id).v AS created_at FROM doc_registry WHERE filename IS NOT NULL GROUP BY filename, batch_no > 0)
        SELECT filename, rec_id, batch_no, size_bytes, epoch_us(coalesce(o.created_at, r.created_at)) AS created_at FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY filename ORDER BY late DESC) = 1) r LEFT JOIN (SELECT filename, created_at FROM r WHERE NOT late) o USING (filename)""",
    "delete_cascade": "SELECT document_id, count(*) AS n, count(DISTINCT id) AS n_ids FROM chunks WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM doc_registry WHERE settings_id = 1 OR settings_id IS NULL) GROUP BY 1",
    "documents_page": "SELECT id, filename, epoch_us(created_at) AS created_at FROM (SELECT id, filename, created_at FROM doc_registry ORDER BY created_at DESC NULLS LAST, id LIMIT 20 OFFSET 40)",
    "find_like": "SELECT id, filename FROM doc_registry WHERE filename LIKE '%-limit%' AND mime_type LIKE '%html%'",
    "chunk_totals": "SELECT d.id, chunk_count, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_indexed, 0)::BIGINT AS n_indexed, coalesce(tokens, 0)::BIGINT AS tokens FROM doc_registry d LEFT JOIN (SELECT document_id, count(DISTINCT id) AS n_chunks, count(*) FILTER (indexed) AS n_indexed, sum(token_count) AS tokens FROM chunks GROUP BY 1) c ON c.document_id = d.id",
    "crawl_groups": """WITH u AS (SELECT unnest([source_url, replace(replace(source_url, '://www.', '://user:key@WWW.'), '.example/', '.example:8443/A%20b/') || '/Page_1.HTML?q=a/b&r=1#top/end', source_url || '/index.html/']) AS url FROM doc_registry),
        r AS (SELECT regexp_extract(url, '^[A-Za-z]+://(?:[^/?#]*@)?([^/?#:]*)', 1) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS whole FROM u WHERE url IS NOT NULL),
        s AS (SELECT host, regexp_replace(whole, '/+$', '') AS bare, list_filter(string_split(whole, '/'), lambda p: p != '') AS path FROM r)
        SELECT array_to_string(list_concat([replace(host, '.', '-')], CASE WHEN path[-1] IN ('index', 'index.html') THEN path[:-2] ELSE path END), '-') AS crawl_group, count(*) AS n,
        min(CASE WHEN regexp_extract(bare, '([^/]*)$', 1) = '' THEN 'index' ELSE lower(regexp_replace(regexp_extract(bare, '([^/]*)$', 1), '[^\\p{L}\\p{N}_-]', '-', 'g')) END) AS slug FROM s GROUP BY 1""",
    "validate_files": f"SELECT rec_id, CASE WHEN coalesce(filename, '') = '' THEN 'File not found' WHEN size_bytes IS NULL OR size_bytes <= 0 THEN 'File is empty' WHEN size_bytes > 20000 THEN 'File too large' WHEN lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) NOT IN ({_KINDS}) THEN 'Unsupported file type' END AS error, CASE lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in files.KINDS.items())} END AS kind FROM doc_registry",
    "cache_join": "SELECT content IN (SELECT content FROM index_chunks WHERE content IS NOT NULL) AS hit, count(*) AS n FROM (SELECT DISTINCT content FROM chunks WHERE content IS NOT NULL) GROUP BY 1",
    "csv_row_text": "SELECT p_partkey, concat_ws(' | ', " + ", ".join(f"'{c}: ' || nullif({c}::VARCHAR, '')" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")) + ") AS text FROM part",
    "metadata_filtered": "SELECT id, document_id, chunk_index FROM index_chunks WHERE CASE WHEN coalesce(metadata['date'], '') != '' THEN try_cast(metadata['date'] AS TIMESTAMP) WHEN coalesce(metadata['created_at'], '') != '' THEN try_cast(metadata['created_at'] AS TIMESTAMP) ELSE try_cast(left(created_at, 19) AS TIMESTAMP) END BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'",
    "mask_metadata": "SELECT event_id, '***' AS token, props FROM events",
    "metric_rollup": "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "metric_gauges": "SELECT event_type, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1",
    "metric_percentiles": "SELECT event_type, round(median(value), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1",
    "rate_limit_window": "SELECT user_id, max(w) AS peak, count(*) FILTER (w > 3) AS over FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS w FROM events) GROUP BY 1",
    "metric_compare": f"WITH {_BOTH(1995, 1996)} SELECT metric, baseline, current, round(current - baseline, 6) AS change, CASE WHEN baseline > 0 THEN current - baseline < -0.001 * baseline ELSE current < baseline END AS regression FROM rows",
    "experiment_compare": f"WITH {_BOTH(1994, 1997)} SELECT metric, baseline, current, round_even(CASE WHEN baseline = 0 THEN CASE WHEN current > 0 THEN 100 ELSE 0 END ELSE (current - baseline) / abs(baseline) * 100 END, 2)::DOUBLE AS change_pct, current > baseline AS improved FROM rows WHERE baseline != 0 OR current != 0",
    "trend_variance": "SELECT event_type AS metric, round(var_pop(v), 6) AS variance, count(*) AS runs FROM (SELECT event_type, ts::DATE AS day, avg(value) AS v FROM events GROUP BY ALL) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "dataset_stats": "SELECT category, coalesce(difficulty, 'unknown') AS difficulty, count(*) AS n, sum(len(expected_documents))::BIGINT AS documents FROM eval_cases GROUP BY ALL",
    "dataset_validate": "SELECT id, error FROM (SELECT id, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id' WHEN coalesce(trim(query), '') = '' THEN 'empty query' WHEN coalesce(trim(expected_answer), '') = '' THEN 'no expected answer' WHEN coalesce(len(expected_documents), 0) = 0 THEN 'no expected documents' END AS error FROM eval_cases) WHERE error IS NOT NULL",
}
