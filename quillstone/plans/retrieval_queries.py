"""Registered retrieval queries and their SQL.

Keyword queries are the evaluation cases' query texts against all documents. Vector
queries are the rows of ``embeddings`` whose id is divisible by 20, against all rows.
Documents and vectors are unrelated tables: hybrid queries align doc_id with vec_id,
and ask with the title and the vector of every 20th id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import evaluation as E
from quillstone.operators import retrieval as R
from quillstone.plans.broadcasting import broadcast_if_small
from quillstone.sources.tables import table


def docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "title")


def cases(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "eval_cases").select(F.col("id").alias("query_id"), "query", "category", "expected_answer")


def vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def vector_queries(spark: SparkSession, root: str) -> DataFrame:
    return vectors(spark, root).where("id % 20 = 0").select(F.col("id").alias("query_id"), "v", F.col("label").alias("query_label"))


def titles(spark: SparkSession, root: str) -> DataFrame:
    return docs(spark, root).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("title").alias("query"))


def big(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("bigint"))


def tokenize_counts(spark, root):
    return R.postings(docs(spark, root)).groupBy("id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf"))


def stemmed_terms(spark, root):
    found = T.without(T.tokens(F.col("text")), T.INDEX_STOPWORDS)
    words = docs(spark, root).select(F.explode(found).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return words.groupBy(T.stem(F.col("t")).alias("term")).agg(F.sum("n").alias("n"), F.count("*").alias("n_forms"))


def idf_table(spark, root):
    d = docs(spark, root)
    df = R.postings(d).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(d.agg(F.count("*").alias("n")))).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def doc_length_stats(spark, root):
    n = F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0))
    return docs(spark, root).agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.round(F.avg(n), 6).alias("avg_length"), F.max(n).cast("bigint").alias("max_length"))


def bm25_batch(spark, root):
    return big(R.bm25(docs(spark, root), cases(spark, root), 10))


def bm25_filtered(spark, root):
    return big(R.bm25(docs(spark, root), cases(spark, root), 5, keep=F.col("lang") == "en"))


def bm25_multifield(spark, root):
    """The better of the scores of text and title; the best ten of both are among the best ten of each."""
    d, q = docs(spark, root), cases(spark, root)
    both = R.bm25(d, q, 10).select("query_id", "id", "score").unionByName(R.bm25(d, q, 10, text="title").select("query_id", "id", "score"))
    return big(R.merge_variants(both, 10))


def vector_batch(spark, root):
    return big(R.vector_search(vectors(spark, root), vector_queries(spark, root), 10))


def vector_filtered(spark, root):
    """Only vectors of the query's own label are candidates."""
    queries = vector_queries(spark, root).withColumnRenamed("query_label", "label")
    return big(R.vector_search(vectors(spark, root), queries, 5, same="label"))


def vector_threshold(spark, root):
    return big(R.vector_search(vectors(spark, root), vector_queries(spark, root), 10, threshold=0.35))


def _lists(spark, root):
    """Keyword and vector lists of the aligned queries, each over its whole table."""
    keyword = R.bm25(docs(spark, root), titles(spark, root), 20)
    vector = R.vector_search(vectors(spark, root), vector_queries(spark, root).select("query_id", "v"), 20)
    return keyword, vector


def rrf_fusion(spark, root):
    keyword, vector = _lists(spark, root)
    return big(R.rrf(R.union_lists(bm25=keyword, vector=vector)))


def rrf_weighted(spark, root):
    keyword, vector = _lists(spark, root)
    return big(R.rrf(R.union_lists(bm25=keyword, vector=vector), weights={"bm25": 2.0, "vector": 1.0}))


def score_fusion(spark, root):
    keyword, vector = _lists(spark, root)
    return big(R.score_fusion(R.union_lists(bm25=keyword, vector=vector)))


def hybrid_search(spark, root):
    keyword, vector = _lists(spark, root)
    return big(R.search("hybrid", 10, keyword, vector))


def hybrid_single_list(spark, root):
    """Without vectors the keyword list passes through with its own scores."""
    return big(R.search("hybrid", 10, keyword=R.bm25(docs(spark, root), titles(spark, root), 20)))


def variant_merge(spark, root):
    """Each case's query and two paraphrases, searched at once; the best score of each document."""
    variants = cases(spark, root).select(F.col("query_id").alias("case"), F.posexplode(T.multi_query(F.col("query"), 3)).alias("variant", "query")).where("query != ''")
    asked = variants.select(F.concat_ws("#", "case", "variant").alias("query_id"), "query")
    found = R.bm25(docs(spark, root), asked, 10)
    return big(R.merge_variants(found.select(F.substring_index("query_id", "#", 1).alias("query_id"), "id", "score"), 10))


def rerank_lexical(spark, root):
    d, q = docs(spark, root), cases(spark, root)
    return big(R.rerank(R.bm25(d, q, 20), q, d, 5))


def enrich(spark, root):
    """Search results with their documents' title, source and language."""
    d = docs(spark, root)
    found = R.bm25(d, cases(spark, root), 5)
    return big(found.join(d.select("id", "title", "source", "lang"), "id", "left").select("query_id", "rank", "id", "title", F.coalesce("source", F.lit("unknown")).alias("source"), "lang"))


def _judged(spark, root):
    """``(asked, found, relevant)``: the cases, their keyword results, and as relevant the
    documents that hold the last word of the query, the subject's name; none without a name."""
    asked = cases(spark, root).select("query_id", "query")
    named = asked.select("query_id", F.lower(F.regexp_extract("query", r"([A-Za-z]+)[?.]*$", 1)).alias("name"))
    d = docs(spark, root)
    words = d.select("id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("name"))
    return asked, R.bm25(d, asked, 10), words.join(broadcast_if_small(named), "name").select("query_id", "id")


def ir_metrics(spark, root):
    return E.per_query(*_judged(spark, root)).drop("query")


def ir_metrics_mean(spark, root):
    return E.means(E.per_query(*_judged(spark, root)))


def ir_metrics_percentiles(spark, root):
    return E.percentiles(E.per_query(*_judged(spark, root)))


def ir_by_category(spark, root):
    rows = E.per_query(*_judged(spark, root)).withColumn("group", E.question_group(F.col("query")))
    return rows.groupBy("group").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("mrr", "hit_rate", "map", "recall_5")))


def cli_metrics(spark, root):
    return E.cli_metrics(*_judged(spark, root), 5)


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_counts, stemmed_terms, idf_table, doc_length_stats, bm25_batch, bm25_filtered, bm25_multifield, vector_batch, vector_filtered,
        vector_threshold, rrf_fusion, rrf_weighted, score_fusion, hybrid_search, hybrid_single_list, variant_merge, rerank_lexical, enrich,
        ir_metrics, ir_metrics_mean, ir_metrics_percentiles, ir_by_category, cli_metrics,
    )
}

TOK = "regexp_extract_all(lower({}), '[a-zA-Z0-9]+')"
STOP = ", ".join(f"'{w}'" for w in T.INDEX_STOPWORDS)
STEM = "CASE " + " ".join(f"WHEN suffix({{0}}, '{s}') AND length({{0}}) >= {len(s) + 3} THEN left({{0}}, length({{0}}) - {len(s)})" for s in T.SUFFIXES) + " ELSE {0} END"


def bm25_sql(queries: str, name: str = "bm25", text: str = "text", keep: str = "true", k: int | None = 10) -> str:
    """CTEs ending in ``name(query_id, id, score, rank)``; ``queries`` is a CTE or table (query_id, query)."""
    cut = "" if k is None else f" QUALIFY rank <= {k}"
    return f"""{name}_d AS (SELECT doc_id AS id, coalesce({TOK.format(text)}, []) AS toks, {keep} AS keep FROM documents),
{name}_s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM {name}_d),
{name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOK.format('query')}) AS term FROM {queries}) GROUP BY ALL),
{name}_w AS (SELECT DISTINCT term FROM {name}_q),
{name}_p AS (SELECT id, dl, keep, term, count(*) AS tf FROM (SELECT id, len(toks) AS dl, keep, unnest(toks) AS term FROM {name}_d) SEMI JOIN {name}_w USING (term) GROUP BY ALL),
{name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_x AS (SELECT query_id, id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * {R.K1 + 1}::DOUBLE / (tf + {R.K1}::DOUBLE * (1 - {R.B}::DOUBLE + {R.B}::DOUBLE * dl / avgdl))), 6) AS score
  FROM {name}_p JOIN {name}_q USING (term) JOIN {name}_f USING (term) CROSS JOIN {name}_s WHERE keep GROUP BY ALL),
{name} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_x WHERE score > 0{cut})"""


def vector_sql(k: int, name: str = "vec", condition: str = "true", threshold: str = "true") -> str:
    return f"""{name}_n AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
{name}_x AS (SELECT q.id AS query_id, c.id AS id, round(list_inner_product(q.v, c.v) / greatest(c.norm, 1e-10), 6) AS score FROM {name}_n q, {name}_n c WHERE q.id % 20 = 0 AND {condition}),
{name}_r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_x QUALIFY rank <= {k}),
{name} AS (SELECT * FROM {name}_r WHERE {threshold})"""


SPLIT = "list_distinct(list_filter(string_split_regex(lower({}), '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda x: x != ''))"
TITLES = "titles AS (SELECT doc_id AS query_id, title AS query FROM documents WHERE doc_id % 20 = 0)"
CASES = "cases AS (SELECT id AS query_id, query, category, expected_answer FROM eval_cases)"
LISTS = f"{TITLES}, {bm25_sql('titles', k=20)}, {vector_sql(20)}, lists AS (SELECT query_id, 'bm25' AS retriever, id, score, rank FROM bm25 UNION ALL SELECT query_id, 'vector', id, score, rank FROM vec)"
RANKED = "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM"
RRF = "(SELECT query_id, id, round(sum({w} / (60.0::DOUBLE + rank)), 6) AS score FROM lists {where} GROUP BY ALL)"
JUDGED = f"""asked AS (SELECT id AS query_id, query FROM eval_cases),
{bm25_sql('asked')}, found AS (SELECT * FROM bm25),
rel AS (SELECT a.query_id, d.id FROM (SELECT DISTINCT doc_id AS id, unnest({TOK.format('text')}) AS name FROM documents) d JOIN asked a ON d.name = lower(regexp_extract(query, '([A-Za-z]+)[?.]*$', 1)))"""
METRICS = JUDGED + ", " + E.METRICS_SQL

SQL = {
    "tokenize_counts": f"SELECT id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, max(tf) AS max_tf FROM (SELECT doc_id AS id, t, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS t FROM documents) GROUP BY ALL) GROUP BY id",
    "stemmed_terms": f"SELECT {STEM.format('t')} AS term, sum(n)::BIGINT AS n, count(*) AS n_forms FROM (SELECT t, count(*) AS n FROM (SELECT unnest({TOK.format('text')}) AS t FROM documents) WHERE t NOT IN ({STOP}) GROUP BY t) GROUP BY term",
    "idf_table": f"SELECT term, df, round(ln(((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 6) AS idf FROM (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY term)",
    "doc_length_stats": f"SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, round(avg(n), 6) AS avg_length, max(n) AS max_length FROM (SELECT coalesce(len({TOK.format('text')}), 0) AS n FROM documents)",
    "bm25_batch": f"WITH {CASES}, {bm25_sql('cases')} SELECT * FROM bm25",
    "bm25_filtered": f"WITH {CASES}, {bm25_sql('cases', keep='''coalesce(lang = 'en', false)''', k=5)} SELECT * FROM bm25",
    "bm25_multifield": f"WITH {CASES}, {bm25_sql('cases', 'bt', k=None)}, {bm25_sql('cases', 'bh', text='title', k=None)} {RANKED} (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score FROM bt UNION ALL SELECT query_id, id, score FROM bh) GROUP BY ALL) QUALIFY rank <= 10",
    "vector_batch": f"WITH {vector_sql(10)} SELECT * FROM vec",
    "vector_filtered": f"WITH {vector_sql(5, condition='q.label = c.label')} SELECT * FROM vec",
    "vector_threshold": f"WITH {vector_sql(10, threshold='score >= 0.35')} SELECT * FROM vec",
    "rrf_fusion": f"WITH {LISTS} {RANKED} {RRF.format(w='1.0::DOUBLE', where='')}",
    "rrf_weighted": f"WITH {LISTS} {RANKED} {RRF.format(w='''CASE retriever WHEN 'bm25' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END''', where='')}",
    "score_fusion": f"""WITH {LISTS}, scaled AS (SELECT query_id, id, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE max(score) OVER w - min(score) OVER w END AS s FROM lists WINDOW w AS (PARTITION BY query_id, retriever))
        {RANKED} (SELECT query_id, id, round(sum(s), 6) AS score FROM scaled GROUP BY ALL)""",
    "hybrid_search": f"""WITH {LISTS}, n AS (SELECT query_id, count(DISTINCT retriever) AS n FROM lists GROUP BY query_id),
        fused AS (SELECT query_id, id, score FROM {RRF.format(w='1.0::DOUBLE', where='SEMI JOIN (SELECT query_id FROM n WHERE n > 1) USING (query_id)')} UNION ALL SELECT query_id, id, score FROM lists SEMI JOIN (SELECT query_id FROM n WHERE n = 1) USING (query_id))
        {RANKED} fused QUALIFY rank <= 10""",
    "hybrid_single_list": f"WITH {TITLES}, {bm25_sql('titles', k=20)} SELECT * FROM bm25 WHERE rank <= 10",
    "variant_merge": f"""WITH {CASES}, cleaned AS (SELECT query_id, query, trim(regexp_replace(query, '[?.!]+$', '')) AS c FROM cases),
        variants AS (SELECT query_id || '#0' AS query_id, query FROM cleaned WHERE query != '' UNION ALL SELECT query_id || '#1', 'What is ' || c || '?' FROM cleaned UNION ALL SELECT query_id || '#2', 'How does ' || c || ' work?' FROM cleaned),
        {bm25_sql('variants')} {RANKED} (SELECT split_part(query_id, '#', 1) AS query_id, id, max(score) AS score FROM bm25 GROUP BY ALL) QUALIFY rank <= 10""",
    "rerank_lexical": f"""WITH {CASES}, {bm25_sql('cases', k=20)},
        s AS (SELECT query_id, id, rank, query, {SPLIT.format('query')} AS a, {SPLIT.format('text')} AS b FROM bm25 JOIN cases USING (query_id) JOIN documents ON doc_id = id)
        {RANKED} (SELECT query_id, id, CASE WHEN coalesce(query, '') = '' THEN -rank::DOUBLE ELSE coalesce(round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6), 0.0::DOUBLE) END AS score FROM s) QUALIFY rank <= 5""",
    "enrich": f"WITH {CASES}, {bm25_sql('cases', k=5)} SELECT query_id, rank, id, title, coalesce(source, 'unknown') AS source, lang FROM bm25 LEFT JOIN documents ON doc_id = id",
    "ir_metrics": f"WITH {METRICS} SELECT * EXCLUDE (query) FROM metrics",
    "ir_metrics_mean": f"WITH {METRICS} SELECT count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in E.COLUMNS)} FROM metrics",
    "ir_metrics_percentiles": f"WITH {METRICS} {E.PERCENTILES_SQL}",
    "ir_by_category": f"WITH {METRICS} SELECT {E.GROUP_SQL} AS \"group\", count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('mrr', 'hit_rate', 'map', 'recall_5'))} FROM metrics GROUP BY 1",
    "cli_metrics": f"WITH {JUDGED} {E.CLI_SQL}",
}
