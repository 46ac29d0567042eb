"""Registered queries over texts: cleaning, query processing, chunking, generation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import chunking as C
from quillstone.operators import evaluation as E
from quillstone.operators import generation as G
from quillstone.operators import retrieval as R
from quillstone.operators import routing
from quillstone.plans.retrieval_queries import CASES, bm25_sql, cases, docs
from quillstone.plans.staging import stage
from quillstone.sources.tables import table


def contents(spark, root):
    return table(spark, root, "doc_registry").select("rec_id", "content")


def _cleaned(change):
    def query(spark, root):
        after = change(F.col("content"))
        return contents(spark, root).select("rec_id", F.md5(F.encode(after, "UTF-8")).alias("cleaned"), F.length(after).cast("bigint").alias("size"), (after != F.col("content")).alias("changed"))

    return query


def messy(column):
    """Content with the damage that page extraction leaves: tabs, double blanks, hyphenated lines, blank lines."""
    for a, b in ((" th", "\t  th"), (". ", ".\n\n\n\n"), ("er ", "er-\n"), (", ", " ​,\x01 ")):
        column = F.replace(column, F.lit(a), F.lit(b))
    return column


clean_controls = _cleaned(lambda c: T.strip_controls(messy(c)))
clean_whitespace = _cleaned(lambda c: T.normalize_whitespace(messy(c)))
clean_blank_lines = _cleaned(lambda c: T.collapse_blank_lines(messy(c)))
clean_page_artifacts = _cleaned(lambda c: T.join_broken_lines(messy(c)))
clean_entities = _cleaned(lambda c: T.unescape_common(c))


def clean_chain(spark, root):
    """All steps in order on the registry's contents, with sizes before and after."""
    before = F.col("content")
    after = T.collapse_blank_lines(T.normalize_whitespace(T.strip_controls(C.normalize_unicode(C.unescape(before)))))
    return contents(spark, root).withColumn("cleaned", after).select("rec_id", "cleaned", *T.change_stats(before, F.col("cleaned")))


def clean_stats(spark, root):
    before, after = messy(F.col("content")), T.collapse_blank_lines(messy(F.col("content")))
    return contents(spark, root).select("rec_id", *_named_stats(before, after))


def _named_stats(before, after):
    names = ["chars_before", "chars_after", "chars_removed", "lines_before", "lines_after"]
    return [c.cast("bigint").alias(n) for c, n in zip(T.change_stats(before, after), names)]


def html_text(spark, root):
    """Text of contents with markup, by a parser that drops scripts, styles and page furniture."""
    return C.html_to_text(contents(spark, root).where(F.col("content").rlike("<[a-zA-Z/]")), "rec_id", "content")


def query_normalize(spark, root):
    q = cases(spark, root).withColumn("clean", T.preprocess_query(F.concat(F.lit("  `"), F.replace("query", F.lit(" "), F.lit("\t ")), F.lit("~ "))))
    return q.select("query_id", "clean", T.query_error(F.col("clean"), 1, 500).alias("error"))


def _asked(spark, root):
    """The cases' queries and expected answers, each behind one of six openings."""
    openings = ["", "Compare ", "Summarize ", "How do I know: ", "Tutorial: ", "TL;DR "]
    n = F.length("text") % 6
    chosen = F.element_at(T.strings(openings), (n + 1).cast("int"))
    one = table(spark, root, "eval_cases").select("id", F.explode(F.array("query", "expected_answer")).alias("text")).where("text is not null")
    return one.select("id", F.concat(chosen, "text").alias("query"))


def query_type(spark, root):
    return _asked(spark, root).groupBy("id", "query").agg(F.first(T.query_type(F.col("query"))).alias("query_type"))


def query_classify(spark, root):
    q = F.col("query")
    return _asked(spark, root).distinct().select("id", "query", T.query_type(q).alias("query_type"), T.complexity(q).alias("complexity"), T.specificity(q).alias("specificity"))


def query_route(spark, root):
    return routing.route(_asked(spark, root).distinct(), "query").select("id", "query", "strategy", "top_k", "rerank")


def query_variants(spark, root):
    q = F.col("query")
    rows = cases(spark, root).where("query != ''")
    return rows.select("query_id", T.hypothetical(q).alias("hypothetical"), F.array_join(T.multi_query(q, 6), "|").alias("paraphrases"), T.step_back(q).alias("step_back"), T.expand_terms(q).alias("expanded"))


def sentence_split(spark, root):
    return docs(spark, root).select("id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def chunk_documents(spark, root):
    return C.chunk(docs(spark, root), "id", "text", target=120, most=200, overlap=20)


def chunk_windows(spark, root):
    """Fixed windows of 100 words with the last 20 of the window before."""
    return C.fixed_windows(docs(spark, root), "id", "text", 100, 20)


def context_budget(spark, root):
    """Of each source's documents in order of id the distinct ones that fit a budget of words."""
    d = docs(spark, root).where("text is not null and source is not null")
    sized = d.select(F.col("source").alias("query_id"), "id", T.word_count(F.col("text")).cast("bigint").alias("size"), F.sha2(F.encode("text", "UTF-8"), 256).alias("h"))
    once = sized.groupBy("query_id", "h").agg(F.min(F.struct("id", "size")).alias("r")).select("query_id", "r.*", (-F.col("r.id")).cast("double").alias("score"))
    return G.running_budget(once, 4076).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.max("id").alias("last_id"))


def context_build(spark, root):
    """Contexts of the five best documents of each case."""
    d = docs(spark, root)
    found = R.bm25(d, cases(spark, root), 5).join(d.select("id", "text"), "id")
    return G.contexts(found, budget=2000).withColumn("context", F.md5(F.encode("context", "UTF-8")))


def prompt_build(spark, root):
    d, q = docs(spark, root), cases(spark, root)
    built = G.contexts(R.bm25(d, q, 3).join(d.select("id", "text"), "id"), budget=2000)
    asked = q.where("query != ''").select("query_id", "query").join(built, "query_id")
    return asked.select("query_id", F.md5(F.encode(G.prompt(F.col("query"), F.col("context")), "UTF-8")).alias("prompt"))


def citations(spark, root):
    """Markers written after the sentences of each expected answer, resolved against the case's documents in order."""
    rows = table(spark, root, "eval_cases").where("expected_answer is not null").select("id", "expected_documents", G.with_markers(F.col("expected_answer")).alias("answer"))
    return G.citations(rows, "id", "answer", "expected_documents")


def _pairs(spark, root):
    """The expected answer of each case and the text of its best document."""
    d, q = docs(spark, root), cases(spark, root).where("expected_answer is not null")
    best = R.bm25(d, q.select("query_id", F.col("expected_answer").alias("query")), 1)
    return best.join(d.select("id", "text"), "id").join(q.select("query_id", "expected_answer"), "query_id").select("query_id", F.col("expected_answer").alias("answer"), F.col("text").alias("reference"))


def text_metrics(spark, root):
    score = lambda c: F.round(c.cast("double"), 6)
    pairs = stage(_pairs(spark, root), "pairs")
    jaccard = pairs.select("query_id", score(E.word_overlap(F.col("answer"), F.col("reference"))).alias("overlap"))
    return E.overlaps(pairs).join(jaccard, "query_id").select("query_id", score(E.rouge1()).alias("rouge1"), "overlap", score(E.bleu()).alias("bleu"))


def rouge_l(spark, root):
    return _pairs(spark, root).select("query_id", F.round(E.rouge_l("answer", "reference"), 6).alias("rouge_l"))


def hallucination_rate(spark, root):
    return _pairs(spark, root).select("query_id", F.round(E.hallucination_rate(F.col("answer"), F.col("reference")).cast("double"), 6).alias("rate"))


QUERIES = {
    "clean_controls": clean_controls, "clean_whitespace": clean_whitespace, "clean_blank_lines": clean_blank_lines, "clean_page_artifacts": clean_page_artifacts,
    "clean_entities": clean_entities, "clean_chain": clean_chain, "clean_stats": clean_stats, "html_text": html_text, "query_normalize": query_normalize,
    "query_type": query_type, "query_classify": query_classify, "query_route": query_route, "query_variants": query_variants,
    "sentence_split": sentence_split, "chunk_documents": chunk_documents, "chunk_windows": chunk_windows, "context_budget": context_budget,
    "context_build": context_build, "prompt_build": prompt_build, "citations": citations, "text_metrics": text_metrics, "rouge_l": rouge_l,
    "hallucination_rate": hallucination_rate,
}

MESSY = "replace(replace(replace(replace(content, ' th', chr(9) || '  th'), '. ', '.' || chr(10) || chr(10) || chr(10) || chr(10)), 'er ', 'er-' || chr(10)), ', ', ' ' || chr(8203) || ',' || chr(1) || ' ')"
CLEANED = "SELECT rec_id, md5({0}) AS cleaned, length({0}) AS size, {0} != content AS changed FROM doc_registry"
LINES = "length({0}) - length(replace({0}, chr(10), '')) + 1"
WD = "[\\p{L}\\p{N}_]"
BLANKS = f"regexp_replace({MESSY}, '\\n{{2,}}', chr(10) || chr(10), 'g')"
OPENED = """asked AS (SELECT DISTINCT id, (['', 'Compare ', 'Summarize ', 'How do I know: ', 'Tutorial: ', 'TL;DR '])[(length(text) % 6) + 1] || text AS query
 FROM (SELECT id, unnest([query, expected_answer]) AS text FROM eval_cases) WHERE text IS NOT NULL)"""
TYPE = "CASE " + " ".join(f"WHEN regexp_matches(query, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:{p})($|[^\\p{{L}}\\p{{N}}_])') THEN '{n}'" for n, p in T.QUERY_TYPES.items()) + " ELSE 'general' END"
WORDS = "list_filter(string_split_regex({0}, '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda x: x != '')"
LOWER = "list_filter(string_split_regex(lower({0}), '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda x: x != '')"
COUNT = f"len({WORDS.format('query')})"
KIND = f"kinds AS (SELECT id, query, {TYPE} AS query_type, CASE WHEN {COUNT} > 15 OR contains(lower(query), ' and ') THEN 'complex' WHEN {COUNT} > 8 THEN 'moderate' ELSE 'simple' END AS complexity, CASE WHEN {COUNT} <= 4 THEN 'broad' WHEN {COUNT} >= 10 THEN 'narrow' ELSE 'medium' END AS specificity FROM asked)"
PAIRS = f"""answers AS (SELECT id AS query_id, expected_answer AS query FROM eval_cases WHERE expected_answer IS NOT NULL), {bm25_sql('answers', k=1)},
 pairs AS (SELECT query_id, query AS answer, text AS reference FROM bm25 JOIN documents ON doc_id = id JOIN answers USING (query_id)),
 worded AS (SELECT query_id, {LOWER.format('answer')} AS a, {LOWER.format('reference')} AS r FROM pairs)"""
_GRAMS = lambda x, n: f"SELECT query_id, g, count(*) AS c FROM (SELECT query_id, unnest(list_transform(generate_series(1, len({x}) - {n - 1}), lambda i: array_to_string({x}[i : i + {n - 1}], ' '))) AS g FROM worded WHERE len({x}) >= {n}) GROUP BY ALL"
NAMES = f"list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{3,}}') AND lower(w) NOT IN ({', '.join(repr(w) for w in T.STEP_BACK_STOPWORDS)}))[1:5]"

SPACE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]+"
STRIPPED = lambda x: f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"
SENTENCES = lambda x: f"list_filter(list_transform(string_split(regexp_replace({STRIPPED(x)}, '([.!?]){SPACE}', '\\1' || chr(57344), 'g'), chr(57344)), lambda s: {STRIPPED('s')}), lambda s: s != '')"
MEANING = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z]+'), lambda w: length(w) >= 2 AND w NOT IN ({', '.join(repr(w) for w in T.CONTENT_STOPWORDS)})))"

CONTEXT = lambda k: f"""{CASES}, {bm25_sql('cases', k=k)},
 d AS (SELECT query_id, id, score, text FROM bm25 JOIN documents ON doc_id = id QUALIFY row_number() OVER (PARTITION BY query_id, sha256(text) ORDER BY score DESC, id) = 1),
 o AS (SELECT query_id, text, {WORDS.format('text')} AS ws, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM d),
 c AS (SELECT query_id, place, CASE WHEN place = 1 AND len(ws) > 1980 THEN array_to_string(ws[1:1970], ' ') ELSE text END AS text, CASE WHEN place = 1 THEN least(len(ws), CASE WHEN len(ws) > 1980 THEN 1970 ELSE len(ws) END) ELSE len(ws) END AS size FROM o),
 f AS (SELECT query_id, place, text FROM c QUALIFY sum(size) OVER (PARTITION BY query_id ORDER BY place) <= 1980),
 built AS (SELECT query_id, '<context>' || chr(10) || string_agg('<source id="' || place || '">' || text || '</source>', chr(10) || chr(10) ORDER BY place) || chr(10) || '</context>' AS context, count(*) AS n_sources FROM f GROUP BY query_id)"""  # noqa: E731

SQL = {
    "context_build": f"WITH {CONTEXT(5)} SELECT query_id, md5(context) AS context, n_sources FROM built",
    "prompt_build": f"WITH {CONTEXT(3)} SELECT query_id, md5('{G.SYSTEM}{G.CITE}' || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query) AS prompt FROM built JOIN cases USING (query_id) WHERE query != ''",
    "clean_controls": CLEANED.format(f"regexp_replace({MESSY}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\p{{Cf}}\\p{{Co}}]', '', 'g')"),
    "sentence_split": f"SELECT id, (unnest(generate_series(1, len(s))) - 1)::INTEGER AS pos, unnest(s) AS sentence FROM (SELECT doc_id AS id, {SENTENCES('text')} AS s FROM documents WHERE text IS NOT NULL)",
    "citations": f"SELECT id, '[' || i || ']' AS marker, d[i] AS source, left(d[i], 200) AS snippet FROM (SELECT id, expected_documents AS d, unnest(generate_series(1, len({SENTENCES('expected_answer')}))) AS i FROM eval_cases WHERE expected_answer IS NOT NULL)",
    "hallucination_rate": f"""WITH {PAIRS}, w AS (SELECT query_id, {SENTENCES('answer')} AS s, {MEANING('reference')} AS known FROM pairs),
        o AS (SELECT query_id, known, {MEANING('sentence')} AS own FROM (SELECT query_id, known, unnest(s) AS sentence FROM w)),
        b AS (SELECT query_id, count(*) AS n, count(*) FILTER (len(own) > 0 AND len(list_filter(own, lambda x: NOT list_contains(known, x))) > len(own) * 0.5) AS bad FROM o GROUP BY query_id)
        SELECT query_id, coalesce(round(bad / n, 6), 0.0::DOUBLE) AS rate FROM pairs LEFT JOIN b USING (query_id)""",
    "clean_whitespace": CLEANED.format(f"regexp_replace(regexp_replace(regexp_replace({MESSY}, '[\\t\\x0b\\f\\r\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g'), ' \\n', chr(10), 'g'), ' $', '')"),
    "clean_blank_lines": CLEANED.format(BLANKS),
    "clean_page_artifacts": CLEANED.format(f"regexp_replace(regexp_replace({MESSY}, '({WD})-\\n({WD})', '\\1\\2', 'g'), '({WD})\\n([a-z])', '\\1\\2', 'g')"),
    "clean_entities": CLEANED.format("replace(replace(replace(replace(replace(content, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"),
    "clean_stats": f"SELECT rec_id, length(b) AS chars_before, length(a) AS chars_after, length(b) - length(a) AS chars_removed, {LINES.format('b')} AS lines_before, {LINES.format('a')} AS lines_after FROM (SELECT rec_id, {MESSY} AS b, {BLANKS} AS a FROM doc_registry)",
    "query_normalize": "SELECT id AS query_id, c AS clean, CASE WHEN c IS NULL OR c = '' THEN 'Query is empty' WHEN length(c) > 500 THEN 'Query is too long' END AS error FROM (SELECT id, trim(replace(replace(trim(regexp_replace('  `' || replace(query, ' ', chr(9) || ' ') || '~ ', '\\s+', ' ', 'g')), '`', ''), '~', '')) AS c FROM eval_cases)",
    "query_type": f"WITH {OPENED} SELECT id, query, {TYPE} AS query_type FROM asked",
    "query_classify": f"WITH {OPENED}, {KIND} SELECT * FROM kinds",
    "query_route": f"WITH {OPENED}, {KIND} {routing.SQL}",
    "query_variants": f"""SELECT id AS query_id, '{T.HYPOTHETICAL}' || query AS hypothetical, array_to_string([query, {', '.join("'" + t.replace('{q}', "' || c || '") + "'" for t in T.TEMPLATES[:5])}], '|') AS paraphrases,
        CASE WHEN len({NAMES}) > 0 THEN '{T.STEP_BACK}' || array_to_string({NAMES}, ' ') ELSE '{T.NO_TERMS}' END AS step_back,
        CASE WHEN len(e) > 0 THEN query || ' ' || array_to_string(e, ' ') ELSE query END AS expanded
        FROM (SELECT id, query, trim(regexp_replace(query, '[?.!]+$', '')) AS c, list_filter(list_transform({WORDS.format('query')}, lambda w: lower(trim(w, '.,;:!?'))), lambda w: length(w) > 2 AND w NOT IN ({', '.join(repr(w) for w in T.EXPANSION_STOPWORDS)}))[1:3] AS e FROM eval_cases WHERE query != '')""",
    "chunk_windows": f"""WITH w AS (SELECT doc_id AS id, {WORDS.format('text')} AS ws FROM documents WHERE text IS NOT NULL),
        c AS (SELECT id, ws, unnest(generate_series(0, (len(ws) - 1) // 100)) AS n FROM w WHERE len(ws) > 0)
        SELECT id, n::INTEGER AS chunk_index, array_to_string(ws[greatest(n * 100 - 20, 0) + 1 : n * 100 + 100], ' ') AS content, sha256(id || ':' || n || ':' || array_to_string(ws[greatest(n * 100 - 20, 0) + 1 : n * 100 + 100], ' ')) AS chunk_id FROM c""",
    "context_budget": f"""WITH d AS (SELECT source AS query_id, doc_id AS id, {WORDS.format('text')} AS ws, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS copy FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
        s AS (SELECT query_id, id, len(ws) AS size, sum(len(ws)) OVER (PARTITION BY query_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS total FROM d WHERE copy = 1)
        SELECT query_id, count(*) AS n, sum(size)::BIGINT AS words, max(id) AS last_id FROM s WHERE total <= 4076 GROUP BY query_id""",
    "text_metrics": f"""WITH {PAIRS},
        {', '.join(f'a{n} AS ({_GRAMS("a", n)}), r{n} AS ({_GRAMS("r", n)}), m{n} AS (SELECT query_id, sum(least(a{n}.c, r{n}.c)) AS both FROM a{n} JOIN r{n} USING (query_id, g) GROUP BY query_id)' for n in range(1, 5))},
        p AS (SELECT w.query_id, len(a) AS la, len(r) AS lr, list_distinct(a) AS da, list_distinct(r) AS dr, {', '.join(f'coalesce(m{n}.both, 0) AS b{n}' for n in range(1, 5))} FROM worded w {' '.join(f'LEFT JOIN m{n} USING (query_id)' for n in range(1, 5))})
        SELECT query_id, round(CASE WHEN b1 > 0 THEN 2 * b1 / (la + lr) ELSE 0 END, 6)::DOUBLE AS rouge1, round(len(list_intersect(da, dr)) / len(list_distinct(list_concat(da, dr))), 6)::DOUBLE AS overlap,
        round(CASE WHEN {' OR '.join(f'(la >= {n} AND b{n} = 0)' for n in range(1, 5))} THEN 0 ELSE least(1, exp(1 - lr / la)) * exp(({' + '.join(f'CASE WHEN la >= {n} THEN ln(b{n} / (la - {n - 1})) ELSE 0 END' for n in range(1, 5))}) / least(la, 4)) END, 6)::DOUBLE AS bleu FROM p""",
}
