"""Text expressions: tokens, stems, cleaning, sentences, query rewriting. All are Column -> Column and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, with and without the line feed; letters, digits and underscore.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
WSN = r"[\t\x0b\f\r\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

# Word lists, patterns and templates that results depend on.
INDEX_STOPWORDS = (
    "a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might "
    "shall can need dare ought used this that these those i me my we our you your he him his she her it its they them their what which who whom"
).split()
STEP_BACK_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from "
    "as into about between through during before after above below and but or nor not so yet both either neither each every all any few more most "
    "other some such no only own same than too very just that this these those what which who whom whose when where why how i me my myself we our "
    "you your he him his she her it its they them their"
).split()
EXPANSION_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from "
    "as into about between through during before after above below and but or nor not so yet both either neither each every all any few more most "
    "other some such no only own same than too very just"
).split()
CONTENT_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought used to of in for "
    "on with at by from as into through during before after above below between out off over under again further then once here there when where "
    "why how all both each few more most other some such no nor not only own same so than too very just because but and or if while about up it its "
    "this that these those i me my we our you your he him his she her they them their what which who whom"
).split()
SUFFIXES = "ing tion ness ment ible able ies ed er ly s".split()
QUERY_TYPES = {
    "factual": r"who|what|when|where|which|how many|how much|define|definition of|meaning of",
    "summarization": r"summarize|summary|summarise|briefly explain|overview of|tldr|tl;dr",
    "comparison": r"compare|versus|vs|difference between|pros and cons|advantages and disadvantages",
    "how_to": r"how (?:do|can|to|should)|steps to|guide to|tutorial|walkthrough|instructions for",
}
TEMPLATES = ["What is {q}?", "How does {q} work?", "Explain {q} in detail.", "Tell me about {q}.", "What should I know about {q}?", "Give me an overview of {q}."]
HYPOTHETICAL = "This document provides a detailed answer about: "
NO_TERMS = "General information and context about the topic"
STEP_BACK = "Overview and background information about "


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def strip(text: Column, what: str = WS) -> Column:
    return F.regexp_replace(text, rf"^{what}+|{what}+\z", "")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9]+"), 0)


def without(words: Column, stopwords: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(stopwords))


def stem(word: Column) -> Column:
    """The first fitting suffix is dropped if three characters remain."""
    cases = F
    for s in SUFFIXES:
        cases = cases.when(F.endswith(word, F.lit(s)) & (F.length(word) >= len(s) + 3), F.substring(word, F.lit(1), F.length(word) - len(s)))
    return cases.otherwise(word)


def words(text: Column) -> Column:
    """Lower-cased, split at white space."""
    return F.filter(F.split(F.lower(text), WS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WS + "+"), lambda w: w != ""))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), r"(?<=[.!?])" + WS + "+"), strip), lambda s: s != "")


def content_words(text: Column) -> Column:
    """Distinct words of ASCII letters, at least two, that carry meaning."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(CONTENT_STOPWORDS)))


def ngrams(array: Column, n: int) -> Column:
    """All runs of n elements, joined by a blank; none if there are fewer."""
    made = F.transform(F.sequence(F.lit(1), F.size(array) - (n - 1)), lambda i: F.array_join(F.slice(array, i, n), " "))
    return F.when(F.size(array) >= n, made).otherwise(F.array().cast("array<string>"))


# Cleaning


def strip_controls(text: Column) -> Column:
    """Characters of any C category but tab, line feed and carriage return are dropped."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t\r]]", "")


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space in a line become a blank, none at its end."""
    return F.regexp_replace(F.regexp_replace(text, WSN + "+", " "), r" ?(?=\n|\z)", "")


def collapse_blank_lines(text: Column, most: int = 1) -> Column:
    return F.regexp_replace(text, rf"\n{{{most + 1},}}", "\n" * (most + 1))


def join_broken_lines(text: Column) -> Column:
    """Hyphenated and mid-sentence line ends, as page extraction leaves them."""
    return F.regexp_replace(F.regexp_replace(text, f"({WORD})-\n({WORD})", "$1$2"), f"({WORD})\n([a-z])", "$1$2")


def strip_tags(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^<>]+>", " "))


def unescape_common(text: Column) -> Column:
    """The five entities of markup itself, ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def change_stats(before: Column, after: Column) -> list[Column]:
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1
    return [
        F.length(before).alias("chars_before"), F.length(after).alias("chars_after"), (F.length(before) - F.length(after)).alias("chars_removed"),
        lines(before).alias("lines_before"), lines(after).alias("lines_after"),
    ]


# Queries


def preprocess_query(query: Column) -> Column:
    """White space to single blanks; backticks, tildes and control characters dropped."""
    return strip(F.regexp_replace(strip(F.regexp_replace(query, WS + "+", " ")), r"[`~\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def query_error(query: Column, least: int = 1, most: int = 500) -> Column:
    """Null for a valid query."""
    size = F.length(query)
    return (
        F.when(query.isNull() | (size == 0), "Query is empty").when(size < least, "Query is too short").when(size > most, "Query is too long")
    )


def query_type(query: Column) -> Column:
    """The first type one of whose phrases stands between word boundaries, else general."""
    bounded = lambda p: rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{p})(?![\p{{L}}\p{{N}}_])"
    chain = F
    for name, phrases in QUERY_TYPES.items():
        chain = chain.when(F.rlike(query, F.lit(bounded(phrases))), name)
    return chain.otherwise("general")


def complexity(query: Column) -> Column:
    n = word_count(query)
    return F.when((n > 15) | F.lower(query).contains(" and "), "complex").when(n > 8, "moderate").otherwise("simple")


def specificity(query: Column) -> Column:
    n = word_count(query)
    return F.when(n <= 4, "broad").when(n >= 10, "narrow").otherwise("medium")


def multi_query(query: Column, n: int = 4) -> Column:
    """The query and its paraphrases by template, ``n`` (1 to 6) in all."""
    n = max(1, min(n, 6))
    clean = strip(F.regexp_replace(query, r"[?.!]+\z", ""))
    made = [F.concat(F.lit(t.split("{q}")[0]), clean, F.lit(t.split("{q}")[1])) for t in TEMPLATES[: n - 1]]
    return F.array(query, *made)


def hypothetical(query: Column) -> Column:
    return F.concat(F.lit(HYPOTHETICAL), query)


def step_back(query: Column, stopwords: list[str] = STEP_BACK_STOPWORDS) -> Column:
    """A broader question from the first five meaningful words."""
    found = F.regexp_extract_all(query, F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]{3,}(?![\p{L}\p{N}_])"), 0)
    kept = F.slice(F.filter(found, lambda w: ~F.lower(w).isin(stopwords)), 1, 5)
    return F.when(F.size(kept) > 0, F.concat(F.lit(STEP_BACK), F.array_join(kept, " "))).otherwise(NO_TERMS)


def expand_terms(query: Column) -> Column:
    """The query followed by its first three meaningful words."""
    clean = F.transform(F.filter(F.split(query, WS + "+"), lambda w: w != ""), lambda w: F.lower(F.regexp_replace(w, r"^[.,;:!?]+|[.,;:!?]+\z", "")))
    kept = F.slice(F.filter(clean, lambda w: (F.length(w) > 2) & ~w.isin(EXPANSION_STOPWORDS)), 1, 3)
    return F.when(F.size(kept) > 0, F.concat(query, F.lit(" "), F.array_join(kept, " "))).otherwise(query)


def expand_synonyms(query: Column, synonyms: dict[str, list[str]]) -> Column:
    """For each known word the first synonym that isn't a part of the query yet."""
    known = F.create_map(*(F.lit(x) if isinstance(x, str) else strings(x) for pair in synonyms.items() for x in pair))
    clean = F.transform(words(query), lambda w: F.regexp_replace(w, r"^[.,;:!?]+|[.,;:!?]+\z", ""))
    found = F.transform(F.filter(clean, lambda w: w.isin(list(synonyms))), lambda w: F.get(F.filter(known[w], lambda s: ~F.contains(F.lower(query), s)), F.lit(0)))
    added = F.filter(found, lambda s: s.isNotNull())
    return F.when(F.size(added) > 0, F.concat(query, F.lit(" "), F.array_join(added, " "))).otherwise(query)


def slug(url: Column) -> Column:
    """The last path segment in lower case, other characters as hyphens; "index" without one."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    last = F.regexp_extract(path, "([^/]*)$", 1)
    return F.when(last == "", "index").otherwise(F.lower(F.regexp_replace(last, r"[^\p{L}\p{N}_-]", "-")))


def crawl_group(url: Column) -> Column:
    """Host and path of a crawl's start page, hyphenated; a trailing index page is dropped."""
    host = F.replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), F.lit("."), F.lit("-"))
    path = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    index = F.get(path, F.size(path) - 1).isin("index", "index.html")
    path = F.when(index, F.slice(path, F.lit(1), F.size(path) - 1)).otherwise(path)
    return F.array_join(F.concat(F.array(host), path), "-")
