"""Evaluation texts leaking into training text.

The test passages are the stated query set: a measured, broadcast block at a time they
are held against every document in one scan, without a shuffle. Runs are followed from
the word of each span of a passage that the fewest passages have. For 60 % in order, the words in common with each
passage are counted as arrays, first over the whole document, then over all its
stretches at once; where there are enough the exact check follows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.words import words

#: A run of so many words, or so large a share of a passage's words in order, is a leak.
RUN, SHARE = 15, 0.6
#: A passage's words in order must lie in a stretch of at most this many times its length.
STRETCH = 1.25
#: Shortest marked run.
TILE = 2
#: Seeds: of any SPAN consecutive passage words the PICK that are in the fewest passages.
SPAN, PICK = RUN, 2
#: Whole passages of fewer words are short phrases, not leaks.
SHORTEST = 3
#: Passages in one broadcast block.
BLOCK = 20_000
#: Bytes of a block's table of words and passages; without it every passage with enough words in the document is checked.
TABLE = 64 << 20

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|\]\([^()\s]*\)")
_UNSEEN = re.compile("[­​-‍⁠﻿]")


def plain_words(text: str | None) -> list[str]:
    """Folded words without markup: tags, link targets, entities and invisible characters don't count."""
    if not text:
        return []
    if "<" in text or "](" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _UNSEEN.sub("", text)
    return words(text)


def tiles(pattern: Sequence[str], text: Sequence[str], least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(place in pattern, place in text, length)``, the longest unmarked match first.

    Candidates for each length come from rolling Karp-Rabin values of unmarked windows;
    equal values are compared word by word. Ties go to the earlier place in the pattern.
    """
    number: dict[str, int] = {}
    p, t = ([number.setdefault(w, len(number) + 1) for w in s] for s in (pattern, text))
    base, modulus = 1_000_003, (1 << 61) - 1
    free_p, free_t = [True] * len(p), [True] * len(t)

    def windows(x, free, n):
        value, top, run = 0, pow(base, n - 1, modulus), 0
        for i, c in enumerate(x):
            if i >= n:
                value -= x[i - n] * top
            value = (value * base + c) % modulus
            run = run + 1 if free[i] else 0
            if run >= n:
                yield i - n + 1, value

    found, size = [], min(len(p), len(t))
    while size >= least:
        seen = defaultdict(list)
        for i, v in windows(t, free_t, size):
            seen[v].append(i)
        longest = size
        matches = []
        for i, v in windows(p, free_p, size):
            for j in seen.get(v, ()):
                if p[i : i + size] == t[j : j + size]:
                    n = size
                    while i + n < len(p) and j + n < len(t) and free_p[i + n] and free_t[j + n] and p[i + n] == t[j + n]:
                        n += 1
                    matches.append((-n, i, j))
                    longest = max(longest, n)
        for n, i, j in sorted(matches):
            if all(free_p[i : i - n]) and all(free_t[j : j - n]):
                free_p[i : i - n] = [False] * -n
                free_t[j : j - n] = [False] * -n
                found.append((i, j, -n))
        # runs grow from any window found, so lengths between the halvings are found extended
        size = size // 2 if size // 2 >= least else (least if size > least else 0)
    return found


def in_order(pattern: Sequence[str], text: Sequence[str]) -> int:
    """Length of the longest common subsequence, a bit per pattern word."""
    at: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        at[w] |= 1 << i
    full = (1 << len(pattern)) - 1
    row = full
    for w in text:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(pattern) - row.bit_count()


def needed(n: int) -> int:
    return math.ceil(round(SHARE * n, 6))


def stretch_counts(text: np.ndarray, at: np.ndarray, budget: np.ndarray, width: int) -> np.ndarray:
    """How many words of the passage each stretch ``text[i : i + width]`` holds, none more often than the passage.

    ``at`` has the places of its words, ``budget`` how often each is in it. An occurrence counts in the stretches that
    begin after the occurrence of its word so many before it, which is a range of starts.
    """
    word = text[at]
    order = np.argsort(word, kind="stable")
    word, at = word[order], at[order]
    before = np.arange(len(at)) - budget[word]
    same = (before >= 0) & (word[before] == word)
    low = np.maximum(np.where(same, at[before], -1), at - width)
    return np.cumsum(np.bincount(low + 1, minlength=len(text) + 1) - np.bincount(at + 1, minlength=len(text) + 1))[: len(text)]


def in_stretch(pattern: np.ndarray, text: np.ndarray, budget: np.ndarray) -> bool:
    """Whether some stretch of about the passage's length holds SHARE of its words in order."""
    n = len(pattern)
    need, width = needed(n), int(STRETCH * n)
    at = budget[text].nonzero()[0]
    good = np.flatnonzero(stretch_counts(text, at, budget, width) >= need)
    if not len(good):
        return False
    order, own = pattern.tolist(), text[at]

    def ordered(start: int, end: int) -> bool:
        return in_order(order, own[slice(*np.searchsorted(at, (start, end)))].tolist()) >= need

    for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1):
        # no stretch of a run has more in order than the run
        if ordered(run[0], run[-1] + width) and any(ordered(i, i + width) for i in run.tolist()):
            return True
    return False


def run_at(pattern: Sequence[str], o: int, text: Sequence[str], i: int) -> int:
    """Length of the common run through word ``o`` of the passage and word ``i`` of the text."""
    a = b = 0
    while a < min(o, i) and pattern[o - a - 1] == text[i - a - 1]:
        a += 1
    while o + b < len(pattern) and i + b < len(text) and pattern[o + b] == text[i + b]:
        b += 1
    return a + b


def held(pattern: Sequence[str], text: Sequence[str]) -> bool:
    """Whether ``text`` holds the passage: whole, a run of RUN words, or SHARE of its words in order."""
    n = len(pattern)
    marked = tiles(pattern, text)
    longest = max((k for _, _, k in marked), default=0)
    if longest == n and n >= SHORTEST or longest >= RUN:
        return True
    return n >= RUN and Passages([(0, list(pattern))]).scattered(text, set()) == [0]


class Passages:
    """Passages of at least RUN words as arrays of word numbers, to be counted in a text all at once."""

    def __init__(self, patterns: list[tuple[int, list[str]]]):
        self.numbers: dict[str, int] = {}
        self.at = [k for k, (_, p) in enumerate(patterns) if len(p) >= RUN]
        self.words = [np.array([self.numbers.setdefault(w, len(self.numbers)) for w in patterns[k][1]], np.int64) for k in self.at]
        parts = [np.unique(w, return_counts=True) for w in self.words]
        self.word = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in parts)])
        self.times = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
        self.starts = np.cumsum([0, *(len(w) for w, _ in parts)])
        self.needed = np.array([needed(len(w)) for w in self.words], np.int64)
        self.width = np.array([int(STRETCH * len(w)) for w in self.words], np.int64)
        self.table = None  # whether a passage has a word
        if len(self.at) * (len(self.numbers) + 1) <= TABLE:
            self.table = np.zeros((len(self.at), len(self.numbers) + 1), bool)
            self.table[np.repeat(np.arange(len(parts)), np.diff(self.starts)), self.word] = True

    def scattered(self, found: Sequence[str], known: set[int]) -> list[int]:
        """Places of the passages, but for the ``known`` ones, of which the text holds SHARE of the words in order in a stretch."""
        if not self.at:
            return []
        none = len(self.numbers)
        number = self.numbers.get
        text = np.array([number(w, none) for w in found], np.int64)
        own = np.bincount(text, minlength=none + 1)
        common = np.add.reduceat(np.minimum(own[self.word], self.times), self.starts[:-1])
        budget = np.zeros(none + 1, np.int64)
        out = []
        some = np.flatnonzero(common >= self.needed)
        for i in some[self.dense(some, text)].tolist():
            if self.at[i] not in known:
                part = slice(self.starts[i], self.starts[i + 1])
                budget[self.word[part]] = self.times[part]
                if in_stretch(self.words[i], text, budget):
                    out.append(self.at[i])
                budget[self.word[part]] = 0
        return out

    def dense(self, some: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Which of the passages ``some`` have enough words in one stretch of the text, those too often there included; all, if the table of words would be too large."""
        if self.table is None:
            return np.ones(len(some), bool)
        held = np.zeros((len(some), len(text) + 1), np.int32)
        np.cumsum(self.table[some[:, None], text], axis=1, out=held[:, 1:])
        ends = np.minimum(np.arange(len(text)) + self.width[some][:, None], len(text))
        return (np.take_along_axis(held, ends, 1) - held[:, :-1] >= self.needed[some][:, None]).any(axis=1)


def seeds(pattern: Sequence[str], counts: dict[str, int]) -> dict[str, bool]:
    """Words such that any SPAN consecutive words of the passage hold its PICK rarest; true for the rarest itself."""
    out: dict[str, bool] = {}
    for i in range(max(1, len(pattern) - SPAN + 1)):
        for place, w in enumerate(sorted(set(pattern[i : i + SPAN]), key=lambda w: (counts.get(w, 0), w))[:PICK]):
            out[w] = out.get(w, False) or not place
    return out


def search(docs: DataFrame, key: str, text: str, patterns: list[tuple[int, list[str]]]) -> DataFrame:
    """``(key, passage)`` of one block of passages, in one scan."""
    counts = Counter(w for _, p in patterns for w in set(p))
    index: dict[str, list[tuple[int, list[int], bool]]] = defaultdict(list)
    for k, (_, pattern) in enumerate(patterns):
        for w, rarest in seeds(pattern, counts).items():
            index[w].append((k, [i for i, x in enumerate(pattern) if x == w], rarest))
    shared = docs.sparkSession.sparkContext.broadcast((dict(index), patterns, Passages(patterns)))

    def leaks(found: list[str]) -> list[int]:
        index, patterns, passages = shared.value
        hits = set()
        for i in [i for i, w in enumerate(found) if w in index]:
            for k, offsets, one in index[found[i]]:
                if one and k not in hits:
                    n = len(patterns[k][1])
                    if any(run_at(patterns[k][1], o, found, i) >= min(n, RUN) for o in offsets):
                        hits.add(k)
        hits.update(passages.scattered(found, hits))
        return [patterns[k][0] for k in hits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for name in leaks(plain_words(value)):
                    at.append(i)
                    names.append(name)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.int64())], ["key", "passage"])

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, passage long")


def leaks(docs: DataFrame, cases: DataFrame, key: str = "doc_id", text: str = "text", case: str = "id", answer: str = "expected_answer") -> DataFrame:
    """Distinct rows ``(key, case_id)``: each document holding a case's passage.

    Passages with equal folded words are one pattern, reported for each of their cases.
    Null and empty passages and those without a word or of fewer than SHORTEST words leak
    nowhere; null, empty and blank documents hold nothing. Very long documents are searched
    whole. Other columns play no part, whatever their names.
    """
    spark = docs.sparkSession
    rows = cases.where(F.col(f"`{case}`").isNotNull() & F.col(f"`{answer}`").isNotNull()).select(F.col(f"`{case}`").alias("case_id"), F.col(f"`{answer}`").alias("answer"))
    names = rows.select("case_id", F.xxhash64("answer").alias("h")).distinct()
    numbered = rows.select("answer", F.xxhash64("answer").alias("h")).distinct()
    parts = max(1, -(-numbered.count() // BLOCK))
    found = None
    for part in range(parts):
        block = [(r.h, plain_words(r.answer)) for r in numbered.where(F.pmod("h", F.lit(parts)) == part).collect()]
        block = [(h, p) for h, p in block if len(p) >= SHORTEST]
        if block:
            one = search(docs.where(F.col(f"`{key}`").isNotNull()), key, text, block)
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], f"key {docs.schema[key].dataType.simpleString()}, passage long")
    return found.join(names, found.passage == names.h).select(F.col("key").alias(key), "case_id").distinct()


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    cases = spark.read.parquet(f"{root}/eval_cases.parquet").select("id", "expected_answer")
    return leaks(docs, cases)
