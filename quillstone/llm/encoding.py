"""Texts garbled by a wrong character encoding: finding and restoring them.

Noisy-channel decoding. A channel says which bytes were read in which wrong encoding.
Per channel the damaged span becomes a lattice: an arc reads characters back to their
bytes and decodes them rightly, another keeps a character, and a lost byte (U+FFFD) is a
wildcard: alone, or as part of a sequence whose other bytes are there. Viterbi search over
(place, part of a word) finds the best path under the words' frequencies in the corpus.
Spark counts the words of all texts, copies once; each task decodes by them, in
one scan without a shuffle of texts.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.plans.broadcasting import broadcast_if_small

LOST = "�"
#: Channels: (true encoding, encoding it was read in). Public codec names.
CHANNELS = [("utf-8", w) for w in ("cp1252", "latin-1", "cp437", "cp850", "mac-roman", "cp1250", "iso8859-2", "iso8859-15", "cp1254")] + [
    (t, w) for t in ("mac-roman", "cp437", "cp850", "cp1252") for w in ("cp1252", "latin-1", "cp437", "cp850", "mac-roman") if t != w and (t, w) != ("cp1252", "latin-1")
]
#: How many times more frequent than the span as found a restored word must be if only single
#: bytes were swapped, which proves less than a multi-byte character read byte by byte.
BY_SWAP = 8
#: Size of the model: the most frequent words and spans beyond ASCII, counted over all texts.
VOCABULARY = 200_000
#: A letter beyond ASCII is the corpus's own if it has so large a share of such letters.
USUAL = 2e-4
FLUSH = 400_000

_ENTITY = re.compile(r"&[A-Za-z]{2,8};")
_PLAIN = {"&lt;", "&gt;", "&amp;", "&quot;"}
_BEYOND = re.compile(r"[^\x00-\x7f]+(?:[A-Za-z]+[^\x00-\x7f]+)*[A-Za-z]*")
_MULTIBYTE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_MARKS = {chr(c) for c in range(0x300, 0x370)}
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ][^\W\d_]*)*|[^\w\s]+|\S")


@lru_cache(maxsize=None)
def _reader(wrong: str) -> dict[str, int]:
    """Character -> byte of a single-byte encoding; bytes it lacks stand for the control characters."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes((b,)).decode(wrong)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(maxsize=None)
def _decoded(data: bytes, true: str) -> str | None:
    try:
        c = data.decode(true)
    except UnicodeDecodeError:
        return None
    # control characters and the like only come out halfway, of text that was garbled twice
    return c if len(c) == 1 and (c.isprintable() or true == "utf-8" and c >= "\x80" or c == "\xa0") else None


def arcs(text: str, true: str, wrong: str, letters: str = "") -> list[list[tuple[int, str]]]:
    """The lattice: for each place the ``(next place, character)`` of its restoring arcs.

    A lost byte stands for any: alone it may be any of ``letters``, in a UTF-8 sequence
    whatever byte makes one of them.
    """
    byte = _reader(wrong)
    out: list[list[tuple[int, str]]] = [[] for _ in text]
    for i, c in enumerate(text):
        if c == LOST:
            out[i] += [(i + 1, r) for r in letters]
        elif c not in byte:
            continue
        data: list[int | None] = []
        for j in range(i, min(i + 4, len(text))):
            if text[j] != LOST and text[j] not in byte:
                break
            data.append(byte.get(text[j]))
            if (true == "utf-8") != (len(data) > 1):
                continue
            if None in data:
                out[i] += [(j + 1, r) for r in _matching(tuple(data), letters) if len(data) > 1]
            elif r := _decoded(bytes(data), true):
                out[i].append((j + 1, r))
            if true != "utf-8":
                break
    return out


@lru_cache(maxsize=1 << 16)
def _matching(data: tuple[int | None, ...], letters: str) -> list[str]:
    """The letters whose UTF-8 bytes agree with the known ones of ``data``."""
    return [c for c in letters if len(e := c.encode()) == len(data) and all(d is None or d == b for d, b in zip(data, e))]


@lru_cache(maxsize=None)
def _table(wrong: str) -> dict[int, int]:
    """For str.translate: each character to the Latin-1 character of its byte."""
    return {ord(c): b for c, b in _reader(wrong).items()}


@lru_cache(maxsize=None)
def _swap(true: str, wrong: str) -> dict[int, str]:
    return {ord(c): r for c, b in _reader(wrong).items() if (r := _decoded(bytes((b,)), true))}


def readable(text: str, wrong: str) -> bool:
    """Whether some run of the text's bytes in ``wrong`` is a multi-byte UTF-8 character."""
    raw = text.translate(_table(wrong))
    return bool(_MULTIBYTE.search("".join(c if c < "\u0100" else " " for c in raw).encode("latin-1")))


def tokens(text: str) -> list[str]:
    """Words and runs of signs that hold a character beyond ASCII: what is counted."""
    return [t for t in _TOKEN.findall(text.lower()) if not t.isascii()]


class Model:
    """Counts of the corpus's words and spans beyond ASCII: over texts, copies counting once, and over rows."""

    def __init__(self, counts: dict[str, float], rows: dict[str, int]):
        self.counts, self.rows = counts, rows
        weight: Counter = Counter()
        for w, n in counts.items():
            for c in set(w):
                if c > "\x7f" and c.isalpha():
                    weight[c] += n
        least = USUAL * weight.total()
        #: The letters beyond ASCII that the corpus itself uses.
        self.usual = {c for c, n in weight.items() if n >= least}
        self.letters = "".join(sorted({x for c in self.usual for x in (c, c.upper()) if len(x) == 1}))
        self.total = math.log(sum(counts.values()) + 1)
        self._starts: set[str] | None = None

    @property
    def starts(self) -> set[str]:
        """All beginnings of the known words: the nodes of their trie."""
        if self._starts is None:
            self._starts = {w[:i] for w in self.counts if LOST not in w and tokens(w) == [w] for i in range(1, len(w) + 1)}
        return self._starts

    def __getstate__(self):
        return {**self.__dict__, "_starts": None}

    def of(self, word: str) -> float:
        return self.counts.get(word.lower(), 0)

    def least(self, text: str) -> float:
        return min((self.of(t) for t in tokens(text)), default=0)

    def prevails(self, text: str, span: str, times: float = 1) -> bool:
        """Whether the rarest word of ``text`` is so many times as frequent as ``span``, over texts or over rows: neither damaged nor sound copies can outvote the rest."""
        words, span = tokens(text.lower()), span.lower()
        return bool(words) and any(min(c.get(w, 0) for w in words) >= times * max(c.get(span, 0), 1) for c in (self.counts, self.rows))

    def unknown(self, part: str) -> float:
        return -2.0 - self.total - sum(c > "\x7f" for c in part) / 2

    def word(self, part: str | None) -> float:
        """What ending a word adds to a path's score; null is a word already known to be none."""
        if not part or part.isascii():
            return 0.0
        n = self.of(part)
        return math.log(n) + math.log(self.rows[part]) / 4 - self.total if n else self.unknown(part)


def viterbi(text: str, true: str, wrong: str, known: Model) -> str:
    """The best path through the span's lattice under the words' frequencies.

    A state is a place and the part of a word that ends there, as a node of the trie of
    known words; all paths that leave the trie share a state, as nothing they read later
    depends on what they were. Words of ASCII alone and blanks cost nothing.
    """
    lattice = arcs(text, true, wrong, known.letters if LOST in text else "")
    starts = known.starts
    # (kind of the last character, part of a word or "" off the trie in ASCII or null off the trie) -> (score, restored)
    best: list[dict[tuple[str, str | None], tuple[float, str]]] = [{} for _ in range(len(text) + 1)]
    best[0]["", ""] = 0.0, ""
    for i, c in enumerate(text):
        ways = lattice[i]
        if not ways or true != "utf-8" or c == LOST:  # a whole sequence isn't left as it stands
            ways = [*ways, (i + 1, c)]
        for (kind, part), (score, path) in best[i].items():
            closed = score + known.word(part)
            for j, r in ways:
                low = r.lower()
                now = "letter" if low.isalpha() or low in _MARKS else "sign" if not (low.isalnum() or low.isspace() or low == "_") else ""
                go = now == kind and now != ""
                value, whole = (score, part) if go else (closed, "")
                if not now or low == LOST:
                    state, value = (now, ""), value - (low == LOST) * (known.total + 1)
                elif go and part is None:
                    state, value = (now, None), value - (low > "\x7f") / 2
                elif (whole or not go) and (whole or "") + low in starts:
                    state = now, (whole or "") + low
                else:
                    off = (whole or "") + low
                    state, value = ((now, ""), value) if off.isascii() else ((now, None), value + known.unknown(off))
                old = best[j].get(state)
                if old is None or (value, path + r) > old:
                    best[j][state] = value, path + r
        best[i] = {}
    return max((score + known.word(part), path) for (_, part), (score, path) in best[-1].items())[1]


def restore(span: str, known: Model) -> tuple[str, str, tuple[str, str]] | None:
    """``(restored, kind, channel)`` of a damaged span, null for a sound one; kind is "sequence", "swap" or "lost".

    A span is damaged if it can be read back, otherwise than it stands, to a word of the
    corpus's own letters or to words that the corpus uses more than the span; text that was
    garbled several times is read back as often.
    """
    if LOST in span:
        found = {viterbi(span, true, wrong, known): (true, wrong) for true, wrong in CHANNELS if true == "utf-8"}
        text = min(found, key=lambda x: (x.count(LOST), -known.least(x) if tokens(x) else 0, len(x), x))
        return text, "lost", found[text]
    found = known.of(span)
    best = None
    for true, wrong in CHANNELS:
        if true != "utf-8":
            swapped = span.translate(_swap(true, wrong))
            parts = tokens(swapped)
            # only a word proves a swap, not a sign
            if swapped != span and any(sum(map(str.isalpha, t)) > 2 for t in parts) and known.prevails(swapped, span, BY_SWAP):
                text = viterbi(span, true, wrong, known)
                rank = (0, known.least(text), text)
                if text != span and (best is None or rank > best[0]):
                    best = rank, text, "swap", (true, wrong)
            continue
        text, times = span, 0
        while readable(text, wrong):
            times += 1
            last, text = text, viterbi(text, true, wrong, known)
            if text == last:
                break
            have = known.least(text)
            # a word nobody else uses still counts if it is one, of the corpus's own letters
            sound = any(len(t) > 2 and t.isalpha() for t in tokens(text)) and all(c in known.usual for c in text.lower() if c > "\x7f" and c.isalpha())
            rank = (times, have, text)
            if (sound or have > found or known.prevails(text, span, 2)) and (best is None or rank > best[0]):
                best = rank, text, "sequence", (true, wrong)
    return best[1:] if best else None


def follow(span: str, channel: tuple[str, str], known: Model) -> tuple[str, str, tuple[str, str]] | None:
    """The verdict on a span of a text in which other words prove that single bytes were swapped: here a short word or a sign will do."""
    text = viterbi(span, *channel, known)
    return (text, "swap", channel) if text != span and known.prevails(text, span, 1.5) else None


def opened(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with entities as their characters, but for those that are markup's own, and after each ``(place there, place in text)``."""
    if "&" not in text:
        return text, []
    out, size, last, ends = [], 0, 0, []
    for m in _ENTITY.finditer(text):
        c = html.unescape(m[0])
        if m[0] not in _PLAIN and c != m[0]:
            out += [text[last : m.start()], c]
            size += m.start() - last + len(c)
            last = m.end()
            ends.append((size, last))
    return "".join([*out, text[last:]]), ends


def place_of(place: int, ends: list[tuple[int, int]]) -> int:
    """The place in the text of a place in what ``opened`` made of it."""
    at = bisect_right(ends, place, key=lambda e: e[0])
    return place - ends[at - 1][0] + ends[at - 1][1] if at else place


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Runs of letters and characters beyond ASCII that hold one of the latter."""
    for m in _BEYOND.finditer(text):
        start = m.start()
        while start and text[start - 1].isascii() and text[start - 1].isalpha():
            start -= 1
        yield start, m.end()


@lru_cache(maxsize=FLUSH)
def evidence(span: str) -> frozenset[str]:
    """What is counted of a span: the span, and its words unless it can be read back as UTF-8, which makes them garble."""
    whole = span.lower()
    garble = any(readable(span, wrong) for true, wrong in CHANNELS if true == "utf-8")
    return frozenset((whole,) if garble else (whole, *tokens(whole)))


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n, n_rows)`` over all texts: words, sign runs and whole spans beyond ASCII, once a text; counted in the task first.

    Of n copies of a text each counts 1/n, so a group of damaged copies has no more say than one.
    """
    own = texts.select("text", F.xxhash64("text").alias("h"))
    copies = own.where("text is not null").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    weighed = own.join(broadcast_if_small(copies), "h", "left").select("text", (1 / F.coalesce("n", F.lit(1))).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        times: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.float64()), pa.array([times[w] for w in counts], pa.int64())], ["word", "n", "n_rows"])
            counts.clear()
            times.clear()
            return out

        for batch in batches:
            for value, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not value or value.isascii() and "&" not in value:
                    continue
                value, _ = opened(value)
                for word in set().union(*(evidence(value[a:b]) for a, b in spans(value))):
                    counts[word] += weight
                    times[word] += 1
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    return weighed.mapInArrow(run, "word string, n double, n_rows long").groupBy("word").agg(F.round(F.sum("n"), 6).alias("n"), F.sum("n_rows").alias("n_rows"))


def train(texts: DataFrame, size: int = VOCABULARY) -> Model:
    """The model: counts of the ``size`` most frequent words and spans; at most ``size`` rows reach the driver."""
    rows = word_counts(texts).orderBy(F.desc("n"), "word").limit(size).collect()
    return Model({r.word: r.n for r in rows}, {r.word: r.n_rows for r in rows})


def repair(rows: DataFrame, text: str, model: Model | None = None) -> DataFrame:
    """``rows`` with ``restored`` (string), ``damaged`` and ``lost`` (numbers of spans).

    Null, empty and ASCII texts are sound (``restored`` is the text). Correct letters and
    signs, however rare, stay: a span is damaged only if its restoration is likelier under
    the corpus's word counts. A lost byte (U+FFFD) is always damage; ``restored`` has the
    likeliest letter there, or U+FFFD if none fits; the text outside damaged spans stays as it
    is, entities included. Columns of ``rows`` named like
    the new ones are replaced; others pass through, whatever their names.
    """
    new = ("restored", "damaged", "lost")
    kept = [c for c in rows.columns if c not in new or c == text]
    if text in new:
        raise ValueError("the text column needs a name of its own")
    source = rows.select(*(F.col(f"`{c}`") for c in kept))
    model = model or train(source.select(F.col(f"`{text}`").alias("text")))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = kept.index(text)
    schema = T.StructType([*source.schema, T.StructField("restored", T.StringType()), T.StructField("damaged", T.IntegerType()), T.StructField("lost", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def verdict(span: str, channel: tuple[str, str] | None = None):
            if (span, channel) not in known:
                if len(known) > FLUSH:
                    known.clear()
                known[span, channel] = follow(span, channel, shared.value) if channel else restore(span, shared.value)
            return known[span, channel]

        for batch in batches:
            restored, damaged, lost = [], [], []
            for value in batch.column(at).to_pylist():
                n = gone = 0
                if value and not (value.isascii() and "&" not in value):
                    plain, ends = opened(value)
                    places = list(spans(plain))
                    verdicts = [verdict(plain[a:b]) for a, b in places]
                    swaps = Counter(v[2] for v in verdicts if v and v[1] == "swap")
                    if swaps:
                        channel = min(swaps, key=lambda c: (-swaps[c], c))
                        verdicts = [v or verdict(plain[a:b], channel) for v, (a, b) in zip(verdicts, places)]
                    out, last = [], 0
                    for (a, b), found in zip(places, verdicts):
                        if found:
                            n += 1
                            gone += found[1] == "lost"
                            out += [value[last : place_of(a, ends)], found[0]]
                            last = place_of(b, ends)
                    if n:
                        value = "".join([*out, value[last:]])
                restored.append(value)
                damaged.append(n)
                lost.append(gone)
            cells = [pa.array(restored, pa.string()), pa.array(damaged, pa.int32()), pa.array(lost, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], schema.names)

    return source.mapInArrow(run, schema)


def registry_texts(spark: SparkSession, root: str) -> DataFrame:
    """``(tab, id, text)`` of both tables' contents."""
    docs = spark.read.parquet(f"{root}/doc_registry.parquet").select(F.lit("doc_registry").alias("tab"), F.col("rec_id").cast("string").alias("id"), F.col("content").alias("text"))
    chunks = spark.read.parquet(f"{root}/chunks.parquet").select(F.lit("chunks").alias("tab"), "id", F.col("content").alias("text"))
    return docs.unionByName(chunks)


def p3_restored(spark: SparkSession, root: str) -> DataFrame:
    """The damaged texts with what could be restored of them."""
    return repair(registry_texts(spark, root), "text").where("damaged > 0").select("tab", "id", "damaged", "lost", "restored")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return repair(registry_texts(spark, root), "text").where("damaged > 0 and id is not null").select("tab", "id").distinct()
