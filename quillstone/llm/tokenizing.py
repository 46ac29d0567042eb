"""Encoding a corpus with a public byte-level BPE tokenizer.

The vocabulary's merges are compiled into a finite-state transducer over bytes
that is determinised lazily: a state is what is still undecided of the input (the
last tokens of the undecided prefixes), and a transition is computed the first
time some text takes it. A token is emitted as soon as every continuation of the
input agrees on it, so the lookahead is bounded by the longest token. Decoding is
streaming: bytes of tokens go through an incremental UTF-8 state machine.

Defined cases: null and empty text give an empty list; special-token strings are
ordinary text; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Remembered pieces per task; beyond it the memory starts afresh (results do not change).
MEMORY = 400_000


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Left-to-right BPE of one vocabulary.

    The token that ends the encoding of a prefix is the longest vocabulary entry
    ending there that is compatible with the token ending before it; two tokens
    are compatible if merging their joined bytes gives back exactly the two.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.entries = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.openings: set[bytes] = {b[:n] for b in ranks for n in range(1, len(b) + 1)}
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone; everything else is determinised again on demand."""
        self._fits: dict[tuple[int, int], bool] = {}
        # state 0: nothing pending and no token before
        self._states: list[tuple[int, bytes, tuple[int, ...]]] = [(-1, b"", ())]
        self._ids = {self._states[0]: 0}
        self._moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._ends: dict[int, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain rank-ordered merging; used for short byte pairs and as the definition in tests."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        known = self._fits.get((left, right))
        if known is None:
            known = self._fits[left, right] = self.merge(self.entries[left] + self.entries[right]) == [left, right]
        return known

    def _last(self, before: int, pending: bytes, lasts: tuple[int, ...]) -> int:
        """The token ending ``pending`` in full; ``lasts`` are those ending its shorter prefixes."""
        for n in range(min(len(pending), self.longest), 0, -1):
            token = self.ranks.get(pending[-n:])
            if token is None:
                continue
            at = len(pending) - n
            previous = lasts[at - 1] if at else before
            if previous < 0 or self.fits(previous, token):
                return token
        raise ValueError("the vocabulary lacks a single byte")

    def _chain(self, lasts: tuple[int, ...], end: int) -> list[int]:
        """Ends of the tokens of the encoding of the pending prefix of length ``end``."""
        ends = []
        while end > 0:
            ends.append(end)
            end -= len(self.entries[lasts[end - 1]])
        return ends

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Next state and the tokens that have become certain."""
        key = state << 8 | byte
        known = self._moves.get(key)
        if known is not None:
            return known
        before, pending, lasts = self._states[state]
        pending += bytes((byte,))
        lasts += (self._last(before, pending, lasts),)
        size = len(pending)
        # places where a later token may still begin: what follows them opens some entry
        live = [at for at in range(size + 1) if at == size or size - at < self.longest and pending[at:] in self.openings]
        shared: set[int] | None = None
        for at in live:
            ends = set(self._chain(lasts, at))
            shared = ends if shared is None else shared & ends
        sure = max(shared, default=0)
        out = tuple(lasts[e - 1] for e in reversed(self._chain(lasts, sure)))
        after = (lasts[sure - 1] if sure else before, pending[sure:], lasts[sure:])
        target = self._ids.setdefault(after, len(self._states))
        if target == len(self._states):
            self._states.append(after)
        self._moves[key] = target, out
        return target, out

    def finish(self, state: int) -> tuple[int, ...]:
        """What a state still owes at the end of the input."""
        known = self._ends.get(state)
        if known is None:
            _, _, lasts = self._states[state]
            known = self._ends[state] = tuple(lasts[e - 1] for e in reversed(self._chain(lasts, len(lasts))))
        return known

    def encode(self, data: bytes) -> list[int]:
        state, out = 0, []
        for byte in data:
            state, sure = self.step(state, byte)
            out += sure
        out += self.finish(state)
        return out


class Encoder:
    """Texts to ids: split by the pattern, then the transducer on each distinct piece."""

    def __init__(self, ranks: dict[bytes, int] | None = None):
        import regex

        self.machine = Transducer(ranks or load_ranks())
        self.split = regex.compile(PATTERN).findall
        self.memory: dict[str, list[int]] = {}

    def _learn(self, piece: str) -> list[int]:
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        if len(self.machine._states) >= MEMORY:
            self.machine.forget()
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.machine.ranks.get(data)
        ids = self.memory[piece] = [whole] if whole is not None else self.machine.encode(data)
        return ids

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        get, learn = self.memory.get, self._learn
        for piece in self.split(text):
            out += get(piece) or learn(piece)
        return out


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with the array column ``ids``; one pass, no shuffle. An existing column ``ids`` is replaced.

    The vocabulary file is read by the driver and broadcast (about 1 MB), so executors needn't have it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kept = [c for c in docs.columns if c != ids]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(shared.value)
            flat: list[int] = []
            ends = [0]
            for value in batch.column(text_at).to_pylist():
                flat += encoder(value)
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [lists], [*kept, ids])

    source = docs.select(*(F.col(f"`{c}`") for c in kept))
    if text == ids:
        raise ValueError("the ids need a column of their own")
    text_at = kept.index(text)
    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """``tokens`` with the string column ``text``; a null list gives null, bytes that are no UTF-8 give U+FFFD."""
    shared = tokens.sparkSession.sparkContext.broadcast({i: b for b, i in load_ranks(vocabulary).items()})

    @F.pandas_udf(T.StringType())
    def run(column):
        entries = shared.value
        return column.map(lambda x: None if x is None else "".join(stream(entries[i] for i in x)))

    return tokens.withColumn(text, run(F.col(f"`{ids}`")))


def stream(pieces: Iterable[bytes]) -> Iterator[str]:
    """Characters as soon as their last byte has come."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        if out := machine.decode(piece):
            yield out
    if out := machine.decode(b"", True):
        yield out


def p7_decoded(spark: SparkSession, root: str) -> DataFrame:
    """All documents encoded and decoded again, and whether that gives the text."""
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    back = decode(encode(docs))
    return back.select("doc_id", F.md5(F.encode("decoded", "UTF-8")).alias("decoded"))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", "ids")
