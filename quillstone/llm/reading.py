"""Reading level of documents, from their sentences.

Every sentence gets a distribution over the levels from two regularised models, one of its
words and one of the character groups in them, each with its own features and rates. A
document's distribution is the mean over its sentences, weighted by words, so fragments of
another level don't move it; a calibration fitted on labelled documents that the models
haven't seen maps it to a level. The models are naive log-linear ones, fitted by Spark
counts: labels of documents give first sentence labels, sentences are labelled anew by the
fitted model, and the counts are taken again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.words import fold
from quillstone.plans.staging import drop, stage

LEVELS = 3
#: Documents with fewer words have no level.
LEAST_WORDS = 20
#: Hashed features of each model; the fitted weights are an array of twice as many rows, whatever the corpus.
FEATURES = 1 << 18
#: Labelled documents used for fitting, at most (the smallest hashes of their ids).
SAMPLE = 8_000
#: Additive smoothing of feature counts and the largest weight a feature may have.
SMOOTH, LARGEST = 0.5, 3.0
#: Weight of the model of characters beside that of words.
CHARACTERS = 0.15
ROUNDS = 3
#: One of so many labelled documents is kept from the models for the calibration.
HELD_OUT = 4
PAIR = 9

#: Remembered words of a task; beyond it the memory starts afresh (results do not change).
MEMORY = 1 << 19
WORD, OTHER, BREAK = 0, 1, 2

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_ITEM = re.compile(r"\w+|[.!?;:](?=\s)|\n(?=\s*[\n#>*\-\d])")


def number(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % FEATURES


def features(word: str) -> np.ndarray:
    """Of a word: itself for the model of words; its ending, its length, its character groups for that of characters."""
    grams = {f"c{word[i : i + 4]}" for i in range(len(word) - 3)} if len(word) > 4 else set()
    own = [FEATURES + number(n) for n in (f"e{word[-4:]}", f"l{min(len(word), 16)}", *sorted(grams))]
    return np.array([number(f"w{word}"), *own], np.int64)


class Reader:
    """Texts as arrays: items (words, others, sentence breaks) and pairs of short words, with what was learned of each.

    Code doesn't count, nor identifiers and numbers. ``weights`` (2 FEATURES x LEVELS) give each
    item its share of the levels' log scores.
    """

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.names: list[str] = []
        self.kinds, self.lengths = np.zeros(4096, np.int8), np.zeros(4096, np.int32)
        self.pair_places: dict[int, int] = {}
        self.pair_numbers: list[int] = []
        self.features: list[np.ndarray] = []
        self.shares, self.pair_shares = np.zeros((4096, LEVELS), np.float32), np.zeros((4096, LEVELS), np.float32)

    def learn(self, item: str) -> int:
        at = self.places.get(item)
        if at is not None:
            return at
        at = self.places[item] = len(self.names)
        self.names.append(item)
        if at == len(self.kinds):
            self.kinds, self.lengths = np.resize(self.kinds, 2 * at), np.resize(self.lengths, 2 * at)
            self.shares = np.resize(self.shares, (2 * at, LEVELS))
        kind = WORD if item.isalpha() else OTHER if item[0].isalnum() or item[0] == "_" else BREAK
        found = features(item) if kind == WORD else np.zeros(0, np.int64)
        self.kinds[at], self.lengths[at] = kind, len(item) if kind == WORD else 2 * PAIR
        self.features.append(found)
        self.shares[at] = self.weights[found[0]] + CHARACTERS * self.weights[found[1:]].sum(axis=0) if self.weights is not None and len(found) else 0
        return at

    def learn_pair(self, code: int) -> int:
        at = self.pair_places.get(code)
        if at is not None:
            return at
        at = self.pair_places[code] = len(self.pair_numbers)
        n = number(f"p{self.names[code >> 20]} {self.names[code & 0xFFFFF]}")
        self.pair_numbers.append(n)
        if at == len(self.pair_shares):
            self.pair_shares = np.resize(self.pair_shares, (2 * at, LEVELS))
        self.pair_shares[at] = 0 if self.weights is None else self.weights[n]
        return at

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(items, their sentences, places of pairs, pairs)``."""
        if len(self.names) > MEMORY or len(self.pair_numbers) > MEMORY:
            self.forget()
        items = _ITEM.findall(fold(_FENCE.sub("\n\n", text) if "```" in text else text))
        at = list(map(self.places.get, items))
        if None in at:
            at = [self.learn(x) if i is None else i for i, x in zip(at, items)]
        at = np.array(at, np.int64)
        lengths = self.lengths[at]
        first = np.flatnonzero(lengths[:-1] + lengths[1:] <= PAIR)
        codes = (at[first] << 20 | at[first + 1]).tolist()
        pairs = list(map(self.pair_places.get, codes))
        if None in pairs:
            pairs = [self.learn_pair(c) if i is None else i for i, c in zip(pairs, codes)]
        return at, np.cumsum(self.kinds[at] == BREAK), first, np.array(pairs, np.int64)

    def scores(self, at: np.ndarray, sentence: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(log scores, words)`` of each sentence."""
        share = self.shares[at]
        share[first] += self.pair_shares[pairs]
        n = int(sentence[-1]) + 1
        scores = np.stack([np.bincount(sentence, share[:, k], n) for k in range(LEVELS)], 1)
        return scores, np.bincount(sentence, self.kinds[at] == WORD, n)

    def document(self, text: str) -> np.ndarray:
        """The mean distribution of the sentences, by words."""
        found = self.read(text)
        if len(found[0]):
            score, sizes = self.scores(*found)
            if sizes.any():
                p = softmax(score)
                return (p * sizes[:, None]).sum(axis=0) / sizes.sum()
        return np.full(LEVELS, 1 / LEVELS)


def softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def labels_of(labels: DataFrame, key: str, level: str, rater: str, sample: int = SAMPLE) -> DataFrame:
    """``(key, level)``: the most frequent label over the raters of a document (each rater's label counts once; ties: the middle one)."""
    votes = labels.where(F.col(level).between(1, LEVELS) & F.col(key).isNotNull()).select(key, level, rater).distinct()
    counted = votes.groupBy(key, level).agg(F.count("*").alias("n"))
    middle = -F.abs(F.col(level) - F.lit((LEVELS + 1) / 2))
    one = counted.groupBy(key).agg(F.max_by(level, F.struct("n", middle, level)).alias("level"))
    return one.orderBy(F.xxhash64(key), key).limit(sample)


def feature_counts(docs: DataFrame, weights: np.ndarray | None) -> np.ndarray:
    """Weighted counts (2 FEATURES x LEVELS) over the labelled documents ``(text, level)``.

    A sentence counts for its document's level, or with ``weights`` for the levels in
    proportion to the model's and the document's opinion of it. Each task adds up its
    own array; what reaches the driver is a fixed number of cells.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LEVELS, 2 * FEATURES))
        reader = Reader(shared.value)
        for batch in batches:
            for text, level in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, sentence, first, pairs = reader.read(text or "")
                if not len(at):
                    continue
                own = np.eye(LEVELS)[np.full(int(sentence[-1]) + 1, level - 1)]
                if shared.value is not None:
                    own = softmax(reader.scores(at, sentence, first, pairs)[0]) * np.where(own > 0, 1.0, 0.2)
                    own /= own.sum(axis=1, keepdims=True)
                found = [reader.features[i] for i in at.tolist()]
                numbers = np.concatenate([*found, np.array([reader.pair_numbers[i] for i in pairs.tolist()], np.int64)])
                of = np.concatenate([np.repeat(sentence, [len(f) for f in found]), sentence[first]])
                for k in range(LEVELS):
                    np.add.at(total[k], numbers, own[of, k])
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[k, at]) for k in range(LEVELS))], ["f", "n1", "n2", "n3"])

    rows = docs.select("text", "level").mapInArrow(run, "f int, n1 double, n2 double, n3 double").groupBy("f").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in (1, 2, 3))).toPandas()
    counts = np.zeros((2 * FEATURES, LEVELS))
    counts[rows["f"].to_numpy(np.int64)] = rows[["n1", "n2", "n3"]].to_numpy()
    return counts


def fit(counts: np.ndarray) -> np.ndarray:
    """Smoothed log ratios against the mean over levels, shrunk where there is little evidence, and clipped."""
    rate = np.concatenate([(c + SMOOTH) / (c.sum(axis=0) + SMOOTH * FEATURES) for c in np.split(counts, 2)])
    weights = np.log(rate)
    weights -= weights.mean(axis=1, keepdims=True)
    seen = counts.sum(axis=1, keepdims=True)
    return np.clip(weights * seen / (seen + 2), -LARGEST, LARGEST).astype(np.float32)


def calibrate(shares: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Weights of a regularised multinomial regression from document distributions to levels (Newton-free gradient steps)."""
    x = np.hstack([np.log(shares + 0.01), np.ones((len(shares), 1))])
    target = np.eye(LEVELS)[levels - 1]
    w = np.vstack([np.eye(LEVELS), np.zeros(LEVELS)])
    for _ in range(400):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 0.3 * (x.T @ (p - target) / max(1, len(x)) + 0.002 * (w - np.vstack([np.eye(LEVELS), np.zeros(LEVELS)])))
    return w


def distributions(docs: DataFrame, key: str, text: str, weights: np.ndarray) -> DataFrame:
    """``(key, words, p1, p2, p3)`` of each document; null texts have 0 words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            rows = [(len(v.split()), reader.document(v)) if v else (0, np.full(LEVELS, 1 / LEVELS)) for v in batch.column(1).to_pylist()]
            p = np.array([r[1] for r in rows]).reshape(-1, LEVELS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), *(pa.array(p[:, k], pa.float64()) for k in range(LEVELS))], ["key", "words", "p1", "p2", "p3"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"key {kind}, words long, p1 double, p2 double, p3 double")


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, level: str = "reading_level", rater: str = "rater") -> tuple[np.ndarray, np.ndarray] | None:
    """Sentence weights and calibration, or null without labelled documents."""
    known = labels_of(labels, key, level, rater)
    held = F.pmod(F.xxhash64(key, F.lit("held")), F.lit(HELD_OUT)) == 0
    labelled = docs.select(key, F.col(f"`{text}`").alias("text")).where("text is not null").join(F.broadcast(known), key).select(key, "text", "level", held.alias("held"))
    labelled = stage(labelled, "labelled")
    own = labelled.where("not held")
    if own.isEmpty():
        own = labelled
    weights = None
    for _ in range(ROUNDS):
        counts = feature_counts(own, weights)
        if not counts.any():
            return None
        weights = fit(counts)
    sample = distributions(labelled.where("held"), key, "text", weights).join(F.broadcast(known.withColumnRenamed(key, "key")), "key").where(F.col("words") >= LEAST_WORDS).toPandas()
    drop(labelled)
    return weights, calibrate(sample[["p1", "p2", "p3"]].to_numpy(), sample["level"].to_numpy(np.int64))


def levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, reading_level, p1, p2, p3)`` of each document with at least LEAST_WORDS words.

    Null, empty and shorter texts have no row; very long texts are read whole; each of
    repeated rows gets its row. Labels that are null or out of range don't count, nor
    repeated ones of one rater. Without any usable label there is no model and no row.
    Other columns play no part, whatever their names.
    """
    model = train(docs, labels, key, text)
    kind = docs.schema[key].dataType.simpleString()
    if model is None:
        return docs.sparkSession.createDataFrame([], f"{key} {kind}, reading_level int, p1 double, p2 double, p3 double")
    weights, w = model
    rows = distributions(docs, key, text, weights).where(F.col("words") >= LEAST_WORDS)
    logs = [F.log(F.col(f"p{k}") + 0.01) for k in (1, 2, 3)]
    scores = [sum((logs[i] * float(w[i, k]) for i in range(LEVELS)), F.lit(float(w[LEVELS, k]))) for k in range(LEVELS)]
    top = F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(-k).alias("k")) for k, s in enumerate(scores, 1))))
    return rows.select(F.col("key").alias(key), (-top["k"]).cast("int").alias("reading_level"), "p1", "p2", "p3")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{root}/level_labels.parquet").select("doc_id", "reading_level", "rater")
    return levels(docs, labels).select("doc_id", "reading_level")
