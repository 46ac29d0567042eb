"""Holding new batches against all accepted history.

An inverted index of rare-token prefixes. The words of a record in the order of their
hashes, which is the same whatever their order in the text, are cut into runs of a few
neighbours: the record's tokens. The rarest of them, by counts over the history, are its
prefix. Postings of prefixes lie in a table bucketed by token, so a batch is sent to
the buckets and the index stays where it is; lengths filter the postings met, shared tokens are
counted, and what is left is verified on the word hashes of both. A record of history is
never read again as text, and of copies only one is indexed.

Changed words break tokens at random places of the hash order, however they are
spread over the text: of two records that share 80 % of their words about 22 % of the
tokens survive, and a pair that keeps BAR of its prefix is found. Short records are
found by their rarest words, exactly.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.words import words
from quillstone.plans.broadcasting import MAX_ROWS
from quillstone.plans.staging import counted, drop, make, remove, shared_dir, stage

#: Share of the longer record's words that must be shared.
SIMILAR = 0.8
#: Neighbours in hash order that make a token.
RUN = 4
#: The prefix: so large a share of a record's tokens, and so many at least.
PREFIX, LEAST = 0.2, 60
#: Share of the smaller prefix that must be shared.
BAR = 0.04
#: Records of up to so many words are found by their rarest words.
SHORT = 48
#: Cells of the token counts. Tokens of a cell with at most ALIKE occurrences, or twice a cell's
#: average, are equally rare: what a group of so many near copies shares doesn't rank behind what each has alone.
CELLS = 1 << 20
ALIKE = 32
SEGMENT = 1 << 14
#: Postings in one bucket of a new index.
BUCKET_ROWS = 2_000_000
#: Fixed value: SHA-256 of the empty file.
EMPTY_FILE = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
FLUSH = 500_000
_MIX, _CELL = np.uint64(0x9E3779B97F4A7C15), np.uint64(65 - CELLS.bit_length())


class Hashes(dict):
    """Word -> 64-bit hash, remembered; the memory starts afresh when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > FLUSH:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, w := words(text)), np.uint64, len(w))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(29)


def occurrences(x: np.ndarray) -> np.ndarray:
    """Ascending hashes of a record's words, the n-th occurrence of a word being a word of its own."""
    x = np.sort(x)
    place = np.arange(len(x))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], x[1:] != x[:-1])), place, 0))
    return np.sort(mixed(x + (place - first).astype(np.uint64) * _MIX))


def runs(word: np.ndarray) -> np.ndarray:
    """Hashes of all runs of RUN neighbours; a shorter record is one run."""
    n = max(1, len(word) - RUN + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(RUN, len(word))):
        out = out * _MIX + word[k : k + n]
    return mixed(out)


def least_shared(n):
    """How many words a record of ``n`` words shares with a similar one that isn't longer."""
    return np.ceil(np.round(np.asarray(n) * SIMILAR, 6)).astype(np.int64)


def cell_of(token: np.ndarray) -> np.ndarray:
    return (token >> _CELL).astype(np.int64)


def rarest(token: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` rarest tokens; equally rare ones (``counts`` ends with the bound) in the order of their hashes."""
    if len(token) <= n:
        return token
    count = counts[cell_of(token)]
    order = np.where(count > counts[-1], count, 0).astype(np.uint64) << np.uint64(32) | token >> np.uint64(32)
    return token[np.argpartition(order, n)[:n]]


def prefix(word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    token = runs(word)
    found = rarest(token, counts, max(LEAST, int(np.ceil(len(token) * PREFIX))))
    if len(word) <= SHORT / SIMILAR:  # of the n - s + 1 rarest words of each, records that share s share one
        found = np.concatenate((found, rarest(word, counts, len(word) - int(least_shared(len(word))) + 1)))
    return found.view(np.int64)


def token_counts(records: DataFrame, text: str) -> np.ndarray:
    """Over all records: how often the tokens of each cell occur, and last how often the equally rare ones do at most.

    Each task adds up an array of its own, which is summed by segment: a fixed number of
    cells reaches the driver, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = Hashes(), np.zeros(CELLS, np.int64)
        for batch in batches:
            found = [cell_of(np.concatenate((runs(w), w)) if len(w) <= SHORT / SIMILAR else runs(w)) for v in batch.column(0).to_pylist() if len(w := occurrences(hashes.of(v)))]
            if found:
                total += np.bincount(np.concatenate(found), minlength=CELLS)
        parts = total.reshape(-1, SEGMENT)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["segment", "counts"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(p, np.int64) for p in parts.column("counts").to_pylist()), np.zeros(SEGMENT, np.int64))
        return pa.table({"segment": parts.column("segment")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "segment int, counts binary"
    rows = records.select(F.col(f"`{text}`")).mapInArrow(count, schema).groupBy("segment").applyInArrow(add, schema).toArrow()
    total = np.zeros((CELLS // SEGMENT, SEGMENT), np.int64)
    for segment, counts in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        total[segment] = np.frombuffer(counts, np.int64)
    return np.append(total.ravel(), max(ALIKE, 2 * int(total.mean()))).clip(0, (1 << 32) - 1).astype(np.uint32)


def file_hash(column: Column) -> Column:
    """The 64 hex digits however they are written; null if there are none or the file is empty."""
    digits = F.lower(F.regexp_extract(column, r"(?i)(?:^|[^0-9a-f])([0-9a-f]{64})(?:$|[^0-9a-f])", 1))
    return F.when((digits != "") & (digits != EMPTY_FILE), digits)


def read(records: DataFrame, key: str, text: str, digest: str | None, counts: np.ndarray) -> DataFrame:
    """``(rec, h, none, sign, n_words, tokens, bag)`` of each record with a key.

    ``h`` is the file hash where it may stand for the text (null or not blank), ``none`` says
    that the text is null; ``sign`` is equal for equal folded texts and null, like what
    follows it, without a word; ``bag`` holds the ascending 32-bit hashes of all words.
    """
    shared = records.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for rows in batches:
            made = []
            for value in rows.column(3).to_pylist():
                x = hashes.of(value)
                if not len(x):
                    made.append((None,) * 4)
                    continue
                word = occurrences(x)
                sign = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                made.append((sign, len(x), prefix(word, shared.value), (word >> np.uint64(32)).astype(np.uint32).tobytes()))
            columns = list(zip(*made)) or [()] * 4
            kinds = pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary()
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], *(pa.array(c, k) for c, k in zip(columns, kinds))], ["rec", "h", "none", "sign", "n_words", "tokens", "bag"])

    content = F.col(f"`{text}`")
    fit = content.isNull() | content.rlike(r"\S")
    h = F.lit(None).cast("string") if digest is None else F.when(fit, file_hash(F.col(f"`{digest}`")))
    rows = records.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("rec"), h.alias("h"), content.isNull().alias("none"), content.alias("text"))
    return rows.mapInArrow(run, "rec long, h string, none boolean, sign binary, n_words int, tokens array<long>, bag binary")


@F.pandas_udf(T.IntegerType())
def shared_words(x, y):
    """Words in common, as often as in both, of two bags."""
    import pandas as pd

    read = [[np.frombuffer(b, np.uint32) for b in bags] for bags in (x, y)]
    return pd.Series([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*read)], dtype="int32")


class Index:
    """The index of accepted records in a folder: postings, word hashes, members of classes of equal texts, links between classes.

    A class is named by the least key of its first batch. Batches are accepted one after the
    other under rising numbers; one accepted again, after a failure, replaces what it
    left. The token counts are taken when the index is made and only order tokens, so
    prefixes of all batches fit together. Null keys and batches are not accepted; repeated
    rows count once; null, empty and blank texts (no letter or digit) have no class, but a
    null text is matched by file hash. Other columns play no part, whatever their names.
    """

    #: Tables bucketed for their joins: name -> (columns, bucket column).
    TABLES = {"postings": ("token long, n_words int, class long", "token"), "members": ("sign binary, rec long, class long", "sign")}
    FOLDERS = {"files": "rec long, h string, none boolean", "links": "a long, c long", "bags": "class long, n_words int, bag binary"}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _name(self, table: str) -> str:
        return f"quillstone_{table}_{hashlib.blake2b(self.path.encode(), digest_size=6).hexdigest()}"

    def _open(self) -> None:
        """Declare the bucketed tables of the folder to this session."""
        frozen = self.spark.read.parquet(f"{self.path}/frozen").first()
        self.buckets, self.counts = frozen.buckets, np.frombuffer(frozen.counts, np.uint32)
        for table, (columns, by) in self.TABLES.items():
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({columns}, batch int) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'")

    def create(self, history: DataFrame, key: str, batch: str, text: str, digest: str | None = None) -> DataFrame:
        """Make the index in an empty folder from the accepted history; its pairs, if it came in several batches."""
        counts = token_counts(history, text)
        postings = int(counts[:-1].sum(dtype=np.int64) * PREFIX)
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-postings // BUCKET_ROWS))
        self.spark.createDataFrame([(buckets, counts.tobytes())], "buckets int, counts binary").write.parquet(f"{self.path}/frozen")
        for folder in ("members", *self.FOLDERS):  # so that an index without batches can be read
            make(self.spark, f"{self.path}/{folder}")
        return self.accept(history, key, batch, text, digest)

    def accept(self, records: DataFrame, key: str, batch: str, text: str, digest: str | None = None) -> DataFrame:
        """Find the links of the batches in ``records`` with what came before, one after the other, and make them part of the index; their pairs."""
        self._open()
        number = F.col(f"`{batch}`").cast("int")
        self.empty = self._rows("members").isEmpty()
        numbers = sorted(r[0] for r in records.select(number).distinct().where(number.isNotNull()).collect())
        for n in numbers:
            self._accept(read(records.where(number == n), key, text, digest, self.counts), n)
        return self.pairs(numbers)

    def _columns(self, folder: str) -> str:
        return self.FOLDERS[folder] if folder in self.FOLDERS else self.TABLES[folder][0]

    def _rows(self, folder: str, before: int | None = None) -> DataFrame:
        schema = T.StructType.fromDDL(self._columns(folder) + ", batch int")
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _write(self, rows: DataFrame, folder: str, number: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{folder}/batch={number}")

    def _insert(self, rows: DataFrame, table: str, number: int) -> None:
        placed = rows.withColumn("batch", F.lit(number)).repartition(self.buckets, self.TABLES[table][1])
        remove(self.spark, f"{self.path}/{table}/batch={number}")  # of a failed attempt
        self.spark.catalog.refreshTable(self._name(table))
        placed.write.mode("append").insertInto(self._name(table))

    def _accept(self, found: DataFrame, number: int) -> None:
        rows = stage(found.withColumn("uid", F.monotonically_increasing_id()), "batch")
        heads = rows.where("sign is not null").groupBy("sign").agg(F.min(F.struct("rec", "uid")).alias("head"))
        known = self.spark.table(self._name("members")).where(F.col("batch") < number).groupBy("sign").agg(F.min("class").alias("known"))
        named = heads.join(known, "sign", "left").select("sign", "head.uid", F.coalesce("known", "head.rec").alias("class"), F.col("known").isNull().alias("fresh"))
        named, n = counted(named, "named")
        small = F.broadcast(named) if n <= MAX_ROWS else named
        self._write(rows.where("h is not null").select("rec", "h", "none").distinct(), "files", number)
        texts = rows.drop("sign").join(small.drop("sign"), "uid")
        posted = texts.select(F.explode("tokens").alias("token"), "n_words", "class", "fresh")
        if not self.empty:
            self._write(self._links(posted, texts, number), "links", number)
        self._write(texts.where("fresh").select("class", "n_words", "bag"), "bags", number)
        self._insert(posted.where("fresh").select("token", "n_words", "class"), "postings", number)
        self._insert(rows.join(small.select("sign", "class"), "sign").select("sign", "rec", "class"), "members", number)
        self.empty = False
        drop(rows, named)

    def _links(self, posted: DataFrame, texts: DataFrame, number: int) -> DataFrame:
        """``(a, c)``: a class of the batch and a similar one of an earlier batch."""
        old = self.spark.table(self._name("postings")).where(F.col("batch") < number).select("token", F.col("n_words").alias("m"), F.col("class").alias("c"))
        new = posted.select("token", F.col("n_words").alias("n"), F.col("class").alias("a"))
        fewer, more = F.least("n", "m"), F.greatest("n", "m")
        met = new.hint("shuffle_hash").join(old, "token").where((fewer >= F.ceil(F.round(more * SIMILAR, 6))) & (F.col("a") != F.col("c")))
        tokens = F.greatest(fewer - (RUN - 1), F.lit(1))
        size = F.least(tokens, F.greatest(F.lit(LEAST), F.ceil(tokens * PREFIX)))
        bar = F.when(fewer <= SHORT, 1).otherwise(F.ceil(F.round(size * BAR, 6)))
        near, found = counted(met.groupBy("a", "c", bar.alias("bar")).count().where("count >= bar").select("a", "c"), "near")
        ours = texts.select(F.col("class").alias("a"), "n_words", F.col("bag").alias("x"))
        theirs = self._rows("bags", number).select(F.col("class").alias("c"), F.col("n_words").alias("m"), F.col("bag").alias("y"))
        both = theirs.join(F.broadcast(near) if found <= MAX_ROWS else near, "c").join(ours, "a")
        return both.where(shared_words("x", "y") >= F.ceil(F.round(F.greatest("n_words", "m") * SIMILAR, 6))).select("a", "c")

    def members(self) -> DataFrame:
        """``(rec, class, batch)`` of all accepted records with a word."""
        return self._rows("members").select("rec", "class", "batch").distinct()

    def links(self) -> DataFrame:
        """``(a, c)``, a < c: similar classes that came in different batches; with ``members`` all pairs, not written out."""
        return self._rows("links").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("c")).distinct()

    def pairs(self, numbers: list[int] | None = None) -> DataFrame:
        """Distinct pairs ``(rec_a, rec_b)`` of all records of different batches, rec_a's the earlier, rec_b's among ``numbers``.

        Same or similar text, or the same file if a text is null. Copies are written out here, so
        a class of n records gives up to n * n / 2 rows.
        """
        m = self.members()
        one, other = (m.select(F.col("class").alias(c), F.col("rec").alias(f"r{c}"), F.col("batch").alias(f"b{c}")) for c in "ac")
        across = self.links().join(one, "a").join(other, "c").select("ra", "ba", "rc", "bc")
        within = one.join(other, F.col("a") == F.col("c")).where("ba < bc").select("ra", "ba", "rc", "bc")
        files = self._rows("files")
        x, y = files.where("none").alias("x"), files.alias("y")
        same = x.join(y, F.col("x.h") == F.col("y.h")).select(F.col("x.rec").alias("ra"), F.col("x.batch").alias("ba"), F.col("y.rec").alias("rc"), F.col("y.batch").alias("bc"))
        found = across.unionByName(within).unionByName(same).where("ba != bc and ra != rc")
        late = F.col("ba") > F.col("bc")
        found = found.select(F.when(late, F.col("rc")).otherwise(F.col("ra")).alias("rec_a"), F.when(late, F.col("ra")).otherwise(F.col("rc")).alias("rec_b"), F.greatest("ba", "bc").alias("b"))
        if numbers is not None:
            found = found.where(F.col("b").isin(numbers))
        return found.select("rec_a", "rec_b").distinct()

    def close(self) -> None:
        """Forget the bucketed tables and delete what only further batches would need; members and links stay."""
        for table in self.TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")
        remove(self.spark, *(f"{self.path}/{f}" for f in ("postings", "bags", "frozen")))


def replay(records: DataFrame, key: str, batch: str, text: str, digest: str | None = None) -> DataFrame:
    """Pairs ``(rec_a, rec_b)`` that come out when the batches arrive one after the other, rec_a in the earlier one; the first is the history."""
    spark = records.sparkSession
    number = F.col(f"`{batch}`").cast("int")
    first = records.agg(F.min(number)).first()[0]
    index = Index(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}")
    index.create(records.where(number == F.lit(first)), key, batch, text, digest)
    index.accept(records.where(number > F.lit(first)), key, batch, text, digest)
    index.close()
    return index.pairs()


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    records = spark.read.parquet(f"{root}/doc_registry.parquet").select("rec_id", "batch_no", "content", "file_hash")
    return replay(records, "rec_id", "batch_no", "content", "file_hash")
