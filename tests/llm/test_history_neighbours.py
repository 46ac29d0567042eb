import random
import tempfile
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillstone.functions.words import words
from quillstone.llm import history as H
from quillstone.llm import neighbours as N

SCHEMA = "rec long, batch int, content string, file_hash string, a string, rep int"


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(900)] + ["the", "of", "and"] * 60
    texts = [[rng.choice(vocabulary) for _ in range(rng.choice([8, 25, 60, 150]))] for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(rng.choice(texts))
        if rng.random() < 0.6:
            for _ in range(max(1, len(w) // 15)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w = w[len(w) // 2 :] + w[: len(w) // 2]
        text = " ".join(w)
        rows.append((i, i // 50, text.upper() + "!" if rng.random() < 0.1 else text, None, "x", 1))
    h = "AB" * 32
    rows += [(200, 0, None, f"sha256:{h}", "x", 1), (201, 1, "anything else", h.lower(), "x", 1), (202, 2, None, H.EMPTY_FILE, "x", 1), (203, 0, None, H.EMPTY_FILE, "x", 1)]
    rows += [(204, 1, " ", h, "x", 1), (205, 2, "", h, "x", 1), (206, 1, None, None, "x", 1), (207, None, texts[0][0], None, "x", 1), (None, 1, " ".join(texts[0]), None, "x", 1)]
    return rows


def brute(rows):
    out = set()
    bags = [(r[0], r[1], Counter(words(r[2]))) for r in rows if r[0] is not None and r[1] is not None and r[2] and words(r[2])]
    for i, (a, x, p) in enumerate(bags):
        for b, y, q in bags[:i] + bags[i + 1 :]:
            if x < y and (p & q).total() >= 0.8 * max(p.total(), q.total()):
                out.add((a, b))
    return out


def test_replay_equals_brute_force_and_batches(spark):
    rows = corpus()
    table = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in H.replay(table, "rec", "batch", "content", "file_hash").collect()}
    assert got == brute(rows) | {(200, 201)}
    index = H.Index(spark, tempfile.mkdtemp(prefix="spark-"))
    index.create(table.where("batch = 0 and rec is not null"), "rec", "batch", "content")
    found = set()
    for b in (1, 2):
        found |= {tuple(r) for r in index.accept(table.where(f"batch = {b} and rec is not null"), "rec", "batch", "content").collect()}
    assert found == brute(rows)


def test_replay_of_copies_and_nothing(spark):
    text = " ".join(f"word{i}" for i in range(40))
    copies = spark.range(300).select(F.col("id").alias("rec"), (F.col("id") % 3).cast("int").alias("batch"), F.lit(text).alias("content"))
    assert H.replay(copies, "rec", "batch", "content").count() == 3 * 100 * 100
    assert H.replay(copies.limit(0), "rec", "batch", "content").count() == 0
    assert H.replay(copies.unionAll(copies), "rec", "batch", "content").count() == 3 * 100 * 100


def test_hilbert_is_a_curve():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    place = N.hilbert(grid, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((150, 48))
    v = np.repeat(centres, 4, axis=0) + 0.1 * rng.standard_normal((600, 48))
    v *= rng.uniform(0.01, 50, (600, 1))
    rows = [(f"k{i:03}", [float(x) for x in r], i, "x") for i, r in enumerate(v)]
    bad = [("n", None), ("e", []), ("s", [1.0] * 24), ("z", [0.0] * 48), ("q", [float("nan")] * 48), ("i", [float("inf")] * 48), (None, [1.0] * 48), ("h", [None] + [1.0] * 47)]
    old = [("k000", [float(x) for x in -v[0]], -1, "x")]
    table = spark.createDataFrame(rows + [(k, x, 0, "x") for k, x in bad] + old, "id string, embedding array<double>, ts int, key string")
    got = N.neighbours(table, k=3, least=0.9, order=F.col("ts")).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    want = {(f"k{i:03}", f"k{j:03}") for i in range(600) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.9}
    found = {(r.id, r.neighbour) for r in got}
    assert len(found & want) >= 0.97 * len(want) and len(found - want) <= 0.03 * len(want)
    assert all(abs(r.cosine - s[int(r.id[1:]), int(r.neighbour[1:])]) < 1e-5 for r in got)
    assert max(r["rank"] for r in got) == 3
    assert N.neighbours(table.limit(0)).count() == 0


def test_equal_vectors(spark):
    table = spark.range(8).select(F.col("id").cast("string").alias("id"), F.array([F.lit(1.0)] * 48).alias("embedding"))
    got = N.neighbours(table, k=5, least=0.99).collect()
    assert Counter(r.id for r in got) == {str(i): 5 for i in range(8)}


def test_p6_neighbours_has_distant_ones_of_every_vector(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1500, 48)) * np.linspace(3, 0.5, 48)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    assert np.median(s.max(axis=1)) < 0.8
    root = tempfile.mkdtemp(prefix="spark-")
    rows = [(f"k{i:04}", [float(x) for x in r], "2024-01-01T00:00:00") for i, r in enumerate(v)]
    spark.createDataFrame(rows, "id string, embedding array<float>, created_at string").write.parquet(f"{root}/index_chunks.parquet")
    got = N.p6_neighbours(spark, root).collect()
    assert Counter(Counter(r.id for r in got).values()) == {5: 1500}
    want = {(f"k{i:04}", f"k{j:04}") for i in range(1500) for j in np.argsort(-s[i])[:5]}
    assert len({(r.id, r.neighbour) for r in got} & want) >= 0.9 * len(want)
    two = [(i, [x] + [0.0] * 47, "") for i, x in (("p", 1.0), ("m", -1.0))]
    assert N.neighbours(spark.createDataFrame(two, "id string, embedding array<float>, t string"), least=-2, copies=6).count() == 2
    assert N.neighbours(spark.createDataFrame(two[:0], "id string, embedding array<float>, t string"), least=-2, copies=6).count() == 0


def found(spark, rows):
    return {tuple(r) for r in H.replay(spark.createDataFrame(rows, "rec long, batch int, content string"), "rec", "batch", "content").collect()}


def test_long_pair_with_every_fifth_word_changed(spark):
    text = [f"word{i}" for i in range(200)]
    even = [f"new{i}" if i % 5 == 2 else w for i, w in enumerate(text)]
    mixed = random.Random(1).sample(text, 200)
    over = [f"other{i}" if i % 5 == 2 or i == 0 else w for i, w in enumerate(text)]
    rows = [(i, i, " ".join(w)) for i, w in enumerate((text, even, mixed, over))]
    assert found(spark, rows) == {(0, 1), (0, 2), (1, 2)}


def test_long_pair_of_few_and_many_rare_words(spark):
    common = [f"common{i}" for i in range(105)]
    rare = [f"rare{i}" for i in range(5)]
    few = common[:90] + rare + common[90:]
    many = common[:40] + [f"{i}00{i}" for i in range(15)] + common[55:90] + rare + common[90:]  # one block of 15 words made new: 5 against 20 rare places
    rows = [(i, i % 2, " ".join(w)) for i, w in enumerate((few, many))]
    others = [(10 + i, i % 2, " ".join(common[i % 50 : i % 50 + 55] + [f"own{i}x{j}" for j in range(50)])) for i in range(150)]
    assert found(spark, rows + others) == {(0, 1)}


def test_index_of_classes_and_repeated_batches(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(40)]
    changed = [[f"new{i}x{j}" if j % 6 == i % 6 else w for j, w in enumerate(text)] for i, text in enumerate(base)]
    rows = [(i, 0, " ".join(t)) for i, t in enumerate(base)] + [(100 + i, 1, " ".join(t)) for i, t in enumerate(changed)] + [(200 + i, 2, " ".join(base[i]).upper()) for i in range(40)]
    table = spark.createDataFrame(rows, "rec long, batch int, content string")
    index = H.Index(spark, "file://" + tempfile.mkdtemp(prefix="spark-") + "/index")
    index.create(table.where("batch = 0"), "rec", "batch", "content")
    first = {tuple(r) for r in index.accept(table.where("batch = 1"), "rec", "batch", "content").collect()}
    again = {tuple(r) for r in H.Index(spark, index.path).accept(table.where("batch = 1"), "rec", "batch", "content").collect()}
    assert first == again == {(i, 100 + i) for i in range(40)}
    found = {tuple(r) for r in index.accept(table.where("batch = 2"), "rec", "batch", "content").collect()}
    assert found == {(i, 200 + i) for i in range(40)} | {(100 + i, 200 + i) for i in range(40)}
    assert {tuple(r) for r in index.links().collect()} == {(i, 100 + i) for i in range(40)}
    assert {(r.rec, r["class"]) for r in index.members().collect() if r.batch == 2} == {(200 + i, i) for i in range(40)}
    index.close()
    assert len({tuple(r) for r in index.pairs().collect()}) == 120
