import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import splitting as S
from quillstone.llm import tokenizing as K

ALPHABET = list("abcdeéßñ中😀 \n\t.,!1203ABC'sll")


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=K.load_ranks(), special_tokens={})


def test_encoder_equals_the_public_one():
    rng, mine, theirs = random.Random(1), K.Encoder(), reference()
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 80))) for _ in range(1500)] + ["a" * 700, "é" * 300, " " * 300, "ab" * 400, "<|endoftext|>"]
    assert [mine(t) for t in texts] == [theirs.encode_ordinary(t) for t in texts]


def test_transducer_is_incremental():
    machine = K.Transducer(K.load_ranks())
    for word in (b"internationalisation", b"aaaaaaaaaaaaaaaaaaaa", "Größenänderung".encode()):
        assert machine.encode(word) == machine.merge(word)
    state, out = 0, []
    for b in b"internationalisation of internationalisation":
        state, sure = machine.step(state, b)
        out += sure
    assert out  # tokens come before the end
    assert out + list(machine.finish(state)) == machine.merge(b"internationalisation of internationalisation")
    machine.forget()
    assert machine.encode(b"hello") == machine.merge(b"hello")


def test_encode_and_decode_tables(spark):
    rows = [(1, "Hello wörld 😀", 7), (2, None, None), (3, "", 0), (3, "", 0), (4, "x " * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = K.encode(docs)
    assert got.columns == ["doc_id", "text", "ids"]
    by = {r.doc_id: r.ids for r in got.collect()}
    assert by[2] == by[3] == [] and len(got.collect()) == 5
    assert by[1] == reference().encode_ordinary("Hello wörld 😀") and len(by[4]) > 5000
    back = {r.doc_id: r.decoded for r in K.decode(got).collect()}
    assert back[1] == rows[0][1] and back[4] == rows[4][1] and back[2] == ""
    assert K.encode(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        K.encode(docs, ids="text")
    assert "".join(K.stream([b"\xf0\x9f", b"\x98\x80", b"\xff"])) == "😀�"


def words(t):
    return [w for w in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]


def test_pieces_hold_the_limit_and_the_text():
    rng = random.Random(3)
    for _ in range(300):
        parts = [rng.choice(["a", "bb.", "c,", "d!\n", "é\n\n", "# h\n", " x"]) + rng.choice([" ", "\t", "\r\n", " "]) for _ in range(rng.randint(0, 120))]
        text = "".join(parts)
        most, overlap = rng.randint(1, 30), rng.randint(0, 40)
        pieces = S.pieces_of(text, most, overlap)
        all_words, own = words(text), []
        shared = min(overlap, most - 1) if len(all_words) > most else 0
        for k, (n, repeated, piece) in enumerate(pieces):
            w = words(piece)
            assert len(w) == n <= most
            if k:
                assert w[:repeated] == words(pieces[k - 1][2])[-repeated:] if repeated else True
                assert repeated == min(shared, len(own))
            own += w[repeated:]
        assert own == all_words


def test_cuts_at_natural_boundaries():
    text = "one two three four five.\n\nsix seven eight nine ten"
    assert [p for *_, p in S.pieces_of(text, 6, 0)] == ["one two three four five.", "six seven eight nine ten"]
    assert [p for *_, p in S.pieces_of("a b c. d e f g", 5, 1)] == ["a b c.", "c. d e f g"]


def test_split_table(spark):
    rows = [("k", "a b c d e f", 3, 1, "x"), ("n", None, 3, 1, "x"), ("e", " \n", 3, 1, "x"), ("z", "a b", None, None, "x"), (None, "a b c", 2, 5, "x")]
    docs = spark.createDataFrame(rows, "id string, text string, m int, o int, piece string")
    got = S.split(docs, "id", "text", "m", "o").collect()
    assert {r.id for r in got} == {"k", "z", None}
    assert [r.piece for r in got if r.id == "z"] == ["a b"]
    assert all(r.n_words <= 3 for r in got) and [r.piece_no for r in got if r.id == "k"] == list(range(sum(r.id == "k" for r in got)))
    assert S.split(docs.limit(0), "id", "text", "m", "o").count() == 0
    assert S.split(docs.withColumn("k", F.lit(1)).withColumn("t", F.lit(2)), "id", "text", "m", "o").count() == len(got)
