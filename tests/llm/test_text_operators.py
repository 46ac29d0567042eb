import random

from quillstone.llm import boilerplate as P
from quillstone.llm import encoding as E
from quillstone.llm import leakage as L
from quillstone.llm import reading as R

RNG = random.Random(4)
NAMES = ["".join(RNG.choice("bcdfgklmnprst") + RNG.choice("aeiou") for _ in range(4)) for _ in range(400)]


def passage(n, rng):
    return " ".join(rng.choice(NAMES if i % 3 == 0 else ["the", "index", "of", "a", "writes", "cache", "and", "then", "reads", "every", "file"]) for i in range(n))


def test_tiles_and_order():
    a, b = "a b c d e f".split(), "x d e f y a b c".split()
    assert sorted(L.tiles(a, b)) == [(0, 5, 3), (3, 1, 3)]
    assert L.tiles([], a) == []
    assert L.in_order("a b c d".split(), "a x c d".split()) == 3


def test_leaks(spark):
    rng = random.Random(8)
    p, q = passage(40, rng), passage(50, rng)
    w = q.split()
    scattered = " ".join("zzz" if i % 3 == 1 else x for i, x in enumerate(w))
    half = " ".join("zzz" if i % 2 else x for i, x in enumerate(w))
    fill = lambda: passage(120, rng)
    docs = [
        (1, f"{fill()} {p.upper()} {fill()}"), (2, f"{fill()} <b>{' '.join(p.split()[5:20])}</b> {fill()}"), (3, f"{fill()} {' '.join(p.split()[5:17])} {fill()}"), (4, f"{fill()} {scattered} {fill()}"),
        (5, f"{fill()} {half} {fill()}"), (6, None), (7, ""), (8, fill()), (9, "Nobody knows Falbaro here. And more."), (9, "Nobody knows Falbaro here. And more."), (10, fill() + " " + q.replace(" ", "\n> ") + " " + fill() * 20),
    ]
    cases = [("a", p, "z"), ("b", p, "z"), ("c", q, "z"), ("d", None, "z"), ("e", "", "z"), ("f", "!", "z"), ("g", "nobody knows Falbaro here", "z"), (None, p, "z"), ("h", "the", "z")]
    table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(cases, "id string, expected_answer string, text string")
    got = sorted(tuple(r) for r in L.leaks(*table).collect())
    assert got == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (4, "c"), (9, "g"), (10, "c")]
    assert L.leaks(table[0], table[1].limit(0)).count() == L.leaks(table[0].limit(0), table[1]).count() == 0


CLEAN = ["Le résumé décide où réécrire la tâche périmée à côté", "Die Größe prüft das Menü für später", "The naïve café — “quoted” words — costs 40 €", "El índice está aquí mañana"]


def test_mojibake_round_trip(spark):
    rng = random.Random(6)
    texts = [rng.choice(CLEAN) for _ in range(200)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    pairs = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("mac-roman", "cp1252"), ("cp850", "cp1252")]
    damaged = {}
    for k, (true, wrong) in enumerate(pairs):
        text = CLEAN[k % 2]
        damaged[1000 + k] = text
        rows.append((1000 + k, text.encode(true).decode(wrong, "replace") if wrong != "cp1252" else "".join(bytes((b,)).decode("cp1252", "ignore") or chr(b) for b in text.encode(true)), "x"))
    twice = "".join(bytes((b,)).decode("cp1252", "ignore") or chr(b) for b in CLEAN[0].encode())
    rows += [(1100, "".join(bytes((b,)).decode("cp1252", "ignore") or chr(b) for b in twice.encode()), "x"), (1101, CLEAN[0].encode("latin-1").decode("utf-8", "replace"), "x"), (1102, "&Atilde;&copy;t&Atilde;&copy;", "x")]
    rows += [(1, "été «Â» and «Ã» are capital letters", "x"), (2, "Ångvik™ module – 5 × faster, NÃO", "x"), (3, None, "x"), (4, "", "x"), (5, "plain &amp; ascii", "x")]
    got = {(r.doc, r.text): r for r in E.repair(spark.createDataFrame(rows, "doc long, text string, restored string"), "text").collect()}
    by = {k[0]: r for k, r in got.items() if k[0] >= 1000}
    assert all(by[k].damaged > 0 for k in by)
    assert all(by[k].restored == t for k, t in damaged.items())
    assert by[1100].restored == CLEAN[0] and by[1101].restored == CLEAN[0] and by[1101].lost > 0
    assert all(r.damaged == 0 and r.restored == r.text for k, r in got.items() if k[0] < 1000)


def test_repair_of_nothing(spark):
    assert E.repair(spark.createDataFrame([], "text string"), "text").count() == 0


def pages(seed=2):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(60):
        host = f"www.site{i % 3}.example"
        items = [passage(2, rng).title() for _ in range(3)]
        body = ["# " + passage(3, rng).title(), passage(40, rng) + ".", "- own item of " + passage(3, rng), "```", "Home", "```", "| a | Home |"]
        nav = ["<ul>", '<li><a href="/h">Home</a></li>', '<li><a href="/b">Blog</a></li>', "</ul>", f"Home > Blog > {items[0]}"]
        side = ["Related pages", *(f"[{t} x](/y)" for t in items), ""]
        foot = [f"© {2000 + i} Site{i % 3}. All rights reserved.", f"{i} comments"]
        lines = [*nav, "", *body, "", *side, *foot]
        truth[i] = {j + 1 for j, t in enumerate(lines) if t and t not in body}
        rows.append((i, host, "\n".join(lines), "x"))
    return rows, truth


def test_boilerplate(spark):
    rows, truth = pages()
    table = spark.createDataFrame(rows + [(100, "www.site1.example", None, "x"), (101, None, "", "x"), (102, None, "only text here", "x")], "rec long, host string, content string, body string")
    got = {r.rec: r for r in P.classified(table, "rec", "host", "content").collect()}
    assert all(set(got[i].removed) == truth[i] for i in truth)
    assert got[100].body is None and got[101].body is None and got[102].body == "only text here"
    assert P.classified(table.limit(0), "rec", "host", "content").count() == 0


def test_boilerplate_of_any_length(spark):
    rng = random.Random(5)
    notice = passage(40, rng) + "."
    legal = passage(60, rng) + "."
    rows, truth = [], {}

    def page(host, marked):
        rows.append((len(rows), host, "\n".join(t for t, _ in marked)))
        truth[rows[-1][0]] = {j + 1 for j, (_, gone) in enumerate(marked) if gone}

    for _ in range(20):  # long notices below long bodies, one beside a short node, one as a part, one behind the page's own text
        page("a.example", [(passage(40, rng), False), ("Send us feedback", True), (notice, True), (legal, True), (f"{notice} Send us feedback", True), (f"{notice} | Send us feedback", True), (f"{passage(40, rng)} | Send us feedback", False)])
    for _ in range(20):  # all long lines are notices
        page("b.example", [(passage(20, rng), False), (legal, True)])
    body = [passage(40, rng) for _ in range(12)]
    for i in range(12):  # near copies of a body, which stays one
        page("c.example", [(body[0], False), *((passage(40, rng) if j == i else t, False) for j, t in enumerate(body[1:], 1)), ("all about this page", True), (legal, True)])
    for _ in range(12):
        page("c.example", [(passage(40, rng), False), ("all about this page", True), (legal, True)])
    got = {r.rec: set(r.removed) for r in P.classified(spark.createDataFrame(rows, "rec long, host string, content string"), "rec", "host", "content").collect()}
    assert got == truth


def test_two_nodes_side_by_side():
    site, low = "quill", {P.node(t, "quill"): 0.1 * i for i, t in enumerate(("Our 12 Quill pages: ", "™ of this site and of all the other sites we run", "About"), 1)}
    cut = lambda text: P.side_by_side(text, low, site)
    assert abs(cut("our 7 quill pages:  ™ of this site and of all the other sites we run.") - 0.2) < 1e-9 and abs(cut("About about") - 0.3) < 1e-9
    assert cut("About our site") == cut("About") == cut("") == 1.0


EASY = ["the cat sits", "we like the red cup", "is the door open", "go home now", "the dog runs"]
MIDDLE = ["to configure the search index set the limit and restart the upload queue", "the retry policy monitors the vector cache every hour", "although the report looks stable the operator removes the backup"]
HARD = ["epistemological heteroscedasticity presupposes incommensurable parameterisation", "notwithstanding methodological orthogonality the counterfactual quantification necessitates decomposition"]


def test_reading_levels_on_held_out_documents(spark):
    rng = random.Random(9)
    docs, truth = [], {}
    for i in range(240):
        level = i % 3 + 1
        own = (EASY, MIDDLE, HARD)[level - 1]
        parts = [rng.choice(own) + rng.choice([".", "!", "?"]) + " " + rng.choice(NAMES).title() + "." for _ in range(12)]
        if rng.random() < 0.3:
            parts.insert(3, rng.choice((HARD, EASY, MIDDLE)[level % 3]) + ".")
        docs.append((i, " ".join(parts) + ("\n```\nx_y = 3\n```" if i % 5 == 0 else ""), "t"))
        truth[i] = level
    docs += [(900, None, "t"), (901, "", "t"), (902, "too short", "t"), (903, "the cat sits and then " * 3000, "t")]
    labels = [(i, truth[i] if rng.random() < 0.9 else rng.randint(1, 3), "r1") for i in range(0, 160)] + [(1, None, "r2"), (2, 7, "r2"), (5, truth[5], "r1")]
    tables = spark.createDataFrame(docs, "doc_id long, text string, level string"), spark.createDataFrame(labels, "doc_id long, reading_level int, rater string")
    got = {r.doc_id: r.reading_level for r in R.levels(*tables).collect()}
    assert not {900, 901, 902} & got.keys() and got[903] == 1
    held = [i for i in range(160, 240)]
    assert sum(got[i] == truth[i] for i in held) >= 0.95 * len(held)
    assert R.levels(tables[0], tables[1].limit(0)).count() == 0
    assert R.levels(tables[0].limit(0), tables[1]).count() == 0


def test_leak_whose_rare_words_are_swapped(spark):
    passage = [f"name{i}" if i % 5 in (0, 2) else f"usual{i}" for i in range(30)]
    copy = [w.replace("name", "swapped") for w in passage]
    usual = [w for w in passage if w.startswith("usual")]
    docs = [(1, "start " * 40 + " ".join(copy) + " end" * 40), (2, " ".join(passage[::-1]))] + [(10 + i, " ".join(usual[::-1])) for i in range(4)]
    got = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("c", " ".join(passage))], "id string, expected_answer string"))
    assert [tuple(r) for r in got.collect()] == [(1, "c")]


def damaged_as(text, true, wrong):
    return "".join(bytes((b,)).decode(wrong, "ignore") or chr(b) for b in text.encode(true))


def test_no_restoration_that_changes_nothing(spark):
    line = "«Â» and «Ã» are capital letters, été"
    rows = [(i, line) for i in range(10_000)] + [(20_000 + i, t) for i, t in enumerate(CLEAN * 20)]
    got = E.repair(spark.createDataFrame(rows, "id long, text string"), "text")
    assert got.where("damaged > 0").count() == 0


def test_damaged_copies_do_not_outvote_the_rest(spark):
    bad = damaged_as(CLEAN[1], "utf-8", "cp1252")
    rows = [(i, bad) for i in range(3000)] + [(5000 + i, f"{CLEAN[1]} {i}") for i in range(4)]
    got = E.repair(spark.createDataFrame(rows, "id long, text string"), "text").groupBy("restored", "damaged").count().collect()
    assert {(r.restored, r["count"]) for r in got if r.damaged} == {(CLEAN[1], 3000)} and len(got) == 5


def test_lost_bytes_inside_sequences(spark):
    pair = damaged_as("é", "utf-8", "cp1252")
    rows = [(i, t) for i, t in enumerate(CLEAN * 10)] + [(100, "r" + pair[0] + E.LOST + "sum" + E.LOST + pair[1] + " &eacute;t&eacute; &lt;b&gt;"), (101, "zz" + E.LOST + "zz x")]
    got = {r.id: r for r in E.repair(spark.createDataFrame(rows, "id long, text string"), "text").collect()}
    assert got[100].restored == "résumé &eacute;t&eacute; &lt;b&gt;" and got[100].lost > 0
    assert got[101].restored == "zz" + E.LOST + "zz x" and got[101].damaged == 1
    assert not any(got[i].damaged for i in range(40))


def test_importance_is_entropy(spark):
    rows = [(i, "h.example", f"Menu\nAbout us\n\n{passage(30, random.Random(i))}.\n\nSee also\n- {NAMES[i]} of {NAMES[i + 1]} here\n- {NAMES[i + 2]} at {NAMES[i + 3]} now") for i in range(200)]
    rows += [(500 + i, f"small{i}.example", f"Twice here\n{passage(30, random.Random(900 + i // 2))} {i}.") for i in range(4)]
    pages = spark.createDataFrame(rows, "rec long, host string, content string")
    low = {r.node: r for r in P.tree(pages).collect() if r.host == "h.example"}
    node = lambda t: low.get(P.node(t, "h"))
    assert node("Menu").importance < 0.02 and node("See also").label and not node("Menu").label and node(f"{NAMES[0]} of {NAMES[1]} here") is None
    got = {r.rec: r.removed for r in P.classified(pages, "rec", "host", "content").collect()}
    assert all(got[i] == [1, 2, 6, 7, 8] for i in range(200)) and not any(got[500 + i] for i in range(4))


def test_leaks_in_several_blocks(spark, monkeypatch):
    rng = random.Random(12)
    passages = [passage(30, rng) for _ in range(12)]
    docs = spark.createDataFrame([(i, f"{passage(50, rng)} {p} {passage(50, rng)}") for i, p in enumerate(passages)], "doc_id long, text string")
    cases = spark.createDataFrame([(f"c{i}", p) for i, p in enumerate(passages)], "id string, expected_answer string")
    monkeypatch.setattr(L, "BLOCK", 5)
    assert sorted(tuple(r) for r in L.leaks(docs, cases).collect()) == [(i, f"c{i}") for i in range(12)]
