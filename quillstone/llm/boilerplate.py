"""Main body of web pages, by a site style tree.

A page is a tree: branches of neighbouring lines in one presentation (items, links, plain
phrases) under a label, lines below them, parts of separated lines below those. The
pages of a host are merged into one tree by the nodes' presentation and text, numbers and
the site's name masked, and the trees of all hosts into one more. The importance of a
node is the entropy it takes from a page: of m pages n have it, each equally likely, so
its content says log n of the log m there is to know (importance 0 if all pages have it, 1 if one
has). A label's presentation is of low importance if what follows it hardly varies over
its pages. Branches of low importance are removed. Lines of any length are nodes. Spark counts the
nodes over distinct bodies, which long lines tell apart unless they stand beside many bodies
(notices); no page is shuffled unless the tree is too large to broadcast.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.words import fold
from quillstone.plans.broadcasting import broadcast_if_small, small_enough
from quillstone.plans.staging import stage

#: Below it a node or branch is of low importance: 0.6 means on more than the 0.4th power of the pages.
IMPORTANT = 0.6
#: Pages without a node that are thought to be on every site beside those seen: one or two copies prove nothing.
UNSEEN = 8
#: Longer lines and line parts are text (words): it tells copies of a body, and is never the own name in a path of nodes.
LONGEST = 24
#: Nodes of a tree that is broadcast, and parts a host's pages are split into where it isn't.
BROADCAST, SALT = 1_000_000, 16

_TAGS = re.compile(r"</?[A-Za-z][^<>]*>")
_LINK = re.compile(r"\[([^\[\]]*)\]\([^()\s]*\)")
_ITEM = re.compile(r"(?:[-*•+]|\d+[.)])\s+")
_PARTS = re.compile(r"\s+(?:[|·•»›>/]|&gt;|&raquo;)\s+")
_NUMBER = re.compile(r"\d+")
_ENDS = re.compile(r"[.!?…:;,=_|]|\d")
_EDGE = " .:*_"


def site_of(host: str) -> str:
    """The host's own name: its longest label but the last."""
    return max(host.split(".")[:-1] or [host], key=len) if host else ""


def shape(line: str) -> tuple[str, str]:
    """``(presentation, text)`` of a stripped line."""
    if line.startswith("#"):
        return "heading", line.lstrip("# ")
    if line.startswith("|"):
        return "table", line
    bare = _TAGS.sub("", line).strip()
    if not bare:
        return "markup", ""
    kind = "plain"
    if bare != line and ("<li" in line or "<a" in line):
        kind = "item"
    elif m := _ITEM.match(bare):
        kind, bare = "item", bare[m.end() :]
    if m := _LINK.fullmatch(bare):
        kind, bare = "link", m[1]
    elif "](" in bare:
        bare = _LINK.sub(r"\1", bare)
    return kind, html.unescape(bare) if "&" in bare else bare


def masked(text: str) -> str:
    """The folded text, numbers masked, without its edges."""
    return _NUMBER.sub("0", fold(text)).strip(_EDGE)


def _coded(plain: str, site: str) -> bytes:
    return (plain.replace(site, "@") if site and site in plain else plain).encode("utf-8", "surrogatepass")


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def _node(plain: str, site: str) -> int:
    return _number(hashlib.blake2b(_coded(plain, site), digest_size=8).digest())


def node(text: str, site: str) -> int:
    """The node of a text: a hash of its folded form, numbers and the site's name masked."""
    return _node(masked(text), site)


def phrase(text: str, least: int = 2) -> bool:
    """Presented as a title or an entry: a few words, no sentence."""
    return least <= len(text.split()) <= 9 and not _ENDS.search(text)


def lines_of(content: str) -> list[tuple[str, str]]:
    """``(presentation, text)`` of each line; fenced code is "code", blank lines are ""."""
    out, fenced = [], False
    for line in content.split("\n"):
        line = line.strip()
        if line.startswith("```") or line.startswith("~~~"):
            fenced = not fenced
            out.append(("code", line))
        elif not line:
            out.append(("", ""))
        elif fenced:
            out.append(("code", line))
        else:
            out.append(shape(line))
    return out


def text_like(text: str) -> bool:
    return len(text.split()) > LONGEST


def parts(text: str) -> list[str]:
    return [p for p in _PARTS.split(text) if p.strip()]


def units(text: str) -> list[str]:
    """The parts of a line that holds text, else the line."""
    pieces = parts(text)
    return pieces if any(map(text_like, pieces)) else [text]


def body_sign(lines: list[tuple[str, str]], site: str = "", notices: Collection[int] = ()) -> int:
    """Equal for copies of a body, mostly equal for near copies: the least hash of its long lines but ``notices``."""
    own = [t for _, t in lines if t]
    long = [t for t in own if text_like(t)]
    if long and notices:
        shared = {t for t in long if all(node(u, site) in notices for u in units(t) if text_like(u))}
        long = [t for t in long if t not in shared]
        own = [t for t in own if t not in shared and node(t, site) not in notices] if not long else own
    return min((node(t, "") for t in long or own), default=0)


def countable(kind: str) -> bool:
    return kind in ("plain", "item", "link")


def importance(pages: Column, own: Column) -> Column:
    """1 less the share of the pages' entropy that a node on ``own`` of them has."""
    return 1 - F.log(own) / F.log(pages + UNSEEN)


def beside(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``pages`` with the other columns of ``found``, as lists, of their host."""
    lists = found.groupBy("host").agg(*(F.collect_list(c).alias(c) for c in found.columns if c != "host"))
    if small_enough(found, BROADCAST):
        return pages.join(F.broadcast(lists), "host", "left")
    # a host with a third of all pages is split into parts, each with the host's nodes
    salted = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return pages.withColumn("part", F.pmod(F.xxhash64("key", "content"), F.lit(SALT)).cast("int")).join(salted, ["host", "part"], "left")


_NODES = "host string, node long, sign long, heads int"


def _rows(out: list[tuple[str, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32()))], ["host", "node", "sign", "heads"])


def page_lines(pages: DataFrame) -> DataFrame:
    """``(host, node, sign, heads)`` of every line's units, the sign being that of the whole content; ``heads`` is 1 for long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int, int]] = []
            for host, content, sign in zip(*(c.to_pylist() for c in batch.columns)):
                site = site_of(host)
                own = {0: 0} | {node(u, site): int(text_like(u)) for _, t in lines_of(content or "") if t for u in units(t)}
                out += [(host, n, sign, f) for n, f in own.items()]
            yield _rows(out)

    return pages.select("host", "content", F.xxhash64("content")).mapInArrow(run, _NODES)


def text_bodies(pages: DataFrame, shared: DataFrame) -> DataFrame:
    """Counts of bodies (as ``node_counts`` gives) beside each unit of ``shared`` (host, node, all).

    A page counts by the share of its other words that it has alone, a unit on ``all`` pages
    being to one part of ``all`` its own: copies of a body make about one, also near copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int, float]] = []
            known: dict[str, dict[int, int]] = {}
            hosts, contents, signs = (c.to_pylist() for c in batch.columns[:3])
            for i, (host, content, sign) in enumerate(zip(hosts, contents, signs)):
                if host not in known:
                    known[host] = dict(zip(*(c[i].as_py() or () for c in batch.columns[3:])))
                site, words = site_of(host), {}
                for u in (u for _, t in lines_of(content or "") if t for u in units(t)):
                    n = node(u, site)
                    words[n] = words.get(n, 0) + len(u.split())
                total, own = sum(words.values()), sum(w / known[host].get(n, 1) for n, w in words.items())
                out.append((host, 0, sign, 1.0))
                out += [(host, n, sign, max(own - words[n] / known[host][n], 0.0) / max(total - words[n], 1)) for n in words.keys() & known[host].keys()]
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()))], ["host", "node", "sign", "share"])

    beside_shared = beside(pages, shared.select("host", "node", "all")).select("host", "content", F.xxhash64("content"), "node", "all")
    once = beside_shared.mapInArrow(run, "host string, node long, sign long, share double").groupBy("host", "node", "sign").agg(F.max("share").alias("share"))
    return once.groupBy("host", "node").agg(F.sum("share").alias("n"), *(F.lit(0).alias(f"h{k}") for k in (0, 1, 2)))


def nodes(pages: DataFrame) -> DataFrame:
    """``(host, node, sign, heads)``: the node of each line and line part, once a page; node 0 stands for the page itself.
    Text is a node if it is a notice: other text is of high importance.

    ``heads`` is the presentation of the branch that a line heads: 1 items, 2 links, 0 none.
    The column ``notices`` of ``pages`` has the host's units that stand beside many bodies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int, int]] = []
            notices: dict[str, set[int]] = {}
            for i, (host, content) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if host not in notices:
                    notices[host] = set(batch.column(2)[i].as_py() or ())
                site = site_of(host)
                lines = lines_of(content or "")
                sign = body_sign(lines, site, notices[host])
                own = {0: 0}
                for j, (kind, text) in enumerate(lines):
                    if not countable(kind):
                        continue
                    after = lines[j + 1] if j + 1 < len(lines) else ("", "")
                    heads = ("item", "link").index(after[0]) + 1 if after[0] in ("item", "link") and phrase(after[1], 3) else 0
                    pieces = parts(text)
                    texts = {p for p in pieces if text_like(p)}
                    for part in {*pieces} if texts else {text, *pieces}:
                        n = node(part, site)
                        if part not in texts or n in notices[host]:
                            own[n] = max(own.get(n, 0), heads)
                out += [(host, n, sign, f) for n, f in own.items()]
            yield _rows(out)

    return pages.select("host", "content", "notices").mapInArrow(run, _NODES)


def node_counts(found: DataFrame) -> DataFrame:
    """``(host, node, n, h0, h1, h2)``: the distinct signs with a node, in all and by what it heads."""
    once = found.groupBy("host", "node", "sign").agg(F.max("heads").alias("heads"))
    return once.groupBy("host", "node").agg(F.count("*").alias("n"), *(F.count_if(F.col("heads") == k).alias(f"h{k}") for k in (0, 1, 2)))


def low_nodes(counts: DataFrame) -> DataFrame:
    """``(host, node, importance, label, all)``: the nodes of low importance on their host or over all hosts.

    A node's importance is the lesser of both; ``all`` is its number over all hosts. ``label``
    says that its presentation is of low importance too: over the pages of all hosts the
    branches it heads have little entropy, and most of them are lists.
    """
    counts = stage(counts, "nodes")
    sizes = counts.where("node = 0").select("host", F.col("n").alias("pages"))
    total = F.lit(counts.where("node = 0").agg(F.sum("n")).first()[0] or 0)
    n = F.col("all")
    everywhere = counts.where("node != 0").groupBy("node").agg(F.sum("n").alias("all"), *(F.sum(f"h{k}").alias(f"h{k}") for k in (0, 1, 2)))
    entropy = sum((F.when(F.col(f"h{k}") > 0, -F.col(f"h{k}") / n * F.log(F.col(f"h{k}") / n)).otherwise(0.0) for k in (0, 1, 2)), F.lit(0.0)) / F.log(n + UNSEEN)
    everywhere = everywhere.select("node", importance(total, n).alias("everywhere"), ((entropy < 1 - IMPORTANT) & (F.col("h1") + F.col("h2") > F.col("h0"))).alias("label"), "all")
    own = counts.where("node != 0").join(broadcast_if_small(sizes), "host").select("host", "node", importance(F.col("pages"), F.col("n")).alias("own"))
    found = own.join(everywhere, "node").select("host", "node", F.least("own", "everywhere").alias("importance"), "label", "all").where(F.col("importance") < IMPORTANT)
    return stage(found, "tree")


def tree(pages: DataFrame) -> DataFrame:
    """``low_nodes`` over distinct bodies. Where pages share long lines, those beside many bodies are notices; the others are copies of a body."""
    shared = low_nodes(node_counts(page_lines(pages)))
    if shared.where("label").isEmpty():
        return low_nodes(node_counts(nodes(pages.withColumn("notices", F.lit(None).cast("array<bigint>")))))
    notices = low_nodes(text_bodies(pages, shared)).select("host", F.col("node").alias("notices"))
    return low_nodes(node_counts(nodes(beside(pages, notices))))


def side_by_side(text: str, low: dict[int, float], site: str) -> float:
    """Importance of a text as two nodes side by side: of the greater of both, at the best cut; 1 if there is none."""
    words = masked(" ".join(text.split())).split(" ")
    best, before = 1.0, hashlib.blake2b(digest_size=8)
    for k in range(1, len(words)):
        if last := words[k - 1].rstrip(_EDGE):
            first = before.copy()
            first.update(_coded(last, site))
            if (value := low.get(_number(first.digest()))) is not None:
                best = min(best, max(value, low.get(_node(" ".join(words[k:]).strip(_EDGE), site), 1.0)))
        before.update(_coded(words[k - 1], site) + b" ")
    return best


def removed(lines: list[tuple[str, str]], low: dict[int, float], labels: set[int], site: str) -> list[bool]:
    """Which lines are in branches of low importance; ``low`` has the importance of the nodes where it isn't 1."""
    n = len(lines)
    values, label = [1.0] * n, [False] * n

    def of(text: str) -> float:
        return low.get(node(text, site), 1.0)

    # leaves
    for i, (kind, text) in enumerate(lines):
        if not countable(kind):
            continue
        values[i] = of(text)
        label[i] = values[i] < IMPORTANT and node(text, site) in labels
        pieces = parts(text)
        if len(pieces) > 1:  # a path or list of nodes: the one that is the page's own doesn't count, unless it is text
            each = sorted(map(of, pieces))
            values[i] = min(values[i], max([sum(each[:-1]) / (len(each) - 1), *(of(p) for p in pieces if text_like(p))]))
        elif values[i] >= IMPORTANT and low:
            values[i] = side_by_side(text, low, site)
    gone = [v < IMPORTANT for v in values]
    # the branch under a label whose presentation says nothing
    for i in np.flatnonzero(label):
        j = i + 1
        while j < n and lines[j][0] == "markup":
            j += 1
        kind = lines[j][0] if j < n else ""
        while j < n and kind in ("plain", "item", "link") and lines[j][0] == kind and not gone[j] and phrase(lines[j][1]):
            gone[j] = True
            j += 1
    # a branch of items or links is as important as its lines on average
    i = 0
    while i < n:
        j = i
        while j < n and lines[j][0] in ("item", "link") and lines[j][0] == lines[i][0]:
            j += 1
        if j - i > 1 and sum(0.0 if g else v for g, v in zip(gone[i:j], values[i:j])) < IMPORTANT * (j - i):
            gone[i:j] = [g or phrase(t, 1) for g, (_, t) in zip(gone[i:j], lines[i:j])]
        i = max(j, i + 1)
    # bare markup goes with what it frames
    for i, (kind, _) in enumerate(lines):
        if kind == "markup":
            after = next((gone[j] for j in range(i + 1, n) if lines[j][0] not in ("markup", "")), None)
            before = next((gone[j] for j in range(i - 1, -1, -1) if lines[j][0] not in ("markup", "")), None)
            gone[i] = bool(before) and after is not False or bool(after) and before is not False or bool(before and i + 1 < n and not lines[i + 1][0]) or bool(after and i and not lines[i - 1][0])
    return gone


def classified(pages: DataFrame, key: str, host: str, content: str) -> DataFrame:
    """``(key, body, removed)``: the main body of each page, and the numbers (from 1) of the non-blank lines that aren't part of it.

    Null and empty contents have a null body and no lines. A null or empty host is a site
    of its own. Lines of code, tables and headings always belong to the body. Repeated
    rows give repeated results, but count once for the tree, as do copies under other
    keys. Other columns play no part, whatever their names.
    """
    own = pages.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("host"), F.col(f"`{content}`").alias("content"))
    found = tree(own).select("host", F.col("node").alias("low"), F.col("importance").cast("float"), "label")
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, tuple[dict[int, float], set[int]]] = {}
        for batch in batches:
            bodies, numbers = [], []
            hosts_here, contents, lows = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.columns[3:6]
            for i, (host, content) in enumerate(zip(hosts_here, contents)):
                if not content:
                    bodies.append(None)
                    numbers.append([])
                    continue
                if host not in hosts:
                    if len(hosts) > 2_000:
                        hosts.clear()
                    names, values, flags = (c[i].as_py() or () for c in lows)
                    hosts[host] = dict(zip(names, values)), {n for n, f in zip(names, flags) if f}
                lines = lines_of(content)
                gone = removed(lines, *hosts[host], site_of(host))
                numbers.append([j + 1 for j, g in enumerate(gone) if g])
                bodies.append("\n".join(line for line, g in zip(content.split("\n"), gone) if not g))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array(numbers, pa.list_(pa.int32()))], ["key", "body", "removed"])

    return beside(own, found).select("key", "host", "content", "low", "importance", "label").mapInArrow(run, f"key {kind}, body string, removed array<int>").withColumnRenamed("key", key)


def registry_pages(spark: SparkSession, root: str) -> DataFrame:
    """Contents of records whose source_type is url in any spelling, with the host of the page."""
    rows = spark.read.parquet(f"{root}/doc_registry.parquet").select("rec_id", "source_type", "source_url", "content")
    host = F.lower(F.regexp_extract("source_url", r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]+)", 1))
    return rows.where(F.lower(F.trim("source_type")) == "url").where("content is not null").select("rec_id", host.alias("host"), "content")


def p5_bodies(spark: SparkSession, root: str) -> DataFrame:
    return classified(registry_pages(spark, root), "rec_id", "host", "content").select("rec_id", "body")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    rows = classified(registry_pages(spark, root), "rec_id", "host", "content")
    return rows.select("rec_id", F.explode("removed").alias("line_no")).distinct()
