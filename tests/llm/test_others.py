"""Vectors, pages, conversations, and the pipeline as a whole."""

from __future__ import annotations

import functools
import html
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import compare, connect
from textloom.llm import decontaminate, learned_partitions, near_dup, quote_links, toxicity, wrappers
from textloom.llm.queries import QUERIES, SQL
from textloom.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


def brute_nearest(rows, k, every):
    out = {}
    known = [
        (i, np.array(v, float)) for i, v in rows
        if i is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    for q, x in known:
        if q % every == 0:
            best = sorted((-(np.float32(y).astype(float) * np.float32(x)).sum(), i) for i, y in known if i != q)
            out[q] = [i for _, i in best[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]
    rows += [(500, None), (501, [0.0] * 4), (502, [1.0, None, 0.0, 0.0]), (503, [math.nan] * 4),
             (504, [math.inf, 0.0, 0.0, 1.0]), (505, [1.0]), (520, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    found = learned_partitions.search(df, F.col("vec_id") % 20 == 0, k=5, probed=1.0, cell=50, block=64)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute_nearest(rows, 5, 20)
    empty = learned_partitions.search(df.filter("false"), F.lit(True))
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    few = learned_partitions.search(df.filter("vec_id < 3"), F.col("vec_id") == 0)
    assert few.count() == 2


def test_neighbour_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = learned_partitions.search(table, F.col("vec_id") % 20 == 0)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = table.collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        order = [i for i in np.lexsort((ids, -(x @ x[q]))) if i != q][:20]
        recall.append(len(got[ids[q]] & set(ids[order])) / 20)
    assert np.mean(recall) >= 0.9


def test_balanced_partition():
    rng = np.random.default_rng(1)
    x = learned_partitions._unit(rng.normal(size=(900, 8)))
    graph = learned_partitions._nearest(x, x, 10)
    part = learned_partitions.balanced_partition(graph, x, 6)
    sizes = np.bincount(part, minlength=6)
    cut = np.mean(part[graph] != part[:, None])
    assert sizes.max() <= math.ceil(1.05 * 150) and cut < 0.6


def test_page_texts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    scratch = Scratch(spark, "test")
    got = {r.page_id: r.text for r in wrappers.extract(pages, scratch).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        flat = re.sub("<[^>]+>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner))
        assert got[r.page_id] == " ".join(html.unescape(flat).split())
    scratch.close()


def layout(body, extra=""):
    return (
        f"<html><head><title>T</title></head><body><div id='top'><a href=/>Home</a> <a href=/x>News</a></div>"
        f"<div class='content'>{body}</div><div class='sidebar'><p>Side words of no use</p></div>{extra}"
        "<form><p>Search here</p></form></body></html>"
    )


def test_page_layouts(spark):
    """A host without article elements, with optional parts, comments and repeats."""
    rows = []
    for i in range(12):
        body = "".join(f"<p>Para {i} {j} &lt;b&gt; caf&eacute;</p>" for j in range(1 + i % 4))
        note = "<div class='notice'>Read this</div>" if i % 2 else ""
        more = f"<ul>{''.join(f'<li>item {i} {j}' for j in range(i % 3))}</ul>" if i % 3 else ""
        talk = f"<div class='comments'><p>I disagree {i}</p></div>"
        rows.append((i, "http://Plain.example/x", layout(body + more + note, talk)))
    rows += [(20, None, None), (21, "::bad", ""), (22, "http://lone.example", "just text"), (22, None, "<p>a<br>b <script>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    for limit in (100, 0):
        scratch = Scratch(spark, "test")
        out = wrappers.extract(df, scratch, broadcast_rows=limit).collect()
        scratch.close()
        got = {r.page_id: r.text for r in out}
        assert len(out) == len(rows)
        for i in range(12):
            want = [f"Para {i} {j} <b> café" for j in range(1 + i % 4)]
            want += [f"item {i} {j}" for j in range(i % 3)]
            assert got[i] == " ".join(want)
        assert got[20] == "" and got[21] == "" and {r.text for r in out if r.page_id == 22} == {"just text", "a b"}
    scratch = Scratch(spark, "test")
    assert wrappers.extract(df.filter("false"), scratch).collect() == []


def main_texts(spark, rows):
    """Texts by id of pages given as (id, url, html)."""
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(df, scratch).collect()}
    scratch.close()
    assert len(got) == len(rows)
    return got


def test_page_templates(spark):
    """Each layout of a host chooses for itself, also of the host of all null and broken URLs."""
    article = "<html><body><div class='ad'>Buy</div><article><h1>Head {0}</h1><p>Story {0}</p></article></body></html>"
    div = "<html><body><div id='top'><a href=/>Home</a></div><div class='content'><p>Report {0}</p></div></body></html>"
    table = "<html><body><section><p>Long {0} " + "words " * 60 + "</p></section><blockquote>Said {0}</blockquote></body></html>"
    rows = [(1, "http://two.example/a", article.format(1)), (2, "http://two.example/b", div.format(2))]
    rows += [(10 + i, "http://hot.example", table.format(i)) for i in range(30)]
    rows += [(50, "http://hot.example", div.format(50))]
    rows += [(60, None, article.format(60)), (61, "http://[bad", div.format(61)), (62, None, table.format(62))]
    got = main_texts(spark, rows)
    assert got[1] == "Head 1 Story 1" and got[2] == "Report 2"
    assert got[50] == "Report 50" and all(f"Long {i} words" in got[10 + i] for i in range(30))
    assert got[60] == "Head 60 Story 60" and got[61] == "Report 61" and got[62].startswith("Long 62 words")


def test_page_copies(spark):
    """Copies of a page keep their text; what differing pages share is dropped outside articles only."""
    div = "<html><body><div class='content'><p>Report {0}</p></div><div class='foot'><p>Imprint</p></div></body></html>"
    article = "<html><body><article><h1>Introduction</h1><p>Story {0}</p></article></body></html>"
    note = "<html><body><article><h1>Introduction</h1><p>Story x</p><div>Note</div></article></body></html>"
    rows = [(i, "http://five.example", div.format("x")) for i in range(5)]
    rows += [(100 + i, "http://many.example", div.format("x")) for i in range(1000)]
    rows += [(2000 + i, "http://named.example", article.format(i)) for i in range(6)]
    rows += [(2010 + i, "http://named.example", note) for i in range(6)]
    rows += [(3000 + i, "http://differ.example", div.format(f"{i} and more")) for i in range(5)]
    # Five copies in layouts that differ are still one text.
    rows += [(4000 + i, "http://names.example", div.format("x").replace("foot", "foot-" + "abcde"[i])) for i in range(5)]
    got = main_texts(spark, rows)
    assert {got[i] for i in [*range(5), *range(100, 1100), *range(4000, 4005)]} == {"Report x Imprint"}
    assert all(got[2000 + i] == f"Introduction Story {i}" for i in range(6))
    assert {got[2010 + i] for i in range(6)} == {"Introduction Story x Note"}
    assert all(got[3000 + i] == f"Report {i} and more" for i in range(5))


def test_page_unclosed(spark):
    """Open heads and empty or open graphics lose nothing that follows; side words need a side element."""
    body = "<article><h1>Title</h1><p>Story</p></article>"
    rest = "<footer><p>Imprint</p></footer></body></html>"
    story = [
        f"<html><head><title>T</title><meta charset=utf-8><body>{body}{rest}",
        f"<html><head><title>T</title><style>p {{}}</style>{body}{rest}",
        f"<html><head><title>T</title></head><body><svg width='1'/>{body}{rest}",
        f"<html><head><title>T</title></head><body><svg hidden/>{body}<svg><text>no</text></svg>{rest}",
        f"<html><head></head><body><iframe src='x'/><object data=x><template>{body}{rest}",
        f"<html><head><title>T<body><svg width=5/><text>no</text></svg>{body}{rest}",
        f"<html><body><iframe>no</iframe><object>no</object><template>no</template>{body}{rest}",
        f"<html><body><div id='page' class='has-header'>{body}<div class='sidebar'>Side</div></div>{rest}",
        f"<html><body><div class='header layout'>{body}<aside>{'Side ' * 30}</aside></div>{rest}",
        f"<html><body>{body.replace('<article', '<article class="post tag-legal"')}{rest}",
        "<html><body><article><header class='entry-header'><h1>Title</h1></header><p>Story</p>"
        f"<div class='share'>Share</div></article>{rest}",
        f"<html><body><div class='content with-sidebar'><p>Title</p><p>Story</p></div>{rest}",
        f"<html><body><div class='form page'><p>Title</p><p>Story</p></div>{rest}",
        f"<html><body><form><div><p>Title</p><p>Story</p></div></form>{rest}",
        f"<html><body><main class='search'>{body}</main><div class='comments'><article>{'No ' * 9}</article></div>{rest}",
        f"<html><body>{body}<script>var no = 1;",
    ]
    got = main_texts(spark, [(i, f"http://h{i}.example", page) for i, page in enumerate(story)])
    assert got == dict.fromkeys(range(len(story)), "Title Story")
    one = main_texts(spark, [(i, "http://all.example", page) for i, page in enumerate(story)])
    assert one == got


def test_page_sections(spark):
    """Links, sections named after a side word and odd attributes inside an article lose nothing."""
    rest = "<footer><p>Imprint</p></footer></body></html>"
    cases = [
        ("<h1><a href=/x>Linked title</a></h1><p>Story</p><ul><li><a href=/a>Ref one</a><li><a href=/b>Ref two</a></ul>",
         "Linked title Story Ref one Ref two"),
        ("<p title=Bob's>Story isn't lost</p><p data-x=\"a > b\" title='it\"s'>More</p><p alt=5'>End</p>",
         "Story isn't lost More End"),
        ("<section id='legal'><p>Law</p></section><section class='related-work'><p>Others</p></section>"
         "<section id='notice-period'><p>Notice</p></section><p data-class='ad' title='class=ads'>Text</p>",
         "Law Others Notice Text"),
        ("<p>Story</p><section id='comments'><p>No</p></section><div class='ad-slot'>Buy</div><div id='sidebar'>Side</div>"
         "<div class='share-buttons'>Share</div><div role='navigation'>Go</div><div class='wide newsletter'>Join</div>", "Story"),
    ]
    rows = [(i, f"http://s{i}.example", f"<html><body><article>{x}</article>{rest}") for i, (x, _) in enumerate(cases)]
    want = {i: w for i, (_, w) in enumerate(cases)}
    words = " ".join(f"word{i}" for i in range(120))
    teaser = "<article><p>Next story</p></article>"
    rows.append((50, "http://t.example", f"<html><body><div class='content'><p>{words}</p></div>{teaser}{rest}"))
    got = main_texts(spark, rows)
    assert {i: got[i] for i in want} == want and words in got[50]


def test_page_sizes(spark):
    """A page of 100,000 elements beside a short one, and a host with a layout for each page."""
    def text(i, n):
        return "".join(f"<x{(j * j + i) % 997}><p>P{i} {j}</p></x{(j * j + i) % 997}>" for j in range(n))

    long = [(i, "http://long.example", f"<html><body><main>{text(i, n)}</main></body></html>") for i, n in ((0, 50_000), (1, 40), (2, 5_000))]
    many = [
        (10 + i, "http://many.example", f"<html><body><div class='menu'>Go</div><article>{text(i, 3)}</article></body></html>")
        for i in range(300)
    ]
    got = main_texts(spark, long + many)
    for i, n in ((0, 50_000), (1, 40), (2, 5_000)):
        assert got[i] == " ".join(f"P{i} {j}" for j in range(n))
    assert all(got[10 + i] == f"P{i} 0 P{i} 1 P{i} 2" for i in range(300))


def test_long_alignment():
    """Matches of long sequences rise on both sides, and none is lost where one side is part of the other."""
    rng = random.Random(5)
    x = [f"<{rng.randrange(4_000)}" for _ in range(6_000)]
    y = [k for k in x if rng.random() < 0.9]
    for one, other in ((x, y), (y, x), (x, ["<a"] * 3_000), (["<a"] * 3_000, ["<b", "<a"] * 2_000)):
        found = wrappers._matches(one, other)
        assert all(one[i] == other[j] for i, j in found)
        assert all(i < k and j < m for (i, j), (k, m) in itertools.pairwise(found))
        if len(one) == 3_000:
            assert len(found) >= 1_000
    assert len(wrappers._matches(x, y)) >= 0.97 * len(y)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(wrappers._matches(a, b)) == best[-1][-1]


def test_wrapper_algebra():
    items, slots = wrappers.fold(["<ul", "<li", "#", "<li", "#", "<li", "#", ">ul", "<p", "#"])
    assert items == ["<ul", ["+", ["<li", "#"]], ">ul", "<p", "#"] and slots == [0, 0, 0, 1]
    joined = wrappers.align(["<a", "#", ">a"], ["<a", "#", "<b", "#", ">b", ">a"])
    assert joined == ["<a", "#", ["?", ["<b", "#", ">b"]], ">a"]
    assert wrappers.slots_of(joined, ["<a", "#", ">a"]) == [0]
    assert wrappers.slots_of(joined, ["<a", "#", "<b", "#", ">b", ">a"]) == [0, 1]
    assert wrappers.align(["<p", "#"], [["+", ["<p", "#"]]])[0][0] in ("+", "?")


MESSAGES = [
    (1, 0, "a", "Hello there\nHow are  you?"),
    (1, 1, "b", "> how are you?\nFine, thanks"),
    (1, 2, "a", ">> How are you?\n> fine,  THANKS\nGood\n>\n"),
    (1, 3, "b", "> unknown words\nWhat?"),
    (2, 0, "a", "> Good\nFrom another room\nHow are you?"),
    (2, 1, "a", None), (2, 2, "a", ""), (None, 3, "a", "> Good"), (2, None, "a", "x"), (1, 1, "b", "> how are you?\nFine, thanks"),
]


def test_quotes(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    out = quote_links.link_quotes(df.withColumn("depth", F.lit("old")))
    rows = out.collect()
    assert len(rows) == len(MESSAGES) and out.columns.count("depth") == 1
    got = {(r.conv_id, r.turn): r for r in rows}
    parent = {k: (r.parent_conv, r.parent_turn) for k, r in got.items()}
    assert parent[1, 1] == (1, 0) and parent[1, 2] == (1, 1) and parent[1, 3] == (None, None)
    assert parent[2, 0] == (1, 2) and parent[None, 3] == (None, None)
    assert (got[2, 0].thread_conv, got[2, 0].thread_turn, got[2, 0].depth) == (1, 0, 3)
    assert got[1, 2].own_text == "Good\n" and got[1, 2].n_quoted == 2 and got[1, 2].n_linked == 2
    assert got[2, 1].own_text == "" and got[1, 0].own_text == "Hello there\nHow are  you?"
    order = [(r.conv_id, r.turn) for r in rows if r.thread_conv == 1]
    assert order == [(1, 0), (1, 1), (1, 1), (1, 2), (2, 0), (1, 3)]
    assert quote_links.link_quotes(df.filter("false")).collect() == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF).sql(SQL[name])) == []


def test_names():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    """Every stage against what it must do, on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = {r.doc_id for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).filter("score >= 0.5").collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == [
        "toxicity", "minhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"
    ]
    scratch = Scratch(spark, "test")
    one = scratch.table(steps["toxicity"](spark, docs, SF), "one")
    assert {r.doc_id for r in one.collect()} == ids - bad and one.columns == columns
    two = scratch.table(steps["minhash_near_dedup"](spark, one, SF), "two")
    roots = {r.component_id for r in near_dup.near_duplicates(one, width=5).collect()}
    assert sorted(r.doc_id for r in two.collect()) == sorted(roots) and two.columns == columns
    three = scratch.table(steps["benchmark_decontamination"](spark, two, SF), "three")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.scan(two, bench).filter("n_hit > 0").collect()}
    assert {r.doc_id for r in three.collect()} == roots - hit and three.columns == columns
    four = scratch.table(steps["source_mixing"](spark, three, SF), "four")
    assert {r.doc_id for r in four.collect()} <= roots - hit and four.columns == columns
    five = steps["sharding"](spark, four, SF)
    assert five.count() == four.count() and five.columns[: len(columns)] == columns
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in four.collect())
    scratch.close()


def test_pipeline_odd(spark, odd):
    """Odd rows pass through every stage."""
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
    empty = odd.filter("false").select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_pipeline_clashing_columns(spark):
    """Columns named like those that operators make and drop come out as they went in."""
    names = ["copy", "copies", "shuffle_key", "__key", "__text", "__nth", "__source", "score", "kept", "rest", "none", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in names])
    for step, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, stage(spark, docs, SF)
        if step != "sharding":
            assert docs.columns == before, step
    mine = [F.col(f"`{n}`") == F.concat(F.lit(f"{n}:"), "doc_id") for n in names]
    both = docs.join(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "lang AS l", "n_chars AS c"), "doc_id")
    wrong = both.filter(~functools.reduce(lambda a, b: a & b, mine, (F.col("lang") == F.col("l")) & (F.col("n_chars") == F.col("c"))))
    assert docs.count() > 100 and wrong.count() == 0


def test_pipeline_without_ids(spark, make):
    """Rows without an id are deduplicated, decontaminated and drawn by their own text."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    story = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"more{i}" for i in range(60))
    rows = [(7, story), (None, story), (None, story), (None, other), (None, other), (None, f"{bench} {bench}"), (8, None)]
    steps = dict(corpus_pipeline.STAGES)
    two = steps["minhash_near_dedup"](spark, make(rows), SF)
    left = sorted(((r.doc_id, r.text) for r in two.collect()), key=str)
    assert left == sorted([(7, story), (None, other), (None, f"{bench} {bench}"), (8, None)], key=str)
    three = steps["benchmark_decontamination"](spark, two, SF)
    assert {(r.doc_id, r.text) for r in three.collect()} == {(7, story), (None, other), (8, None)}
    docs = make([(None, f"clean text {i}") for i in range(400)])
    four = steps["source_mixing"](spark, docs, SF).groupBy("text").count().collect()
    assert 210 < len(four) < 300 and len({r["count"] for r in four}) > 2
