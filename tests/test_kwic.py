from __future__ import annotations

import itertools
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from textloom.operators import kwic, tokens

HIT_SCHEMA = (
    "doc string, CONC_left_context string, CONC_matched_text string, CONC_right_context string, "
    "CONC_start_idx bigint, CONC_end_idx bigint, CONC_l1 string, CONC_r1 string, "
    "CONC_l1_freq bigint, CONC_r1_freq bigint, CONC_doc_length bigint"
)


def hit_table(spark):
    hello = "Hello world this is a test document"
    other, third = "Another doc with some content here", "Different doc entirely"
    data = [
        (hello, "", "Hello", "world this", 0, 5, "", "world", 1, 1, len(hello)),
        (other, "Another", "doc", "with some", 8, 11, "Another", "with", 1, 1, len(other)),
        (hello, "Hello", "world", "this is", 6, 11, "Hello", "this", 1, 1, len(hello)),
        (third, "Different", "doc", "entirely", 10, 13, "Different", "entirely", 1, 1, len(third)),
    ]
    df = spark.createDataFrame(data, HIT_SCHEMA)
    return df.withColumn("CONC_extraction", kwic.extraction(F.col("doc")))


def reference_hits(text, pattern, left, right):
    """Contexts found the slow way."""
    out = []
    for m in re.finditer(pattern, text):
        before = list(re.finditer(r"\S+", text[: m.start()]))[-left:] if left else []
        after = list(itertools.islice(re.finditer(r"\S+", text[m.end() :]), right))
        lc = text[before[0].start() : before[-1].end()] if before else ""
        rc = text[m.end() :][after[0].start() : after[-1].end()] if after else ""
        low = max(0, m.start() - (len(lc) + 1 if lc else 0))
        high = m.end() + (len(rc) + 1 if rc else 0)
        out.append((lc, m.group(), rc, m.start(), m.end(), text[low:high]))
    return out


@pytest.mark.parametrize("left,right", [(10, 10), (1, 3), (40, 0), (0, 2)])
def test_hits_equal_brute_force(spark, left, right):
    rng = random.Random(left * 7 + right)
    vocabulary = ["the", "a", "über", "日本", "x" * 90, "y" * 700, "z" * 5000, "the.", "🙂", "q" * 17]
    texts = ["the", " the ", "", "   ", "thethe the"]
    for _ in range(30):
        size = rng.choice([3, 20, 150])
        gaps = [" ", "  ", "\n", " " * 200, "\t"]
        weights = [30, 20, 20, 10, 4, 2, 1, 20, 5, 5]
        texts.append(
            "".join(
                rng.choices(vocabulary, weights)[0] + rng.choices(gaps, [50, 5, 5, 1, 2])[0]
                for _ in range(size)
            )
        )
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", kwic.kwic_hits(F.col("t"), "the", left, right).alias("h")).collect()
    for r in got:
        want = reference_hits(texts[r["i"]], "the", left, right)
        fields = [*kwic.CORE[:5], "CONC_extraction"]
        assert [tuple(h[f] for f in fields) for h in r["h"]] == want
        near = reference_hits(texts[r["i"]], "the", 1, 1)
        assert [(h["CONC_l1"], h["CONC_r1"]) for h in r["h"]] == [(n[0], n[2]) for n in near]


def test_search_pattern():
    assert kwic.search_pattern("alpha.beta", whole_word=True).endswith(r"\b(?:alpha\.beta)\b")
    assert kwic.search_pattern("词", whole_word=True, language="zh") == "(?i)(?U)词"
    assert kwic.search_pattern("a|b", regex=True, case_sensitive=True) == "(?U)a|b"
    with pytest.raises(ValueError):
        kwic.search_pattern("  ")
    with pytest.raises(ValueError):
        kwic.search_pattern("a*", regex=True)


def test_case_and_whole_words(spark):
    data = [("alpha beta alpha", "A"), ("beta gamma", "B"), ("Alpha beta", "C"), ("alphabet", "D")]
    df = spark.createDataFrame(data, "text string, speaker string")

    def speakers(**options):
        hits = kwic.concordance(df, "text", "alpha", ["speaker"], **options)
        return sorted(r["speaker"] for r in hits.collect())

    assert speakers() == ["A", "A", "C", "D"]
    assert speakers(case_sensitive=True) == ["A", "A", "D"]
    assert speakers(whole_word=True) == ["A", "A", "C"]
    assert speakers(whole_word=True, language="ja") == ["A", "A", "C", "D"]
    tongues = {"A": "en", "B": None, "C": None, "D": " JA "}
    own = F.create_map(*[F.lit(x) for pair in tongues.items() for x in pair])[F.col("speaker")]
    df = df.withColumn("own", own)
    assert speakers(whole_word=True, language_col="own") == ["A", "A", "C", "D"]
    df = df.withColumn("own", F.when(F.col("speaker") == "D", "xx"))
    assert speakers(whole_word=True, language_col="own") == ["A", "A", "C"]
    assert speakers(language_col="own") == ["A", "A", "C", "D"]
    with pytest.raises(ValueError):
        speakers(whole_word=True, language="en", language_col="own")
    umlaut = spark.createDataFrame([("Bär äpfel ÄPFEL",)], "text string")
    assert kwic.concordance(umlaut, "text", "äpfel", [], whole_word=True).count() == 2


def test_matches_agree_with_hits(spark):
    df = spark.createDataFrame([(1, "ab ab"), (2, ""), (3, None), (4, "xx ab")], "id int, t string")
    full = kwic.concordance(df, "t", "ab", ["id"])
    light = kwic.matches(df, "t", "ab", ["id"])
    assert rows(full.select(light.columns)) == rows(light)
    assert light.count() == 3


def test_blank_documents_and_blank_hits(spark):
    data = [(None, "", ""), ("alpha", "", ""), ("   ", "", "\t"), ("", "context", None)]
    df = spark.createDataFrame(
        data, "CONC_matched_text string, CONC_left_context string, CONC_right_context string"
    )
    assert kwic.non_empty(df).count() == 2


def test_token_hits(spark):
    text = "The cat, the dog and THE end"
    df = tokens.tokenise(spark.createDataFrame([(1, text)], "id int, text string"), "text")
    name = tokens.find_derived(df, "text")
    hits = rows(
        kwic.token_concordance(df, "text", name, "dog|End, nothing", ["id"], left=2, right=1),
        "CONC_start_idx",
    )
    assert hits[0] == (1, "cat, the ", "dog", " and", 13, 16, "the", "and", "cat, the dog and", len(text))
    assert hits[1] == (1, "and THE ", "end", "", 25, 28, "the", None, "and THE end", len(text))
    assert kwic.token_concordance(df, "text", name, " , ", ["id"]).count() == 0
    assert kwic.token_alternatives("a, b|A") == ["a", "b"]


def test_token_hits_with_single_character_tokens(spark):
    text = "我爱你你爱我"
    df = tokens.tokenise(spark.createDataFrame([(text,)], "text string"), "text", "char")
    hits = kwic.token_concordance(
        df, "text", tokens.find_derived(df, "text"), "爱", [], left=1, right=2
    )
    got = hits.orderBy("CONC_start_idx").select(*kwic.CORE[:3]).collect()
    assert [tuple(r) for r in got] == [("我", "爱", "你你"), ("你", "爱", "我")]


def test_neighbour_frequencies_under_skew(spark):
    data = [(i, "common word" if i % 3 else f"w{i} word {'' if i % 2 else 'z'}") for i in range(600)]
    df = spark.createDataFrame(data, "id int, text string")
    hits = kwic.concordance(df, "text", "word", ["id"])
    got = kwic.with_neighbour_freqs(hits).collect()
    assert len(got) == 600
    for r in got:
        assert r["CONC_l1_freq"] == (400 if r["CONC_l1"] == "common" else 1)
        assert r["CONC_r1_freq"] == (100 if r["CONC_r1"] == "z" else 500)


def test_null_neighbours_have_no_frequency(spark):
    df = tokens.tokenise(spark.createDataFrame([("a b",), ("a b",)], "text string"), "text")
    hits = kwic.token_concordance(df, "text", tokens.find_derived(df, "text"), "a", ["text"])
    got = kwic.with_neighbour_freqs(hits).select("CONC_l1_freq", "CONC_r1_freq").collect()
    assert [tuple(r) for r in got] == [(None, 2), (None, 2)]


def test_dispersion_detach(spark):
    hits = hit_table(spark)
    out = {r["doc"]: r for r in kwic.dispersion_detach(hits, "doc").collect()}
    hello = out["Hello world this is a test document"]
    assert hello["CONC_extraction"] == "- Hello world this\n- Hello world this is"
    assert hello["CONC_matched_text"] == ["Hello", "world"] and hello["CONC_l1_freq"] == [1, 1]
    assert len(out) == 3
    assert kwic.dispersion_detach(hits, "doc", bins=[0], total_bins=2).count() == 3
    assert kwic.dispersion_detach(hits, "doc", bins=[1], total_bins=2).count() == 0
    assert kwic.dispersion_detach(hits, "doc", matched_texts=[]).count() == 0
    some = kwic.dispersion_detach(hits, "doc", matched_texts=["hello", "DOC"], fold_case=True)
    assert {tuple(r["CONC_matched_text"]) for r in some.collect()} == {("Hello",), ("doc",)}


def test_copies_of_a_text_become_one_row(spark):
    df = spark.createDataFrame([(i, "so the end") for i in range(50)], "id int, text string")
    hits = kwic.concordance(df, "text", "the", ["text"])
    (row,) = kwic.dispersion_detach(hits, "text", merge_copies=True).collect()
    assert row["copies"] == 50 and row["CONC_matched_text"] == ["the"]


def test_dispersion_sums_to_hits(spark):
    texts = [("the " * n,) for n in (1, 7, 50, 333)]
    df = spark.createDataFrame(texts, "text string")
    hits = kwic.matches(df, "text", "the", [])
    fine = kwic.dispersion(hits)
    assert fine.agg(F.sum("count")).first()[0] == hits.count() == 391
    assert fine.agg(F.max("bin_idx"), F.min("bin_idx")).first()[0] <= 99
    for bins in (4, 5, 10, 20, 25, 50):
        wide = kwic.rebin(fine, bins)
        assert wide.agg(F.sum("count")).first()[0] == 391
        assert wide.agg(F.max("bin_idx")).first()[0] < bins
    with pytest.raises(ValueError):
        kwic.rebin(fine, 7)


def test_interleave_and_pages(spark):
    left = spark.createDataFrame([(f"L{i}",) for i in (1, 2, 3, 4)], "v string")
    right = spark.createDataFrame([(f"R{i}",) for i in (1, 2)], "v string")
    both = kwic.interleave(left, right, ["v"], "a", "b")
    assert [r["v"] for r in both.orderBy("position").collect()] == ["L1", "R1", "L2", "R2", "L3", "L4"]
    docs = spark.createDataFrame([(i, "x " * i) for i in range(30)], "id int, t string")
    page = kwic.document_page(docs, ["id"], page=2, page_size=7)
    assert [r["id"] for r in page.orderBy("id").collect()] == list(range(7, 14))
    sizes = {"x": 10, "y": 100}
    for pattern, size in sizes.items():
        assert kwic.estimate_page_size(docs, "t", pattern, ["id"]).first()[0] == size


def test_hits_by_document_and_summary(spark):
    hits = hit_table(spark)
    grouped = {r["doc"]: r["hits"] for r in kwic.hits_by_document(hits, "doc").collect()}
    assert [h["CONC_matched_text"] for h in grouped["Hello world this is a test document"]] == [
        "Hello",
        "world",
    ]
    source = spark.range(9)
    assert tuple(kwic.hit_summary(hits, "doc", source).first()) == (4, 3, 9)


def test_text_does_not_travel_with_the_hits(spark):
    df = spark.createDataFrame([(1, "the end")], "id int, text string")
    plan = kwic.concordance(df, "text", "the", ["id"])._jdf.queryExecution().toString()
    generate = next(x for x in plan.split("Physical Plan")[1].split("\n") if "Generate" in x)
    assert re.search(r"\), \[(.*?)\], false", generate).group(1).split("#")[0] == "id"
