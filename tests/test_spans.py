from __future__ import annotations

import random
import re
import unicodedata

import pytest
import regex
from conftest import rows
from pyspark.sql import functions as F

from textloom.functions import spans
from textloom.functions.textfix import composed, repair_mojibake, repair_text_columns
from textloom.operators import tokens


def random_texts(n, seed=0):
    rng = random.Random(seed)
    words = ["the", "Then", "über", "naïve", "a", "x" * 40, "日本", "🙂", "co-op", "end.", "ñandú"]
    texts = []
    for _ in range(n):
        size = rng.choice([0, 1, 3, 30, 400])
        texts.append("".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ", "]) for _ in range(size)))
    return texts


@pytest.mark.parametrize("pattern", [r"[\p{L}\p{N}]+", "the", r"\s+", "🙂|x", r"[^\s]{2}"])
def test_spans_equal_finditer(spark, pattern):
    texts = random_texts(30)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", spans.regex_spans(F.col("t"), pattern).alias("s")).collect()
    for r in got:
        want = [(m.group(), m.start(), m.end()) for m in regex.finditer(pattern, texts[r["i"]])]
        assert [tuple(x) for x in r["s"]] == want


def test_spans_of_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    assert [r[0] for r in df.select(spans.regex_spans(F.col("t"), "a")).collect()] == [[], []]


def test_empty_matches_are_rejected(spark):
    for pattern in ("", "a*", "x?"):
        with pytest.raises(ValueError):
            spans.check_pattern(pattern)
    df = spark.createDataFrame([("ab cd",)], "t string")
    with pytest.raises(Exception, match="without a span"):
        df.select(spans.regex_spans(F.col("t"), r"\b")).collect()


def test_cut_equals_slicing(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("aé日🙂 \n") for _ in range(900))
    cases = [(a, a + rng.choice([0, 1, 5, 100, 128, 129, 500])) for a in range(0, 899, 37)]
    cases = [(a, min(b, len(text))) for a, b in cases]
    df = spark.createDataFrame([(text, a, b) for a, b in cases], "t string, a bigint, b bigint")
    cut = spans.cut(F.col("t"), spans.chunked(F.col("t"), 7), 7, F.col("a"), F.col("b"))
    for r in df.select("a", "b", cut.alias("x")).collect():
        assert r["x"] == text[r["a"] : r["b"]]


def test_quote_literal(spark):
    word = "a.b*(c)[d]{2}|^$\\#&~-/é+?"
    df = spark.createDataFrame([(f"x {word} y",)], "t string")
    found = df.select(spans.regex_spans(F.col("t"), spans.quote_literal(word))[0]["text"])
    assert found.first()[0] == word
    assert re.fullmatch(spans.quote_literal(word), word)


def test_token_models(spark):
    df = spark.createDataFrame([("Ein Haus-Boot, 日本語 test",)], "t string")

    def words(model):
        return [t["token"] for t in df.select(tokens.token_spans(F.col("t"), model)).first()[0]]

    assert words("word") == ["ein", "haus", "boot", "日本語", "test"]
    assert words("whitespace") == ["ein", "haus-boot,", "日本語", "test"]
    assert words("char") == ["Ein", "Haus", "Boot", "日", "本", "語", "test"]
    with pytest.raises(ValueError):
        tokens.model_pattern("bert")


def test_token_offsets_point_into_the_raw_text(spark):
    text = "İstanbul Über ALLES"
    df = spark.createDataFrame([(text,)], "t string")
    for t in df.select(tokens.token_spans(F.col("t"))).first()[0]:
        assert text[t["start"] : t["end"]].lower() == t["token"]


def test_derived_columns(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id bigint, text string")
    once = tokens.tokenise(df, "text", "word", "en")
    both = tokens.tokenise(tokens.tokenise(once, "text", "char"), "text", "word")
    names = list(tokens.derived_registry(both))
    assert names == ["__derived__tokens__text__char", "__derived__tokens__text__word"]
    assert tokens.find_derived(both, "text", model="word") == names[1]
    assert tokens.find_derived(both, "text") == names[0]
    assert tokens.find_derived(both, "other") is None
    filtered = both.filter("id = 1").unionByName(both.filter("id = 2"))
    joined = filtered.join(df.select("id"), "id")
    assert tokens.find_derived(joined, "text", model="char") == names[0]
    about = tokens.derived_registry(once)["__derived__tokens__text__word"]
    assert about["language"] == "en" and about["source_column"] == "text"
    with pytest.raises(ValueError):
        tokens.tokenise(df, "missing")
    with pytest.raises(ValueError):
        tokens.drop_derived(both, "id")


def test_token_store_tokenises_only_unseen_texts(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("a b",), ("a b",), ("c",)], "text string")
    tokens.update_token_store(df, "text", path)
    assert spark.read.parquet(path).count() == 2
    more = df.unionByName(spark.createDataFrame([("d e f",)], "text string"))
    tokens.update_token_store(more, "text", path)
    assert spark.read.parquet(path).count() == 3
    # A retried append leaves doubles, which a reader does not see.
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    assert tokens.read_token_store(spark, path + "2").count() == 3
    assert not tokens.compact_when(spark, path + "2", path + "3", tokens.STORE_SCHEMA, 1, 99)
    assert tokens.compact_when(spark, path + "2", path + "3", tokens.STORE_SCHEMA, 1, 1)
    assert spark.read.parquet(path + "3").count() == 3


MOJIBAKE = [
    ("CafÃ©", "Café"),
    ("itâ€™s â€œfineâ€\u009d", "it’s “fine”"),
    ("Â£5 and Â©", "£5 and ©"),
    ("seÃ±or", "señor"),
]
CLEAN = [
    "",
    "plain ASCII only",
    "Café Mëtàl Ümläüt",
    "你好，世界！",
    "こんにちは",
    "Здравствуйте, мир!",
    "مرحبا بالعالم",
    "10³ × 5²",
    "« guillemets »",
]


def test_normal_form(spark):
    """Canonical composition as the standard library has it, over letters and marks of many scripts."""
    rng = random.Random(3)
    spans_ = [(0x41, 0x5B), (0xC0, 0x250), (0x300, 0x345), (0x370, 0x3D0), (0x5B0, 0x5C0), (0x900, 0x950),
              (0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3), (0x1E00, 0x2000), (0x2126, 0x212C),
              (0xAC00, 0xAC20), (0xFB1D, 0xFB50), (0x1D15E, 0x1D165), (0x1F600, 0x1F610)]
    pool = [chr(c) for a, b in spans_ for c in range(a, b) if unicodedata.category(chr(c)) != "Cn"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 12))) for _ in range(5000)]
    texts += ["", None, "plain", "e" + "\u0301" * 5000, "x\u0301\u0323\u0302 " * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", composed(F.col("t")).alias("n")).collect():
        assert r.n == (None if r.t is None else unicodedata.normalize("NFC", r.t)), ascii(r.t[:40])


def test_mojibake(spark):
    cases = MOJIBAKE + [(c, c) for c in CLEAN]
    df = spark.createDataFrame(cases, "a string, b string")
    for r in df.select("a", "b", repair_mojibake(F.col("a")).alias("x")).collect():
        assert r["x"] == r["b"], r
    # Wider characters and other broken bytes do not keep a sequence from being repaired.
    cases = [("Ã© 日本 é Ã", 1), (None, 2), ("ÃƒÂ©", 3), ("e\u0301 a\u0302\u0301 q\u0301", 4)]
    odd = spark.createDataFrame(cases, "a string, n int")
    wanted = [("é 日本 é Ã", 1), (None, 2), ("é", 3), ("é ấ q\u0301", 4)]
    assert rows(repair_text_columns(odd), "n") == wanted
