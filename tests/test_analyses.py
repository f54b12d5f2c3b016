from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from textloom.functions import stopwords
from textloom.operators import annotate, keyness, quotes, tokens, topics, trends
from textloom.streaming.tokens import stream_token_store
from textloom.streaming.topics import assign_nearest, read_topics, stream_topics, update_topics
from textloom.streaming.trends import read_trend, stream_trend, write_available


# --- keyness ----------------------------------------------------------------


def corpus(spark, counts):
    data = [(t,) for t, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(data, "token string")


def test_keyness_formulas(spark):
    ref, study = {"a": 30, "b": 10, "r": 5}, {"a": 10, "b": 40, "s": 7}
    got = {r["token"]: r for r in keyness.keyness(corpus(spark, ref), corpus(spark, study)).collect()}
    c1, c2 = sum(ref.values()), sum(study.values())
    for token, r in got.items():
        o1, o2 = ref.get(token, 0), study.get(token, 0)
        e1, e2 = c1 * (o1 + o2) / (c1 + c2), c2 * (o1 + o2) / (c1 + c2)
        ll = 2 * sum(o * math.log(o / e) for o, e in ((o1, e1), (o2, e2)) if o)
        assert r["log_likelihood_llv"] == pytest.approx(ll)
        assert r["bayes_factor_bic"] == pytest.approx(ll - math.log(c1 + c2))
        assert r["effect_size_ell"] == pytest.approx(ll / ((c1 + c2) * math.log(min(e1, e2))))
        if o1 and o2:
            assert r["log_ratio"] == pytest.approx(math.log2((o2 / c2) / (o1 / c1)))
            assert r["percent_diff"] == pytest.approx(((o2 / c2) / (o1 / c1) - 1) * 100)
            assert r["odds_ratio"] == pytest.approx(o1 * (c2 - o2) / (o2 * (c1 - o1)))
            assert r["relative_risk"] == pytest.approx((o1 / c1) / (o2 / c2))
    assert got["r"]["log_ratio"] == -math.inf and got["r"]["relative_risk"] == math.inf
    assert got["s"]["log_ratio"] == math.inf and got["s"]["percent_diff"] == math.inf
    assert got["s"]["relative_risk"] == 0.0
    for r in got.values():
        passed = [mark for least, mark in keyness.STARS if r["log_likelihood_llv"] >= least]
        assert r["significance"] == (passed[0] if passed else "")
    assert len({r["significance"] for r in got.values()}) > 1
    spelled = keyness.spelled_infinities(keyness.keyness(corpus(spark, ref), corpus(spark, study)))
    ratios = {r["token"]: r["log_ratio"] for r in spelled.collect()}
    assert ratios["r"] == "-Inf" and ratios["s"] == "+Inf" and float(ratios["a"])


def test_keyness_of_an_empty_corpus(spark):
    none = corpus(spark, {"a": 1}).filter("false")
    (row,) = keyness.keyness(none, corpus(spark, {"a": 3})).collect()
    assert row["freq_reference"] == 0 and row["log_ratio"] == math.inf


def test_frequencies_and_limits(spark):
    df = spark.createDataFrame([("The cat. the",), (None,), ("",)], "text string")
    assert rows(keyness.token_frequencies(df, "text")) == [("cat", 1), ("the", 2)]
    with_tokens = tokens.tokenise(df, "text")
    assert rows(keyness.token_frequencies(with_tokens, "text")) == [("cat", 1), ("the", 2)]
    for corpora, limit in ((3, 5), (0, 5), (1, 0)):
        with pytest.raises(ValueError):
            keyness.check_request(corpora, limit)
    table = keyness.token_frequencies(df, "text")
    assert rows(keyness.without_stop_words(table, [" THE ", ""])) == [("cat", 1)]
    assert rows(keyness.wildcard(table, "*a*")) == [("cat", 1)]
    assert keyness.wildcard(table, "a*").count() == 0
    assert keyness.wildcard(table, "t.e").count() == 0


def test_stop_words():
    assert "the" in stopwords.default_stop_words("English")
    assert stopwords.default_stop_words("xx") == stopwords.default_stop_words("en")
    assert stopwords.default_stop_words("xx", strict=True) == []
    assert stopwords.clean_words([" a", "b", "a ", ""]) == ["a", "b"]
    assert stopwords.clean_words("x") == ["x"] and stopwords.clean_words(None) == []
    for language in stopwords.WORDS:
        assert len(stopwords.default_stop_words(language)) > 20
    with pytest.raises(ValueError):
        stopwords.require_language("quotes", "de")


# --- trends -----------------------------------------------------------------


def test_folded_groups(spark):
    data = [(dt.datetime(2024, 1, d), p, s) for d, p, s in ((1, "LNP", "Yes"), (1, "lnp", "yes"), (2, "LNP", "yes"))]
    df = spark.createDataFrame(data, "ts timestamp, party string, stance string")
    assert trends.time_trend(df, "ts", "yearly", ["party", "stance"]).count() == 3
    folded = trends.time_trend(df, "ts", "yearly", ["party", "stance"], case_sensitive=False)
    (row,) = folded.collect()
    assert (row["party"], row["sequential_count"], row["time_period_formatted"]) == ("lnp", 3, "2024")
    with pytest.raises(ValueError):
        trends.time_trend(df, "party")
    unknown = trends.time_trend(df, "ts", "hourglass").select("time_period_formatted")
    assert rows(unknown) == [("2024-01-01",), ("2024-01-02",)]


def test_numeric_bins(spark):
    df = spark.createDataFrame([(0,), (5,), (10,), (15,), (None,)], "score int")
    out = trends.numeric_trend(df.filter("score IS NOT NULL"), "score", 10)
    assert rows(out.select("time_period", "sequential_count", "time_period_formatted")) == [
        (0.0, 2, "[0, 10)"),
        (10.0, 2, "[10, 20)"),
    ]
    for width in (0, -1, None):
        with pytest.raises(ValueError):
            trends.numeric_trend(df, "score", width)


def test_significant_digits(spark):
    values = [0.0, 1e-7, 123456789.0, 1.5, -2.25, 100000.0, 999999.5, 0.0001, 0.00001234567, 1e20, 12.3456789]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(trends.significant(F.col("x"))).collect()]
    assert got == [format(v, ".6g") for v in values]


def test_custom_interval_checks(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 10),)], "ts timestamp")
    week = trends.time_trend(df, "ts", "custom", every=1, unit="weeks").first()
    assert week["time_period_formatted"] == "2024-01-08"
    for every, unit in ((0, "days"), (None, "days"), (1, "years")):
        with pytest.raises(ValueError):
            trends.time_trend(df, "ts", "custom", every=every, unit=unit)


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "double", "decimal(12,2)", "long"])
def test_detach_many_periods(spark, kind):
    rng = random.Random(5)
    values = [rng.randrange(0, 40_000) for _ in range(3000)] + [0, 40_000, -9, 99_999]
    periods = [(a, a + rng.choice((0, 1, 2, 300))) for a in rng.sample(range(40_000), 400)]
    periods += [(50, 20), (12, 12), (0, 0)]
    inside = sorted(v for v in values if any(a <= v <= b for a, b in periods))
    day = lambda n: dt.datetime(1990, 1, 1) + dt.timedelta(days=n)
    timed = kind.startswith(("date", "time"))
    raw = spark.createDataFrame([(v, day(v).isoformat(sep=" ")) for v in values] + [(None, None)], "v long, d string")
    df = raw.select("v", F.col("d" if timed else "v").cast(kind).alias("a.x"))
    given = [(day(a).isoformat(), day(b)) for a, b in periods] if timed else periods
    assert sorted(r.v for r in trends.detach_periods(df, "a.x", given).collect()) == inside
    plan = trends.detach_periods(df, "a.x", given)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    table = spark.createDataFrame(periods + [(None, 5)], "p long, q long")
    ends = [F.date_add(F.lit("1990-01-01").cast("date"), F.col(c).cast("int")) if timed else F.col(c) for c in ("p", "q")]
    typed = table.select(*[e.cast(kind).alias(n) for e, n in zip(ends, "pq", strict=True)])
    assert sorted(r.v for r in trends.detach_periods(df, "a.x", typed).collect()) == inside
    assert trends.detach_periods(df, "a.x", typed.limit(0)).count() == 0


def test_detach_open_periods(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1e300, -3, 0, 5, 8, 1e300)] + [(None,), (float("nan"),)], "x double")
    inf = float("inf")
    for periods, wanted in (
        ([(-inf, -3.0), (5.0, 5.0)], 3), ([(8.0, inf)], 2), ([(-inf, inf)], 6), ([(0.0, 0.0)], 1)
    ):
        table = spark.createDataFrame(periods, "low double, high double")
        assert trends.detach_periods(df, "x", table).count() == wanted
        assert trends.detach_periods(df, "x", periods).count() == wanted


def test_missing_buckets_keep_null_groups(spark):
    data = [(dt.datetime(2024, 1, d), g) for d, g in ((1, "a"), (4, "a"), (2, None))]
    days = trends.time_trend(spark.createDataFrame(data, "ts timestamp, g string"), "ts", "daily", ["g"])
    full = trends.fill_missing(days, ["g"], "daily")
    assert full.count() == 8 and full.agg(F.sum("sequential_count")).first()[0] == 3
    assert trends.min_group_size(days, ["g"], 2).count() == 2
    assert trends.min_group_size(days, ["g"], 1).count() == 3


def test_detach_periods(spark):
    data = [(dt.datetime(2024, 1, d), g) for d, g in ((1, "Alpha"), (1, "alpha"), (2, None), (3, "b"))]
    df = spark.createDataFrame(data, "at timestamp, g string")
    day = [("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z")]
    assert trends.detach_periods(df, "at", day).count() == 3
    assert trends.detach_periods(df, "at", day, [{"g": None}]).count() == 1
    assert trends.detach_periods(df, "at", day, [{"g": "ALPHA"}], case_sensitive=False).count() == 2
    assert trends.detach_periods(df, "at", day, [{"g": "alpha"}, {"g": None}]).count() == 2
    for periods, groups in (([], None), (day, [{"nope": 1}])):
        with pytest.raises(ValueError):
            trends.detach_periods(df, "at", periods, groups)


# --- topics -----------------------------------------------------------------


def vectors(spark):
    data = []
    for i in range(120):
        base = [0.0] * 8
        base[i % 4] = 10.0
        base[(i + 1) % 8] += (i % 7) / 50
        data.append((i, base, i % 4))
    return spark.createDataFrame(data, "id int, v array<float>, label int")


def test_clusters_are_found(spark):
    found = topics.assign_topics(vectors(spark), "v", 4, seed=1, dimensions=5)
    pairs = found.select("label", topics.TOPIC).distinct().collect()
    assert len(pairs) == 4 and len({p[0] for p in pairs}) == 4
    again = topics.assign_topics(vectors(spark), "v", 4, seed=1, dimensions=5)
    assert rows(topics.assignments(found, "id")) == rows(topics.assignments(again, "id"))


def test_reduction_and_map(spark):
    df = vectors(spark).withColumn(topics.TOPIC, (F.col("label") * 2 + F.col("id") % 2).cast("bigint"))
    n = df.select(topics.TOPIC).distinct().count()
    for wanted in (2, 3, n):
        reduced = topics.reduce_topics(df, "v", wanted)
        assert reduced.select(topics.TOPIC).distinct().count() == wanted
        assert reduced.count() == 120
    for wanted in (1, n + 1):
        with pytest.raises(ValueError):
            topics.reduce_topics(df, "v", wanted)
    table = topics.centroids(df, "v")
    assert topics.topic_map(table).count() == n
    single = topics.topic_map(table.limit(1)).first()
    assert (single["x"], single["y"]) == (0.0, 0.0)


def test_outliers(spark):
    data = [(i, 0 if i < 10 else 1) for i in range(12)]
    df = spark.createDataFrame(data, f"id int, {topics.TOPIC} bigint")
    marked = topics.mark_outliers(df, 5)
    assert marked.filter(F.col(topics.TOPIC) == -1).count() == 2


def test_sizes_and_names():
    assert topics.topic_size(1000, "target", 5) == 20 and topics.topic_size(10, "target", 5) == 2
    assert topics.topic_size(9, "min", 1) == 2 and topics.topic_size(9, "min", 7) == 7
    assert topics.topic_size(1000, "exact", 5) == 15 and topics.topic_size(10, "exact", 5) == 5
    assert topics.default_clusters(8) == 10 and topics.default_clusters(10**9) == 200
    assert topics.words_to_compute(5) == 50 and topics.words_to_compute(40) == 80
    assert topics.free_name("x", ["x", "x_1"]) == "x_2" and topics.free_name(None, []) == topics.TOPIC
    with pytest.raises(ValueError):
        topics.topic_size(5, "other", 1)


def test_detach_topics(spark):
    source = spark.createDataFrame([(i, f"doc {i}", "s") for i in range(4)], "id bigint, document string, source string")
    assigned = spark.createDataFrame([(1, 0), (3, 1)], f"id bigint, {topics.TOPIC} bigint")
    out = topics.detach_topics(source, assigned, "id", ["document"], [0])
    assert out.columns == ["document", topics.TOPIC] and rows(out) == [("doc 1", 0)]
    meaning = spark.createDataFrame(
        [(0, ["alpha", "beta"]), (1, ["x"]), (2, ["y"])], f"{topics.TOPIC} bigint, {topics.MEANING} array<string>"
    )
    kept = topics.detach_meanings(meaning, assigned, words={1: ["mine"]})
    assert rows(kept) == [(0, ["alpha", "beta"]), (1, ["mine"])]
    with pytest.raises(ValueError):
        topics.detach_topics(source, assigned, "id", ["nope"])


def test_topic_labels(spark):
    df = spark.createDataFrame([(3, ["a", "b"]), (4, [])], "t bigint, w array<string>")
    labels = [r[0] for r in df.select(topics.topic_label(F.col("w"), F.col("t"))).collect()]
    assert labels == ["a | b", "Topic 4"]


# --- quotations -------------------------------------------------------------


PARAGRAPH = (
    '"It is late," said Ada Lovelace. Then he paused. “We go now”, Noël added.\n'
    'Mr. Smith said: "No!" The sign read "Closed" and "unpaired mark'
)


def test_quotation_shapes(spark):
    df = spark.createDataFrame([(1, PARAGRAPH), (2, ""), (3, None), (4, "none")], "id int, text string")
    found = quotes.extract_quotations(df, "text")
    flat = quotes.flatten_quotations(found, ["id"]).orderBy("QUOTE_quote_row_idx").collect()
    assert [(r["QUOTE_quote"], r["QUOTE_speaker"], r["QUOTE_verb"], r["QUOTE_quote_type"]) for r in flat] == [
        ("It is late,", "Ada Lovelace", "said", "QVS"),
        ("We go now", "Noël", "added", "QSV"),
        ("No!", "Mr. Smith", "said", "SVQ"),
        ("Closed", None, None, "FLOATING"),
    ]
    for r in flat:
        for part in ("quote", "speaker", "verb"):
            start, end = r[f"QUOTE_{part}_start_idx"], r[f"QUOTE_{part}_end_idx"]
            if r[f"QUOTE_{part}"] is not None:
                assert PARAGRAPH[start:end] == r[f"QUOTE_{part}"]
            else:
                assert start is None and end is None
    assert [r["QUOTE_is_floating_quote"] for r in flat] == [False, False, False, True]
    assert flat[0]["QUOTE_quote_token_count"] == 3
    with pytest.raises(ValueError):
        quotes.extract_quotations(df, "text", "de")


def test_quotation_window(spark):
    df = spark.createDataFrame([(PARAGRAPH,)], "text string")
    found = quotes.extract_quotations(df, "text")
    flat = quotes.flatten_quotations(found, [], text_col="text", context=4)
    windows = {r["QUOTE_quote"]: r["QUOTE_extraction"] for r in flat.collect()}
    assert windows["It is late,"] == PARAGRAPH[:35]
    start, end = PARAGRAPH.index("Mr. Smith") - 4, PARAGRAPH.index('No!') + len("No!") + 4
    assert windows["No!"] == PARAGRAPH[start:end]


def test_preprocessing_maps_back(spark):
    texts = ['Line one\nShe said "hi" loudly.', "word  gap here.", "Café said “hello” today.", "a..\n b\n\n\nc", ""]
    for text in texts:
        plain, at = quotes.preprocess(text)
        assert len(at) == len(plain) + 1 and at[-1] == len(text)
        assert at == sorted(at)
    plain, at = quotes.preprocess(texts[0])
    start = plain.index("She said")
    assert texts[0][at[start] : at[start + 8]] == "She said" and len(plain) == len(texts[0]) + 2
    assert quotes.preprocess(texts[1])[0] == "word gap here."
    assert quotes.preprocess(texts[2])[0] == 'Cafe said "hello" today.'
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", quotes.preprocessed("t").alias("p")).collect()
    for r in got:
        assert (r["p"]["text"], r["p"]["offsets"]) == quotes.preprocess(r["t"])


def test_context_length():
    assert [quotes.context_length(v) for v in (None, "x", 0, 5, 9999)] == [20, 20, 0, 5, 9999]
    with pytest.raises(ValueError):
        quotes.context_length(-3)


# --- annotation -------------------------------------------------------------

CLASSES = [{"name": "Pets", "description": "cat dog"}, {"name": "Cars", "description": "engine wheel"}]


def test_classifier_hook(spark):
    df = spark.createDataFrame([(1, "a cat"), (2, "one wheel"), (3, "nothing"), (4, None)], "id bigint, t string")
    answers = annotate.classify(df, "id", "t", annotate.KeywordClassifier(CLASSES))
    out = annotate.label_rows(answers, ["Pets", "Cars"]).select("id", "classification", "error")
    assert rows(out, "id") == [
        (1, "Pets", None),
        (2, "Cars", None),
        (3, None, annotate.NO_ANSWER),
        (4, None, annotate.NO_ANSWER),
    ]
    def failing(texts):
        raise RuntimeError("offline")

    failed = annotate.classify(df, "id", "t", failing, batch_size=2).collect()
    assert len(failed) == 4 and all(r["error"] == "offline" for r in failed)
    short = annotate.classify(df.coalesce(1), "id", "t", lambda texts: ["Pets"], batch_size=2)
    assert [r["error"] for r in short.orderBy("id").collect()] == [None, annotate.NO_ANSWER] * 2
    shown = annotate.KeywordClassifier(CLASSES, [{"text": "whiskers", "classification": "Pets"}])
    assert df.select(shown.answer(F.lit("Whiskers!"))).first()[0] == "Pets"


def test_labels(spark):
    raw = [(" pets ",), ("surely CARS",), ("boats",), (None,), ("cars or pets",)]
    df = spark.createDataFrame(raw, "a string")
    got = [r[0] for r in df.select(annotate.normalised_label(F.col("a"), ["Pets", "Cars"])).collect()]
    assert got == ["Pets", "Cars", "boats", None, "Pets"]


def test_edits_and_annotations(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    edits = spark.createDataFrame([(2, "new")], "id int, label string")
    once = annotate.save_edits(df, edits, "id", "topic")
    assert rows(once, "id") == [(1, "x", None), (2, "y", "new")]
    twice = annotate.save_edits(once, spark.createDataFrame([(1, "old")], "id int, label string"), "id", "topic")
    assert rows(twice, "id") == [(1, "x", "old"), (2, "y", "new")]
    noted = annotate.add_annotation(twice, "notes", F.lit("me"), F.col("topic"))
    noted = annotate.add_annotation(noted, "notes", F.lit("you"), F.lit(None).cast("string"))
    assert [r[0] for r in annotate.annotation_values(noted, "notes").collect()] == ["new", "old"]
    assert [r[0] for r in annotate.annotation_values(noted, "notes", "provider").collect()] == ["me"]
    assert annotate.annotation_values(twice, "topic").count() == 2


# --- streams ----------------------------------------------------------------


def test_stream_trend_has_all_windows(spark, tmp_path):
    data = [(dt.datetime(2024, 1, 1, h, 30), "a") for h in range(5)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, g string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    trend = stream_trend(stream, "ts", "1 hour", "1 hour", ["g"])
    write_available(trend, str(tmp_path / "out"), str(tmp_path / "state"))
    out = read_trend(spark, trend, str(tmp_path / "out"), ["time_period", "g"])
    assert out.count() == 5 and out.agg(F.sum("sequential_count")).first()[0] == 5
    # More input changes the open windows; the newest state of each counts.
    more = [(dt.datetime(2024, 1, 1, 4, 45), "a"), (dt.datetime(2024, 1, 1, 9), "a")]
    spark.createDataFrame(more, df.schema).write.mode("append").parquet(str(tmp_path / "in"))
    again = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    trend = stream_trend(again, "ts", "1 hour", "1 hour", ["g"])
    write_available(trend, str(tmp_path / "out"), str(tmp_path / "state"))
    out = read_trend(spark, trend, str(tmp_path / "out"), ["time_period", "g"])
    assert sorted(r["sequential_count"] for r in out.collect()) == [1, 1, 1, 1, 1, 2]


def test_stream_token_store(spark, tmp_path):
    schema = "text string"
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    for n, texts in enumerate((["a b", "c"], ["a b", "d e"])):
        spark.createDataFrame([(t,) for t in texts], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream_token_store(stream, "text", store, state)
        assert spark.read.parquet(store).count() == 2 + n


def vector_stream(spark, folder, parts):
    """One file per part, read as one micro-batch each."""
    for i, part in enumerate(parts):
        data = [(k, None if v is None else [float(x) for x in v]) for k, v in part]
        frame = spark.createDataFrame(data, "k long, v array<double>").coalesce(1)
        frame.write.parquet(f"{folder}/{i}")
    reader = spark.readStream.schema("k long, v array<double>").option("maxFilesPerTrigger", 1)
    return reader.parquet(f"{folder}/*")


def centres_of(spark, folder):
    return {r["TOPIC_topic"]: (r["centroid"], r["size"]) for r in read_topics(spark, folder).collect()}


def test_stream_topics_one_or_five_batches(spark, tmp_path):
    rng = random.Random(8)
    middles = [(0, 0, 9), (9, 0, 0), (0, 9, 0)]
    data = [(k, [m + rng.uniform(-1, 1) for m in middles[k % 3]]) for k in range(150)]
    odd = [(900, None), (901, []), (902, [1.0, float("nan"), 2.0]), (903, [1.0, float("inf"), 2.0])]
    seeds = spark.createDataFrame(list(enumerate([list(map(float, m)) for m in middles])), "TOPIC_topic int, centroid array<double>")
    found = []
    for name, parts in (("one", [data + odd]), ("five", [data[i::5] + odd for i in range(5)])):
        stream = vector_stream(spark, tmp_path / name, parts)
        stream_topics(stream, "v", "k", str(tmp_path / f"{name}-state"), str(tmp_path / f"{name}-check"), 3, seeds)
        found.append(centres_of(spark, str(tmp_path / f"{name}-state")))
    for t in range(3):
        own = [v for k, v in data if k % 3 == t]
        for state in found:
            centre, size = state[t]
            assert size == 50 and centre == pytest.approx([sum(x) / 50 for x in zip(*own, strict=True)], abs=1e-9)
    rows_ = spark.createDataFrame(data + odd, "k long, v array<double>")
    named = assign_nearest(rows_, "v", read_topics(spark, str(tmp_path / "five-state")))
    assert all(r["TOPIC_topic"] == (r["k"] % 3 if r["k"] < 900 else None) for r in named.collect())


def test_stream_topics_repeated_batch(spark, tmp_path):
    rng = random.Random(9)
    data = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(90)] + [(90, [5.0] * 4)] * 40
    parts = [data[:1], data[1:60], [], data[60:]]
    folder = str(tmp_path / "state")
    stream_topics(vector_stream(spark, tmp_path / "in", parts), "v", "k", folder, str(tmp_path / "check"), 7)
    state = centres_of(spark, folder)
    assert sum(n for _, n in state.values()) == len(data) and len(state) == 7
    for axis in range(4):  # however the batches fell, the mean of all rows is kept
        total = sum(c[axis] * n for c, n in state.values())
        assert total / len(data) == pytest.approx(sum(v[axis] for _, v in data) / len(data), abs=1e-9)
    # A batch that comes again after a failure counts once.
    number = spark.read.parquet(folder).agg(F.max("batch")).first()[0] + 1
    again = spark.createDataFrame(data[60:], "k long, v array<double>")
    update_topics(again, "v", "k", folder, 7, number)
    once = centres_of(spark, folder)
    update_topics(again, "v", "k", folder, 7, number)
    assert centres_of(spark, folder) == once
    assert sum(n for _, n in once.values()) == len(data) + len(data[60:])
    with pytest.raises(ValueError):
        stream_topics(again, "v", "k", folder, folder, 0)


def test_stream_topics_without_rows(spark, tmp_path):
    stream = vector_stream(spark, tmp_path / "in", [[(1, None)]])
    stream_topics(stream, "v", "k", str(tmp_path / "state"), str(tmp_path / "check"), 3)
    centres = read_topics(spark, str(tmp_path / "state"))
    assert centres.count() == 0
    rows_ = spark.createDataFrame([(1, [1.0])], "k long, v array<double>")
    assert assign_nearest(rows_, "v", centres).first()["TOPIC_topic"] is None


def test_requests(spark):
    """One corpus gives frequencies, two give keyness; other requests are refused."""
    one = spark.createDataFrame([("b a a",), (None,), ("",)], "t string")
    two = spark.createDataFrame([("a c c c",)], "t string")
    assert [tuple(r) for r in keyness.compare_corpora([one], "t", 1).collect()] == [("a", 2)]
    got = keyness.compare_corpora([one, two], "t", 5).collect()
    assert [(r.token, r.freq_reference, r.freq_study) for r in got] == [("c", 0, 3), ("b", 1, 0), ("a", 2, 1)]
    assert keyness.compare_corpora([one.filter("false")], "t", 5).count() == 0
    for corpora, limit in (([], 5), ([one, two, one], 5), ([one], 0)):
        with pytest.raises(ValueError):
            keyness.compare_corpora(corpora, "t", limit)


def test_small_topics(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([1] * 6 + [2] * 3 + [3])], f"id int, {topics.TOPIC} bigint")
    sizes = lambda d: {r[0]: r[1] for r in d.groupBy(topics.TOPIC).count().collect()}
    assert sizes(topics.mark_small(rows, "target", 1)) == {1: 6, 2: 3, -1: 1}
    assert sizes(topics.mark_small(rows, "min", 4)) == {1: 6, -1: 4}
    assert sizes(topics.mark_small(rows, "exact", 1)) == {1: 6, -1: 4}
    assert topics.mark_small(rows.filter("false"), "min", 4).count() == 0
