"""Queries on trends, topics, quotations, annotation and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.stopwords import default_stop_words
from textloom.operators import annotate, kwic, quotes, sampling, topics, trends
from textloom.operators.ranks import with_row_index
from textloom.operators.tokens import read_token_store, tokenise
from textloom.plans.registry import documents, query, table
from textloom.plans.texts import WORD, kwic_sql, spans_sql
from textloom.session import scratch_path
from textloom.streaming.tokens import stream_token_store
from textloom.streaming.topics import assign_nearest, read_topics, stream_topics
from textloom.streaming.trends import read_trend, stream_trend, write_available

# --- trends -----------------------------------------------------------------

BUCKETS = {
    "second": ("events", "ts", "date_trunc('second', t)", "strftime(p, '%Y-%m-%d %H:%M:%S')"),
    "minute": ("events", "ts", "date_trunc('minute', t)", "strftime(p, '%Y-%m-%d %H:%M')"),
    "hourly": ("events", "ts", "date_trunc('hour', t)", "strftime(p, '%Y-%m-%d %H:%M')"),
    "daily": ("events", "ts", "CAST(t AS DATE)", "strftime(p, '%Y-%m-%d')"),
    "weekly": ("orders", "o_orderdate", "CAST(date_trunc('week', t) AS DATE)", "strftime(p, '%Y-W%W')"),
    "monthly": ("orders", "o_orderdate", "CAST(date_trunc('month', t) AS DATE)", "strftime(p, '%Y-%m')"),
    "quarterly": (
        "orders",
        "o_orderdate",
        "CAST(date_trunc('quarter', t) AS DATE)",
        "year(p) || '-Q' || quarter(p)",
    ),
    "yearly": ("lineitem", "l_shipdate", "CAST(date_trunc('year', t) AS DATE)", "strftime(p, '%Y')"),
}


def trend_sql(source: str, column: str, bucket: str, label: str, groups: str = "") -> str:
    keys = f", {groups}" if groups else ""
    return f"""SELECT p AS time_period{keys}, sequential_count, period_start, period_end,
               {label} AS time_period_formatted
        FROM (SELECT {bucket} AS p{keys}, count(*) AS sequential_count, min(t) AS period_start,
                     max(t) AS period_end
              FROM (SELECT {column} AS t, * FROM {source}) GROUP BY ALL)"""


def register_bucket(frequency: str) -> None:
    source, column, bucket, label = BUCKETS[frequency]

    @query(f"k33_{frequency}", trend_sql(source, column, bucket, label))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return trends.ordered(trends.time_trend(table(spark, sf, source), column, frequency))


for _frequency in BUCKETS:
    register_bucket(_frequency)

CUSTOM = {
    "seconds": (45, "1970-01-01", 45, "%Y-%m-%d %H:%M:%S"),
    "minutes": (90, "1970-01-01", 90 * 60, "%Y-%m-%d %H:%M"),
    "hours": (7, "1970-01-01", 7 * 3600, "%Y-%m-%d %H:00"),
    "days": (10, "1970-01-01", 10 * 86400, "%Y-%m-%d"),
    "weeks": (2, "1970-01-05", 14 * 86400, "%Y-%m-%d"),
}


def register_custom(unit: str) -> None:
    every, origin, width, label = CUSTOM[unit]
    start = f"TIMESTAMP '{origin}'"
    bucket = f"time_bucket(to_seconds({width}), t, {start})"

    @query(
        f"k34_{unit}", trend_sql("events", "ts", bucket, f"strftime(p, '{label}')", "event_type")
    )
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return trends.time_trend(
            table(spark, sf, "events"), "ts", "custom", ["event_type"], every=every, unit=unit
        )


for _unit in CUSTOM:
    register_custom(_unit)


def numeric_sql(source: str, column: str, width: str, origin: str, groups: str = "") -> str:
    keys = f", {groups}" if groups else ""
    return f"""SELECT round(p, 6) AS time_period{keys}, sequential_count, period_start, period_end,
               '[' || format('{{:.6g}}', round(p, 6)) || ', '
                   || format('{{:.6g}}', round(p, 6) + {width}) || ')' AS time_period_formatted
        FROM (SELECT o + floor((x - o) / {width}) * {width} AS p{keys},
                     count(*) AS sequential_count, min(x) AS period_start, max(x) AS period_end
              FROM (SELECT CAST({column} AS DOUBLE) AS x, CAST({origin} AS DOUBLE) AS o, *
                    FROM {source}) GROUP BY ALL)"""


@query(
    "k35_numeric_bins",
    numeric_sql(
        "lineitem", "l_extendedprice", "1234.5", "(SELECT min(l_extendedprice) FROM lineitem)"
    ),
)
def k35_numeric_bins(spark: SparkSession, sf: str) -> DataFrame:
    return trends.numeric_trend(table(spark, sf, "lineitem"), "l_extendedprice", 1234.5)


@query(
    "k35_numeric_origin",
    numeric_sql("customer", "c_acctbal", "0.25", "-1000.5", "c_mktsegment"),
)
def k35_numeric_origin(spark: SparkSession, sf: str) -> DataFrame:
    return trends.numeric_trend(
        table(spark, sf, "customer"), "c_acctbal", 0.25, -1000.5, ["c_mktsegment"]
    )


@query(
    "k36_grouped",
    trend_sql(
        "orders", "o_orderdate", "CAST(date_trunc('month', t) AS DATE)", "strftime(p, '%Y-%m')",
        "o_orderstatus, o_orderpriority",
    ),
)
def k36_grouped(spark: SparkSession, sf: str) -> DataFrame:
    groups = ["o_orderstatus", "o_orderpriority"]
    return trends.time_trend(table(spark, sf, "orders"), "o_orderdate", "monthly", groups)


@query(
    "k36_coarsen",
    trend_sql(
        "events", "ts", "CAST(date_trunc('week', t) AS DATE)", "strftime(p, '%Y-W%W')", "event_type"
    ),
)
def k36_coarsen(spark: SparkSession, sf: str) -> DataFrame:
    hours = trends.time_trend(table(spark, sf, "events"), "ts", "hourly", ["event_type"])
    return trends.coarsen(hours, "weekly", ["event_type"])


MIXED_CASE = """(SELECT event_id, ts, CASE WHEN user_id % 2 = 0 THEN upper(event_type)
                 ELSE event_type END AS kind, user_id % 3 AS part FROM events)"""


def mixed_case(spark: SparkSession, sf: str) -> DataFrame:
    kind = "CASE WHEN user_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS kind"
    return table(spark, sf, "events").selectExpr("event_id", "ts", kind, "user_id % 3 AS part")


@query(
    "k37_fold_case",
    trend_sql(
        f"(SELECT event_id, ts, lower(kind) AS kind, CAST(part AS VARCHAR) AS part FROM {MIXED_CASE})",
        "ts", "CAST(t AS DATE)", "strftime(p, '%Y-%m-%d')", "kind, part",
    ),
)
def k37_fold_case(spark: SparkSession, sf: str) -> DataFrame:
    return trends.time_trend(
        mixed_case(spark, sf), "ts", "daily", ["kind", "part"], case_sensitive=False
    )


@query(
    "k39_ordered",
    "SELECT time_period, event_type, sequential_count, row_number() OVER (ORDER BY time_period, "
    "event_type) AS place FROM ("
    + trend_sql("events", "ts", "CAST(t AS DATE)", "p", "event_type")
    + ")",
)
def k39_ordered(spark: SparkSession, sf: str) -> DataFrame:
    days = trends.time_trend(table(spark, sf, "events"), "ts", "daily", ["event_type"])
    rows = trends.ordered(days, ["event_type"]).select("time_period", "event_type", "sequential_count")
    # The place of a row in the sorted result shows its order.
    return with_row_index(rows, ["time_period", "event_type"], "place")


@query(
    "k40_min_group_size",
    """SELECT time_period, user_id, sequential_count FROM (
         SELECT CAST(ts AS DATE) AS time_period, user_id, count(*) AS sequential_count,
                sum(count(*)) OVER (PARTITION BY user_id) AS total FROM events GROUP BY 1, 2)
       WHERE total >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id))""",
)
def k40_min_group_size(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    days = trends.time_trend(events, "ts", "daily", ["user_id"])
    sizes = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    least = sizes.agg(F.avg("n")).scalar()
    kept = trends.min_group_size(days, ["user_id"], least)
    return kept.select("time_period", "user_id", "sequential_count")


@query(
    "k41_missing_buckets",
    """WITH c AS (SELECT date_trunc('hour', ts) AS p, event_type, count(*) AS n FROM events
                  GROUP BY 1, 2),
            g AS (SELECT unnest(generate_series(min(p), max(p), INTERVAL 1 HOUR)) AS p FROM c)
       SELECT g.p AS time_period, k.event_type, coalesce(c.n, 0) AS sequential_count
       FROM g CROSS JOIN (SELECT DISTINCT event_type FROM c) k
       LEFT JOIN c ON c.p = g.p AND c.event_type = k.event_type""",
)
def k41_missing_buckets(spark: SparkSession, sf: str) -> DataFrame:
    hours = trends.time_trend(table(spark, sf, "events"), "ts", "hourly", ["event_type"])
    return trends.fill_missing(hours, ["event_type"], "hourly")


@query(
    "k41_missing_months",
    """WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS p, count(*) AS n
                  FROM orders WHERE month(o_orderdate) <> 5 GROUP BY 1),
            g AS (SELECT CAST(unnest(generate_series(min(p), max(p), INTERVAL 1 MONTH)) AS DATE) AS p
                  FROM c)
       SELECT g.p AS time_period, coalesce(n, 0) AS sequential_count FROM g LEFT JOIN c ON c.p = g.p""",
)
def k41_missing_months(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").filter("month(o_orderdate) <> 5")
    return trends.fill_missing(trends.time_trend(orders, "o_orderdate", "monthly"), [], "monthly")


@query(
    "k41_missing_bins",
    """WITH c AS (SELECT p_size // 4 * 4 AS p, count(*) AS n FROM part
                  WHERE p_size < 10 OR p_size > 30 GROUP BY 1)
       SELECT CAST(g.p AS DOUBLE) AS time_period, coalesce(n, 0) AS sequential_count
       FROM (SELECT unnest(generate_series(min(p), max(p), 4)) AS p FROM c) g
       LEFT JOIN c ON c.p = g.p""",
)
def k41_missing_bins(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").filter("p_size < 10 OR p_size > 30")
    return trends.fill_missing(trends.numeric_trend(parts, "p_size", 4, 0), [], width=4)


@query(
    "k41_custom",
    """WITH c AS (SELECT event_type, time_bucket(INTERVAL 90 MINUTE, ts, TIMESTAMP '1970-01-01') AS p,
                         count(*) AS n FROM events WHERE value > 40 GROUP BY 1, 2),
            g AS (SELECT unnest(generate_series(min(p), max(p), INTERVAL 90 MINUTE)) AS p FROM c)
       SELECT g.p AS time_period, k.event_type, coalesce(c.n, 0) AS sequential_count
       FROM g CROSS JOIN (SELECT DISTINCT event_type FROM c) k
       LEFT JOIN c ON c.p = g.p AND c.event_type = k.event_type""",
)
def k41_custom(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").filter("value > 40")
    trend = trends.time_trend(
        events, "ts", "custom", ["event_type"], every=90, unit="minutes"
    )
    return trends.fill_missing(trend, ["event_type"], every=90, unit="minutes")


@query(
    "k41_fractional_bins",
    """WITH c AS (SELECT floor((p_retailprice / 1000 - 0.1234567) * 3) AS b, count(*) AS n
                  FROM part WHERE p_size < 10 GROUP BY 1)
       SELECT g.b AS bin, coalesce(n, 0) AS sequential_count
       FROM (SELECT unnest(generate_series(min(b)::BIGINT, max(b)::BIGINT)) AS b FROM c) g
       LEFT JOIN c ON c.b = g.b""",
)
def k41_fractional_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Bins of a third; each is told by its number, as its start is rounded."""
    parts = table(spark, sf, "part").filter("p_size < 10").selectExpr("p_retailprice / 1000 AS x")
    trend = trends.numeric_trend(parts, "x", 1 / 3, 0.1234567)
    full = trends.fill_missing(trend, [], width=1 / 3)
    number = F.round((F.col("time_period") - 0.1234567) * 3).cast("bigint")
    return full.select(number.alias("bin"), "sequential_count")


@query(
    "k42_detach",
    f"""SELECT event_id, ts, kind FROM {MIXED_CASE}
        WHERE (ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05 12:00:00'
               OR ts BETWEEN TIMESTAMP '2024-01-20 06:00:00' AND TIMESTAMP '2024-01-21')
          AND (lower(kind) = 'click' OR (lower(kind) = 'error' AND part = 2))""",
)
def k42_detach(spark: SparkSession, sf: str) -> DataFrame:
    periods = [
        ("2024-01-03T00:00:00Z", "2024-01-04T18:00:00Z"),
        ("2024-01-20T06:00:00Z", "2024-01-21T00:00:00Z"),
        (dt.datetime(2024, 1, 4, tzinfo=dt.UTC), dt.datetime(2024, 1, 5, 12, tzinfo=dt.UTC)),
    ]
    groups = [{"kind": "Click"}, {"kind": "ERROR", "part": 2}]
    rows = trends.detach_periods(mixed_case(spark, sf), "ts", periods, groups, case_sensitive=False)
    return rows.select("event_id", "ts", "kind")


@query(
    "k42_detach_numeric",
    "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 3 AND 9 OR p_size BETWEEN 20 AND 25",
)
def k42_detach_numeric(spark: SparkSession, sf: str) -> DataFrame:
    rows = trends.detach_periods(table(spark, sf, "part"), "p_size", [(3, 7), ("20", "25"), (5, 9)])
    return rows.select("p_partkey", "p_size")


@query(
    "k42_detach_many",
    """SELECT event_id, ts, event_type FROM events e
       WHERE EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'error'
                     AND e.ts BETWEEN p.ts - INTERVAL 40 SECOND AND p.ts + INTERVAL 2 MINUTE)""",
)
def k42_detach_many(spark: SparkSession, sf: str) -> DataFrame:
    """Events around any error: as many periods, overlapping ones too, as there are errors."""
    events = table(spark, sf, "events")
    around = events.filter("event_type = 'error'").selectExpr(
        "ts - INTERVAL 40 SECOND AS low", "ts + INTERVAL 2 MINUTE AS high"
    )
    return trends.detach_periods(events, "ts", around).select("event_id", "ts", "event_type")


@query(
    "k42_detach_many_numeric",
    """SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice FROM lineitem l
       JOIN part p ON l_extendedprice BETWEEN p_retailprice * 20 AND p_retailprice * 20 + p_size / 4
       WHERE p_partkey % 2 = 0""",
)
def k42_detach_many_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Line items whose price lies in a band around the price of twenty of some part."""
    bands = table(spark, sf, "part").filter("p_partkey % 2 = 0").selectExpr(
        "p_retailprice * 20 AS low", "p_retailprice * 20 + p_size / 4 AS high"
    )
    rows = trends.detach_periods(table(spark, sf, "lineitem"), "l_extendedprice", bands)
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice")


# --- topics -----------------------------------------------------------------


def hashed_part(source: str, key: str, seed: int, share: float) -> str:
    return f"""SELECT '{source}' AS corpus, {key} AS id FROM (
        SELECT *, row_number() OVER (ORDER BY md5('{seed}|' || CAST({key} AS VARCHAR))) AS r,
               count(*) OVER () AS n FROM {source}) WHERE r <= greatest(1, floor({share} * n))"""


@query(
    "k43_sample_corpora",
    hashed_part("documents", "doc_id", 9, 0.2)
    + " UNION ALL "
    + hashed_part("benchmark", "item_id", 10, 0.2),
)
def k43_sample_corpora(spark: SparkSession, sf: str) -> DataFrame:
    corpora = [
        ("documents", table(spark, sf, "documents").selectExpr("doc_id AS id")),
        ("benchmark", table(spark, sf, "benchmark").selectExpr("item_id AS id")),
    ]
    return sampling.sample_corpora(corpora, "id", 0.2, seed=9)


def clustered(spark: SparkSession, sf: str, clusters: int | None = None) -> DataFrame:
    return topics.assign_topics(table(spark, sf, "embeddings"), "embedding", clusters, seed=42)


# One micro-batch from the first eight vectors by hash: every row to the nearest, then the means.
ONLINE = """WITH s AS (SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) - 1 AS t,
                          CAST(embedding AS DOUBLE[]) AS c FROM embeddings
                   ORDER BY md5(CAST(vec_id AS VARCHAR)) LIMIT 8),
            e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
            a AS (SELECT vec_id, any_value(v) AS v, arg_min(t, list_distance(v, c)) AS t
                  FROM e, s GROUP BY vec_id),
            m AS (SELECT t, list(x ORDER BY i) AS c, any_value(n) AS n FROM (
                    SELECT t, i, avg(v[i]) AS x, count(*) AS n
                    FROM a, range(1, 65) r(i) GROUP BY t, i) GROUP BY t) """


def online_centres(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").schema
    stream = spark.readStream.schema(vectors).parquet(f"{sf}/embeddings*.parquet")
    folder = scratch_path(spark, "stream-topics")
    stream_topics(stream, "embedding", "vec_id", folder, scratch_path(spark, "stream-topics-state"), 8)
    return read_topics(spark, folder)


@query(
    "k45_online",
    ONLINE + """SELECT CAST(t AS BIGINT) AS topic, CAST(n AS BIGINT) AS size, CAST(i AS BIGINT) AS axis,
                       CAST(round(c[i] * 1e6) AS BIGINT) AS millionths FROM m, range(1, 65) r(i)""",
)
def k45_online(spark: SparkSession, sf: str) -> DataFrame:
    rows = online_centres(spark, sf).select(
        F.col(topics.TOPIC).alias("topic"), "size", F.posexplode("centroid").alias("at", "x")
    )
    return rows.select(
        "topic", "size", (F.col("at") + 1).cast("bigint").alias("axis"),
        F.round(F.col("x") * 1e6).cast("bigint").alias("millionths"),
    )


@query(
    "k45_online_nearest",
    ONLINE + """SELECT vec_id, CAST(arg_min(m.t, list_distance(v, c)) AS BIGINT) AS topic
                FROM e, m GROUP BY vec_id""",
)
def k45_online_nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows = assign_nearest(table(spark, sf, "embeddings"), "embedding", online_centres(spark, sf))
    return rows.select("vec_id", F.col(topics.TOPIC).alias("topic"))


@query("k45_cluster")
def k45_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return topics.assignments(clustered(spark, sf), "vec_id")


@query("k45_cluster_bisecting")
def k45_cluster_bisecting(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    found = topics.assign_topics(rows, "embedding", 8, seed=42, bisecting=True)
    return topics.assignments(found, "vec_id")


@query("k46_outliers")
def k46_outliers(spark: SparkSession, sf: str) -> DataFrame:
    rows = clustered(spark, sf)
    least = topics.topic_size(rows.count(), "target", 5)
    return topics.assignments(topics.mark_outliers(rows, least), "vec_id")


@query(
    "k46_mark_outliers",
    """SELECT vec_id, CASE WHEN count(*) OVER (PARTITION BY label) <
                (SELECT avg(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label))
              THEN -1 ELSE CAST(label AS BIGINT) END AS "TOPIC_topic" FROM embeddings""",
)
def k46_mark_outliers(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled_vectors(spark, sf)
    sizes = rows.groupBy(topics.TOPIC).agg(F.count(F.lit(1)).alias("n"))
    return topics.mark_outliers(rows, sizes.agg(F.avg("n")).scalar()).select("vec_id", topics.TOPIC)


def labelled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors with their given label as topic."""
    return table(spark, sf, "embeddings").withColumn(topics.TOPIC, F.col("label").cast("bigint"))


@query(
    "k47_label_text",
    f"""SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '{WORD}'), ' ') AS label_text
        FROM documents""",
)
def k47_label_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = tokenise(documents(spark, sf), "text")
    return docs.select("doc_id", topics.label_text(docs, "text").alias("label_text"))


STOP = ", ".join(f"'{w}'" for w in default_stop_words("en"))
TOPIC_WORDS = f"""(SELECT topic, token AS word, score,
        row_number() OVER (PARTITION BY topic ORDER BY score DESC, token) AS rank
    FROM (SELECT topic, token,
                 n / sum(n) OVER (PARTITION BY topic) * ln(1 + mean / everywhere) AS score
          FROM (SELECT *, sum(n) OVER (PARTITION BY token) AS everywhere,
                       sum(n) OVER () / (SELECT count(DISTINCT source) FROM documents) AS mean
                FROM (SELECT topic, token, count(*) AS n
                      FROM (SELECT CAST(source[4:] AS BIGINT) AS topic,
                                   unnest(regexp_extract_all(lower(text), '{WORD}')) AS token
                            FROM documents)
                      WHERE length(token) > 1 AND token NOT IN ({STOP}) GROUP BY 1, 2))))"""


def source_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the number of their source as topic and language as corpus."""
    topic = F.expr("CAST(substring(source, 4) AS BIGINT)")
    return documents(spark, sf).withColumn(topics.TOPIC, topic)


@query(
    "k48_topic_words",
    f"""SELECT topic, word, round(score, 9) AS score, rank FROM {TOPIC_WORDS} WHERE rank <= 50""",
)
def k48_topic_words(spark: SparkSession, sf: str) -> DataFrame:
    words = topics.topic_words(
        source_topics(spark, sf), topics.TOPIC, F.col("text"), "en", topics.words_to_compute(5)
    )
    return words.withColumns({"score": F.round("score", 9), "rank": F.col("rank").cast("bigint")})


def meanings(spark: SparkSession, sf: str, shown: int = 5) -> DataFrame:
    words = topics.topic_words(source_topics(spark, sf), topics.TOPIC, F.col("text"), "en")
    return topics.topic_meanings(words, shown)


MEANINGS = f"""(SELECT topic, string_agg(word, ' | ' ORDER BY rank) AS label FROM {TOPIC_WORDS}
                WHERE rank <= 5 GROUP BY topic)"""


@query(
    "k49_topic_table",
    f"""SELECT topic AS id, label, CAST(count_if(lang = 'en') AS BIGINT) AS en,
               CAST(count_if(lang = 'de') AS BIGINT) AS de, count(*) AS total_size
        FROM {MEANINGS} JOIN documents ON topic = CAST(source[4:] AS BIGINT) GROUP BY 1, 2""",
)
def k49_topic_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = topics.topic_table(
        source_topics(spark, sf), meanings(spark, sf), ["en", "de"], "lang"
    )
    return rows.select(
        "id",
        "label",
        F.get("size", F.lit(0)).alias("en"),
        F.get("size", F.lit(1)).alias("de"),
        "total_size",
    )


@query(
    "h5_topic_counts",
    """SELECT lang, CAST(source[4:] AS BIGINT) AS "TOPIC_topic", count(*) AS size
       FROM documents GROUP BY 1, 2""",
)
def h5_topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_counts(source_topics(spark, sf), "lang")


@query("k50_topic_map")
def k50_topic_map(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_map(topics.centroids(labelled_vectors(spark, sf), "embedding"))


@query(
    "k50_centroids",
    """SELECT CAST(label AS BIGINT) AS "TOPIC_topic", count(*) AS size,
              round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS first,
              round(avg(CAST(embedding[64] AS DOUBLE)), 6) AS last FROM embeddings GROUP BY 1""",
)
def k50_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return topics.centroids(labelled_vectors(spark, sf), "embedding").select(
        topics.TOPIC,
        "size",
        F.round(F.element_at("centroid", 1), 6).alias("first"),
        F.round(F.element_at("centroid", -1), 6).alias("last"),
    )


@query(
    "k51_one_merge",
    """WITH v AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x,
                         unnest(range(len(embedding))) AS d FROM embeddings),
            c AS (SELECT label, d, avg(x) AS x FROM v GROUP BY ALL),
            s AS (SELECT a.label AS keep, b.label AS gone,
                         sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS alike
                  FROM c a JOIN c b ON a.d = b.d AND a.label < b.label GROUP BY ALL),
            m AS (SELECT * FROM s ORDER BY alike DESC LIMIT 1)
       SELECT vec_id, CAST(CASE WHEN label = (SELECT gone FROM m) THEN (SELECT keep FROM m)
                                ELSE label END AS BIGINT) AS "TOPIC_topic" FROM embeddings""",
)
def k51_one_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The most similar pair of topics becomes one."""
    assigned = labelled_vectors(spark, sf)
    wanted = assigned.select(topics.TOPIC).distinct().count() - 1
    return topics.assignments(topics.reduce_topics(assigned, "embedding", wanted), "vec_id")


@query("k51_reduce_topics")
def k51_reduce_topics(spark: SparkSession, sf: str) -> DataFrame:
    reduced = topics.reduce_topics(labelled_vectors(spark, sf), "embedding", 4)
    return topics.assignments(reduced, "vec_id")


@query("k52_assignments", 'SELECT vec_id, CAST(label AS BIGINT) AS "TOPIC_topic" FROM embeddings')
def k52_assignments(spark: SparkSession, sf: str) -> DataFrame:
    return topics.assignments(labelled_vectors(spark, sf), "vec_id")


@query(
    "k52_meanings",
    f"""SELECT topic AS "TOPIC_topic", string_agg(word, ',' ORDER BY rank) AS words
        FROM {TOPIC_WORDS} WHERE rank <= 8 GROUP BY topic""",
)
def k52_meanings(spark: SparkSession, sf: str) -> DataFrame:
    return meanings(spark, sf, 8).select(
        topics.TOPIC, F.array_join(topics.MEANING, ",").alias("words")
    )


@query(
    "k53_detach_topics",
    """SELECT doc_id, lang, CAST(source[4:] AS BIGINT) AS "TOPIC_topic_1" FROM documents
       WHERE source IN ('src1', 'src4', 'src7')""",
)
def k53_detach_topics(spark: SparkSession, sf: str) -> DataFrame:
    assigned = topics.assignments(source_topics(spark, sf), "doc_id")
    source = documents(spark, sf).withColumn(topics.TOPIC, F.lit("taken"))
    return topics.detach_topics(source, assigned, "doc_id", ["doc_id", "lang"], [1, 4, 7])


@query(
    "f9_assignment_join",
    """SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def f9_assignment_join(spark: SparkSession, sf: str) -> DataFrame:
    assigned = table(spark, sf, "labels").withColumn(topics.TOPIC, F.col("quality"))
    return topics.detach_topics(
        documents(spark, sf), assigned, "doc_id", ["doc_id", "source"], topic_name="quality"
    )


@query(
    "k53_detach_meanings",
    f"""SELECT topic AS "TOPIC_topic", CASE WHEN topic = 4 THEN 'my | words' ELSE label END AS label
        FROM {MEANINGS} WHERE topic IN (1, 4)""",
)
def k53_detach_meanings(spark: SparkSession, sf: str) -> DataFrame:
    rows = topics.detach_meanings(
        meanings(spark, sf), source_topics(spark, sf), [1, 4, 99], {4: ["my", "words"]}
    )
    return rows.select(topics.TOPIC, F.array_join(topics.MEANING, " | ").alias("label"))


# --- quotations -------------------------------------------------------------

# Turns of a conversation told as reported speech, in all shapes of the grammar.
SAID = "regexp_replace(text, '\\s+', ' ', 'g')"
NAME = "CASE WHEN role = 'user' THEN 'Ada Byron' ELSE 'Noel' END"
SHAPES = {
    0: ("QVS", "'\"' || said || ',\" replied ' || name || ' at last.'"),
    1: ("QSV", "'\"' || said || '\", ' || name || ' said.'"),
    2: ("SVQ", "'and then ' || name || ' asked: \"' || said || '\"'"),
    3: ("FLOATING", "'All heard “' || said || '”'"),
}
REPORTED = f"""(SELECT conv_id, turn, said, name, (conv_id + turn) % 4 AS kind,
        CASE (conv_id + turn) % 4 {" ".join(f"WHEN {k} THEN {v[1]}" for k, v in SHAPES.items())} END
          AS text
    FROM (SELECT conv_id, turn, {SAID} AS said, {NAME} AS name FROM conversations))"""


def reported(spark: SparkSession, sf: str) -> DataFrame:
    """The same texts in Spark."""
    said = F.regexp_replace("text", r"\s+", " ")
    name = F.expr(NAME)
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", said.alias("said"), name.alias("name")
    )
    shape = " ".join(f"WHEN {k} THEN {v[1]}" for k, v in SHAPES.items())
    return turns.withColumn("text", F.expr(f"CASE (conv_id + turn) % 4 {shape} END"))


@query(
    "k54_preprocess",
    """SELECT doc_id, length(text) AS last_offset, replace(replace(replace(replace(replace(replace(
         translate(text, 'àáâãäåāèéêëēìíîïıīòóôõöōùúûüūýÿȳçñşÀÁÂÃÄÅĀÈÉÊËĒÌÍÎÏİĪÒÓÔÕÖŌÙÚÛÜŪÝŸȲÇÑŞ”“',
           'aaaaaaaeeeeeiiiiiioooooouuuuuyyycnsAAAAAAAEEEEEIIIIIIOOOOOOUUUUUYYYCNS""'),
         chr(10), '.' || chr(10) || ' '), '..' || chr(10) || ' ', '.' || chr(10) || ' '),
         '. .' || chr(10) || ' ', '.' || chr(10) || ' '), '  ', ' '), '\\n', ' '), '\\n\\n', ' ')
         AS plain
       FROM documents""",
)
def k54_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", quotes.preprocessed("text").alias("p"))
    return rows.select(
        "doc_id",
        F.element_at("p.offsets", -1).cast("bigint").alias("last_offset"),
        F.col("p.text").alias("plain"),
    )


@query(
    "k55_reported_speech",
    f"""SELECT conv_id, turn,
               CASE kind WHEN 0 THEN said || ',' ELSE said END AS quote,
               CASE WHEN kind < 3 THEN name END AS speaker,
               CASE kind WHEN 0 THEN 'replied' WHEN 1 THEN 'said' WHEN 2 THEN 'asked' END AS verb,
               CASE kind WHEN 0 THEN 'QVS' WHEN 1 THEN 'QSV' WHEN 2 THEN 'SVQ' ELSE 'FLOATING' END
                 AS quote_type, kind = 3 AS floating,
               len(regexp_extract_all(said, '\\S+')) AS token_count,
               CASE kind WHEN 2 THEN length('and then  asked: "') + length(name)
                         WHEN 3 THEN length('All heard “') ELSE 1 END AS quote_start,
               CASE kind WHEN 0 THEN length(said) + length('",  replied ')
                         WHEN 1 THEN length(said) + length('"", ')
                         WHEN 2 THEN length('and then ') END AS speaker_start
        FROM {REPORTED}""",
)
def k55_reported_speech(spark: SparkSession, sf: str) -> DataFrame:
    found = quotes.extract_quotations(reported(spark, sf), "text")
    flat = quotes.flatten_quotations(found, ["conv_id", "turn"])
    return flat.select(
        "conv_id",
        "turn",
        F.col("QUOTE_quote").alias("quote"),
        F.col("QUOTE_speaker").alias("speaker"),
        F.col("QUOTE_verb").alias("verb"),
        F.col("QUOTE_quote_type").alias("quote_type"),
        F.col("QUOTE_is_floating_quote").alias("floating"),
        F.col("QUOTE_quote_token_count").alias("token_count"),
        F.col("QUOTE_quote_start_idx").alias("quote_start"),
        F.col("QUOTE_speaker_start_idx").alias("speaker_start"),
    )


HTML = "(SELECT page_id AS doc_id, html AS text FROM pages)"


@query(
    "k55_quotations",
    f"""SELECT doc_id, matched[2:-2] AS quote, start + 1 AS quote_start,
               row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS row_idx
        FROM {spans_sql("(SELECT doc_id, translate(text, '”“', '\"\"') AS text FROM documents)", "doc_id", '"[^"\\n]+"')}""",
)
def k55_quotations(spark: SparkSession, sf: str) -> DataFrame:
    found = quotes.extract_quotations(documents(spark, sf), "text")
    return quotes.flatten_quotations(found, ["doc_id"]).select(
        "doc_id",
        F.col("QUOTE_quote").alias("quote"),
        F.col("QUOTE_quote_start_idx").alias("quote_start"),
        F.col("QUOTE_quote_row_idx").alias("row_idx"),
    )


LONG_NAME = "A" + "bcdefghijk" * 5


@query(
    "k55_long_speaker",
    f"""SELECT item_id, 'A' || repeat('bcdefghijk', 5) || ' A' || repeat('bcdefghijk', 5) AS speaker,
               length('"' || item_id || '" said ') AS speaker_start, 'said' AS verb
        FROM benchmark""",
)
def k55_long_speaker(spark: SparkSession, sf: str) -> DataFrame:
    """A speaker of 103 characters is found whole."""
    said = table(spark, sf, "benchmark").select(
        "item_id",
        F.concat(F.lit('"'), "item_id", F.lit(f'" said {LONG_NAME} {LONG_NAME}.\n'), "text").alias("t"),
    )
    found = quotes.extract_quotations(said, "t")
    flat = quotes.flatten_quotations(found, ["item_id"]).filter("QUOTE_verb = 'said'")
    return flat.select(
        "item_id",
        F.col("QUOTE_speaker").alias("speaker"),
        F.col("QUOTE_speaker_start_idx").alias("speaker_start"),
        F.col("QUOTE_verb").alias("verb"),
    )


@query(
    "k56_flatten",
    f"""SELECT doc_id, matched[2:-2] AS "QUOTE_quote",
               substring(text, greatest(0, start - 9) + 1,
                         least(length(text), stop + 9) - greatest(0, start - 9)) AS "QUOTE_extraction"
        FROM {spans_sql(HTML, "doc_id", '"[^"\\n]+"')} WHERE trim(matched[2:-2]) <> ''""",
)
def k56_flatten(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").selectExpr("page_id AS doc_id", "html")
    found = quotes.extract_quotations(pages, "html")
    # Attribute values only: the window then starts and ends at the quotation.
    floating = F.filter("quotation", lambda q: q["is_floating_quote"])
    flat = quotes.flatten_quotations(
        found.withColumn("quotation", floating), ["doc_id"], text_col="html", context=10
    )
    return flat.select("doc_id", "QUOTE_quote", "QUOTE_extraction")


@query(
    "k57_quotation_page",
    f"""SELECT conv_id, turn, CASE kind WHEN 0 THEN said || ',' ELSE said END AS "QUOTE_quote"
        FROM {REPORTED} ORDER BY conv_id, turn LIMIT 100 OFFSET 100""",
)
def k57_quotation_page(spark: SparkSession, sf: str) -> DataFrame:
    page = kwic.document_page(reported(spark, sf), ["conv_id", "turn"], page=2, page_size=100)
    found = quotes.extract_quotations(page, "text")
    flat = quotes.flatten_quotations(found, ["conv_id", "turn"])
    return flat.select("conv_id", "turn", "QUOTE_quote")


@query(
    "k58_context",
    f"""SELECT doc_id, start, substring(text, greatest(0, start - 20) + 1,
                 least(length(text), stop + 20) - greatest(0, start - 20)) AS around
        FROM {spans_sql("documents", "doc_id", "token = ")}""",
)
def k58_context(spark: SparkSession, sf: str) -> DataFrame:
    hits = kwic.concordance(
        documents(spark, sf), "text", "token = ", ["doc_id", "text"], case_sensitive=True
    )
    window = quotes.around(
        F.col("text"), F.col("CONC_start_idx"), F.col("CONC_end_idx"), quotes.context_length("x")
    )
    return hits.select("doc_id", F.col("CONC_start_idx").alias("start"), window.alias("around"))


# --- annotation -------------------------------------------------------------

CLASSES = [
    {"name": "English", "description": "the and that"},
    {"name": "German", "description": "der die und"},
    {"name": "French", "description": "le les une"},
]


def score_sql(words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    tokens = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
    return f"len(list_filter({tokens}, lambda t: t IN ({listed})))"


@query(
    "k59_classify",
    f"""SELECT doc_id, CASE WHEN greatest(e, g, f) = 0 THEN NULL WHEN e >= g AND e >= f THEN 'English'
                            WHEN g >= f THEN 'German' ELSE 'French' END AS classification,
               CASE WHEN greatest(e, g, f) = 0 THEN 'No classification returned' END AS error
        FROM (SELECT doc_id, {score_sql(["english", "the", "and", "that"])} AS e,
                     {score_sql(["german", "der", "die", "und"])} AS g,
                     {score_sql(["french", "le", "les", "une"])} AS f FROM documents)""",
)
def k59_classify(spark: SparkSession, sf: str) -> DataFrame:
    answers = annotate.classify(
        documents(spark, sf), "doc_id", "text", annotate.KeywordClassifier(CLASSES)
    )
    rows = annotate.label_rows(answers, [c["name"] for c in CLASSES])
    return rows.select("doc_id", "classification", "error")


RAW = """CASE WHEN lang = 'en' THEN ' ENGLISH ' WHEN lang = 'de' THEN 'probably german, or english'
         WHEN lang = 'es' THEN 'Spanish' END"""


@query(
    "k60_normalise_labels",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'English'
                                WHEN 'es' THEN 'Spanish' END AS label FROM documents""",
)
def k60_normalise_labels(spark: SparkSession, sf: str) -> DataFrame:
    names = [c["name"] for c in CLASSES]
    return documents(spark, sf).select(
        "doc_id", annotate.normalised_label(F.expr(RAW), names).alias("label")
    )


def edited(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose new annotation column is filled from the labels."""
    edits = table(spark, sf, "labels").selectExpr(
        "doc_id", "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' END AS label"
    )
    return annotate.save_edits(documents(spark, sf), edits, "doc_id", "annotation")


EDITED = """(SELECT d.*, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' END
             AS annotation FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query("k61_save_edits", f"SELECT doc_id, source, annotation FROM {EDITED}")
def k61_save_edits(spark: SparkSession, sf: str) -> DataFrame:
    return edited(spark, sf).select("doc_id", "source", "annotation")


@query("k62_detach_labels", f"SELECT lang, text, annotation FROM {EDITED}")
def k62_detach_labels(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.detach_labels(edited(spark, sf), "text", "annotation", ["lang"])


@query(
    "h6_categories",
    f"""SELECT DISTINCT annotation AS value, 'category' AS kind FROM {EDITED}
        WHERE annotation IS NOT NULL
        UNION ALL SELECT DISTINCT source, 'provider' FROM {EDITED} WHERE annotation IS NOT NULL""",
)
def h6_categories(spark: SparkSession, sf: str) -> DataFrame:
    rows = annotate.add_annotation(edited(spark, sf), "notes", F.col("source"), F.col("annotation"))
    kinds = {"category": "annotation", "provider": "provider"}
    parts = [
        annotate.annotation_values(rows, "notes", field).withColumn("kind", F.lit(kind))
        for kind, field in kinds.items()
    ]
    return parts[0].unionByName(parts[1])


@query(
    "h7_lists_by_document",
    f"""SELECT doc_id, lang, source, string_agg(matched, '|' ORDER BY start) AS matched,
               string_agg(l1, '|' ORDER BY start) AS l1
        FROM {kwic_sql("documents", "doc_id, lang, source", "(?i)[a-z]+ ?= ?[^ ]+", 2, 2)}
        GROUP BY doc_id, lang, source""",
)
def h7_lists_by_document(spark: SparkSession, sf: str) -> DataFrame:
    keep = ["doc_id", "lang", "source"]
    hits = kwic.concordance(
        documents(spark, sf), "text", "[a-z]+ ?= ?[^ ]+", keep, left=2, right=2, regex=True
    )
    rows = kwic.dispersion_detach(hits, "doc_id", ["lang", "source"])
    return rows.select(
        *keep,
        F.array_join("CONC_matched_text", "|").alias("matched"),
        F.array_join("CONC_l1", "|").alias("l1"),
    )


# --- streams ----------------------------------------------------------------


@query(
    "m1_stream_trend",
    """SELECT date_trunc('hour', ts) AS time_period, event_type, count(*) AS sequential_count,
              min(ts) AS period_start, max(ts) AS period_end FROM events
       GROUP BY 1, 2""",
)
def m1_stream_trend(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    path = scratch_path(spark, "stream-trend")
    result = stream_trend(stream, "ts", "1 hour", "1 hour", ["event_type"])
    write_available(result, path, scratch_path(spark, "stream-state"))
    rows = read_trend(spark, result, path, ["time_period", "event_type"])
    times = ("time_period", "period_start", "period_end")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


@query(
    "m2_stream_tokens",
    f"""SELECT sha256('word' || chr(1) || text) AS text_hash,
               len(regexp_extract_all(text, '{WORD}')) AS n
        FROM (SELECT DISTINCT text FROM documents)""",
)
def m2_stream_tokens(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet")
    path = scratch_path(spark, "stream-tokens")
    stream_token_store(stream, "text", path, scratch_path(spark, "stream-tokens-state"))
    return read_token_store(spark, path).select(
        "text_hash", F.size("tokens").cast("bigint").alias("n")
    )
