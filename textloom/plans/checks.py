"""Queries on what is checked or named before work begins: formats, types, names, schemas, requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import columns, combine, keyness, schema, topics
from textloom.operators.tokens import find_derived, tokenise
from textloom.plans.analyses import source_topics
from textloom.plans.registry import documents, query, table
from textloom.plans.texts import COUNTS, WORD
from textloom.sources import readers

# A listing of files, one per document.
NAMES = """concat(source, '.d/', CASE WHEN doc_id % 11 = 0 THEN '.' ELSE 'part.' END, lang, '.', CASE doc_id % 8
    WHEN 0 THEN 'CSV' WHEN 1 THEN 'jsonl' WHEN 2 THEN 'parquet' WHEN 3 THEN 'tsv' WHEN 4 THEN 'md'
    WHEN 5 THEN 'xlsx' WHEN 6 THEN 'zip' ELSE 'bin' END)"""


@query(
    "a1_formats",
    f"""SELECT CASE lower(regexp_extract(name, '([^.]+)$', 1)) WHEN 'csv' THEN 'csv' WHEN 'jsonl' THEN 'jsonl'
                    WHEN 'parquet' THEN 'parquet' WHEN 'tsv' THEN 'tsv' WHEN 'md' THEN 'text'
                    WHEN 'xlsx' THEN 'excel' WHEN 'zip' THEN 'zip' ELSE 'unknown' END AS format,
               count(*) AS files, min(name) AS first_name
        FROM (SELECT {NAMES} AS name FROM documents) GROUP BY 1""",
)
def a1_formats(spark: SparkSession, sf: str) -> DataFrame:
    listing = documents(spark, sf).selectExpr(f"{NAMES} AS name")
    formats = listing.select(readers.format_of(F.col("name")).alias("format"), "name")
    return formats.groupBy("format").agg(
        F.count(F.lit(1)).alias("files"), F.min("name").alias("first_name")
    )


@query(
    "b10_axes",
    """SELECT 'event_id' AS "column", 'numeric' AS axis, count(event_id) AS filled FROM events
       UNION ALL SELECT 'ts', 'datetime', count(ts) FROM events
       UNION ALL SELECT 'user_id', 'numeric', count(user_id) FROM events
       UNION ALL SELECT 'value', 'numeric', count(*) FILTER (WHERE isfinite(value)) FROM events""",
)
def b10_axes(spark: SparkSession, sf: str) -> DataFrame:
    return schema.axis_report(table(spark, sf, "events"))


@query(
    "d4_output_names",
    """SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS "no digits",
              regexp_replace(lang, 'e', 'E', 'g') AS lang, regexp_replace(source, 'src', 's', 'g') AS computed_column
       FROM documents""",
)
def d4_output_names(spark: SparkSession, sf: str) -> DataFrame:
    """A tidied name, a column that is overwritten, and the default name."""
    docs = columns.find_replace(documents(spark, sf), "text", "[0-9]+", "#", output="  no \n\t digits ")
    docs = columns.find_replace(docs, "lang", "e", "E")
    docs = columns.find_replace(docs, "source", "src", "s", output=" \n ")
    return docs.select("doc_id", "no digits", "lang", "computed_column")


@query(
    "g3_schema_report",
    """SELECT '2' AS "table", 'lang' AS "column", 'missing' AS problem, 'string' AS detail,
              count(lang) AS filled FROM documents
       UNION ALL SELECT '2', 'n_chars', 'type', 'bigint vs string', count(n_chars) FROM documents WHERE lang = 'de'
       UNION ALL SELECT '2', 'words', 'unexpected', 'int', count(text) FROM documents WHERE lang = 'de'
       UNION ALL SELECT '3', 'source', 'type', 'string vs array<string>', count(source) FROM documents""",
)
def g3_schema_report(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    german = docs.filter("lang = 'de'").selectExpr(
        "doc_id", "text", "source", "string(n_chars) AS n_chars", "size(split(text, ' ')) AS words"
    )
    listed = docs.withColumn("source", F.expr("if(source IS NULL, NULL, array(source))"))
    return combine.schema_report([docs, german, listed])


@query(
    "k3_find_tokens",
    f"""SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '{WORD}')) AS BIGINT) AS words,
               CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS pieces FROM documents""",
)
def k3_find_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token columns found by source and model in a table that has several, after it was cut and joined."""
    docs = tokenise(tokenise(documents(spark, sf), "text"), "text", "whitespace")
    docs = tokenise(docs, "source").drop("text")
    names = {m: find_derived(docs, "text", model=m) for m in ("word", "whitespace")}
    first = find_derived(docs, "text")
    if find_derived(docs, "lang") is not None or first != names["word"]:
        raise ValueError("found a column of another source or model")
    return docs.select(
        "doc_id", *[
            F.size(names[m]).cast("bigint").alias(n) for m, n in (("word", "words"), ("whitespace", "pieces"))
        ]
    )


@query("k32_one_corpus", f"SELECT * FROM {COUNTS} ORDER BY frequency DESC, token LIMIT 40")
def k32_one_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return keyness.compare_corpora([documents(spark, sf)], "text", 40)


@query(
    "k44_size_rules",
    """WITH s AS (SELECT CAST(source[4:] AS BIGINT) AS topic, count(*) AS n FROM documents GROUP BY 1),
            t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM s),
            r AS (SELECT 'target' AS mode, greatest(2, total // 20) AS least FROM t
                  UNION ALL SELECT 'min', greatest(2, total // 20 + 1) FROM t
                  UNION ALL SELECT 'exact', greatest(5, CAST(floor(0.75 * greatest(2, total // 10)) AS BIGINT)) FROM t)
       SELECT mode, CASE WHEN n < least THEN -1 ELSE topic END AS "TOPIC_topic", CAST(sum(n) AS BIGINT) AS documents
       FROM s, r GROUP BY ALL""",
)
def k44_size_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per topic under each rule; the sources are the topics."""
    rows = source_topics(spark, sf).select(topics.TOPIC)
    rules = {"target": 2, "min": rows.count() // 20 + 1, "exact": 1}
    marked = [topics.mark_small(rows, m, v).withColumn("mode", F.lit(m)) for m, v in rules.items()]
    stacked = reduce(lambda a, b: a.unionByName(b), marked)
    return stacked.groupBy("mode", topics.TOPIC).agg(F.count(F.lit(1)).alias("documents"))


@query(
    "n2_lambdas",
    """SELECT doc_id, len(list_filter(w, lambda x: length(x) > 7)) AS long_words,
              array_to_string(list_transform(list_filter(w, lambda x: length(x) > 7), lambda x: x[1:3]), '-') AS heads,
              CASE WHEN lang = 'en' THEN concat('en:', source) ELSE 'other' END AS label
       FROM (SELECT *, string_split(text, ' ') AS w FROM documents)""",
)
def n2_lambdas(spark: SparkSession, sf: str) -> DataFrame:
    """Lambdas over lists, a condition and a text put together, as expression texts."""
    docs = columns.add_columns(documents(spark, sf), "w = filter(split(text, ' '), x -> length(x) > 7)")
    return columns.select_expressions(
        docs, "doc_id", "long_words = bigint(size(w))",
        "heads = array_join(transform(w, x -> substring(x, 1, 3)), '-')",
        "label = if(lang = 'en', concat('en:', source), 'other')",
    )
