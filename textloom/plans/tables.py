"""Queries on sources, types, filters, columns, sampling, joins and statistics."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import scalars
from textloom.functions.textfix import repair_text_columns
from textloom.operators import columns, combine, predicates, sampling, schema, stats
from textloom.operators.keyness import token_frequencies, top_tokens
from textloom.operators.ranks import with_row_index
from textloom.operators.tokens import token_words, tokenise
from textloom.plans.registry import documents, query, table
from textloom.session import scratch_path
from textloom.sources import readers, writers

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUSTOMER_SQL = """
    SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
    FROM customer"""


def typed_customer(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("c_custkey").cast("bigint"),
        "c_name",
        F.col("c_nationkey").cast("bigint"),
        F.col("c_acctbal").cast("double"),
        "c_mktsegment",
    )


# --- A: sources and sinks ---------------------------------------------------


@query("a2_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def a2_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "documents") + ".csv"
    writers.write_table(documents(spark, sf), path, "csv")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return readers.load(spark, path, schema=schema, multiline=True)


@query("a3_tsv", CUSTOMER_SQL)
def a3_tsv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "customer") + ".tsv"
    table(spark, sf, "customer").write.option("header", True).option("sep", "\t").csv(path)
    return typed_customer(readers.load(spark, path))


@query("a4_parquet", "SELECT * FROM part")
def a4_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return readers.load(spark, f"{sf}/part.parquet")


@query("a5_json_array", CUSTOMER_SQL)
def a5_json_array(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "customer") + ".json"
    writers.write_table(table(spark, sf, "customer"), path, "json")
    return typed_customer(readers.load(spark, path))


@query(
    "a6_json_lines",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
              CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders""",
)
def a6_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "orders") + ".jsonl"
    writers.write_table(table(spark, sf, "orders"), path, "ndjson")
    return readers.load(spark, path).select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        F.to_date("o_orderdate").alias("o_orderdate"),
        "o_orderpriority",
    )


@query("a7_text_lines", "SELECT url AS text FROM pages")
def a7_text_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "urls") + ".txt"
    table(spark, sf, "pages").select("url").write.text(path)
    return readers.load(spark, path)


ARCHIVE_BYTES = 1 << 20  # from which on an archive of zipped texts is closed


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives of some rows each, with members a reader has to skip."""

    def closed(archive: zipfile.ZipFile, buffer: io.BytesIO) -> pa.RecordBatch:
        archive.close()
        return pa.RecordBatch.from_arrays([pa.array([buffer.getvalue()], pa.binary())], ["content"])

    for batch in batches:
        archive = None
        for row in zip(*(batch.column(c) for c in ("doc_id", "source", "text")), strict=True):
            doc_id, source, text = (x.as_py() for x in row)
            if archive is None:
                buffer = io.BytesIO()
                archive = zipfile.ZipFile(buffer, "w")
            archive.writestr(f"{source}/{doc_id}.txt", text)
            archive.writestr(f"__MACOSX/{source}/{doc_id}.txt", text)
            archive.writestr(f"{source}/{doc_id}.png", b"\x89PNG")
            if buffer.tell() >= ARCHIVE_BYTES:
                yield closed(archive, buffer)
                archive = None
        if archive is not None:
            yield closed(archive, buffer)


@query(
    "a8_archives",
    """SELECT source || '/' || doc_id || '.txt' AS file_path,
              CAST(doc_id AS VARCHAR) AS base_name, '.txt' AS extension, text AS document
       FROM documents""",
)
def a8_archives(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "source", "text")
    return readers.unpack_archives(docs.mapInArrow(zipped, "content binary"))


@query(
    "a9_preview",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
              coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), 'None') AS c_nationkey,
              c_mktsegment
       FROM customer ORDER BY customer.c_custkey LIMIT 50 OFFSET 50""",
)
def a9_preview(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        "c_name",
        F.expr("nullif(c_nationkey, 3)").alias("c_nationkey"),
        "c_mktsegment",
    )
    return readers.preview(rows, ["c_custkey"], page=1, size=50)


@query("a10_stage", "SELECT * FROM orders")
def a10_stage(spark: SparkSession, sf: str) -> DataFrame:
    return writers.stage(table(spark, sf, "orders"), "orders")


@query(
    "a11_csv_texts",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang,
              CAST(to_json(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS VARCHAR) AS words
       FROM documents""",
)
def a11_csv_texts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "words")
    words = documents(spark, sf).select(
        "doc_id", "lang", token_words(F.col("text")).alias("words")
    )
    writers.write_table(words, path, "csv")
    return readers.read_csv(spark, path, schema="doc_id string, lang string, words string")


@query("a12_ndjson", "SELECT item_id, text FROM benchmark")
def a12_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "benchmark") + ".ndjson"
    writers.write_table(table(spark, sf, "benchmark"), path, "ndjson")
    return readers.read_json_lines(spark, path, "item_id bigint, text string")


@query(
    "a13_parquet_partitioned",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem",
)
def a13_parquet_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "lineitem")
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"
    )
    writers.write_table(items, path, "parquet", ["l_returnflag"])
    return spark.read.parquet(path)


@query(
    "a14_export",
    """SELECT 'nation' AS block, count(*) AS row_count FROM nation UNION ALL
       SELECT 'nation_1', count(*) FROM supplier UNION ALL
       SELECT 'a_b', count(*) FROM customer""",
)
def a14_export(spark: SparkSession, sf: str) -> DataFrame:
    blocks = [("nation", "nation"), ("nation", "supplier"), ("a/b", "customer")]
    paths = writers.export_tables(
        [(label, table(spark, sf, name)) for label, name in blocks],
        scratch_path(spark, "export"),
        "parquet",
    )
    counts = [
        spark.read.parquet(path)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("block"), "row_count")
        for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query("a15_visible", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def a15_visible(spark: SparkSession, sf: str) -> DataFrame:
    return writers.visible(tokenise(documents(spark, sf), "text"))


# --- B: types and text repair -----------------------------------------------


@query(
    "b1_types",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
              o_totalprice, CAST(year(o_orderdate) AS BIGINT) AS y,
              'timestamp,bigint' AS types FROM orders""",
)
def b1_types(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", "o_totalprice", F.year("o_orderdate").alias("y")
    )
    typed, _ = schema.normalise_types(orders)
    return typed.withColumns(
        {
            "types": F.concat_ws(",", F.typeof("o_orderdate"), F.typeof("y")),
            "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        }
    )


@query("b2_mojibake", "SELECT doc_id, text FROM documents")
def b2_mojibake(spark: SparkSession, sf: str) -> DataFrame:
    broken = documents(spark, sf).select(
        "doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("text")
    )
    return repair_text_columns(broken, ["text", "doc_id", "missing"])


@query(
    "b2_mixed",
    "SELECT doc_id, '日本 é ' || text || ' é ẹ̀' AS text FROM documents",
)
def b2_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of which only a part was misread, with marks set apart."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    mixed = F.concat(F.lit("日本 é "), broken, F.lit(" e\u0301 e\u0323\u0300"))
    return repair_text_columns(documents(spark, sf).select("doc_id", mixed.alias("text")))


# Marks out of order, three on a letter, Hangul parts, a singleton, an excluded composition.
MARKS = "o\u0302\u0323 \u1112\u1161\u11ab \u212b \ufb2c a\u0315\u0300\u05ae\u0301 u\u0308\u0323\u0304 "


@query("b2_normal_form", f"SELECT doc_id, nfc_normalize('{MARKS}' || text) AS text FROM documents")
def b2_normal_form(spark: SparkSession, sf: str) -> DataFrame:
    texts = documents(spark, sf).select("doc_id", F.concat(F.lit(MARKS), "text").alias("text"))
    return repair_text_columns(texts, ["text"])


@query(
    "b3_to_datetime",
    """SELECT event_id,
              CASE WHEN event_id % 7 <> 0 THEN date_trunc('second', ts) END AS at,
              CASE WHEN event_id % 7 <> 0 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END
                AS zoned
       FROM events""",
)
def b3_to_datetime(spark: SparkSession, sf: str) -> DataFrame:
    text = F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    good = F.col("event_id") % 7 != 0
    texts = table(spark, sf, "events").select(
        "event_id",
        F.when(good, text).otherwise(F.col("event_type")).alias("at"),
        F.when(good, F.concat(text, F.lit(" +0200"))).otherwise(F.col("event_type")).alias("zoned"),
    )
    cast = schema.cast_column(texts, "at", "datetime", "%d/%m/%Y %H:%M:%S")
    cast = schema.cast_column(cast, "zoned", "datetime", "%d/%m/%Y %H:%M:%S %z")
    return cast.select(
        "event_id",
        F.col("at").cast("timestamp_ntz").alias("at"),
        F.col("zoned").cast("timestamp_ntz").alias("zoned"),
    )


@query(
    "b4_to_string",
    """SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS o_orderdate,
              CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders""",
)
def b4_to_string(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    text = schema.cast_column(orders, "o_orderdate", "string", "%d.%m.%Y %H:%M")
    return schema.cast_column(text, "o_custkey", "string")


MIXED = "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE CAST({} AS {}) END"


@query(
    "b5_to_integer",
    f"""SELECT p_partkey, TRY_CAST({MIXED.format("p_size", "VARCHAR")} AS BIGINT) AS v,
               CAST(trunc(p_retailprice) AS BIGINT) AS price FROM part""",
)
def b5_to_integer(spark: SparkSession, sf: str) -> DataFrame:
    mixed = table(spark, sf, "part").select(
        "p_partkey",
        F.expr(MIXED.format("p_size", "STRING")).alias("v"),
        F.col("p_retailprice").alias("price"),
    )
    return schema.cast_column(schema.cast_column(mixed, "v", "integer"), "price", "integer")


@query(
    "b6_to_float",
    f"SELECT p_partkey, TRY_CAST({MIXED.format('p_retailprice', 'VARCHAR')} AS DOUBLE) AS v "
    "FROM part",
)
def b6_to_float(spark: SparkSession, sf: str) -> DataFrame:
    mixed = table(spark, sf, "part").select(
        "p_partkey", F.expr(MIXED.format("p_retailprice", "STRING")).alias("v")
    )
    return schema.cast_column(mixed, "v", "float")


@query("b7_to_category", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def b7_to_category(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return schema.cast_column(rows, "c_nationkey", "categorical")


@query("b8_rename_drop", "SELECT s_suppkey, s_name AS name, s_nationkey FROM supplier")
def b8_rename_drop(spark: SparkSession, sf: str) -> DataFrame:
    renamed = schema.rename_column(table(spark, sf, "supplier"), "s_name", "name")
    return schema.drop_column(renamed, "s_acctbal")


@query(
    "b9_logical_types",
    """SELECT 'event_id' AS "column", 'integer' AS family, count(event_id) AS filled FROM events
       UNION ALL SELECT 'ts', 'datetime', count(ts) FROM events
       UNION ALL SELECT 'user_id', 'integer', count(user_id) FROM events
       UNION ALL SELECT 'event_type', 'string', count(event_type) FROM events
       UNION ALL SELECT 'value', 'float', count(value) FROM events
       UNION ALL SELECT 'props', 'string', count(props) FROM events""",
)
def b9_logical_types(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    filled = events.agg(*[F.count(c).alias(c) for c in events.columns]).unpivot(
        [], events.columns, "column", "filled"
    )
    return schema.logical_types(events).join(filled, "column").select("column", "family", "filled")


# --- C: filters -------------------------------------------------------------

# Nulls for the null rules: customers of two nations lose their segment.
SEGMENT = "CASE WHEN c_nationkey IN (3, 7) THEN NULL ELSE c_mktsegment END"
CUSTOMER_NULLS = f"(SELECT c_custkey, c_acctbal, {SEGMENT} AS segment FROM customer)"


def customer_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", F.expr(SEGMENT).alias("segment")
    )


def where(column: str, operator: str, value: object = None, **more: object) -> dict:
    return {"column": column, "operator": operator, "value": value, **more}


@query(
    "c1_equals",
    f"SELECT c_custkey, segment FROM {CUSTOMER_NULLS} "
    "WHERE segment <> 'BUILDING' AND c_custkey <> 12",
)
def c1_equals(spark: SparkSession, sf: str) -> DataFrame:
    tests = [where("segment", "ne", "BUILDING"), where("c_custkey", "eq", "12", negate=True)]
    return predicates.filter_rows(customer_nulls(spark, sf), tests).select("c_custkey", "segment")


@query(
    "c2_compare",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_quantity > 10 AND l_quantity <= 40 AND l_discount >= 0.02 AND l_tax < 0.07""",
)
def c2_compare(spark: SparkSession, sf: str) -> DataFrame:
    tests = [
        where("l_quantity", "greater_than", "10"),
        where("l_quantity", "lte", 40),
        where("l_discount", "gte", "0.02"),
        where("l_tax", "less_than", 0.07),
    ]
    kept = predicates.filter_rows(table(spark, sf, "lineitem"), tests)
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "c3_in",
    f"SELECT c_custkey, segment FROM {CUSTOMER_NULLS} "
    "WHERE segment IN ('BUILDING', 'MACHINERY') OR segment IS NULL",
)
def c3_in(spark: SparkSession, sf: str) -> DataFrame:
    test = where("segment", "in", ["BUILDING", None, "MACHINERY"])
    return predicates.filter_rows(customer_nulls(spark, sf), [test]).select("c_custkey", "segment")


@query(
    "c4_in_list",
    """SELECT doc_id, lang FROM documents
       WHERE list_has_any(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['the', 'und'])""",
)
def c4_in_list(spark: SparkSession, sf: str) -> DataFrame:
    words = documents(spark, sf).withColumn("words", token_words(F.col("text")))
    kept = predicates.filter_rows(words, [where("words", "in", ["the", "und"])])
    return kept.select("doc_id", "lang")


@query(
    "c5_contains",
    "SELECT doc_id, n_chars FROM documents "
    "WHERE contains(lower(text), 'tion') AND NOT contains(text, 'The')",
)
def c5_contains(spark: SparkSession, sf: str) -> DataFrame:
    tests = [
        where("text", "contains", "TION"),
        where("text", "contains", "The", case_sensitive=True, negate=True),
    ]
    return predicates.filter_rows(documents(spark, sf), tests).select("doc_id", "n_chars")


@query(
    "c6_contains_regex",
    "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(heit|keit|mente) [a-z]+ung')",
)
def c6_contains_regex(spark: SparkSession, sf: str) -> DataFrame:
    test = where("text", "contains", "(heit|keit|mente) [a-z]+ung", regex=True)
    return predicates.filter_rows(documents(spark, sf), [test]).select("doc_id")


@query(
    "c7_starts_ends",
    "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small') OR ends_with(p_name, 'ring')",
)
def c7_starts_ends(spark: SparkSession, sf: str) -> DataFrame:
    tests = [where("p_name", "startswith", "small"), where("p_name", "endswith", "ring")]
    kept = predicates.filter_rows(table(spark, sf, "part"), tests, "or")
    return kept.select("p_partkey", "p_name")


@query("c8_nulls", f"SELECT c_custkey, c_acctbal FROM {CUSTOMER_NULLS} WHERE segment IS NULL")
def c8_nulls(spark: SparkSession, sf: str) -> DataFrame:
    tests = [where("segment", "is_null"), where("c_acctbal", "is_not_null")]
    return predicates.filter_rows(customer_nulls(spark, sf), tests).select("c_custkey", "c_acctbal")


@query(
    "c9_between",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderkey >= 100
         AND o_orderdate <= TIMESTAMP '1998-01-01'""",
)
def c9_between(spark: SparkSession, sf: str) -> DataFrame:
    tests = [
        where("o_totalprice", "between", {"start": 100000, "end": 200000}),
        where("o_orderkey", "between", {"start": 100}),
        where("o_orderdate", "between", {"end": "1998-01-01T00:00:00Z"}),
        where("o_custkey", "between", {}),
    ]
    kept = predicates.filter_rows(table(spark, sf, "orders"), tests)
    return kept.select("o_orderkey", "o_totalprice")


@query("c10_unknown_operator", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^(ECO|STAN)')")
def c10_unknown_operator(spark: SparkSession, sf: str) -> DataFrame:
    test = where("p_type", "looks_like", "^(ECO|STAN)")
    return predicates.filter_rows(table(spark, sf, "part"), [test]).select("p_partkey")


@query(
    "c11_negate",
    f"SELECT c_custkey FROM {CUSTOMER_NULLS} "
    "WHERE NOT (segment IN ('BUILDING')) AND NOT starts_with(segment, 'M')",
)
def c11_negate(spark: SparkSession, sf: str) -> DataFrame:
    tests = [
        where("segment", "in", "BUILDING", negate=True),
        where("segment", "startswith", "M", negate=True),
    ]
    return predicates.filter_rows(customer_nulls(spark, sf), tests).select("c_custkey")


@query(
    "c12_or",
    "SELECT event_id, event_type FROM events WHERE event_type = 'click' OR value > 90 OR user_id = 5",
)
def c12_or(spark: SparkSession, sf: str) -> DataFrame:
    tests = [
        where("event_type", "eq", "click"),
        where("value", "gt", 90),
        where("user_id", "eq", 5),
    ]
    kept = predicates.filter_rows(table(spark, sf, "events"), tests, "or")
    return kept.select("event_id", "event_type")


@query("c13_coercion", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25.5 AND (l_tax = 0.0)")
def c13_coercion(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").withColumn("untaxed", F.col("l_tax") == 0)
    tests = [where("untaxed", "eq", "true"), where("l_quantity", "gt", "25.5")]
    return predicates.filter_rows(items, tests).select("l_orderkey", "l_linenumber")


@query(
    "c14_time_literal",
    """SELECT event_id, ts FROM events
       WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts <= TIMESTAMP '2024-01-20 10:30:00'
         AND CAST(ts AS DATE) <> DATE '2024-01-15'""",
)
def c14_time_literal(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumns(
        {"zoned": schema.as_utc(F.col("ts")), "day": F.to_date("ts")}
    )
    tests = [
        where("ts", "gte", "2024-01-10T06:00:00+00:00"),
        where("zoned", "lte", "2024-01-20T12:30:00+02:00"),
        where("day", "ne", "2024-01-15T23:00:00Z"),
    ]
    return predicates.filter_rows(events, tests).select("event_id", "ts")


@query(
    "c15_quick_filter",
    "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'dg') AND starts_with(p_brand, 'Brand#1')",
)
def c15_quick_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = predicates.quick_filter(table(spark, sf, "part"), "p_name", "dg")
    kept = predicates.quick_filter(kept, "p_brand", "Brand#1", "startswith")
    return predicates.quick_filter(kept, "p_size", "5", "eq").select("p_partkey", "p_name")


@query(
    "c16_expression",
    "SELECT o_orderkey FROM orders WHERE length(o_orderpriority) > 5 AND o_totalprice / 2 < o_custkey * 100",
)
def c16_expression(spark: SparkSession, sf: str) -> DataFrame:
    rule = "length(o_orderpriority) > 5 AND o_totalprice / 2 < o_custkey * 100"
    return columns.apply_expressions(table(spark, sf, "orders"), "filter", [rule]).select("o_orderkey")


# --- D: columns -------------------------------------------------------------


@query(
    "d1_replace_all",
    """SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS plain,
              regexp_replace(url, '([a-z]+)=([0-9a-z]+)', '\\2:\\1$', 'g') AS url FROM pages""",
)
def d1_replace_all(spark: SparkSession, sf: str) -> DataFrame:
    pages = columns.find_replace(table(spark, sf, "pages"), "html", "<[^>]*>", " ", output="plain")
    pages = columns.find_replace(pages, "url", "([a-z]+)=([0-9a-z]+)", "${2}:$1$$")
    return pages.select("page_id", "plain", "url")


@query(
    "d2_replace_first",
    """SELECT doc_id,
              regexp_replace(regexp_replace(text, '[aeiou]+', '#'), '[aeiou]+', '#') AS literal,
              regexp_replace(text, '([A-Z])([a-z]+)', '\\2-\\1') AS grouped FROM documents""",
)
def d2_replace_first(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    docs = columns.find_replace(
        docs, "text", "[aeiou]+", "#", count="first", n=2, output="literal"
    )
    docs = columns.find_replace(
        docs, "text", "([A-Z])([a-z]+)", "$2-$1", count="first", output="grouped"
    )
    return docs.select("doc_id", "literal", "grouped")


@query(
    "d2_lookaround",
    "SELECT doc_id, regexp_replace(text, 'e([rn])', 'e<\\1>') AS marked FROM documents",
)
def d2_lookaround(spark: SparkSession, sf: str) -> DataFrame:
    """The first match of a pattern that looks at what stands before it."""
    docs = columns.find_replace(
        documents(spark, sf), "text", "(?<=e)([rn])", "<$1>", count="first", output="marked"
    )
    return docs.select("doc_id", "marked")


@query(
    "d3_extract",
    """SELECT page_id,
              nullif(array_to_string(regexp_extract_all(html, 'href="[^"]*"'), ' '), '') AS links,
              nullif(array_to_string(regexp_extract_all(url, '[0-9]+')[1:1], '-'), '') AS number,
              nullif(array_to_string(regexp_extract_all(url, 'qqq+'), '-'), '') AS none
       FROM pages""",
)
def d3_extract(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    pages = columns.find_replace(
        pages, "html", 'href="[^"]*"', mode="extract", output="links"
    )
    pages = columns.find_replace(
        pages, "url", "[0-9]+", mode="extract", count="first", connector="-", output="number"
    )
    pages = columns.find_replace(pages, "url", "qqq+", mode="extract", output="none")
    return pages.select("page_id", "links", "number", "none")


@query(
    "d5_with_columns",
    """SELECT l_orderkey, l_linenumber, l_tax * 100 AS l_tax,
              l_extendedprice * (1 - l_discount) AS revenue,
              l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem""",
)
def d5_with_columns(spark: SparkSession, sf: str) -> DataFrame:
    items = columns.apply_expressions(
        table(spark, sf, "lineitem"),
        "with_columns",
        [
            "l_tax = l_tax * 100",
            "revenue = l_extendedprice * (1 - l_discount)",
            "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge",
        ],
    )
    return items.select("l_orderkey", "l_linenumber", "l_tax", "revenue", "charge")


@query(
    "d6_select",
    "SELECT upper(p_type) AS kind, p_size + 1 AS bigger, p_partkey FROM part",
)
def d6_select(spark: SparkSession, sf: str) -> DataFrame:
    return columns.apply_expressions(
        table(spark, sf, "part"), "select", ["kind = upper(p_type)", "bigger = p_size + 1", "p_partkey"]
    )


BUILT = {
    "label": "concat_ws(' / ', c_name, c_mktsegment)",
    "size": "round(abs(c_acctbal) + 10, 1)",
    "class": "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END",
    "segment": "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')",
    "one": "1",
}


@query(
    "d7_column_builder",
    "SELECT c_custkey, " + ", ".join(f"{v} AS {k}" for k, v in BUILT.items()) + " FROM customer",
)
def d7_column_builder(spark: SparkSession, sf: str) -> DataFrame:
    rows = columns.add_columns(
        table(spark, sf, "customer"), *[f"{name} = {rule}" for name, rule in BUILT.items()]
    )
    return rows.select("c_custkey", *BUILT)


# --- E: order, pages, samples -----------------------------------------------


@query(
    "e1_table_page",
    f"""SELECT c_custkey, segment, count(*) OVER () AS total_rows FROM {CUSTOMER_NULLS}
        ORDER BY segment DESC NULLS LAST, c_custkey LIMIT 100 OFFSET 200""",
)
def e1_table_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = customer_nulls(spark, sf).select("c_custkey", "segment")
    return sampling.table_page(rows, "c_custkey", 3, 100, "segment", descending=True)


@query(
    "e2_sort",
    f"""SELECT c_custkey, segment,
               row_number() OVER (ORDER BY segment DESC NULLS FIRST, abs(c_acctbal) ASC NULLS FIRST,
                                  c_custkey) AS place FROM {CUSTOMER_NULLS}""",
)
def e2_sort(spark: SparkSession, sf: str) -> DataFrame:
    rows = customer_nulls(spark, sf)
    order = [F.desc_nulls_first("segment"), F.asc_nulls_first(F.expr("abs(c_acctbal)")), "c_custkey"]
    return with_row_index(rows, order, "place").select("c_custkey", "segment", "place")


@query(
    "e2_sort_expressions",
    "SELECT p_partkey, p_type, p_size FROM part ORDER BY p_type, p_size * 2 DESC, p_partkey",
)
def e2_sort_expressions(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    return columns.apply_expressions(
        parts, "sort", ["p_type", "p_size * 2", "p_partkey"], descending=[False, True, False]
    )


@query("e3_slice", "SELECT * FROM part ORDER BY p_partkey LIMIT 250 OFFSET 125")
def e3_slice(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.slice_rows(table(spark, sf, "part"), ["p_partkey"], 125, 250)


@query(
    "e3_slice_open",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM "
    "(SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "l_extendedprice, l_shipdate) AS r FROM lineitem) WHERE r > 1000",
)
def e3_slice_open(spark: SparkSession, sf: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    rows = sampling.slice_rows(table(spark, sf, "lineitem").select(*order), order, 1000)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


def hashed_sql(source: str, id_col: str, seed: int, keep: str, size: str) -> str:
    return f"""SELECT {keep} FROM (
        SELECT *, row_number() OVER (ORDER BY md5('{seed}|' || CAST({id_col} AS VARCHAR))) AS r,
               count(*) OVER () AS n FROM {source}) WHERE r <= {size}"""


@query("e4_sample_fraction", hashed_sql("orders", "o_orderkey", 7, "o_orderkey, o_custkey", "floor(0.13 * n)"))
def e4_sample_fraction(spark: SparkSession, sf: str) -> DataFrame:
    rows = sampling.sample_fraction(table(spark, sf, "orders"), "o_orderkey", 0.13, seed=7)
    return rows.select("o_orderkey", "o_custkey")


@query("e5_sample_rows", hashed_sql("documents", "doc_id", 3, "doc_id, lang", "150"))
def e5_sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_rows(documents(spark, sf), "doc_id", 150, seed=3).select("doc_id", "lang")


@query(
    "e6_shuffle",
    """SELECT o_orderkey, row_number() OVER (ORDER BY md5('11|' || CAST(o_orderkey AS VARCHAR)))
              AS position FROM orders""",
)
def e6_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.shuffled(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", seed=11)


TOKEN_COUNTS = """(SELECT token, count(*) AS frequency FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents)
    GROUP BY token)"""


@query("e7_top_tokens", f"SELECT * FROM {TOKEN_COUNTS} ORDER BY frequency DESC, token LIMIT 9000")
def e7_top_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return top_tokens(token_frequencies(documents(spark, sf), "text"), 9000)


@query(
    "e8_head_tail",
    """(SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20)
       UNION
       (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC
        LIMIT 20)""",
)
def e8_head_tail(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    up = [F.asc("o_totalprice"), F.asc("o_orderkey")]
    down = [F.desc("o_totalprice"), F.desc("o_orderkey")]
    return sampling.head_and_tail(orders, up, down, 20)


@query(
    "e9_corpus_sample",
    hashed_sql("benchmark", "item_id", 42, "item_id, text", "greatest(1, floor(0.0001 * n))"),
)
def e9_corpus_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.corpus_sample(table(spark, sf, "benchmark"), "item_id", 0.0001, 42)


# --- F: joins ---------------------------------------------------------------


def order_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Whole tables with rows that match nothing on both sides."""
    left = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 3).alias("key"), F.col("s_name").alias("name"), "s_nationkey"
    )
    right = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("name"), "o_orderkey"
    )
    return left, right


SIDES = """WITH l AS (SELECT s_suppkey * 3 AS key, s_name AS name, s_nationkey FROM supplier),
     r AS (SELECT o_custkey AS cust, o_orderpriority AS name, o_orderkey FROM orders) """


@query(
    "f1_inner",
    SIDES + "SELECT l.key, l.name, l.s_nationkey, r.name AS name_right, r.o_orderkey "
    "FROM l JOIN r ON l.key = r.cust",
)
def f1_inner(spark: SparkSession, sf: str) -> DataFrame:
    return combine.join_tables(*order_sides(spark, sf), "key", "cust")


@query(
    "f1_inner_hot_keys",
    "SELECT e.event_id, e.event_type, e.user_id, t.total FROM events e "
    "JOIN (SELECT event_type AS kind, count(*) AS total FROM events GROUP BY 1) t "
    "ON e.event_type = t.kind",
)
def f1_inner_hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    totals = events.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("total"))
    return combine.join_tables(events, totals, "event_type", "kind", spread_hot_keys=True)


@query(
    "f2_left",
    SIDES + "SELECT l.key, l.name, l.s_nationkey, r.name AS name_right, r.o_orderkey "
    "FROM l LEFT JOIN r ON l.key = r.cust",
)
def f2_left(spark: SparkSession, sf: str) -> DataFrame:
    return combine.join_tables(*order_sides(spark, sf), "key", "cust", "left")


@query(
    "f3_right",
    SIDES + "SELECT l.name, l.s_nationkey, r.cust, r.name AS name_right, r.o_orderkey "
    "FROM l RIGHT JOIN r ON l.key = r.cust",
)
def f3_right(spark: SparkSession, sf: str) -> DataFrame:
    return combine.join_tables(*order_sides(spark, sf), "key", "cust", "right")


@query(
    "f4_full",
    SIDES + "SELECT l.key, l.name, l.s_nationkey, r.cust, r.name AS name_right, r.o_orderkey "
    "FROM l FULL JOIN r ON l.key = r.cust",
)
def f4_full(spark: SparkSession, sf: str) -> DataFrame:
    return combine.join_tables(*order_sides(spark, sf), "key", "cust", "full")


@query("f5_semi", SIDES + "SELECT * FROM l WHERE key IN (SELECT cust FROM r)")
def f5_semi(spark: SparkSession, sf: str) -> DataFrame:
    return combine.join_tables(*order_sides(spark, sf), "key", "cust", "semi")


@query("f6_anti", SIDES + "SELECT * FROM l WHERE key NOT IN (SELECT cust FROM r)")
def f6_anti(spark: SparkSession, sf: str) -> DataFrame:
    return combine.join_tables(*order_sides(spark, sf), "key", "cust", "anti")


@query(
    "f4_full_hot_keys",
    SIDES + "SELECT l.key, l.name, l.s_nationkey, r.cust, r.name AS name_right, r.o_orderkey "
    "FROM l FULL JOIN r ON l.key = r.cust",
)
def f4_full_hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    return combine.join_tables(*order_sides(spark, sf), "key", "cust", "full", spread_hot_keys=True)


@query("f7_cross", "SELECT r_name, n_name, n_regionkey FROM region CROSS JOIN nation")
def f7_cross(spark: SparkSession, sf: str) -> DataFrame:
    joined = combine.join_tables(
        table(spark, sf, "region"), table(spark, sf, "nation"), how="cross"
    )
    return joined.select("r_name", "n_name", "n_regionkey")


@query(
    "f8_suffix",
    """SELECT a.s_suppkey, a.s_name, a.s_nationkey, a.s_acctbal, b.s_name AS s_name_right,
              b.s_nationkey AS s_nationkey_right, b.s_acctbal AS s_acctbal_right
       FROM supplier a JOIN supplier b ON a.s_suppkey = b.s_suppkey""",
)
def f8_suffix(spark: SparkSession, sf: str) -> DataFrame:
    supplier = table(spark, sf, "supplier")
    return combine.join_tables(supplier, table(spark, sf, "supplier"), "s_suppkey", "s_suppkey")


# --- G: stacking, distinct --------------------------------------------------


def word_lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    first = documents(spark, sf).select("lang", "source")
    second = documents(spark, sf).select("source", F.upper("lang").alias("lang"))
    return first, second


@query(
    "g1_stack",
    "SELECT lang, source FROM documents UNION ALL SELECT upper(lang), source FROM documents",
)
def g1_stack(spark: SparkSession, sf: str) -> DataFrame:
    return combine.stack_tables(list(word_lists(spark, sf)))


@query(
    "g2_stack_distinct",
    "SELECT lang, source FROM documents UNION SELECT upper(lang), source FROM documents",
)
def g2_stack_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return combine.stack_tables(list(word_lists(spark, sf)), distinct=True)


@query(
    "g4_stack_counts",
    """SELECT 'documents' AS source, count(*) AS rows FROM documents UNION ALL
       SELECT 'benchmark', count(*) FROM benchmark UNION ALL
       SELECT 'stack', (SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark)""",
)
def g4_stack_counts(spark: SparkSession, sf: str) -> DataFrame:
    names = ["documents", "benchmark"]
    return combine.stack_counts([(n, table(spark, sf, n)) for n in names])


@query("g5_distinct", "SELECT DISTINCT source AS value FROM documents")
def g5_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return combine.distinct_values(documents(spark, sf), "source")


@query(
    "g5_distinct_summary",
    f"""SELECT count(*) AS unique_count, bool_or(segment IS NULL) AS has_null
        FROM (SELECT DISTINCT segment FROM {CUSTOMER_NULLS})""",
)
def g5_distinct_summary(spark: SparkSession, sf: str) -> DataFrame:
    return combine.distinct_summary(customer_nulls(spark, sf), "segment")


@query(
    "g6_distinct_elements",
    "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS value FROM documents",
)
def g6_distinct_elements(spark: SparkSession, sf: str) -> DataFrame:
    words = documents(spark, sf).select(token_words(F.col("text")).alias("words"))
    return combine.distinct_values(words, "words")


@query(
    "g6_element_summary",
    """SELECT count(*) AS unique_count, bool_or(v IS NULL) AS has_null FROM (
       SELECT DISTINCT v FROM (
         SELECT unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS v FROM (
           SELECT regexp_extract_all(text, 'ung[a-z]*') AS w FROM documents)))""",
)
def g6_element_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("ung[a-z]*"), F.lit(0))
    return combine.distinct_summary(documents(spark, sf).select(found.alias("w")), "w")


# --- H: aggregates ----------------------------------------------------------


@query(
    "h1_group",
    """SELECT l_returnflag, l_linestatus, year(l_shipdate) AS ship_year,
              round(sum(l_quantity), 4) AS sum_qty,
              CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE)
                AS revenue,
              CAST(sum(CAST(l_discount AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS avg_disc, count(DISTINCT l_suppkey) AS suppliers
       FROM lineitem GROUP BY 1, 2, 3""",
)
def h1_group(spark: SparkSession, sf: str) -> DataFrame:
    grouped = columns.apply_expressions(
        table(spark, sf, "lineitem"),
        "group_by_agg",
        [
            "sum_qty = round(sum(l_quantity), 4)",
            "revenue = CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE)",
            "avg_disc = CAST(sum(CAST(l_discount AS DECIMAL(18, 2))) AS DOUBLE) / count(*)",
            "suppliers = count(DISTINCT l_suppkey)",
        ],
        keys=["l_returnflag", "l_linestatus", "ship_year = year(l_shipdate)"],
    )
    return grouped.withColumn("ship_year", F.col("ship_year").cast("bigint"))


def describe_sql(source: str, x: str) -> str:
    def rank(q: float) -> str:
        return f"max(CASE WHEN r = CAST(round({q} * (n - 1)) AS BIGINT) + 1 THEN x END)"

    return f"""SELECT count(x) AS count, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END)::BIGINT AS
        null_count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min,
        {rank(0.25)} AS percentile_25, {rank(0.5)} AS median, {rank(0.75)} AS percentile_75,
        max(x) AS max
        FROM (SELECT x, row_number() OVER (ORDER BY x NULLS LAST) AS r, count(x) OVER () AS n
              FROM (SELECT CAST({x} AS DOUBLE) AS x FROM {source}))"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("h2_describe", describe_sql("lineitem", "nullif(l_quantity, 50)"))
def h2_describe(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.expr("nullif(l_quantity, 50)").alias("q"))
    return rounded(stats.describe(rows, "q"))


@query("h2_describe_wide", describe_sql("orders", "o_totalprice"))
def h2_describe_wide(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.describe(table(spark, sf, "orders"), "o_totalprice"))


@query(
    "h2_describe_time",
    """SELECT count(*) AS count, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS min,
              strftime(max(CASE WHEN r = CAST(round(0.5 * (n - 1)) AS BIGINT) + 1 THEN ts END),
                       '%Y-%m-%dT%H:%M:%S.%f') AS median,
              strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS max
       FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS r, count(*) OVER () AS n FROM events)""",
)
def h2_describe_time(spark: SparkSession, sf: str) -> DataFrame:
    row = stats.describe(table(spark, sf, "events"), "ts")
    plain = [F.regexp_replace(c, r"\+00:00$|Z$", "").alias(c) for c in ("min", "median", "max")]
    return row.select("count", *plain)


@query("h3_shape", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def h3_shape(spark: SparkSession, sf: str) -> DataFrame:
    return stats.shape(table(spark, sf, "lineitem"))


# --- I: windows -------------------------------------------------------------


@query("i1_row_index", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_index FROM events")
def i1_row_index(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "ts")
    return with_row_index(events, ["ts", "event_id"]).select("event_id", "row_index")


@query(
    "i2_window_expression",
    """SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step
       FROM events""",
)
def i2_window_expression(spark: SparkSession, sf: str) -> DataFrame:
    return columns.select_expressions(
        table(spark, sf, "events"),
        "event_id",
        "step = value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)",
    )


# --- J: scalar functions ----------------------------------------------------


def pick(df: DataFrame, column: str, names: dict[str, str]) -> list:
    """Functions of one column, aliased and with integers as BIGINT."""
    return [scalars.apply(df, column, f).alias(alias) for alias, f in names.items()]


@query(
    "j1_common",
    f"""SELECT count(segment) AS filled, CAST(count_if(segment IS NULL) AS BIGINT) AS empty,
               count(DISTINCT segment) + max(CASE WHEN segment IS NULL THEN 1 ELSE 0 END) AS kinds,
               CAST(count_if(segment IS NOT NULL) AS BIGINT) AS not_null
        FROM {CUSTOMER_NULLS}""",
)
def j1_common(spark: SparkSession, sf: str) -> DataFrame:
    rows = customer_nulls(spark, sf)
    row = rows.agg(
        *pick(rows, "segment", {"filled": "count", "empty": "null_count", "kinds": "n_unique"}),
        F.count_if(scalars.apply(rows, "segment", "is_not_null")).alias("not_null"),
    )
    return row.select([F.col(c).cast("bigint").alias(c) for c in row.columns])


@query("j2_unique", f"SELECT DISTINCT segment FROM {CUSTOMER_NULLS}")
def j2_unique(spark: SparkSession, sf: str) -> DataFrame:
    return scalars.unique(customer_nulls(spark, sf), "segment")


@query(
    "j3_text",
    """SELECT doc_id, lower(text) AS low, length(text) AS chars,
              strlen(text) AS bytes, md5(trim(text, E' \\t\\n\\r')) AS bare,
              regexp_replace(source || '.a+b', '([\\\\.+*?()|\\[\\]{}^$#&~-])', '\\\\\\1', 'g')
                AS escaped
       FROM documents""",
)
def j3_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).withColumn("pattern", F.concat("source", F.lit(".a+b")))
    names = {"low": "to_lowercase", "chars": "len_chars", "bytes": "len_bytes"}
    return docs.select(
        "doc_id",
        *pick(docs, "text", names),
        F.md5(scalars.apply(docs, "text", "strip_chars")).alias("bare"),
        scalars.apply(docs, "pattern", "escape_regex").alias("escaped"),
    ).withColumns({c: F.col(c).cast("bigint") for c in ("chars", "bytes")})


@query(
    "j3_names",
    """SELECT p_partkey, upper(p_name) AS up, reverse(p_name) AS back,
              array_to_string(list_transform(string_split(p_name, ' '),
                lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title,
              ltrim('  ' || p_name || ' ') AS head, rtrim('  ' || p_name || ' ') AS tail
       FROM part""",
)
def j3_names(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").withColumn(
        "padded", F.concat(F.lit("  "), "p_name", F.lit(" "))
    )
    names = {"up": "to_uppercase", "back": "reverse", "title": "to_titlecase"}
    ends = {"head": "strip_chars_start", "tail": "strip_chars_end"}
    return parts.select("p_partkey", *pick(parts, "p_name", names), *pick(parts, "padded", ends))


@query(
    "j4_number_aggregates",
    """SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean,
              round(median(o_totalprice), 6) AS middle, min(o_totalprice) AS least,
              max(o_totalprice) AS most, round(stddev_samp(o_totalprice), 6) AS std,
              round(var_samp(o_totalprice), 2) AS variance FROM orders""",
)
def j4_number_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    names = {"total": "sum", "mean": "mean", "middle": "median", "least": "min", "most": "max"}
    row = orders.agg(*pick(orders, "o_totalprice", {**names, "std": "std", "variance": "var"}))
    digits = {"total": 2, "mean": 6, "middle": 6, "std": 6, "variance": 2}
    return row.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "j4_numbers",
    """SELECT c_custkey, abs(c_acctbal) AS size, round(sqrt(abs(c_acctbal)), 6) AS root,
              round(exp(c_acctbal / 10000), 6) AS grown,
              CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS logged,
              CAST(floor(c_acctbal) AS BIGINT) AS low, CAST(ceil(c_acctbal) AS BIGINT) AS high,
              round(c_acctbal) AS near,
              c_acctbal < 0 AS bad_root
       FROM customer""",
)
def j4_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").withColumns(
        {"small": F.col("c_acctbal") / 10000, "size": F.abs("c_acctbal")}
    )
    logged = scalars.apply(rows, "c_acctbal", "log")
    roots = rows.withColumn("root", scalars.apply(rows, "c_acctbal", "sqrt"))
    return roots.select(
        "c_custkey",
        scalars.apply(rows, "c_acctbal", "abs").alias("size"),
        F.round(scalars.apply(rows, "size", "sqrt"), 6).alias("root"),
        F.round(scalars.apply(rows, "small", "exp"), 6).alias("grown"),
        F.when(F.col("c_acctbal") > 0, F.round(logged, 6)).alias("logged"),
        scalars.apply(rows, "c_acctbal", "floor").alias("low"),
        scalars.apply(rows, "c_acctbal", "ceil").alias("high"),
        scalars.apply(rows, "c_acctbal", "round").alias("near"),
        scalars.apply(roots, "root", "is_nan").alias("bad_root"),
    )


TIME_PARTS = {
    "year": "year(ts)",
    "month": "month(ts)",
    "day": "day(ts)",
    "hour": "hour(ts)",
    "minute": "minute(ts)",
    "second": "second(ts)",
    "millisecond": "(microsecond(ts) % 1000000) // 1000",
    "microsecond": "microsecond(ts) % 1000000",
    "nanosecond": "(microsecond(ts) % 1000000) * 1000",
    "ordinal_day": "dayofyear(ts)",
    "quarter": "quarter(ts)",
    "week": "week(ts)",
    "weekday": "isodow(ts)",
    "iso_year": "isoyear(ts)",
}


@query(
    "j5_time_parts",
    "SELECT event_id, "
    + ", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in TIME_PARTS.items())
    + ", CAST(ts AS DATE) AS date, strftime(ts, '%H:%M:%S.%f') AS time FROM events",
)
def j5_time_parts(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    parts = [scalars.apply(events, "ts", p).cast("bigint").alias(p) for p in TIME_PARTS]
    return events.select("event_id", *parts, *pick(events, "ts", {"date": "date", "time": "time"}))


@query(
    "j6_booleans",
    "SELECT CAST(count_if(toxic = 1) AS BIGINT) AS toxic, round(avg(quality), 6) AS quality FROM labels",
)
def j6_booleans(spark: SparkSession, sf: str) -> DataFrame:
    flags = table(spark, sf, "labels").select(
        (F.col("toxic") == 1).alias("toxic"), (F.col("quality") == 1).alias("quality")
    )
    return flags.agg(
        scalars.apply(flags, "toxic", "sum").alias("toxic"),
        F.round(scalars.apply(flags, "quality", "mean"), 6).alias("quality"),
    )


@query(
    "j7_lists",
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS w FROM documents)
       SELECT doc_id, len(w) AS len, w[1] AS first, w[-1] AS last,
              array_to_string(list_reverse(w), ' ') AS back,
              len(list_distinct(w)) AS kinds, array_to_string(list_sort(w), ' ') AS sorted FROM w""",
)
def j7_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select(
        "doc_id", F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)).alias("w")
    )
    return rows.select(
        "doc_id",
        scalars.apply(rows, "w", "len").cast("bigint").alias("len"),
        *pick(rows, "w", {"first": "first", "last": "last"}),
        F.array_join(scalars.apply(rows, "w", "reverse"), " ").alias("back"),
        F.size(scalars.apply(rows, "w", "unique")).cast("bigint").alias("kinds"),
        F.array_join(scalars.apply(rows, "w", "sort"), " ").alias("sorted"),
    )


@query(
    "j8_function_table",
    """SELECT 'user_id' AS "column", 'numeric' AS family, count(user_id) AS filled FROM events
       UNION ALL SELECT 'event_type', 'string', count(event_type) FROM events
       UNION ALL SELECT 'ts', 'datetime', count(ts) FROM events
       UNION ALL SELECT 'big', 'boolean', count(value) FROM events
       UNION ALL SELECT 'words', 'list', count(props) FROM events""",
)
def j8_function_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        "user_id",
        "event_type",
        "ts",
        (F.col("value") > 50).alias("big"),
        F.split("props", " ").alias("words"),
    )
    counts = rows.agg(*[scalars.apply(rows, c, "count").alias(c) for c in rows.columns])
    filled = counts.unpivot([], rows.columns, "column", "filled")
    families = scalars.function_table(rows).select("column", "family").distinct()
    return families.join(filled, "column")
