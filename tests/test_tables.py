from __future__ import annotations

import datetime as dt
import math
import random
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import scalars
from textloom.operators import columns, combine, predicates, ranks, sampling, schema, stats
from textloom.sources import readers, writers


def where(column, operator, value=None, **more):
    return {"column": column, "operator": operator, "value": value, **more}


# --- sources ----------------------------------------------------------------


def test_formats():
    known = {"a.CSV": "csv", "b.jsonl": "jsonl", "c.md": "text", "d.xlsx": "excel", "e.zip": "zip"}
    for name, kind in known.items():
        assert readers.detect_format(name) == kind
    assert readers.detect_format("noext") == readers.detect_format("a.bin") == "unknown"


def test_load_people(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('name,age,city\nAlice,25,"New\nYork"\nBob,30,"say ""hi"""\nZoë,,CafÃ©\n')
    df = readers.load(spark, str(path), multiline=True)
    assert rows(df) == [("Alice", 25, "New\nYork"), ("Bob", 30, 'say "hi"'), ("Zoë", None, "Café")]
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path / "x.xlsx"))


def test_round_trips(spark, tmp_path):
    data = [(1, "a,\n\"b\"", [1, 2], None), (2, "é", [], 2.5)]
    df = spark.createDataFrame(data, "i bigint, t string, l array<int>, d double")
    for fmt, extension in (("json", "json"), ("ndjson", "jsonl"), ("parquet", "parquet")):
        path = str(tmp_path / f"t.{extension}")
        writers.write_table(df.repartition(2), path, fmt)
        back = readers.load(spark, path).select("i", "t", F.col("l").cast("array<int>"), "d")
        assert rows(back) == rows(df)
    writers.write_table(df, str(tmp_path / "t.csv"), "csv")
    assert ("1", 'a,\n"b"', "[1,2]", None) in rows(
        readers.read_csv(spark, str(tmp_path / "t.csv"), schema="i string, t string, l string, d string", multiline=True)
    )
    with pytest.raises(ValueError):
        writers.write_table(df, "x", "xlsx")


def test_json_array_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none.json")
    writers.write_table(spark.createDataFrame([], "a int"), path, "json")
    assert readers.read_json(spark, path, "a int").count() == 0


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\ntwo\n\nvier ü".encode())
    assert [r[0] for r in readers.load(spark, str(tmp_path / "a.txt")).collect()] == [
        "one",
        "two",
        "",
        "vier ü",
    ]


def test_archives(spark, tmp_path):
    for n in range(3):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            z.writestr(f"d{n}/a.txt", "hé")
            z.writestr(f"d{n}/b.PNG", "no")
            z.writestr(f"d{n}/README", "plain")
            z.writestr(f"__MACOSX/d{n}/a.txt", "no")
            z.writestr(f"d{n}/._a.txt", "no")
            z.writestr(f"d{n}/bad.md", b"\xff\xfeok")
    path = str(tmp_path / "*.zip")
    df = readers.read_archives(spark, path)
    assert df.count() == 9
    assert rows(df.filter("file_path LIKE 'd0/%'"), "file_path") == [
        ("d0/README", "README", "", "plain"),
        ("d0/a.txt", "a", ".txt", "hé"),
        ("d0/bad.md", "bad", ".md", "ok"),
    ]
    assert readers.read_archives(spark, path, errors="strict").count() == 6
    only = readers.read_archives(spark, path, extensions=["MD"], extensionless=False)
    assert only.count() == 3


def test_preview_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "i int, t string")
    assert rows(readers.preview(df, ["i"], 0, 1)) == [("1", "None")]
    with pytest.raises(ValueError):
        readers.preview(df, ["i"], 0, 0)
    paths = writers.export_tables([("a/b", df), ("a/b", df), (None, df)], str(tmp_path), "ndjson")
    assert list(paths) == ["a_b", "a_b_1", "table_2"]
    with pytest.raises(ValueError):
        writers.export_tables([], str(tmp_path), "pdf")


# --- types ------------------------------------------------------------------


def test_normalise_types(spark):
    df = spark.sql(
        "SELECT 1Y AS a, 2S AS b, 3 AS c, 4L AS d, 1.5F AS e, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS f,"
        " 'x' AS g, DATE '2024-01-01' AS h"
    )
    out, changes = schema.normalise_types(df)
    assert [t for _, t in out.dtypes] == [
        "bigint", "bigint", "bigint", "bigint", "double", "timestamp", "string", "date",
    ]
    assert [c["column"] for c in changes] == ["a", "b", "c", "e", "f"]
    same, none = schema.normalise_types(out)
    assert none == [] and same is out


def test_casts(spark):
    df = spark.createDataFrame([("2024-01-01T10:30:15", "1.5"), ("bad", "x"), ("2024-01-01T10:30:15+02:00", "3")], "t string, n string")
    cast = schema.cast_column(schema.cast_column(df, "t", "datetime"), "n", "float")
    text = cast.select(F.date_format("t", "HH:mm"), "n").collect()
    assert [tuple(r) for r in text] == [("10:30", 1.5), (None, None), ("08:30", 3.0)]
    assert [r[0] for r in schema.cast_column(df, "n", "integer").select("n").collect()] == [None, None, 3]
    for target, column in (("float", "n"), ("datetime", "t")):
        with pytest.raises(Exception, match="CAST_INVALID|CANNOT_PARSE|malformed"):
            schema.cast_column(df, column, target, strict=True).collect()
    with pytest.raises(ValueError):
        schema.cast_column(df, "n", "blob")
    assert schema.spark_pattern("%Y-%m-%dT%H:%M:%S%z") == "yyyy-MM-dd'T'HH:mm:ssxx"


def test_logical_types(spark):
    df = spark.sql(
        "SELECT 1 a, 1.5D b, true c, 'x' d, current_timestamp() e, array('x') f, array(1) g,"
        " struct(1) h, CAST(NULL AS array<struct<provider:string,annotation:string>>) i, 1.5BD j"
    )
    families = {r["column"]: r["family"] for r in schema.logical_types(df).collect()}
    assert families == {
        "a": "integer", "b": "float", "c": "boolean", "d": "string", "e": "datetime",
        "f": "list_string", "g": "unknown", "h": "object", "i": "annotation", "j": "unknown",
    }
    schema.check_axis_type(df, "j", "numeric")
    for column, axis in (("d", "numeric"), ("a", "datetime")):
        with pytest.raises(ValueError):
            schema.check_axis_type(df, column, axis)


def test_rename_and_drop(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        schema.rename_column(df, "a", "b")
    with pytest.raises(ValueError):
        schema.drop_column(df, "z")


# --- filters ----------------------------------------------------------------


def test_in_with_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None)], "v int, c string")

    def kept(*tests, logic="and"):
        return [r["v"] for r in predicates.filter_rows(df, tests, logic).orderBy("v").collect()]

    assert kept(where("c", "in", ["a", None])) == [1, 2, 4]
    assert kept(where("c", "in", None)) == [2, 4]
    assert kept(where("c", "in", "b")) == [3]
    assert kept(where("c", "in", ["a"], negate=True)) == [3]
    assert kept(where("c", "eq", "a"), where("v", "gte", "3"), logic="or") == [1, 3, 4]
    with pytest.raises(ValueError):
        kept(where("c", "in", []))
    with pytest.raises(ValueError):
        kept()


def test_in_list_column(spark):
    df = spark.createDataFrame(
        [(1, ["a", "b"]), (2, ["c"]), (3, None), (4, []), (5, [None, "a"])], "v int, l array<string>"
    )
    kept = predicates.filter_rows(df, [where("l", "in", ["a", "z"])])
    assert [r["v"] for r in kept.orderBy("v").collect()] == [1, 5]
    assert predicates.filter_rows(df, [where("l", "in", [])]).count() == 0
    assert predicates.filter_rows(df, [where("l", "in", ["a"], negate=True)]).count() == 3


def test_time_literals(spark):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ '2024-01-01 10:00:00' n, TIMESTAMP '2024-01-01 10:00:00Z' z, DATE '2024-01-01' d"
    )
    for test in (
        where("n", "eq", "2024-01-01T10:00:00+05:00"),
        where("z", "eq", "2024-01-01T12:00:00+02:00"),
        where("z", "eq", dt.datetime(2024, 1, 1, 10)),
        where("d", "eq", "2024-01-01T23:00:00Z"),
        where("n", "between", {"start": "2024-01-01"}),
    ):
        assert predicates.filter_rows(df, [test]).count() == 1, test


# --- columns ----------------------------------------------------------------


def test_find_replace(spark):
    df = spark.createDataFrame([("Invoice 123-45",), ("Order",), (None,)], "Body string")

    def out(**options):
        result = columns.find_replace(df, "Body", output="x", **options)
        return [r["x"] for r in result.collect()]

    assert out(pattern=r"\d+", replacement="#") == ["Invoice #-#", "Order", None]
    assert out(pattern=r"\d+", replacement="#", count="first") == ["Invoice #-45", "Order", None]
    assert out(pattern=r"(\d)(\d)", replacement="${2}$1", count="first", n=2) == [
        "Invoice 213-54",
        "Order",
        None,
    ]
    assert out(pattern=r"\d", replacement=r"\$$") == ["Invoice \\$\\$\\$-\\$\\$", "Order", None]
    assert out(pattern=r"\d+", mode="extract", connector="+") == ["123+45", None, None]
    assert out(pattern=r"\d+", mode="extract", count="first") == ["123", None, None]
    assert columns.output_name("  a \n b ") == "a b"
    assert columns.output_name("", "") == "computed_column"
    assert len(columns.output_name("x" * 300)) == 120


def test_expressions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    out = columns.apply_expressions(df, "with_columns", ["i = i * 10", "u = upper(t)", "i + 1"])
    assert out.columns == ["t", "i", "u", "(i + 1)"]
    assert rows(out) == [("a", 10, "A", 2), ("b", 20, "B", 3)]
    assert columns.apply_expressions(df, "filter", ["t == 'a' OR i = 5"]).count() == 1
    with pytest.raises(ValueError):
        columns.apply_expressions(df, "pivot", ["x"])


# --- samples ----------------------------------------------------------------


def test_samples_are_exact_and_seeded(spark):
    df = spark.range(0, 3000, numPartitions=6).withColumn("x", F.col("id") * 2)
    a = sampling.sample_fraction(df, "id", 0.1, seed=5)
    assert a.count() == 300
    assert rows(a) == rows(sampling.sample_fraction(df, "id", 0.1, seed=5))
    assert rows(a) != rows(sampling.sample_fraction(df, "id", 0.1, seed=6))
    assert sampling.sample_rows(df, "id", 17, 1).count() == 17
    assert sampling.sample_rows(df, "id", 9999, 1).count() == 3000
    assert sampling.sample_fraction(df, "id", 0.0001).count() == 0
    assert sampling.corpus_sample(df, "id", 0.0001, 3).count() == 1
    assert sampling.corpus_sample(df, "id", 1.0, 3) is df
    mixed = sampling.shuffled(df, "id", 3)
    assert [r["position"] for r in mixed.orderBy("position").collect()] == list(range(1, 3001))
    assert mixed.orderBy("position").first()["id"] != 0


def test_slices(spark):
    df = spark.range(0, 500, numPartitions=5)
    near = sampling.slice_rows(df, ["id"], 100, 50)
    assert sorted(r[0] for r in near.collect()) == list(range(100, 150))
    assert sampling.slice_rows(df, ["id"], 480).count() == 20
    with pytest.raises(ValueError):
        sampling.slice_rows(df, ["id"], -1)


def test_row_index_with_uneven_partitions(spark):
    df = spark.range(0, 2000).select(F.when(F.col("id") < 700, 5).otherwise(F.col("id") % 13).alias("k"), "id")
    got = ranks.with_row_index(df, ["k", "id"]).orderBy("row_index").collect()
    assert [r["row_index"] for r in got] == list(range(1, 2001))
    assert [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)


# --- joins ------------------------------------------------------------------


def test_join_kinds(spark):
    left = spark.createDataFrame([(1, "a", 9), (2, "b", 8), (None, "n", 7)], "k int, v string, x int")
    right = spark.createDataFrame([(1, "A"), (1, "AA"), (3, "C"), (None, "N")], "k int, v string")

    def join(how, **more):
        out = combine.join_tables(left, right, "k", "k", how, **more)
        return out.columns, rows(out)

    assert join("inner") == (["k", "v", "x", "v_right"], [(1, "a", 9, "A"), (1, "a", 9, "AA")])
    assert join("inner", spread_hot_keys=True) == join("inner")
    for how in ("left", "right", "full"):
        assert join(how, spread_hot_keys=True) == join(how)
    named = left.withColumnRenamed("x", "v_right")
    with pytest.raises(ValueError, match="v_right"):
        combine.join_tables(named, right, "k", "k")
    assert len(join("left")[1]) == 4
    assert join("right")[0] == ["v", "x", "k", "v_right"] and len(join("right")[1]) == 4
    assert join("full")[0] == ["k", "v", "x", "k_right", "v_right"] and len(join("full")[1]) == 6
    assert join("semi") == (["k", "v", "x"], [(1, "a", 9)])
    assert len(join("anti")[1]) == 2
    assert combine.join_tables(left, right, how="cross").count() == 12
    with pytest.raises(ValueError):
        join("asof")
    with pytest.raises(ValueError):
        combine.join_tables(left, right, how="inner")


def test_hot_keys_are_spread(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k2"), (F.col("id") * 3).alias("w"))
    salts = ranks.salted_join(left, right, "k", "k2", "left")
    assert salts.count() == 3000
    for how in ("inner", "left", "right", "full"):
        salted = combine.join_tables(left, right, "k", "k2", how, spread_hot_keys=True)
        assert rows(salted) == rows(combine.join_tables(left, right, "k", "k2", how))


def test_stacking(spark):
    a = spark.createDataFrame([(1, "x")], "i int, t string")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "t string, i int")
    assert rows(combine.stack_tables([a, b])) == [(1, "x"), (1, "x"), (2, "y")]
    assert combine.stack_tables([a, b], distinct=True).count() == 2
    c = spark.createDataFrame([(1.0, 2)], "i double, z int")
    report = [(r["column"], r["problem"]) for r in combine.schema_differences([a, c])]
    assert report == [("i", "type"), ("t", "missing"), ("z", "unexpected")]
    with pytest.raises(ValueError, match="missing t"):
        combine.stack_tables([a, c])
    with pytest.raises(ValueError):
        combine.stack_tables([a])


def test_distinct_list_elements(spark):
    df = spark.createDataFrame([(["a", "b"],), (["b", "c"],), (None,), ([],), (["d"],)], "l array<string>")
    assert rows(combine.distinct_values(df, "l")) == [("a",), ("b",), ("c",), ("d",)]
    assert tuple(combine.distinct_summary(df, "l").first()) == (5, True)


# --- statistics -------------------------------------------------------------


def nearest(values, q):
    ordered = sorted(values)
    return ordered[math.floor(q * (len(ordered) - 1) + 0.5)]


@pytest.mark.parametrize("kind", ["even", "hot", "two", "heavy", "one"])
def test_quantiles(spark, kind):
    rng = random.Random(2)
    values = {
        "even": [rng.random() for _ in range(2000)],
        "hot": [1.0] * 1500 + [rng.random() * 9 for _ in range(700)],
        "two": [1.0, 2.0] * 800,
        "heavy": [rng.paretovariate(0.3) for _ in range(2000)],
        "one": [4.5],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    points = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)
    assert stats.exact_quantiles(df, "x", points) == [nearest(values, q) for q in points]


def test_describe(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (4, "b")], "n int, t string")
    row = stats.describe(df, "n").first()
    assert (row["count"], row["null_count"], row["min"], row["median"], row["max"]) == (3, 1, 1, 2, 4)
    assert stats.describe(df, "n", exact=False).first()["max"] == 4
    text = stats.describe(df, "t").first()
    assert (text["count"], text["mean"], text["median"], text["max"]) == (3, None, None, "b")
    empty = stats.describe(df.filter("n > 9"), "n").first()
    assert empty["count"] == 0 and empty["median"] is None


# --- scalars ----------------------------------------------------------------


def test_functions(spark):
    df = spark.createDataFrame(
        [(-1.0, " Ab ", [2, 1, 2]), (0.0, None, [])], "n double, t string, l array<int>"
    )

    def values(column, function):
        return [r[0] for r in df.select(scalars.apply(df, column, function)).collect()]

    assert math.isnan(values("n", "log")[0]) and values("n", "log")[1] == -math.inf
    assert math.isnan(values("n", "sqrt")[0])
    assert values("t", "strip_chars") == ["Ab", None]
    assert values("l", "first") == [2, None] and values("l", "unique") == [[2, 1], []]
    assert df.agg(scalars.apply(df, "t", "n_unique")).first()[0] == 2
    with pytest.raises(ValueError):
        scalars.apply(df, "t", "sqrt")
    assert scalars.family(T.DateType()) == "datetime" and scalars.family(T.BinaryType()) == "string"


def test_format_column(spark):
    names = ["a.CSV", "x/.hidden", "x.d/noext", "dir.csv/", "a.tar.gz", "b.JSONL", ".x.md", "", "a.", "p/q.xlsx", None]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r[1] for r in rows.select("name", readers.format_of(F.col("name"))).collect()]
    assert got == [None if n is None else readers.detect_format(n) for n in names]


def test_axis_and_schema_reports(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), None, "x"), (None, 2.0, None, "y"), (3, float("inf"), None, None)],
        "`a.b` int, v double, t timestamp, s string",
    )
    want = {("a.b", "numeric", 2), ("v", "numeric", 1), ("t", "datetime", 0)}
    assert {tuple(r) for r in schema.axis_report(df).collect()} == want
    assert schema.axis_report(df.select("s")).count() == 0
    assert {r.filled for r in schema.axis_report(df.filter("false")).collect()} == {0}
    assert combine.schema_report([df, df]).count() == 0
    other = df.select("v", F.col("t").cast("string").alias("t"), "s", F.lit("z").alias("a"))
    got = {tuple(r) for r in combine.schema_report([df, df, other]).collect()}
    assert got == {
        ("3", "a.b", "missing", "int", 2), ("3", "t", "type", "timestamp vs string", 0),
        ("3", "a", "unexpected", "string", 3),
    }
