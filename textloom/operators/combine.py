"""Joins, stacking and distinct values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.ranks import salted_join
from textloom.operators.schema import col

JOINS = {
    "inner": "inner",
    "left": "left",
    "right": "right",
    "full": "full",
    "semi": "left_semi",
    "anti": "left_anti",
    "cross": "cross",
}
SUFFIX = "_right"


def join_tables(
    left: DataFrame,
    right: DataFrame,
    left_on: str | None = None,
    right_on: str | None = None,
    how: str = "inner",
    spread_hot_keys: bool = False,
) -> DataFrame:
    """Equi-join on one pair of keys; colliding right columns get a suffix.

    Inner and left joins keep the left key, right joins the right key, full
    joins both. Names that still collide are refused. ``spread_hot_keys`` salts
    joins whose keys are very uneven; otherwise adaptive execution splits the
    hot partitions of all but full joins.
    """
    if how not in JOINS:
        raise ValueError(f"join type {how!r}; use one of {sorted(JOINS)}")
    if how != "cross" and not (left_on and right_on):
        raise ValueError("both keys are needed")
    if how in ("semi", "anti"):
        keys = right.select(col(right_on).alias("__key")).distinct()
        return left.join(keys, col(left_on) == F.col("__key"), JOINS[how])

    l_drop, r_drop = set(), set()
    if how in ("inner", "left"):
        r_drop = {right_on}
    elif how == "right":
        l_drop = {left_on}
    l_kept = [c for c in left.columns if c not in l_drop]
    r_kept = [c for c in right.columns if c not in r_drop]
    names = {c: (c + SUFFIX if c in l_kept else c) for c in r_kept}
    taken = [*l_kept, *names.values()]
    double = sorted({c for c in taken if taken.count(c) > 1})
    if double:
        raise ValueError(f"the join would give two columns named {', '.join(double)}")
    metadata = {f.name: f.metadata for f in (*left.schema.fields, *right.schema.fields)}

    l_side = left.select(*[col(c).alias(f"l__{c}") for c in left.columns])
    r_side = right.select(*[col(c).alias(f"r__{c}") for c in right.columns])
    if how == "cross":
        joined = l_side.crossJoin(r_side)
    elif spread_hot_keys:
        joined = salted_join(l_side, r_side, f"l__{left_on}", f"r__{right_on}", how)
    else:
        joined = l_side.join(r_side, col(f"l__{left_on}") == col(f"r__{right_on}"), JOINS[how])
    return joined.select(
        *[col(f"l__{c}").alias(c, metadata=metadata[c]) for c in l_kept],
        *[col(f"r__{c}").alias(names[c], metadata=metadata[c]) for c in r_kept],
    )


def schema_differences(tables: list[DataFrame]) -> list[dict[str, str]]:
    """How the tables after the first differ from it: missing, unexpected, type."""
    base = {f.name: f.dataType.simpleString() for f in tables[0].schema.fields}
    report = []
    for number, table in enumerate(tables[1:], start=2):
        other = {f.name: f.dataType.simpleString() for f in table.schema.fields}
        for name in sorted(base.keys() | other.keys()):
            if name not in other:
                problem, detail = "missing", base[name]
            elif name not in base:
                problem, detail = "unexpected", other[name]
            elif base[name] != other[name]:
                problem, detail = "type", f"{base[name]} vs {other[name]}"
            else:
                continue
            report.append(
                {"table": str(number), "column": name, "problem": problem, "detail": detail}
            )
    return report


def schema_report(tables: list[DataFrame]) -> DataFrame:
    """``schema_differences`` as a table, with the values each difference concerns.

    ``filled`` counts the non-null values of the column: in the first table if
    the other lacks it, else in the other one. Each table is read once, and
    only its columns that differ.
    """
    schema = "`table` string, `column` string, problem string, detail string"
    spark = tables[0].sparkSession
    report = schema_differences(tables)
    if not report:
        return spark.createDataFrame([], schema + ", filled bigint")
    parts = []
    for number in range(len(tables)):
        own = [
            r for r in report
            if (0 if r["problem"] == "missing" else int(r["table"]) - 1) == number
        ]
        if own:
            rows = [
                F.struct(
                    *[F.lit(r[k]).alias(k) for k in ("table", "column", "problem", "detail")],
                    F.count(col(r["column"])).alias("filled"),
                )
                for r in own
            ]
            parts.append(tables[number].agg(F.array(*rows).alias("rows")).select(F.inline("rows")))
    return reduce(lambda a, b: a.unionAll(b), parts)


def stack_tables(tables: list[DataFrame], distinct: bool = False) -> DataFrame:
    """Rows of all tables, columns in the order of the first."""
    if len(tables) < 2:
        raise ValueError("stacking needs at least two tables")
    report = schema_differences(tables)
    if report:
        lines = [f"table {r['table']}: {r['problem']} {r['column']} ({r['detail']})" for r in report]
        raise ValueError("schemas differ: " + "; ".join(lines))
    stacked = reduce(lambda a, b: a.unionByName(b), tables)
    return stacked.distinct() if distinct else stacked


def stack_counts(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Row count of every input and of the stack."""
    counts = reduce(
        lambda a, b: a.unionByName(b),
        [
            t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows")
            for name, t in tables
        ],
    )
    total = counts.agg(F.sum("rows").cast("bigint").alias("rows"))
    return counts.unionByName(total.select(F.lit("stack").alias("source"), "rows"))


def _values(df: DataFrame, column: str) -> DataFrame:
    value = col(column)
    data_type = df.schema[column].dataType
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StringType):
        value = F.explode_outer(value)
    return df.select(value.alias("value")).distinct()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column, or of the elements of a list column."""
    return _values(df, column).filter(F.col("value").isNotNull())


def distinct_summary(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct values, null counting as one, and whether it occurs."""
    return _values(df, column).agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.coalesce(F.bool_or(F.col("value").isNull()), F.lit(False)).alias("has_null"),
    )
