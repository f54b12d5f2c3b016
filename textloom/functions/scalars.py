"""Named column functions per type family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.schema import col

Function = Callable[[Column], Column]


def _distinct_with_null(c: Column) -> Column:
    return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def _micro_of_second(c: Column) -> Column:
    return F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000))


def _strip(pattern: str) -> Function:
    return lambda c: F.regexp_replace(c, pattern, "")


# Aggregates and predicates every family has.
COMMON: dict[str, Function] = {
    "is_null": lambda c: c.isNull(),
    "is_not_null": lambda c: c.isNotNull(),
    "count": F.count,
    "null_count": lambda c: F.count_if(c.isNull()),
    "n_unique": _distinct_with_null,
}
STRING: dict[str, Function] = {
    "len": lambda c: F.count(F.lit(1)),
    "to_lowercase": F.lower,
    "to_uppercase": F.upper,
    "to_titlecase": F.initcap,
    "strip_chars": _strip(r"(?U)^\s+|\s+$"),
    "strip_chars_start": _strip(r"(?U)^\s+"),
    "strip_chars_end": _strip(r"(?U)\s+$"),
    "len_chars": F.length,
    "len_bytes": F.octet_length,
    "reverse": F.reverse,
    "escape_regex": lambda c: F.regexp_replace(c, r"([\\.+*?()|\[\]{}^$#&~-])", r"\\$1"),
}
NUMERIC: dict[str, Function] = {
    "sum": F.sum,
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "abs": F.abs,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "log": lambda c: F.when(c > 0, F.ln(c))
    .when(c == 0, F.lit(float("-inf")))
    .when(c < 0, F.lit(float("nan"))),
    "floor": F.floor,
    "ceil": F.ceil,
    "round": F.round,
    "is_nan": F.isnan,
    "is_not_nan": lambda c: ~F.isnan(c),
}
DATETIME: dict[str, Function] = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "millisecond": lambda c: F.floor(_micro_of_second(c) / 1000),
    "microsecond": _micro_of_second,
    "nanosecond": lambda c: _micro_of_second(c) * 1000,
    "date": F.to_date,
    "time": lambda c: F.date_format(c, "HH:mm:ss.SSSSSS"),
    "ordinal_day": F.dayofyear,
    "quarter": F.quarter,
    "week": F.weekofyear,
    "weekday": lambda c: F.weekday(c) + 1,
    "iso_year": lambda c: F.extract(F.lit("YEAROFWEEK"), c),
}
BOOLEAN: dict[str, Function] = {
    "sum": F.count_if,
    "mean": lambda c: F.avg(c.cast("int")),
}
LIST: dict[str, Function] = {
    "len": F.size,
    "first": lambda c: F.try_element_at(c, F.lit(1)),
    "last": lambda c: F.try_element_at(c, F.lit(-1)),
    "reverse": F.reverse,
    "unique": F.array_distinct,
    "sort": F.sort_array,
}
FAMILIES = {
    "string": {**COMMON, **STRING},
    "numeric": {**COMMON, **NUMERIC},
    "datetime": {**COMMON, **DATETIME},
    "boolean": {**COMMON, **BOOLEAN},
    "list": {**COMMON, **LIST},
}


def family(data_type: T.DataType) -> str:
    """The function family of a type; types without one of their own act as text."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(
        data_type,
        (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType),
    ):
        return "datetime"
    if isinstance(data_type, T.ArrayType):
        return "list"
    return "numeric" if isinstance(data_type, T.NumericType) else "string"


def apply(df: DataFrame, column: str, function: str) -> Column:
    """The named function of the column's family, as an expression."""
    known = FAMILIES[family(df.schema[column].dataType)]
    if function not in known:
        raise ValueError(f"{function!r} does not suit column {column!r}; use {sorted(known)}")
    return known[function](col(column))


def unique(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, null included."""
    return df.select(col(column)).distinct()


def function_table(df: DataFrame) -> DataFrame:
    """The functions on offer for every column."""
    rows = [
        (f.name, family(f.dataType), name)
        for f in df.schema.fields
        for name in FAMILIES[family(f.dataType)]
    ]
    return df.sparkSession.createDataFrame(rows, "column string, family string, function string")
