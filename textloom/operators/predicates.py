"""Filters built from plain condition records."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.schema import col

COMPARISONS = {
    "eq": lambda c, v: c == v,
    "equals": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "greater_than": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "less_than": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def literal(value: Any, data_type: T.DataType) -> Column:
    """A literal of the column's own type.

    Texts become booleans, numbers or times only where the column asks for
    them. Times without a zone are UTC; a zone is dropped for columns without
    one, the time of day for dates.
    """
    if isinstance(data_type, TEMPORAL):
        return _temporal(value, data_type)
    if isinstance(value, str):
        if isinstance(data_type, T.BooleanType):
            if value.lower() not in ("true", "false"):
                raise ValueError(f"{value!r} is not a boolean")
            return F.lit(value.lower() == "true")
        if isinstance(data_type, T.NumericType):
            return F.lit(float(value) if re.search(r"[.eE]", value) else int(value))
    return F.lit(value)


def _temporal(value: Any, data_type: T.DataType) -> Column:
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if isinstance(value, date) and not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if isinstance(data_type, T.DateType):
        return F.lit(value.date())
    wall = value.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(data_type, T.TimestampNTZType):
        return F.lit(wall).cast("timestamp_ntz")
    zone = value.strftime("%:z") if value.tzinfo else "+00:00"
    return F.lit(wall + zone).cast("timestamp")


def _membership(column: Column, value: Any, data_type: T.DataType) -> Column | None:
    if isinstance(value, (list, tuple, set)):
        wanted = [v for v in value if v is not None]
        with_null = len(wanted) < len(value)
    else:
        wanted, with_null = ([], True) if value is None else ([value], False)
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StringType):
        if not wanted:
            return F.lit(False)
        texts = F.array(*[F.lit(str(v)) for v in wanted])
        return F.coalesce(F.arrays_overlap(F.array_compact(column), texts), F.lit(False))
    if not wanted:
        return column.isNull() if with_null else None
    match = column.isin([literal(v, data_type) for v in wanted])
    return match | column.isNull() if with_null else match


def _contains(column: Column, text: str, regex: bool, case_sensitive: bool) -> Column:
    if regex:
        return column.rlike(("(?U)" if case_sensitive else "(?i)(?U)") + text)
    if case_sensitive:
        return column.contains(F.lit(text))
    return F.lower(column).contains(F.lit(text.lower()))


def _between(column: Column, bounds: Any, data_type: T.DataType) -> Column:
    limits = bounds if isinstance(bounds, dict) else {}
    tests = []
    if limits.get("start") is not None:
        tests.append(column >= literal(limits["start"], data_type))
    if limits.get("end") is not None:
        tests.append(column <= literal(limits["end"], data_type))
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def condition(spec: dict[str, Any], schema: T.StructType) -> Column | None:
    """One predicate. Keys: column, operator, value, negate, regex, case_sensitive."""
    name, op, value = spec["column"], spec.get("operator", "eq"), spec.get("value")
    column, data_type = col(name), schema[name].dataType
    if op in COMPARISONS:
        test = COMPARISONS[op](column, literal(value, data_type))
    elif op == "in":
        test = _membership(column, value, data_type)
    elif op == "contains":
        test = _contains(
            column, str(value), bool(spec.get("regex")), bool(spec.get("case_sensitive"))
        )
    elif op == "startswith":
        test = column.startswith(F.lit(str(value)))
    elif op == "endswith":
        test = column.endswith(F.lit(str(value)))
    elif op == "is_null":
        test = column.isNull()
    elif op == "is_not_null":
        test = column.isNotNull()
    elif op == "between":
        test = _between(column, value, data_type)
    else:
        test = column.rlike("(?U)" + str(value))
    return ~test if test is not None and spec.get("negate") else test


def filter_rows(
    df: DataFrame, conditions: Iterable[dict[str, Any]], logic: str = "and"
) -> DataFrame:
    """Keep the rows that meet all (``and``) or any (``or``) of the conditions."""
    tests = [t for t in (condition(c, df.schema) for c in conditions) if t is not None]
    if not tests:
        raise ValueError("no valid filter conditions")
    either = logic.lower() == "or"
    return df.filter(reduce((lambda a, b: a | b) if either else (lambda a, b: a & b), tests))


def quick_filter(df: DataFrame, column: str, value: str, op: str = "contains") -> DataFrame:
    """The one-box filter of a table view; other than text columns are not filtered."""
    if column not in df.columns or not isinstance(df.schema[column].dataType, T.StringType):
        return df
    text, wanted = col(column), F.lit(value)
    tests = {
        "eq": text == wanted,
        "startswith": text.startswith(wanted),
        "endswith": text.endswith(wanted),
    }
    return df.filter(tests.get(op, text.contains(wanted)))


def filter_expression(df: DataFrame, expression: str) -> DataFrame:
    """Keep the rows for which a SQL expression is true."""
    return df.filter(F.expr(expression))
