"""New columns by find/replace, extraction and SQL expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.spans import check_pattern, let
from textloom.operators.schema import col

NAME_LIMIT = 120  # fixed value
DEFAULT_NAME = "computed_column"


def output_name(wanted: str | None, source: str | None = None) -> str:
    """Column name of a computed column: tidy, bounded, never empty."""
    label = re.sub(r"\s+", " ", wanted or source or "").strip()
    return label[:NAME_LIMIT] or DEFAULT_NAME


def java_replacement(replacement: str) -> str:
    """Group references as ``$1`` or ``${1}``, ``$$`` for a dollar sign."""
    def one(m: re.Match[str]) -> str:
        if m.group() == "\\":
            return r"\\"
        if m.group() == "$$":
            return r"\$"
        if m.group(1) or m.group(2):
            return "$" + (m.group(1) or m.group(2))
        return r"\$"

    return re.sub(r"\\|\$\$|\$\{(\d+)\}|\$(\d+)|\$", one, replacement)


def replacement_parts(replacement: str) -> list[str | int]:
    """The literal pieces and the group numbers of a replacement, in order."""
    parts: list[str | int] = []
    for m in re.finditer(r"\$\$|\$\{(\d+)\}|\$(\d+)|[^$]+|\$", replacement):
        number = m.group(1) or m.group(2)
        parts.append(int(number) if number else "$" if m.group() == "$$" else m.group())
    return parts


def replaced(text: Column, pattern: str, replacement: str, first: int | None = None) -> Column:
    """Replace all matches, or the ``first`` ones. Group references are allowed."""
    java = java_replacement(replacement)
    if first is None:
        return F.regexp_replace(text, pattern, java)
    check_pattern(pattern)
    if first < 1:
        return text
    parts = F.split(text, pattern, first + 1)
    if "$" not in replacement and "\\" not in replacement:
        return F.array_join(parts, replacement)
    # The replacement of each match, from its groups as found in the whole text.
    def groups(number: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(number))

    pieces = replacement_parts(replacement)
    lists = {n: groups(n) for n in sorted({p for p in pieces if isinstance(p, int)} | {0})}

    def build(found: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            new = [F.lit(p) if isinstance(p, str) else F.get(found[f"g{p}"], i) for p in pieces]
            return F.concat(part, F.when(i < F.size(parts) - 1, F.concat(*new)).otherwise(""))

        return F.array_join(F.transform(parts, one), "")

    return let(F.struct(*[g.alias(f"g{n}") for n, g in lists.items()]), build)


def extracted(
    text: Column, pattern: str, connector: str = " ", first: int | None = None
) -> Column:
    """Matches joined by ``connector``; null where there is none."""
    check_pattern(pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def joined(m: Column) -> Column:
        kept = m if first is None else F.slice(m, 1, first)
        return F.when(F.size(m) > 0, F.array_join(kept, connector))

    return let(found, joined)


def find_replace(
    df: DataFrame,
    source: str,
    pattern: str,
    replacement: str = "",
    mode: str = "replace",
    count: str = "all",
    n: int | None = None,
    connector: str = " ",
    output: str | None = None,
) -> DataFrame:
    """Replace or extract in one text column, into itself or a new column."""
    if mode not in ("replace", "extract") or count not in ("all", "first"):
        raise ValueError("mode is replace or extract, count is all or first")
    first = None if count == "all" else (1 if n is None else n)
    if mode == "extract":
        value = extracted(col(source), pattern, connector, first)
    else:
        value = replaced(col(source), pattern, replacement, first)
    name = output_name(output, source)
    if len(output or source) > NAME_LIMIT and name in df.columns:
        raise ValueError(f"cut to {NAME_LIMIT} characters, the name is taken: {name!r}")
    return df.withColumn(name, value)


ASSIGNMENT = re.compile(r"^\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.+)$", re.DOTALL)


def _named(df: DataFrame, text: str) -> Column:
    """A SQL expression, with an optional leading ``name =``."""
    found = ASSIGNMENT.match(text)
    return F.expr(found.group(2)).alias(found.group(1)) if found else F.expr(text)


def add_columns(df: DataFrame, *expressions: str) -> DataFrame:
    """Add or overwrite columns by SQL expressions, all reading the input."""
    new = [_named(df, e) for e in expressions]
    names = df.select(*new).columns
    kept = [col(c) for c in df.columns if c not in names]
    return df.select(*kept, *new)


def select_expressions(df: DataFrame, *expressions: str) -> DataFrame:
    return df.select(*[_named(df, e) for e in expressions])


def sort_expressions(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """Sort by (expression, descending) pairs; nulls come first."""
    order = [
        F.desc_nulls_first(F.expr(e)) if down else F.asc_nulls_first(F.expr(e)) for e, down in keys
    ]
    return df.orderBy(*order)


def group_expressions(df: DataFrame, keys: list[str], aggregates: list[str]) -> DataFrame:
    return df.groupBy(*[_named(df, k) for k in keys]).agg(*[_named(df, a) for a in aggregates])


def apply_expressions(
    df: DataFrame,
    context: str,
    expressions: list[str],
    keys: list[str] | None = None,
    descending: list[bool] | None = None,
) -> DataFrame:
    """SQL expressions in one of five contexts."""
    if context == "filter":
        return df.filter(F.expr(expressions[0]))
    if context == "with_columns":
        return add_columns(df, *expressions)
    if context == "select":
        return select_expressions(df, *expressions)
    if context == "sort":
        down = descending or [False] * len(expressions)
        return sort_expressions(df, *zip(expressions, down, strict=True))
    if context == "group_by_agg":
        return group_expressions(df, keys or [], expressions)
    raise ValueError(f"unknown context {context!r}")
