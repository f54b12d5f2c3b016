"""Writing tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.schema import col
from textloom.operators.tokens import is_derived
from textloom.session import staged

FORMATS = ("csv", "json", "ndjson", "parquet")


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a table to the shared folder and scan it from there."""
    return staged(df, label)


def visible(df: DataFrame) -> DataFrame:
    """The table without its derived columns."""
    return df.select(*[col(c) for c in df.columns if not is_derived(c)])


def as_texts(df: DataFrame) -> DataFrame:
    """Every column as text; lists and records as JSON."""
    def text(field: T.StructField):
        nested = isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType))
        value = F.to_json(col(field.name)) if nested else col(field.name).cast("string")
        return value.alias(field.name)

    return df.select(*[text(f) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, fmt: str, partition_by: list[str] | None = None) -> None:
    """Write the visible columns in one of FORMATS.

    ``json`` gives one JSON array per file, ``ndjson`` one object per line.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; use one of {FORMATS}")
    table = visible(df)
    if fmt == "csv":
        writer = as_texts(table).write.option("header", True).option("escape", '"')
        writer.option("quote", '"').option("emptyValue", '""').csv(path)
    elif fmt == "json":
        _write_json_arrays(table, path)
    elif fmt == "ndjson":
        table.write.option("ignoreNullFields", False).json(path)
    else:
        table.write.partitionBy(*(partition_by or [])).parquet(path)


def _write_json_arrays(df: DataFrame, path: str) -> None:
    """Every task writes its rows as one array, row by row."""
    def bracketed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead = "["
        for frame in frames:
            if len(frame):
                lines = frame["value"].tolist()
                lines[0] = lead + lines[0]
                yield pd.DataFrame({"value": [lines[0], *["," + x for x in lines[1:]]]})
                lead = ","
        yield pd.DataFrame({"value": ["]" if lead == "," else "[]"]})

    options = {"ignoreNullFields": "false"}
    objects = df.select(F.to_json(F.struct(*[col(c) for c in df.columns]), options).alias("value"))
    objects.mapInPandas(bracketed, "value string").write.text(path)


def safe_name(label: str | None, fallback: str) -> str:
    """The label as a file name: control characters and those some systems reserve become ``_``."""
    return re.sub(r'[\x00-\x1f<>:"/\\|?*]', "_", (label or fallback).strip()).strip() or fallback


def export_tables(tables: list[tuple[str, DataFrame]], folder: str, fmt: str) -> dict[str, str]:
    """Write several tables, each into its own folder; returns name to path."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; use one of {FORMATS}")
    out: dict[str, str] = {}
    for i, (label, df) in enumerate(tables):
        stem = safe_name(label, f"table_{i}")
        name, n = stem, 0
        while name in out:
            n += 1
            name = f"{stem}_{n}"
        out[name] = f"{folder.rstrip('/')}/{name}.{fmt}"
        write_table(df, out[name], fmt)
    return out
