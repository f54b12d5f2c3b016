"""Small helpers for columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without(df: DataFrame, added: Iterable[str]) -> DataFrame:
    """``df`` without the columns whose names an operator is about to add."""
    names = {a.lower() for a in added}
    return df.select(*[df[c] for c in df.columns if c.lower() not in names])


def keep_runs(gone: str) -> Column:
    """Runs ``from, len`` between the sorted positions in ``gone``; the last one's length is null."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(gone)),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1).alias("from"),
            F.get(gone, i).alias("to"),
        ),
    )
    return F.transform(
        F.filter(runs, lambda r: r["to"].isNull() | (r["to"] > r["from"])),
        lambda r: F.struct(r["from"].alias("from"), (r["to"] - r["from"]).alias("len")),
    )


def take_runs(items: str, runs: str) -> Column:
    """The items inside the runs, in order."""
    rest = lambda r: F.greatest(F.size(items) - r["from"], F.lit(0))
    return F.flatten(
        F.transform(
            runs, lambda r: F.slice(items, r["from"] + 1, F.coalesce(r["len"], rest(r)))
        )
    )
