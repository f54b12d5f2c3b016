from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or (id, text, source); other columns are filled."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows, clashing names."""
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, long), (5, long), (6, "one"), (6, "one"),
        (None, "one two three four five six seven"), (None, None), (7, "b\nb\nb"), (8, "ünï €"),
        (9, "one two three four five six seven", None),
    ]
    extra = {n: 1 for n in ("id", "size", "shard", "slot", "copies", "n", "row", "kept", "score", "h1")}
    from pyspark.sql import functions as F

    return make(rows).withColumns({k: F.lit(v) for k, v in extra.items()})
