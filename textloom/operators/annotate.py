"""Label annotation: a classifier hook and the table work around it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.spans import let
from textloom.operators.schema import ANNOTATION_TYPE

Classifier = Callable[[list[str]], list[str | None]]
BATCH = 100
NO_ANSWER = "No classification returned"


class KeywordClassifier:
    """Picks the class whose own words occur most often; the first one on ties."""

    def __init__(self, classes: list[dict[str, str]], examples: list[dict[str, str]] | None = None):
        self.words: dict[str, set[str]] = {}
        for c in classes:
            about = f"{c['name']} {c.get('description', '')}"
            about += " ".join(
                f" {e['text']}" for e in examples or [] if e.get("classification") == c["name"]
            )
            self.words[c["name"]] = set(re.findall(r"\w+", about.lower()))

    def answer(self, text: Column) -> Column:
        """The class of a text as a column; null without a hit."""
        if not self.words:
            return F.lit(None).cast("string")
        body = F.lower(F.coalesce(text, F.lit("")))
        found = F.regexp_extract_all(body, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

        def score(tokens: Column, own: list[str]) -> Column:
            return F.size(F.filter(tokens, lambda t: t.isin(own)))

        def best(tokens: Column) -> Column:
            scores = [score(tokens, sorted(w)) for w in self.words.values()]
            top = scores[0] if len(scores) == 1 else F.greatest(*scores)
            names = [F.when(s == top, F.lit(n)) for s, n in zip(scores, self.words, strict=True)]
            return F.when(top > 0, F.coalesce(*names))

        return let(found, best)


def classify(
    df: DataFrame, id_col: str, text_col: str, classifier: Classifier | KeywordClassifier,
    batch_size: int = BATCH,
) -> DataFrame:
    """One answer per row: id, raw_label and error.

    A ``KeywordClassifier`` is a column expression. Any other classifier sees
    batches of texts on the executors; a batch that fails gives its rows the
    error and no label.
    """
    if isinstance(classifier, KeywordClassifier):
        told = df.select(id_col, classifier.answer(F.col(text_col)).alias("raw_label"))
        return told.withColumn("error", F.when(F.col("raw_label").isNull(), F.lit(NO_ANSWER)))
    key = df.schema[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                texts = [t or "" for t in part[text_col]]
                try:
                    answers = list(classifier(texts))[: len(texts)]
                    answers += [None] * (len(texts) - len(answers))
                    errors = [None if a is not None else NO_ANSWER for a in answers]
                except Exception as err:  # the hook is user code
                    answers, errors = [None] * len(texts), [str(err)] * len(texts)
                yield pd.DataFrame(
                    {id_col: part[id_col].values, "raw_label": answers, "error": errors}
                )

    schema = T.StructType(
        [
            T.StructField(id_col, key.dataType),
            T.StructField("raw_label", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )
    return df.select(id_col, text_col).mapInPandas(run, schema)


def normalised_label(raw: Column, classes: list[str]) -> Column:
    """The class a raw answer means: the same name, else the first class named in
    it, else the answer itself."""
    text = F.trim(raw)
    low = F.lower(text)
    # Of two classes spelled alike but for case, the later one wins.
    by_name = {c.lower(): c for c in classes}
    exact = [F.when(low == name, F.lit(c)) for name, c in by_name.items()]
    inside = [F.when(low.contains(c.lower()), F.lit(c)) for c in classes]
    return F.when(raw.isNotNull(), F.coalesce(*exact, *inside, text))


def label_rows(answers: DataFrame, classes: list[str]) -> DataFrame:
    """Add the normalised label and complete the error column."""
    label = normalised_label(F.col("raw_label"), classes)
    return answers.withColumns(
        {
            "classification": label,
            "error": F.when(label.isNull(), F.coalesce("error", F.lit(NO_ANSWER))).otherwise(
                F.col("error")
            ),
        }
    )


def save_edits(df: DataFrame, edits: DataFrame, id_col: str, column: str) -> DataFrame:
    """Write edited labels into a column, created empty if it is new.

    ``edits`` has the id and a ``label``, one row per id.
    """
    if column not in df.columns:
        df = df.withColumn(column, F.lit(None).cast("string"))
    new = edits.select(id_col, F.col("label").alias("__edit"))
    joined = df.join(new, id_col, "left")
    kept = [
        F.coalesce("__edit", column).alias(column) if c == column else F.col(c) for c in df.columns
    ]
    return joined.select(*kept)


def add_annotation(df: DataFrame, column: str, provider: Column, label: Column) -> DataFrame:
    """Append {provider, annotation} to an annotation column where there is a label."""
    old = F.col(column) if column in df.columns else F.lit(None).cast(ANNOTATION_TYPE)
    empty = F.array().cast(ANNOTATION_TYPE)
    entry = F.array(F.struct(provider.alias("provider"), label.alias("annotation")))
    value = F.concat(F.coalesce(old, empty), F.when(label.isNotNull(), entry).otherwise(empty))
    return df.withColumn(column, value)


def annotation_values(df: DataFrame, column: str, field: str = "annotation") -> DataFrame:
    """Distinct categories (or providers) of an annotation or text column, sorted."""
    if df.schema[column].dataType == ANNOTATION_TYPE:
        values = df.select(F.explode(column).alias("a")).select(F.col(f"a.{field}").alias("value"))
    else:
        values = df.select(F.col(column).alias("value"))
    return values.filter(F.col("value").isNotNull()).distinct().orderBy("value")


def detach_labels(df: DataFrame, text_col: str, label_col: str, extra: list[str]) -> DataFrame:
    return df.select(*extra, text_col, label_col)
