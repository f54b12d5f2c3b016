"""Quotations with speaker and verb, by a rule grammar.

Three shapes are known: ``"...," verb Speaker``, ``"...," Speaker verb`` and
``Speaker verb, "..."``; a quotation without a speaker is floating. Quotation
marks pair up within one line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.spans import chunked, cut, let, regex_pieces
from textloom.functions.stopwords import require_language

# The accents that are stripped, quotation marks, and the ordered
# replacements of the preprocessing step.
ACCENTS = {
    "a": "àáâãäåā", "e": "èéêëē", "i": "ìíîïıī", "o": "òóôõöō", "u": "ùúûüū", "y": "ýÿȳ",
    "c": "ç", "n": "ñ", "s": "ş",
    "A": "ÀÁÂÃÄÅĀ", "E": "ÈÉÊËĒ", "I": "ÌÍÎÏİĪ", "O": "ÒÓÔÕÖŌ", "U": "ÙÚÛÜŪ", "Y": "ÝŸȲ",
    "C": "Ç", "N": "Ñ", "S": "Ş",
}
MARKS = "”“〝〞"
REPLACEMENTS = (
    ("\n", ".\n "),
    ("..\n ", ".\n "),
    (". .\n ", ".\n "),
    ("  ", " "),
    ("\\n", " "),
    ("\\n\\n", " "),
)
FROM = " " + "".join(ACCENTS.values()) + MARKS
TO = " " + "".join(k * len(v) for k, v in ACCENTS.items()) + '"' * len(MARKS)
TABLE = str.maketrans(FROM, TO)

# Our own verb list and speaker form.
VERBS = (
    "said says say told tells asked asks added adds replied replies answered answers wrote writes "
    "explained explains noted notes stated states claimed claims argued argues announced announces "
    "insisted insists warned warns admitted admits suggested suggests declared declares"
).split()
VERB = "(?:" + "|".join(VERBS) + ")"
NAME = r"(?:(?:Mr|Mrs|Ms|Dr|Prof|St)\.|[A-Z]\.|[A-Z][A-Za-z'-]*)"
SPEAKER = rf"(?:{NAME}(?: {NAME}){{0,3}}|he|she|they|it|we|I|you)"
QUOTED = r'"[^"\n]+"'

AFTER_VS = rf"^(\s*,?\s*)({VERB})(\s+)({SPEAKER})(?![A-Za-z])"
AFTER_SV = rf"^(\s*,?\s*)({SPEAKER})(\s+)({VERB})(?![A-Za-z])"
BEFORE_SV = rf"(?<![A-Za-z])({SPEAKER})(\s+)({VERB})(\s*[,:]?\s*)$"

COLUMNS = [
    "speaker",
    "speaker_start_idx",
    "speaker_end_idx",
    "quote",
    "quote_start_idx",
    "quote_end_idx",
    "verb",
    "verb_start_idx",
    "verb_end_idx",
    "quote_type",
    "quote_token_count",
    "is_floating_quote",
    "quote_row_idx",
]
QUOTE_TYPE = (
    "array<struct<"
    + ",".join(
        f"{c}:{'boolean' if c.startswith('is_') else 'bigint' if c.endswith(('_idx', '_count')) else 'string'}"
        for c in COLUMNS
    )
    + ">>"
)
DEFAULT_CONTEXT = 20


def plain_text(text: Column) -> Column:
    """Accents, no-break spaces and curly quotes made plain; same length."""
    return F.translate(text, FROM, TO)


def _replace_all(text: str, at: np.ndarray, old: str, new: str) -> tuple[str, np.ndarray]:
    pieces, marks, i = [], [], 0
    while (j := text.find(old, i)) >= 0:
        pieces += [text[i:j], new]
        marks += [at[i:j], np.repeat(at[j], len(new))]
        i = j + len(old)
    if not pieces:
        return text, at
    return "".join(pieces) + text[i:], np.concatenate([*marks, at[i:]])


def _preprocess(text: str) -> tuple[str, np.ndarray]:
    plain = text.translate(TABLE)
    at = np.arange(len(plain) + 1, dtype=np.int32)
    for old, new in REPLACEMENTS:
        plain, at = _replace_all(plain, at, old, new)
    return plain, at


def preprocess(text: str) -> tuple[str, list[int]]:
    """The text as the parser sees it, and the original offset of each character."""
    plain, at = _preprocess(text)
    return plain, at.tolist()


PREPROCESSED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("offsets", T.ArrayType(T.IntegerType())),
    ]
)
FRAME_CHARS = 1 << 20  # of texts whose offsets are held at one time


@F.arrow_udf(PREPROCESSED)
def preprocessed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``preprocess`` for a text column, a few texts at a time."""
    for texts in batches:
        plain, marks, size = [], [], 0
        for text in texts:
            found, at = _preprocess(text.as_py() or "")
            plain.append(found)
            marks.append(at)
            size += len(at)
            if size >= FRAME_CHARS:
                yield _packed(plain, marks)
                plain, marks, size = [], [], 0
        if plain or not len(texts):
            yield _packed(plain, marks)


def _packed(plain: list[str], marks: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, marks)]).astype(np.int32)
    values = np.concatenate(marks) if marks else np.empty(0, np.int32)
    offsets = pa.ListArray.from_arrays(ends, values)
    return pa.StructArray.from_arrays([pa.array(plain, pa.string()), offsets], ["text", "offsets"])


def _first_part(gap: Column, side: int) -> Column:
    """The part of a text up to its first line break or quotation mark, from the left (1) or right (-1)."""
    return F.substring_index(F.substring_index(gap, "\n", side), '"', side)


def quotations(text: Column) -> Column:
    """All quotations of one document as an array of structs with COLUMNS."""
    bits = 8
    body = F.coalesce(text, F.lit(""))
    none = F.lit(None).cast("bigint")

    def quote(doc: Column, q: Column, i: Column) -> Column:
        start, end = q["start"], q["end"]

        def part(near: Column, pattern: str, group: int) -> Column:
            return F.regexp_extract(near, pattern, group)

        def parts(near: Column, pattern: str) -> Column:
            return F.array(*[part(near, pattern, g) for g in range(1, 5)])

        def shapes(w: Column) -> Column:
            after, before = w["after"], w["before"]
            found = (
                F.when(after.rlike(AFTER_VS), F.struct(F.lit("QVS").alias("kind"), parts(after, AFTER_VS).alias("g")))
                .when(after.rlike(AFTER_SV), F.struct(F.lit("QSV").alias("kind"), parts(after, AFTER_SV).alias("g")))
                .when(before.rlike(BEFORE_SV), F.struct(F.lit("SVQ").alias("kind"), parts(before, BEFORE_SV).alias("g")))
                .otherwise(F.struct(F.lit("FLOATING").alias("kind"), F.array().cast("array<string>").alias("g")))
            )
            return let(found, build)

        def build(f: Column) -> Column:
            g = [F.get(f["g"], F.lit(k)) for k in range(4)]
            n = [F.length(x).cast("bigint") for x in g]
            kind = f["kind"]
            # Where the four groups begin: after the quote, or ending at it.
            base = F.when(kind == "SVQ", start - n[0] - n[1] - n[2] - n[3]).otherwise(end)
            edges = [base, base + n[0], base + n[0] + n[1], base + n[0] + n[1] + n[2]]
            spots = F.when(
                kind != "FLOATING",
                F.struct(
                    F.when(kind == "QVS", 3).when(kind == "QSV", 1).otherwise(0).alias("s"),
                    F.when(kind == "QVS", 1).when(kind == "QSV", 3).otherwise(2).alias("v"),
                ),
            )
            edge_list, sizes = F.array(*edges), F.array(*n)

            def span(which: str) -> tuple[Column, Column]:
                begin = F.get(edge_list, spots[which])
                return begin, begin + F.get(sizes, spots[which])

            (s0, s1), (v0, v1) = span("s"), span("v")

            def raw(a: Column, b: Column) -> Column:
                return F.when(a.isNotNull(), cut(doc["text"], doc["chunks"], bits, a, b))

            inner = cut(doc["text"], doc["chunks"], bits, start + 1, end - 1)
            values = [
                raw(s0, s1),
                F.coalesce(s0, none),
                F.coalesce(s1, none),
                inner,
                start + 1,
                end - 1,
                raw(v0, v1),
                F.coalesce(v0, none),
                F.coalesce(v1, none),
                kind,
                F.size(F.regexp_extract_all(inner, F.lit(r"\S+"), F.lit(0))).cast("bigint"),
                kind == "FLOATING",
                i.cast("bigint"),
            ]
            return F.struct(*[v.alias(c) for v, c in zip(values, COLUMNS, strict=True)])

        windows = F.struct(
            F.get(doc["after"], i + F.lit(1)).alias("after"), F.get(doc["before"], i).alias("before")
        )
        return let(windows, shapes)

    def with_plain(plain: Column) -> Column:
        return let(regex_pieces(plain, QUOTED), with_pieces)

    def with_pieces(found: Column) -> Column:
        # Speaker and verb hold no quotation mark and no line break, so they lie
        # between the quotation and the next of either.
        doc = F.struct(
            body.alias("text"),
            chunked(body, bits).alias("chunks"),
            F.transform(found["gaps"], lambda g: _first_part(g, 1)).alias("after"),
            F.transform(found["gaps"], lambda g: _first_part(g, -1)).alias("before"),
            found["spans"].alias("spans"),
        )
        return let(doc, lambda d: F.transform(d["spans"], lambda q, i: quote(d, q, i)))

    # Texts without a quotation mark are not looked into.
    marked = body.rlike(f'["{MARKS}]')
    return F.when(marked, let(plain_text(body), with_plain)).otherwise(
        F.array().cast(QUOTE_TYPE)
    )


def extract_quotations(
    df: DataFrame, text_col: str, language: str = "en", output: str = "quotation"
) -> DataFrame:
    """Add the quotations of every document as a list column."""
    require_language("quotation extraction", language)
    return df.withColumn(output, quotations(F.col(text_col)))


def flatten_quotations(
    df: DataFrame,
    keep: list[str],
    quotation_col: str = "quotation",
    text_col: str | None = None,
    context: int | None = None,
) -> DataFrame:
    """One row per quotation with QUOTE_ columns; empty quotations are dropped.

    With ``text_col``, QUOTE_extraction holds the text from the first to the
    last part of the quotation with ``context`` characters around it.
    """
    if text_col is None:
        exploded = F.explode(F.transform(quotation_col, lambda q: F.struct(q.alias("q"))))
        tail = []
    else:
        exploded = F.explode(_with_windows(F.col(text_col), F.col(quotation_col), context))
        tail = [F.col("x.extraction").alias("QUOTE_extraction")]
    rows = df.select(*keep, exploded.alias("x"))
    filled = [
        F.coalesce(F.length(F.trim(f"x.q.{c}")), F.lit(0)) > 0 for c in ("quote", "speaker", "verb")
    ]
    named = [F.col(f"x.q.{c}").alias(f"QUOTE_{c}") for c in COLUMNS]
    return rows.filter(filled[0] | filled[1] | filled[2]).select(*keep, *named, *tail)


def _with_windows(text: Column, found: Column, context: int | None) -> Column:
    """Every quotation with the text around it, cut before the rows are split up."""
    width = context_length(context)
    parts = ("speaker", "quote", "verb")

    def window(doc: Column, q: Column) -> Column:
        low = F.least(*[q[f"{p}_start_idx"] for p in parts]) - width
        high = F.greatest(*[q[f"{p}_end_idx"] for p in parts]) + width
        low, high = F.greatest(F.lit(0).cast("bigint"), low), F.least(doc["length"], high)
        return F.struct(
            q.alias("q"), cut(doc["text"], doc["chunks"], 8, low, high).alias("extraction")
        )

    body = F.coalesce(text, F.lit(""))
    doc = F.struct(
        body.alias("text"),
        chunked(body, 8).alias("chunks"),
        F.length(body).cast("bigint").alias("length"),
        found.alias("found"),
    )
    return let(doc, lambda d: F.transform(d["found"], lambda q: window(d, q)))


def context_length(value: object) -> int:
    """The context length asked for; what is no number gives the default."""
    try:
        number = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return DEFAULT_CONTEXT
    if number < 0:
        raise ValueError("a context is not negative")
    return number


def around(text: Column, start: Column, end: Column, context: int) -> Column:
    """Text of a span with ``context`` characters on both sides."""
    low = F.greatest(F.lit(0), start - context)
    return F.substring(text, (low + 1).cast("int"), (end + context - low).cast("int"))
