"""Concordance: keyword in context, by pattern or by token, and dispersion."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.spans import (
    check_pattern,
    chunk_at,
    chunk_bits,
    chunked,
    cut,
    let,
    piece,
    quote_literal,
    regex_spans,
)
from textloom.functions.stopwords import NO_WORD_BOUNDARY
from textloom.operators.paging import SortKey, rows_between
from textloom.operators.ranks import spread_lookup, with_row_index
from textloom.session import staged

# The output columns.
CORE = [
    "CONC_left_context",
    "CONC_matched_text",
    "CONC_right_context",
    "CONC_start_idx",
    "CONC_end_idx",
    "CONC_l1",
    "CONC_r1",
]
EXTRACTION = "CONC_extraction"
L1_FREQ, R1_FREQ = "CONC_l1_freq", "CONC_r1_freq"
DOC_LENGTH = "CONC_doc_length"
HIT_FIELDS = [*CORE, EXTRACTION, DOC_LENGTH]
HIT_TYPE = (
    "array<struct<"
    + ",".join(
        f"{name}:{'bigint' if name.endswith(('_idx', '_length')) else 'string'}"
        for name in HIT_FIELDS
    )
    + ">>"
)
# Chunks next to the match's own that are searched for context; 0 means all.
WINDOW_CHUNKS = (1, 16, 0)
PAGE_SIZES = (10, 20, 50, 100)
PAGE_TARGET = 10
FINE_BINS = 100


def search_pattern(
    word: str,
    regex: bool = False,
    whole_word: bool = False,
    case_sensitive: bool = False,
    language: str | None = None,
) -> str:
    """The Java regex of a search.

    Word boundaries make no sense in scripts without spaces, so ``whole_word``
    is ignored for those languages.
    """
    if not (word or "").strip():
        raise ValueError("the search word is empty")
    body = word if regex else quote_literal(word)
    if whole_word and (language or "").strip().lower() not in NO_WORD_BOUNDARY:
        body = rf"\b(?:{body})\b"
    check_pattern(body)
    return ("(?U)" if case_sensitive else "(?i)(?U)") + body


def _words(count: int, least: int = 1) -> str:
    """Between ``least`` and ``count`` words at the start of a text."""
    return rf"(?U)^\s*(\S++(?:\s++\S++){{{least - 1},{max(count, 1) - 1}}})"


def kwic_hits(text: Column, pattern: str, left: int = 10, right: int = 10) -> Column:
    """All hits of one document as an array of structs with the CORE fields.

    A context is the raw text of up to ``left`` / ``right`` whitespace-separated
    words, a word cut by the match counting as one. It is looked for in the
    chunks of text next to the match, and in more of them, at last in all, only
    where the words do not fit. The left side is read backwards.
    """
    bits = chunk_bits(16 * max(left, right))
    body = F.coalesce(text, F.lit(""))

    def words_in(near: list[tuple[Column, Column]], count: int) -> Column:
        """Words at the start of the first window that holds them for sure: all
        of them with a space behind, or the window is the whole side."""
        window, is_all = near[0]
        if len(near) == 1:
            return F.regexp_extract(window, _words(count), 1)
        full = _words(count, max(count, 1)) + r"\s"

        def found(w: Column) -> Column:
            return let(
                F.regexp_extract(w, full, 1),
                lambda x: F.when(x != "", x)
                .when(is_all, F.regexp_extract(w, _words(count), 1))
                .otherwise(words_in(near[1:], count)),
            )

        return let(window, found)

    def windows(doc: Column, start: Column, end: Column) -> tuple[list, list]:
        j, k = chunk_at(start, bits)
        own_before = F.right(piece(doc["reversed"], j), k)
        before = []
        for n in WINDOW_CHUNKS:
            more = F.least(j, F.lit(n)) if n else j
            if n == 1:
                rest = piece(doc["reversed"], j - 1)
            else:
                rest = F.array_join(F.reverse(F.slice(doc["reversed"], j - more + 1, more)), "")
            before.append((F.concat(own_before, rest), j <= n if n else F.lit(True)))
        j, k = chunk_at(end, bits)
        own_after = F.substring(piece(doc["chunks"], j), k + 1, F.lit(1 << bits))
        after = []
        for n in WINDOW_CHUNKS:
            last = F.size(doc["chunks"]) - 1
            if n == 1:
                rest = piece(doc["chunks"], j + 1)
            else:
                rest = F.array_join(
                    F.slice(doc["chunks"], j + 2, F.lit(n) if n else last + 1), ""
                )
            after.append((F.concat(own_after, rest), j + n >= last if n else F.lit(True)))
        return before, after

    def hit(doc: Column, h: Column) -> Column:
        start, end = h["start"], h["end"]
        before, after = windows(doc, start, end)
        sides = F.struct(
            words_in(before, left).alias("back"), words_in(after, right).alias("forth")
        )

        def with_sides(s: Column) -> Column:
            left_context = F.reverse(s["back"]) if left > 0 else F.lit("")
            right_context = s["forth"] if right > 0 else F.lit("")
            pad_l = F.when(s["back"] != "", F.length(s["back"]) + 1).otherwise(0)
            pad_r = F.when(s["forth"] != "", F.length(s["forth"]) + 1).otherwise(0)
            low = F.greatest(F.lit(0).cast("bigint"), start - (pad_l if left > 0 else 0))
            high = end + (pad_r if right > 0 else 0)
            return F.struct(
                left_context.alias(CORE[0]),
                h["text"].alias(CORE[1]),
                right_context.alias(CORE[2]),
                start.alias(CORE[3]),
                end.alias(CORE[4]),
                F.reverse(F.regexp_extract(s["back"], r"(?U)^(\S+)", 1)).alias(CORE[5]),
                F.regexp_extract(s["forth"], r"(?U)^(\S+)", 1).alias(CORE[6]),
                cut(doc["text"], doc["chunks"], bits, low, high).alias(EXTRACTION),
                doc["length"].alias(DOC_LENGTH),
            )

        return let(sides, with_sides)

    def with_chunks(c: Column) -> Column:
        doc = F.struct(
            c["text"].alias("text"),
            c["chunks"].alias("chunks"),
            F.transform(c["chunks"], F.reverse).alias("reversed"),
            c["spans"].alias("spans"),
            F.length(c["text"]).cast("bigint").alias("length"),
        )
        return let(doc, lambda d: F.transform(d["spans"], lambda h: hit(d, h)))

    parts = F.struct(
        body.alias("text"),
        chunked(body, bits).alias("chunks"),
        regex_spans(body, pattern).alias("spans"),
    )
    # Texts without a hit are not cut up.
    none = F.array().cast(HIT_TYPE)
    return F.when(body.rlike(pattern), let(parts, with_chunks)).otherwise(none)


def token_alternatives(query: str, case_sensitive: bool = False) -> list[str]:
    """The wanted tokens of a query split at spaces, commas and bars."""
    parts = [p for p in re.split(r"[\s,|]+", query or "") if p]
    return sorted({p if case_sensitive else p.lower() for p in parts})


def token_hits(
    text: Column,
    tokens: Column,
    query: str,
    left: int = 10,
    right: int = 10,
    case_sensitive: bool = False,
) -> Column:
    """Hits whose token equals one of the query's, as an array of structs.

    Contexts are ``left`` / ``right`` tokens, cut from the raw text. Neighbour
    tokens are null at the edges.
    """
    wanted = token_alternatives(query, case_sensitive)
    bits = chunk_bits(32 * max(left, right))
    body = F.coalesce(text, F.lit(""))

    def is_wanted(token: Column) -> Column:
        folded = token if case_sensitive else F.lower(token)
        return F.coalesce(folded.isin(wanted), F.lit(False)) if wanted else F.lit(False)

    def hit(doc: Column, i: Column) -> Column:
        all_tokens = doc["tokens"]
        last = F.size(all_tokens) - 1
        this = F.get(all_tokens, i)
        first_left = F.get(all_tokens, F.greatest(F.lit(0), i - left))
        last_right = F.get(all_tokens, F.least(last, i + right))

        def raw(start: Column, end: Column) -> Column:
            return cut(doc["text"], doc["chunks"], bits, start, end)

        return F.struct(
            raw(first_left["start"], this["start"]).alias(CORE[0]),
            this["token"].alias(CORE[1]),
            raw(this["end"], last_right["end"]).alias(CORE[2]),
            this["start"].alias(CORE[3]),
            this["end"].alias(CORE[4]),
            F.get(all_tokens, i - 1)["token"].alias(CORE[5]),
            F.get(all_tokens, i + 1)["token"].alias(CORE[6]),
            raw(first_left["start"], last_right["end"]).alias(EXTRACTION),
            doc["length"].alias(DOC_LENGTH),
        )

    doc = F.struct(
        body.alias("text"),
        chunked(body, bits).alias("chunks"),
        F.coalesce(tokens, F.array().cast("array<struct<token:string,start:bigint,end:bigint>>"))
        .alias("tokens"),
        F.length(body).cast("bigint").alias("length"),
    )

    def positions(d: Column) -> Column:
        flags = F.transform(
            d["tokens"], lambda t, i: F.when(is_wanted(t["token"]), i).otherwise(F.lit(None))
        )
        return F.array_compact(flags)

    return let(doc, lambda d: F.transform(positions(d), lambda i: hit(d, i)))


def not_blank(text_col: str) -> Column:
    """Whether a text has anything but white space."""
    return F.coalesce(F.col(text_col), F.lit("")).rlike(r"(?U)\S")


def _flat(df: DataFrame, hits: Column, text_col: str, keep: list[str]) -> DataFrame:
    """One row per hit. The text itself travels only if it is in ``keep``."""
    rows = df.filter(not_blank(text_col)).select(*keep, F.explode(hits).alias("__hit"))
    return rows.select(*keep, *[F.col(f"__hit.{name}").alias(name) for name in HIT_FIELDS])


def _by_language(
    search: Callable[[str | None], Column], language: str | None, language_col: str | None
) -> Column:
    """``search`` with the word rule of ``language``, or of each row's own language.

    A row is searched once, by the rule for scripts with or without spaces. A row
    whose language is null or unknown has the rule for scripts with spaces.
    """
    if language_col is None:
        return search(language)
    if language is not None:
        raise ValueError("name a language or a column of languages, not both")
    own = F.lower(F.trim(F.col(language_col).cast("string")))
    unspaced = sorted(NO_WORD_BOUNDARY)
    return F.when(own.isin(unspaced), search(unspaced[0])).otherwise(search(None))


def concordance(
    df: DataFrame,
    text_col: str,
    word: str,
    keep: list[str],
    left: int = 10,
    right: int = 10,
    regex: bool = False,
    whole_word: bool = False,
    case_sensitive: bool = False,
    language: str | None = None,
    language_col: str | None = None,
) -> DataFrame:
    """Flat hit table of a text search: kept columns, then the CONC columns.

    For a table of mixed languages ``language_col`` holds the language of each row.
    """

    def hits(code: str | None) -> Column:
        pattern = search_pattern(word, regex, whole_word, case_sensitive, code)
        return kwic_hits(F.col(text_col), pattern, left, right)

    found = _by_language(hits, language, language_col if whole_word else None)
    return _flat(df, found, text_col, keep)


def matches(
    df: DataFrame,
    text_col: str,
    word: str,
    keep: list[str],
    regex: bool = False,
    whole_word: bool = False,
    case_sensitive: bool = False,
    language: str | None = None,
    language_col: str | None = None,
) -> DataFrame:
    """Hits of a text search without their contexts: all that counting,
    grouping and dispersion need, at a fraction of the work."""
    by_row = language_col if whole_word else None

    def pattern(code: str | None) -> str:
        return search_pattern(word, regex, whole_word, case_sensitive, code)

    body = F.coalesce(F.col(text_col), F.lit(""))

    def with_length(d: Column) -> Column:
        return F.transform(
            d["spans"],
            lambda h: F.struct(
                h["text"].alias(CORE[1]),
                h["start"].alias(CORE[3]),
                h["end"].alias(CORE[4]),
                d["length"].alias(DOC_LENGTH),
            ),
        )

    doc = F.struct(
        _by_language(lambda code: regex_spans(body, pattern(code)), language, by_row).alias("spans"),
        F.length(body).cast("bigint").alias("length"),
    )
    found = _by_language(lambda code: F.col(text_col).rlike(pattern(code)), language, by_row)
    rows = df.filter(not_blank(text_col) & found).select(
        *keep, F.explode(let(doc, with_length)).alias("__hit")
    )
    fields = [CORE[1], CORE[3], CORE[4], DOC_LENGTH]
    return rows.select(*keep, *[F.col(f"__hit.{name}").alias(name) for name in fields])


def token_concordance(
    df: DataFrame,
    text_col: str,
    tokens_col: str,
    query: str,
    keep: list[str],
    left: int = 10,
    right: int = 10,
    case_sensitive: bool = False,
) -> DataFrame:
    """Flat hit table of a token search, with the columns of ``concordance``."""
    hits = token_hits(F.col(text_col), F.col(tokens_col), query, left, right, case_sensitive)
    return _flat(df, hits, text_col, keep)


def extraction(text: Column) -> Column:
    """The text from left context to right context of a flat hit row, with one
    separator on each side that has a context."""
    def pad(name: str) -> Column:
        length = F.length(F.coalesce(F.col(name), F.lit("")))
        return length + F.when(length > 0, 1).otherwise(0)

    start = F.greatest(F.lit(0), F.col("CONC_start_idx") - pad("CONC_left_context"))
    end = F.col("CONC_end_idx") + pad("CONC_right_context")
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def non_empty(df: DataFrame) -> DataFrame:
    """Drop hits whose match and contexts are all blank."""
    def filled(name: str) -> Column:
        bare = F.regexp_replace(F.col(name).cast("string"), r"(?U)^\s+|\s+$", "")
        return F.coalesce(F.length(bare), F.lit(0)) > 0

    return df.filter(filled(CORE[1]) | filled(CORE[0]) | filled(CORE[2]))


def with_neighbour_freqs(hits: DataFrame) -> DataFrame:
    """Add how often each neighbour word occurs as such over all hits.

    The hits are written to the shared folder first: they are read three times
    and cost far more to find than to store.
    """
    hits = staged(hits, "hits")
    sides = hits.select(
        F.explode(
            F.array(
                F.struct(F.lit("l").alias("side"), F.col("CONC_l1").alias("word")),
                F.struct(F.lit("r").alias("side"), F.col("CONC_r1").alias("word")),
            )
        ).alias("s")
    ).filter(F.col("s.word").isNotNull())
    counts = sides.groupBy("s.side", "s.word").agg(F.count(F.lit(1)).alias("n"))
    out = hits
    for side, key, name in (("l", "CONC_l1", L1_FREQ), ("r", "CONC_r1", R1_FREQ)):
        table = counts.filter(F.col("side") == side).select(
            F.col("word").alias(key), F.col("n").alias(name)
        )
        out = spread_lookup(out, table, key, name)
    return out


def hit_summary(hits: DataFrame, id_col: str, source: DataFrame) -> DataFrame:
    """Number of hits, of documents with hits, and of source documents."""
    total = source.agg(F.count(F.lit(1)).alias("n")).scalar()
    return hits.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_distinct(id_col).alias("unique_documents_with_hits"),
    ).withColumn("total_source_documents", total)


def document_page(
    df: DataFrame,
    order_by: list[str],
    page: int = 1,
    page_size: int = 20,
    descending: bool = False,
) -> DataFrame:
    """One page of source documents, taken before any search runs."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    keys = [SortKey(order_by[0], descending, nulls_last=True), *map(SortKey, order_by[1:])]
    return rows_between(df, keys, (page - 1) * page_size, page_size)


def estimate_page_size(
    df: DataFrame, text_col: str, pattern: str, order_by: list[str]
) -> DataFrame:
    """Smallest page size whose first page has enough hits, else the largest."""
    first = df.orderBy(*order_by).limit(PAGE_SIZES[-1])
    # At most one hundred rows reach the window.
    ranked = first.select(
        F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), F.lit(0)))
        .cast("bigint")
        .alias("hits"),
        F.row_number().over(Window.orderBy(*order_by)).alias("rank"),
    )
    sums = ranked.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("rank") <= s, F.col("hits"))), F.lit(0)).alias(f"n{s}")
            for s in PAGE_SIZES
        ]
    )
    size = F.lit(PAGE_SIZES[-1])
    for s in reversed(PAGE_SIZES):
        size = F.when(F.col(f"n{s}") >= PAGE_TARGET, F.lit(s)).otherwise(size)
    return sums.select(size.cast("bigint").alias("page_size"))


def interleave(
    left: DataFrame,
    right: DataFrame,
    order_by: list[str],
    left_name: str,
    right_name: str,
) -> DataFrame:
    """Rows of two tables in turn, then the rest of the longer one.

    ``position`` is the place in the combined view and ``__source_node`` the
    table of origin.
    """
    ranked = [with_row_index(df, order_by, "__rank") for df in (left, right)]
    # The numbered rows are stored, so their counts do not search again.
    shared = F.least(
        *[F.coalesce(t.agg(F.max("__rank")).scalar(), F.lit(0).cast("bigint")) for t in ranked]
    )
    tagged = [
        t.withColumns({"__side": F.lit(side), "__source_node": F.lit(name)})
        for side, (t, name) in enumerate(zip(ranked, (left_name, right_name), strict=True))
    ]
    both = tagged[0].unionByName(tagged[1], allowMissingColumns=True)
    paired = 2 * (F.col("__rank") - 1) + F.col("__side") + 1
    place = F.when(F.col("__rank") <= shared, paired).otherwise(F.col("__rank") + shared)
    return both.withColumn("position", place.cast("bigint")).drop("__rank", "__side")


def append_sources(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Hit tables of several sources one after another, tagged by source."""
    out = None
    for order, (name, df) in enumerate(tables):
        tagged = df.withColumns({"__source_node": F.lit(name), "__source_order": F.lit(order)})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def detach(hits: DataFrame, metadata: list[str], with_extraction: bool = False) -> DataFrame:
    """Chosen metadata, the core columns and their frequencies."""
    tail = [EXTRACTION] if with_extraction else []
    return hits.select(*metadata, *CORE, L1_FREQ, R1_FREQ, *tail)


def hits_by_document(hits: DataFrame, id_col: str) -> DataFrame:
    """Hits of each document as one ordered list.

    A list holds the hits of one document, so its size is bounded by that
    document's text.
    """
    fields = [c for c in hits.columns if c != id_col]
    lead = ["CONC_start_idx", *[c for c in fields if c != "CONC_start_idx"]]
    return hits.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(*lead))).alias("hits"))


def relative_bin(start: Column, length: Column, bins: int = FINE_BINS) -> Column:
    """Bin of a position inside its document."""
    raw = F.floor(start.cast("double") / length.cast("double") * bins)
    return F.when(length > 0, F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw))).cast("bigint")


def dispersion(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hits per matched text and hundredth of the document."""
    keys = by or []
    return (
        hits.filter((F.col("CONC_doc_length") > 0) & F.col("CONC_start_idx").isNotNull())
        .withColumn("bin_idx", relative_bin(F.col("CONC_start_idx"), F.col("CONC_doc_length")))
        .groupBy(*keys, F.col("CONC_matched_text").alias("matched_text"), "bin_idx")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def rebin(
    fine: DataFrame, bins: int = 20, merge_case: bool = False, by: list[str] | None = None
) -> DataFrame:
    """Sum the hundred fine bins into fewer, without reading the hits again."""
    if FINE_BINS % bins:
        raise ValueError(f"bins must divide {FINE_BINS}")
    text = F.lower("matched_text") if merge_case else F.col("matched_text")
    wide = F.floor(F.col("bin_idx") * bins / FINE_BINS).cast("bigint")
    return fine.groupBy(*(by or []), text.alias("matched_text"), wide.alias("bin_idx")).agg(
        F.sum("count").cast("bigint").alias("count")
    )


def dispersion_detach(
    hits: DataFrame,
    id_col: str,
    metadata: list[str] | None = None,
    bins: list[int] | None = None,
    total_bins: int | None = None,
    matched_texts: list[str] | None = None,
    fold_case: bool = False,
    merge_copies: bool = False,
) -> DataFrame:
    """One row per document: its hits as lists in text order, and the
    extractions as a bulleted text.

    ``id_col`` names the document, so a list holds the hits of one text. With
    ``merge_copies`` it may be the text itself: copies become one row whose
    hits are kept once, with the number of copies.
    """
    df = hits
    if matched_texts is not None:
        found = F.lower("CONC_matched_text") if fold_case else F.col("CONC_matched_text")
        allowed = [t.lower() if fold_case else t for t in matched_texts]
        df = df.filter(found.isin(allowed) if allowed else F.lit(False))
    if bins is not None and total_bins:
        at = relative_bin(F.col("CONC_start_idx"), F.col("CONC_doc_length"), total_bins)
        df = df.filter(at.isin([int(b) for b in bins]))
    freqs = [c for c in (L1_FREQ, R1_FREQ) if c in hits.columns]
    listed = ["CONC_matched_text", "CONC_l1", "CONC_r1", *freqs]
    copies = []
    if merge_copies:
        # Identical hits of copies collapse before any list is built.
        df = df.groupBy(id_col, "CONC_start_idx", *listed, EXTRACTION).agg(
            F.count(F.lit(1)).alias("copies"), *[F.min(c).alias(c) for c in metadata or []]
        )
        copies = [F.max("copies").alias("copies")]
    grouped = df.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("CONC_start_idx", *listed, EXTRACTION))).alias("h"),
        *copies,
        *[F.min(c).alias(c) for c in metadata or []],
    )
    bullet = F.transform(
        "h",
        lambda x: F.concat(
            F.lit("- "),
            F.regexp_replace(
                F.regexp_replace(x[EXTRACTION], r"(?U)\s+", " "), "^ | $", ""
            ),
        ),
    )
    return grouped.select(
        id_col,
        F.array_join(bullet, "\n").alias(EXTRACTION),
        *[F.col(f"h.{c}").alias(c) for c in listed],
        *(metadata or []),
        *(["copies"] if merge_copies else []),
    )
