"""Token frequencies and keyness of a study corpus against a reference."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.spans import quote_literal
from textloom.functions.stopwords import stop_word_table
from textloom.operators.tokens import find_derived, token_words

# The critical values of log-likelihood.
STARS = ((15.13, "****"), (10.83, "***"), (6.63, "**"), (3.84, "*"))


def token_rows(df: DataFrame, text_col: str, model: str = "word") -> DataFrame:
    """All tokens of a corpus, one per row: from its token column, else its text."""
    name = find_derived(df, text_col, model=model)
    if name:
        words = F.transform(F.col(f"`{name}`"), lambda t: t["token"])
    else:
        words = token_words(F.col(text_col), model)
    return df.select(F.explode(words).alias("token")).filter(F.col("token").isNotNull())


def token_frequencies(df: DataFrame, text_col: str, model: str = "word") -> DataFrame:
    """Token counts. Frequent tokens collapse inside every task before the shuffle."""
    return (
        token_rows(df, text_col, model)
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def check_request(corpora: int, limit: int) -> None:
    if not 1 <= corpora <= 2:
        raise ValueError("one or two corpora can be compared")
    if limit < 1:
        raise ValueError("the token limit is positive")


def top_tokens(frequencies: DataFrame, limit: int = 25) -> DataFrame:
    """The ``limit`` most frequent tokens, equal ones in the order of their text."""
    check_request(1, limit)
    return frequencies.orderBy(F.desc("frequency"), F.asc("token")).limit(limit)


def compare_corpora(corpora: list[DataFrame], text_col: str, limit: int) -> DataFrame:
    """The strongest tokens of a request: the most frequent of one corpus, or the keyness of two.

    Of two corpora the first is the reference; equal tokens come in the order of
    their text. A request for other numbers of corpora, or for no token, is refused.
    """
    check_request(len(corpora), limit)
    if len(corpora) == 1:
        return top_tokens(token_frequencies(corpora[0], text_col), limit)
    scored = keyness(*[token_rows(c, text_col) for c in corpora])
    return scored.orderBy(F.desc("log_likelihood_llv"), F.asc("token")).limit(limit)


def without_stop_words(df: DataFrame, words: list[str]) -> DataFrame:
    """Drop rows of stop words after all statistics are done."""
    if not words:
        return df
    stop = stop_word_table(df.sparkSession, words).withColumnRenamed("token", "__stop")
    return df.join(stop, F.lower("token") == F.col("__stop"), "left_anti")


def keyness(reference: DataFrame, study: DataFrame) -> DataFrame:
    """Keyness of every token in two token-row tables.

    Both corpora are counted in one aggregation. Ratios without a finite value
    are plus or minus infinity, undefined ones null.
    """
    tagged = reference.select("token", F.lit(0).alias("c")).unionAll(
        study.select("token", F.lit(1).alias("c"))
    )
    return keyness_statistics(
        tagged.groupBy("token").agg(
            F.count_if(F.col("c") == 0).alias("freq_reference"),
            F.count_if(F.col("c") == 1).alias("freq_study"),
        )
    )


def keyness_of_counts(reference: DataFrame, study: DataFrame) -> DataFrame:
    """``keyness`` from two frequency tables (token, frequency)."""
    tagged = reference.select("token", "frequency", F.lit(0).alias("c")).unionAll(
        study.select("token", "frequency", F.lit(1).alias("c"))
    )

    def of(c: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("c") == c, F.col("frequency"))), F.lit(0))

    return keyness_statistics(
        tagged.groupBy("token").agg(of(0).alias("freq_reference"), of(1).alias("freq_study"))
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """Division with infinities; zero by zero is null."""
    infinite = F.when(top > 0, F.lit(float("inf"))).when(top < 0, F.lit(float("-inf")))
    return F.when(bottom != 0, top / bottom).otherwise(infinite)


def keyness_statistics(counts: DataFrame) -> DataFrame:
    """Add the statistics to (token, freq_reference, freq_study)."""
    sizes = counts.agg(
        F.struct(
            F.sum("freq_reference").cast("bigint").alias("reference"),
            F.sum("freq_study").cast("bigint").alias("study"),
        )
    ).scalar()
    totals = counts.withColumns(
        {"reference_total": sizes["reference"], "study_total": sizes["study"]}
    )
    o1, o2 = F.col("freq_reference").cast("double"), F.col("freq_study").cast("double")
    c1, c2 = F.col("reference_total").cast("double"), F.col("study_total").cast("double")
    expected = totals.withColumns(
        {
            "expected_reference": c1 * (o1 + o2) / (c1 + c2),
            "expected_study": c2 * (o1 + o2) / (c1 + c2),
            "__nf1": F.when(c1 > 0, o1 / c1).otherwise(F.lit(0.0)),
            "__nf2": F.when(c2 > 0, o2 / c2).otherwise(F.lit(0.0)),
        }
    )
    e1, e2 = F.col("expected_reference"), F.col("expected_study")
    nf1, nf2 = F.col("__nf1"), F.col("__nf2")

    def term(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.ln(o / e)).otherwise(F.lit(0.0))

    scored = expected.withColumn("log_likelihood_llv", 2 * (term(o1, e1) + term(o2, e2)))
    ll, n = F.col("log_likelihood_llv"), c1 + c2
    stars = F.lit("")
    for value, mark in reversed(STARS):
        stars = F.when(ll >= value, F.lit(mark)).otherwise(stars)
    least = F.least(e1, e2)
    log_ratio = (
        F.when((nf1 > 0) & (nf2 > 0), F.log2(nf2 / nf1))
        .when(nf2 > 0, F.lit(float("inf")))
        .when(nf1 > 0, F.lit(float("-inf")))
    )
    return scored.select(
        "token",
        "freq_reference",
        "freq_study",
        "expected_reference",
        "expected_study",
        "reference_total",
        "study_total",
        (nf1 * 100).alias("percent_reference"),
        (nf2 * 100).alias("percent_study"),
        (_ratio(nf2 - nf1, nf1) * 100).alias("percent_diff"),
        ll.alias("log_likelihood_llv"),
        (ll - F.ln(n)).alias("bayes_factor_bic"),
        F.when(least > 0, _ratio(ll, n * F.ln(least))).alias("effect_size_ell"),
        _ratio(nf1, nf2).alias("relative_risk"),
        log_ratio.alias("log_ratio"),
        _ratio(o1 * (c2 - o2), o2 * (c1 - o1)).alias("odds_ratio"),
        stars.alias("significance"),
    )


RATIOS = [
    "percent_diff",
    "effect_size_ell",
    "relative_risk",
    "log_ratio",
    "odds_ratio",
]


def spelled_infinities(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Ratio columns as text, with +Inf and -Inf spelled out and NaN as null."""
    def shown(name: str) -> Column:
        value = F.nanvl(F.col(name), F.lit(None).cast("double"))
        return (
            F.when(value == float("inf"), F.lit("+Inf"))
            .when(value == float("-inf"), F.lit("-Inf"))
            .otherwise(value.cast("string"))
        )

    return df.withColumns({c: shown(c) for c in columns or RATIOS})


def wildcard(df: DataFrame, pattern: str) -> DataFrame:
    """Keep tokens matching a pattern in which ``*`` stands for any characters."""
    body = ".*".join(quote_literal(p) for p in re.split(r"\*+", pattern))
    return df.filter(F.col("token").rlike(f"(?isU)^{body}$"))


def contrast(statistics: DataFrame) -> DataFrame:
    """Add the contrast score of tokens that occur in both corpora."""
    both = statistics.filter((F.col("freq_reference") > 0) & (F.col("freq_study") > 0))
    joint = (F.col("freq_reference") + F.col("freq_study")).cast("double")
    return both.withColumn("score", F.log10(joint) * F.col("log_ratio"))
