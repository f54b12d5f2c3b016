"""Short function-word lists and language defaults."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LANGUAGE = "en"
NO_WORD_BOUNDARY = ("zh", "ja", "ko")

# Our own lists of the most common function words, one string per language.
WORDS = {
    "en": "a about after all also an and any are as at be been but by can could did do does for "
    "from had has have he her him his how i if in into is it its just me more most my no not of "
    "on one only or other our out over she so some such than that the their them then there "
    "these they this those to up was we were what when which who will with would you your",
    "es": "a al algo antes como con cuando de del desde donde el ella ellas ellos en entre era es "
    "ese eso esta este esto ha han hasta hay la las le les lo los mas me mi muy no nos o para "
    "pero por porque que se ser si sin sobre son su sus te todo tu un una uno y ya yo",
    "fr": "a au aux avec ce ces cette comme dans de des du elle elles en entre est et eux il ils "
    "je la le les leur lui ma mais me mes mon ne nos notre nous on ont ou par pas plus pour qu "
    "que qui sa sans se ses si son sont sur ta te tes toi ton tu un une vos votre vous y",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein "
    "eine einem einen einer er es für hat hatte ich ihr im in ist ja kann mit nach nicht noch "
    "nur oder sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird "
    "zu zum zur",
    "zh": "的 了 和 是 在 我 有 他 这 中 大 来 上 个 到 说 们 为 子 你 地 就 也 不 她 那 要 会 着 都",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や など なっ ない この",
    "ko": "이 그 저 것 수 등 들 및 에서 그리고 그러나 하지만 또는 있다 없다 하다 되다 을 를 은 는 가 의 에",
}
ALIASES = {
    "english": "en",
    "spanish": "es",
    "french": "fr",
    "german": "de",
    "chinese": "zh",
    "japanese": "ja",
    "korean": "ko",
}


def clean_words(words: str | Iterable[object] | None) -> list[str]:
    """Trimmed, non-empty, first occurrence kept, order kept."""
    if words is None:
        return []
    items = [words] if isinstance(words, str) else list(words)
    trimmed = (str(w).strip() for w in items)
    return list(dict.fromkeys(w for w in trimmed if w))


def default_stop_words(language: str | None = None, strict: bool = False) -> list[str]:
    """The list of a language; unknown ones give English, or nothing if strict."""
    code = (language or DEFAULT_LANGUAGE).strip().lower()
    code = ALIASES.get(code, code)
    if code not in WORDS:
        if strict:
            return []
        code = DEFAULT_LANGUAGE
    return clean_words(WORDS[code].split())


def stop_word_table(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    """A one-column table of lower-cased words."""
    rows = [(w.lower(),) for w in clean_words(words)]
    return spark.createDataFrame(rows, "token string").distinct()


def language_column(requested: str | None, column: Column | None = None) -> Column:
    """Language per row: the request, else the row's own code, else English."""
    wanted = (requested or "").strip().lower() or None
    found = F.lit(None).cast("string")
    if column is not None:
        found = F.nullif(F.lower(F.trim(column)), F.lit(""))
    return F.coalesce(F.lit(wanted).cast("string"), found, F.lit(DEFAULT_LANGUAGE))


def require_language(tool: str, language: str, supported: tuple[str, ...] = ("en",)) -> None:
    if language not in supported:
        raise ValueError(f"{tool} supports {', '.join(supported)}, not {language!r}")
