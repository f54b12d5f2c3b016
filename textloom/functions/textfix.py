"""Repair of UTF-8 text that was once read as Windows-1252 or Latin-1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.spans import let

# The signature of broken text, and the characters Windows-1252
# puts where Latin-1 has control codes.
GATE = "â€|Ã[\\x80-\\xbf]|Â[\\xa0-\\xbf]"
CP1252_SPECIALS = {
    "€": 0x80, "‚": 0x82, "ƒ": 0x83, "„": 0x84, "…": 0x85, "†": 0x86, "‡": 0x87, "ˆ": 0x88,
    "‰": 0x89, "Š": 0x8A, "‹": 0x8B, "Œ": 0x8C, "Ž": 0x8E, "‘": 0x91, "’": 0x92, "“": 0x93,
    "”": 0x94, "•": 0x95, "–": 0x96, "—": 0x97, "˜": 0x98, "™": 0x99, "š": 0x9A, "›": 0x9B,
    "œ": 0x9C, "ž": 0x9E, "Ÿ": 0x9F,
}
# The gate sees Windows-1252 readings too, where the second byte is a special.
WIDE_GATE = GATE + "|Ã[" + "".join(CP1252_SPECIALS) + "]"


_AFTER = "[\\x80-\\xBF" + "".join(CP1252_SPECIALS) + "]"
SEQUENCE = f"[\\xC2-\\xDF]{_AFTER}|[\\xE0-\\xEF]{_AFTER}{{2}}|[\\xF0-\\xF4]{_AFTER}{{3}}"


def _mapped(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with every match of ``pattern`` changed."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    rest = F.split(text, pattern, -1)
    both = F.zip_with(rest, found, lambda r, f: F.concat(r, F.coalesce(f, F.lit(""))))
    return F.array_join(both, "")


def repair_mojibake(text: Column) -> Column:
    """Undo one wrong reading in texts with the signature, sequence by sequence.

    A sequence is a run of characters whose Latin-1 or Windows-1252 bytes look
    like one UTF-8 character; it is replaced if they are one. All else stays.
    """
    specials = "".join(CP1252_SPECIALS)
    controls = "".join(chr(code) for code in CP1252_SPECIALS.values())

    def reread(run: Column) -> Column:
        raw = F.encode(F.translate(run, specials, controls), "ISO-8859-1").cast("string")
        return let(raw, lambda t: F.when(F.is_valid_utf8(t), t).otherwise(run))

    return F.when(text.rlike(WIDE_GATE), _mapped(text, SEQUENCE, reread)).otherwise(text)


def composed(text: Column) -> Column:
    """The text in canonical composition (NFC), for all of Unicode.

    Only texts with a character from U+0300 on can change; the others are passed
    on as they are. The rest goes through the normaliser that Spark ships for its
    collations.
    """
    nfc = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False)
    )
    return F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), nfc).otherwise(text)


def repair_text_columns(
    df: DataFrame, columns: list[str] | None = None, passes: int = 2
) -> DataFrame:
    """Repair every string column, or the named ones that are strings.

    A second pass repairs texts that were misread twice; then letters and marks are composed.
    """
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)
    ]
    for _ in range(passes if names else 0):
        df = df.withColumns({n: repair_mojibake(F.col(f"`{n}`")) for n in names})
    return df.withColumns({n: composed(F.col(f"`{n}`")) for n in names}) if names else df
