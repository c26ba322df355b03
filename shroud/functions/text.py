"""Text primitives as Column functions; native but for those whose name says Arrow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..operators.vault import nfc

# Characters that a reader doesn't see.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\ufeff"
ARABIC_MARKS = "[\u064b-\u0652\u0670\u0640\u0653-\u0655]"
__all__ = ["nfc"]


def visible(text: Column) -> Column:
    """Without invisible characters (not yet composed)."""
    return F.translate(text, INVISIBLE, "")


def as_a_person_reads_it(text: Column) -> Column:
    """Without invisible characters and composed; text that is ASCII takes no Python pass worth naming."""
    return nfc(visible(text))


def their_own_word(text: Column) -> Column:
    return F.concat(F.lit("\u2068"), text, F.lit("\u2069"))


def without_marks(text: Column) -> Column:
    """Arabic without vowel marks and lengthening."""
    return F.regexp_replace(text, ARABIC_MARKS, "")


def display_share(text: Column) -> Column:
    """Percent of Arabic letters in presentation forms; null under 8 of them."""
    shown = F.regexp_count(text, F.lit("[\ufb50-\ufdff\ufe70-\ufeff]"))
    every = shown + F.regexp_count(text, F.lit("[\u0600-\u06ff]"))
    return F.when(every >= 8, F.floor(shown * 100 / every).cast("long"))


def words(text: Column) -> Column:
    """Words with the marks at their edges trimmed; those that are only marks go."""
    trimmed = F.transform(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+$", ""))
    return F.filter(trimmed, lambda w: w != "")


def plain_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def cells(line: Column) -> Column:
    """The cells of a line: a tab or two spaces part them."""
    return F.regexp_extract_all(line, F.lit("[^\t ]+(?: [^\t ]+)*"), F.lit(0))


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def day_of(seconds: Column) -> Column:
    """An epoch second as a civil date in UTC; years of five digits stand without the sign that the formatter sets before them."""
    return F.regexp_replace(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd"), r"^\+", "")


def capitalised_word_before(text: Column, start: Column) -> Column:
    """The word before an offset across exactly one space, if it has two letters and a capital first; else empty."""
    return F.regexp_extract(F.substr(text, F.lit(1), start.cast("int")), r"(?:^|\s)(\p{Lu}[^\s]+) $", 1)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def occurrences_arrow(text: pd.Series, needle: pd.Series) -> pd.Series:
    """Places of a value in any case, as a word of its own (Arrow)."""
    from ..operators.kernel import occurrences

    return pd.Series([[{"start": a, "end": z} for a, z in occurrences(t or "", n or "")] for t, n in zip(text, needle, strict=True)])
