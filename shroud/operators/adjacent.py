"""What stands beside a word, as arrays: no Python and no shuffle.

A text's words are one array with their places and the space before each. A neighbour is the same array moved by one, put
beside it by zip_with, so lag and lead take a step a word; "among the words before it on its line" is as many moves as words
may lie between. Where patterns can tell the words, only those places are looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .spans import matches, once

#: What separates words.
SPACE = " \\t\\n\\r\\f"
_SHAPE = "struct<start:int,end:int,value:string,gap:string>"
Test = Callable[[Column], Column]


def words(text: Column) -> Column:
    """array<struct<start, end, value, gap>>: gap is the space before the word. A null text has none."""
    gaps = F.split(text, f"[^{SPACE}]+", -1)
    made = F.zip_with(matches(text, f"[^{SPACE}]+"), gaps, lambda w, g: F.when(w.isNotNull(), F.struct(w["start"].alias("start"), w["end"].alias("end"), w["value"].alias("value"), g.alias("gap"))))
    return F.coalesce(F.filter(made, lambda w: w.isNotNull()), F.array().cast(f"array<{_SHAPE}>"))


def moved(array: Column, by: int, shape: str) -> Column:
    """The array with each element where the one `by` places further on stood (before: by < 0); null where there is none."""
    none = F.array_repeat(F.lit(None).cast(shape), F.least(F.lit(abs(by)), F.size(array)))
    rest = F.greatest(F.size(array) - abs(by), F.lit(0))
    return F.concat(F.slice(array, F.lit(by + 1), rest), none) if by > 0 else F.concat(none, F.slice(array, F.lit(1), rest))


def breaks(word: Column) -> Column:
    """Whether a word begins a line."""
    return F.coalesce(word["gap"].contains("\n") | word["gap"].contains("\f"), F.lit(True))


def pairs(words_: Column, first: Test, second: Test) -> Column:
    """array<struct<a, b>> of words that pass `first` and whose next word on the line passes `second`."""
    beside = once(words_, lambda w: F.zip_with(w, moved(w, 1, _SHAPE), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    return F.filter(beside, lambda p: F.coalesce(first(p["a"]) & ~breaks(p["b"]) & second(p["b"]), F.lit(False)))


def led_by(words_: Column, test: Test, lead: Test, back: int = 6) -> Column:
    """The words that pass `test` and have one that passes `lead` among the `back` words before them on their line."""

    def near(facts: Column) -> Column:
        out = F.transform(facts, lambda x: F.struct(F.lit(False).alias("near"), (~x["breaks"]).alias("open")))
        for k in range(1, back + 1):
            before = moved(facts, -k, "struct<leads:boolean,breaks:boolean>")
            out = F.zip_with(out, before, lambda n, p: F.struct((n["near"] | (n["open"] & F.coalesce(p["leads"], F.lit(False)))).alias("near"), (n["open"] & ~F.coalesce(p["breaks"], F.lit(True))).alias("open")))
        return out

    facts = F.transform(words_, lambda w: F.struct(F.coalesce(lead(w), F.lit(False)).alias("leads"), breaks(w).alias("breaks")))
    found = F.zip_with(words_, once(facts, near), lambda w, n: F.when(n["near"] & test(w), w))
    return F.filter(found, lambda w: w.isNotNull())


#: What parts two words of a line.
_ON_LINE = "[ \\t\\r]+"
_BEGINS, _ENDS = f"(?<![^{SPACE}])", f"(?![^{SPACE}])"


def pairs_like(text: Column, first: str, second: str) -> Column:
    """array<struct<start, end, value, next>>: pairs() for words that patterns can tell. One search for the pairs themselves, so what
    it costs hangs on them and not on all the words."""
    text = F.coalesce(text, F.lit(""))
    pattern = f"{_BEGINS}(?:{first})(?={_ON_LINE}((?:{second})){_ENDS})"
    next_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.zip_with(matches(text, pattern), next_, lambda m, b: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), b.alias("next")))


def led_like(text: Column, word: str, lead: str, back: int = 6) -> Column:
    """array<struct<start, end, value>>: led_by() for words that patterns can tell. Words are looked for only behind those that lead."""
    text = F.coalesce(text, F.lit(""))
    pattern = f"{_BEGINS}(?:{lead}){_ENDS}(?=((?:{_ON_LINE}[^{SPACE}]+){{1,{back}}}))"
    behind = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    moved_ = lambda by, w: F.struct((w["start"] + by).alias("start"), (w["end"] + by).alias("end"), w["value"].alias("value"))
    each = F.zip_with(matches(text, pattern), behind, lambda m, s: F.transform(matches(s, f"{_BEGINS}(?:{word}){_ENDS}"), lambda w: moved_(m["end"], w)))
    return F.array_distinct(F.flatten(each))
