"""Spans in native expressions: where matches stand, overlap, splice and counts. Offsets are code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def once(value: Column, then) -> Column:
    """then(value) with value worked out once, however often `then` uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: Matches whose places are worked out in one fold; a fold copies what it has at each step.
_FOLD = 256


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost matches that don't overlap; the pattern never matches nothing.

    Between matches stand the pieces of a split; running lengths of pieces and matches give the places, inside runs of _FOLD
    matches first and then over the runs, so that long texts take little more than linear time.
    """
    shape = "array<struct<start:int,end:int,value:string>>"
    nothing, found, pieces = F.array().cast(shape), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    gaps = F.filter(F.zip_with(found, pieces, lambda m, p: F.struct(m.alias("value"), F.length(p).alias("gap"), F.length(m).alias("size"))), lambda x: x["value"].isNotNull())
    end = lambda a, x: a["at"] + x["gap"] + x["size"]
    step = lambda a, x: F.struct(end(a, x).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), end(a, x).alias("end"), x["value"].alias("value")))).alias("out"))
    runs = once(gaps, lambda all_: F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(_FOLD)), lambda k: F.aggregate(F.slice(all_, k, F.lit(_FOLD)), F.struct(F.lit(0).alias("at"), nothing.alias("out")), step)))
    moved = lambda a, s: F.struct((s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end"), s["value"].alias("value"))
    join = lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(x["out"], lambda s: moved(a, s)))).alias("out"))
    placed = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{shape}>").alias("out")), join, lambda a: F.flatten(a["out"]))
    return F.when(text.isNull() | ~text.rlike(pattern), nothing).otherwise(placed)


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def first_of_overlapping(spans: Column, kind: str) -> Column:
    """Of sorted spans, those that begin at or after the end of the last one kept."""
    step = lambda kept, s: F.when(F.size(kept) == 0, F.array(s)).when(s["start"] >= F.element_at(kept, -1)["end"], F.concat(kept, F.array(s))).otherwise(kept)
    return F.aggregate(spans, F.array().cast(f"array<{kind}>"), step)


def splice(text: Column, spans: Column, by: str = "token") -> Column:
    """The text with each of the sorted, disjoint spans replaced by its field `by`."""
    step = lambda a, s: F.struct(s["end"].cast("int").alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"].cast("int") - a["at"]), s[by]).alias("out"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def utf16(text: Column, at: Column) -> Column:
    """A code-point offset as UTF-16 units."""
    before = F.substr(text, F.lit(1), at.cast("int"))
    return F.length(before) + F.regexp_count(before, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def from_utf16(text: Column, units: Column) -> Column:
    """An offset in UTF-16 units as a code-point offset; null outside the text and between the halves of a character."""
    wide = F.transform(matches(text, r"[\x{10000}-\x{10FFFF}]"), lambda m, k: m["start"] + k)  # where each begins, in units
    before = F.size(F.filter(wide, lambda w: w + 2 <= units))
    split = F.exists(wide, lambda w: w + 1 == units)
    return F.when((units >= 0) & (units <= F.length(text) + F.size(wide)) & ~split, units - before)
