"""Overlaps of intervals of one document, by sweeping instead of pairing.

An interval overlaps one of the others where the largest end among those that start before its own end lies beyond its
start. So both sides are put in one order (others by their start, own ones by their end) and a running maximum of ends
answers all of them: n log n for n intervals, however many overlap. The order is cut into bins of positions, and
bins pass the maximum of all before them on, as one more row of the order, so a document with very many intervals is many tasks
and intervals are shuffled and sorted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Positions of a bin.
BIN = 1 << 16


def marked(own: DataFrame, other: DataFrame, keys: list[str], out_col: str = "touched", start: str = "start", end: str = "end", bin_: int = BIN) -> DataFrame:
    """own with a boolean: whether an interval of other with equal keys overlaps (own.start < other.end and other.start < own.end).

    Keys that are null are equal to null; an interval without a start or end touches nothing.
    """
    row = F.struct(*own.columns)
    mine = own.select(*keys, F.col(end).cast("long").alias("at__"), F.lit(0).alias("side__"), F.lit(None).cast("long").alias("far__"), F.col(start).cast("long").alias("from__"), row.alias("row__"))
    none = F.lit(None).cast(mine.schema["row__"].dataType)
    theirs = other.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.col(start).cast("long").alias("at__"), F.lit(1).alias("side__"), F.col(end).cast("long").alias("far__"), F.lit(None).cast("long").alias("from__"), none.alias("row__"))
    bin_of = F.floor(F.coalesce("at__", F.lit(0)) / bin_).alias("bin__")
    both = mine.union(theirs).select("*", bin_of)
    stops = mine.select(*keys, bin_of, "far__").distinct().union(theirs.select(*keys, bin_of, "far__")).groupBy(*keys, "bin__").agg(F.max("far__").alias("far__"))
    past = F.max("far__").over(Window.partitionBy(*keys).orderBy("bin__").rowsBetween(Window.unboundedPreceding, -1))  # a row a bin
    before = stops.select(*keys, F.lit(None).cast("long").alias("at__"), F.lit(-1).alias("side__"), past.alias("far__"), F.lit(None).cast("long").alias("from__"), none.alias("row__"), "bin__").where("far__ IS NOT NULL")
    inside = Window.partitionBy(*keys, "bin__").orderBy("at__", "side__")  # bins before come first; an own end stands before others that start there
    swept = both.union(before).withColumn("near__", F.max("far__").over(inside.rowsBetween(Window.unboundedPreceding, -1))).where("side__ = 0")
    reach = (F.col("near__") > F.col("from__")) & F.col("at__").isNotNull()
    return swept.select("row__", F.coalesce(reach, F.lit(False)).alias("hit__")).select("row__.*", F.col("hit__").alias(out_col))


def touching(own: DataFrame, other: DataFrame, keys: list[str], **names) -> DataFrame:
    """Rows of own that an interval of other overlaps (semi-join)."""
    return marked(own, other, keys, "hit__", **names).where("hit__").drop("hit__")


def untouched(own: DataFrame, other: DataFrame, keys: list[str], **names) -> DataFrame:
    """Rows of own that none overlaps (anti-join)."""
    return marked(own, other, keys, "hit__", **names).where("NOT hit__").drop("hit__")
