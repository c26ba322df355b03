"""Name banks from public registers: counts by name over cities, tiers, ranks and genders; and the checks a bank must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import without_marks


def given_names(registers: DataFrame, least_share: float = 0.20) -> DataFrame:
    """registers: city, name, count, gender (m, w). -> name, count, cities, tier, gender, rank.

    Tier 1 from three cities, 2 from two, else 3. A gender counts with a fifth of the bearers; both or none is u.
    """
    g = registers.where(F.col("name").isNotNull()).groupBy("name").agg(F.sum("count").alias("count"), F.count_distinct("city").alias("cities"), F.sum(F.when(F.col("gender") == "m", F.col("count")).otherwise(0)).alias("m"), F.sum(F.when(F.col("gender") == "w", F.col("count")).otherwise(0)).alias("w"))
    share = lambda c: F.col(c) / F.col("count") >= least_share
    gender = F.when(share("m") & ~share("w"), "m").when(share("w") & ~share("m"), "w").otherwise("u")
    tier = F.when(F.col("cities") >= 3, 1).when(F.col("cities") == 2, 2).otherwise(3)
    return ranked(g.select("name", "count", "cities", tier.alias("tier"), gender.alias("gender")))


def family_names(bearers: DataFrame, known: DataFrame | None = None, tier_one: int = 10) -> DataFrame:
    """bearers: a row a person with a family name; known: names to leave out."""
    n = bearers.where(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("count"))
    if known is not None:
        n = n.join(known.select("name"), "name", "left_anti")
    return ranked(n.withColumn("tier", F.when(F.col("count") >= tier_one, 1).otherwise(2)))


def ranked(names: DataFrame, buckets: int = 64) -> DataFrame:
    """Adds rank by count, ties by name: a rank inside ranges of counts plus the names of the ranges above, so no task
    sees all names."""
    cut = names.withColumn("range", F.floor(F.log2(F.col("count") + 1) * 4).cast("int"))
    sizes = cut.groupBy("range").agg(F.count("*").alias("n"))  # a row a quarter power of two: some hundred at most
    above = sizes.select("range", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("range"))) - F.col("n")).alias("above"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("count"), "name"))
    return cut.withColumn("inside", inside).join(F.broadcast(above), "range").withColumn("rank", (F.col("above") + F.col("inside")).cast("int")).drop("range", "inside", "above")


def library_genders(male: DataFrame, female: DataFrame) -> DataFrame:
    """A name in both lists is u (intersection)."""
    both = male.select("name").intersect(female.select("name"))
    tag = lambda d, g: d.select("name").distinct().join(both, "name", "left_anti").withColumn("gender", F.lit(g))
    return tag(male, "m").union(tag(female, "w")).union(both.withColumn("gender", F.lit("u")))


def bank_faults(bank: DataFrame) -> DataFrame:
    """Rows of a bank that break its rules: blank or numeric names, and tiers that their cities don't give."""
    bad: Column = F.when(F.trim("name") == "", "blank").when(F.col("name").rlike("[0-9]"), "digits").when((F.col("cities") >= 3) != (F.col("tier") == 1), "tier")
    return bank.withColumn("fault", bad).where(F.col("fault").isNotNull())


def loaded(bank_lines: DataFrame, tiers: tuple[int, ...] = (1,), marks: bool = True) -> DataFrame:
    """From a bank's lines (value): name, type of rows in the loaded tiers; comments and the header are passed. Without marks
    Arabic names lose their vowel marks and lengthening, as words of a text do before they are looked up."""
    cells = F.split("value", ",")
    last = F.element_at(cells, -1)
    rows = bank_lines.where(~F.col("value").startswith("#") & (F.trim("value") != "") & ~F.lower(F.col("value")).startswith("name,"))
    keep = ~F.trim(last).rlike("^[0-9]{1,3}$") | F.trim(last).cast("string").isin(*map(str, tiers))
    return rows.where((F.size(cells) >= 2) & keep).select((F.lower(F.trim(cells[0])) if marks else without_marks(F.lower(F.trim(cells[0])))).alias("name"), F.trim(cells[1]).alias("type")).distinct()
