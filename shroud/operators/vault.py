"""Known values as tables: entities, values, aliases, lists, names, exceptions, blocks; views and changes over them.

Every view is DataFrame joins: an equi-join on the spelling in NFC, anti-joins for exemptions, and the scope rule: a row
without a profile is always in, one with a profile only while that profile is active.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .staging import kept

SCHEMAS = {
    "entities": "entity_id int, kind string, label string, profile_id string",
    "values": "value_id int, entity_id int, kind string, value string, policy string, learned_at long, list string",
    "aliases": "value_id int, alias string",
    "lists": "name string, enabled boolean",
    "names": "lang string, name string, type string, profile_id string, list string",
    "exceptions": "id int, kind string, value string, profile_id string",
    "label_rules": "id string, label string, kind string, profile_id string",
    "blocks": "block_id int, kind string, value string, tokens array<string>",
    "block_exemptions": "block_id int, reach string, ref string",
}


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no function for it. Arrow batches; ASCII passes at once."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


def in_scope(profile: str | None, col: str = "profile_id") -> Column:
    return F.col(col).isNull() | (F.col(col) == F.lit(profile)) if profile is not None else F.col(col).isNull()


def spellings(values: DataFrame, aliases: DataFrame) -> DataFrame:
    """value_id, spelling: a value's own text and its aliases."""
    return values.select("value_id", F.col("value").alias("spelling")).union(aliases.select("value_id", "alias")).where(F.trim("spelling") != "").distinct()


def hints(entities: DataFrame, values: DataFrame, aliases: DataFrame, lists: DataFrame, blocks: DataFrame, exemptions: DataFrame, profile: str | None = None, conversation: str | None = None) -> DataFrame:
    """spelling, kind, policy, entity_id of all that a scan should know, longest first.

    A list never registered counts as enabled. Blocks are Always, share one entity (-1), give way to a value of the same
    spelling, and skip those exempted everywhere, or for this conversation or profile.
    """
    live = values.where(F.col("policy") != "Manual").join(entities.where(in_scope(profile)).select("entity_id"), "entity_id").join(lists.select(F.col("name").alias("list"), "enabled"), "list", "left").where(F.coalesce("enabled", F.lit(True)))
    known = live.join(spellings(values, aliases), "value_id").select(nfc("spelling").alias("spelling"), "kind", "policy", "entity_id")
    free = blocks.join(exemptions.where((F.col("reach") == "everywhere") | ((F.col("reach") == "conversation") & (F.col("ref") == F.lit(conversation))) | ((F.col("reach") == "profile") & (F.col("ref") == F.lit(profile)))), "block_id", "left_anti")
    more = free.select(nfc("value").alias("spelling"), "kind", F.lit("Always").alias("policy"), F.lit(-1).alias("entity_id")).join(known.select("spelling"), "spelling", "left_anti")
    return known.unionByName(more).distinct().orderBy(F.desc(F.octet_length("spelling")), "spelling", "entity_id")


def claims(hint_table: DataFrame) -> DataFrame:
    """What scan.scan() takes: a row a spelling in NFC, the kind of its least entity, its entities, and sure: one entity claims it,
    Always in one row at least. Manual ones are left out."""
    live = hint_table.where(F.col("policy") != "Manual").withColumn("spelling", nfc("spelling"))
    owners = F.array_sort(F.collect_set("entity_id"))
    return live.groupBy("spelling").agg(F.min_by("kind", F.struct("entity_id", "kind")).alias("kind"), ((F.min("entity_id") == F.max("entity_id")) & F.max(F.col("policy") == "Always")).alias("sure"), owners.alias("entities"))


def conflicts(hint_table: DataFrame) -> DataFrame:
    """Spellings that more than one entity claims."""
    return hint_table.groupBy("spelling").agg(F.count_distinct("entity_id").alias("claimants")).where("claimants > 1")


def taught_names(names: DataFrame, lists: DataFrame, profile: str | None = None) -> DataFrame:
    enabled = names.where(in_scope(profile)).join(lists.select(F.col("name").alias("list"), "enabled"), "list", "left").where(F.coalesce("enabled", F.lit(True)))
    return enabled.select("lang", F.lower("name").alias("name"), "type").distinct()


def search(entities: DataFrame, values: DataFrame, aliases: DataFrame, needle: str) -> DataFrame:
    """Entities whose label or a spelling holds the needle, in any case."""
    n = F.lower(F.lit(unicodedata.normalize("NFC", needle)))
    by_spelling = values.join(spellings(values, aliases), "value_id").where(F.lower(nfc("spelling")).contains(n)).select("entity_id")
    by_label = entities.where(F.lower(nfc("label")).contains(n)).select("entity_id")
    return entities.join(by_spelling.union(by_label).distinct(), "entity_id", "left_semi")


def forget_plan(entities: DataFrame, values: DataFrame, aliases: DataFrame, spelling: str) -> DataFrame:
    """What forgetting a spelling's values takes: a row a value, its aliases, whether its entity empties, and how many other
    values still know one of its spellings (a self-join on spellings)."""
    all_ = spellings(values, aliases).withColumn("s", nfc("spelling"))
    gone = all_.where(F.col("s") == F.lit(unicodedata.normalize("NFC", spelling))).select("value_id").distinct()
    mine = all_.join(gone, "value_id", "left_semi")
    others = all_.join(gone, "value_id", "left_anti").select("s", F.col("value_id").alias("other"))
    still = mine.join(others, "s").groupBy("value_id").agg(F.count_distinct("other").alias("still_known_by"))
    n_alias = aliases.groupBy("value_id").agg(F.count("*").alias("aliases"))
    left = values.join(gone, "value_id", "left_anti").select("entity_id").distinct().withColumn("stays", F.lit(True))
    plan = values.join(gone, "value_id", "left_semi").join(n_alias, "value_id", "left").join(still, "value_id", "left").join(left, "entity_id", "left").join(entities.select("entity_id", "profile_id"), "entity_id", "left")
    return plan.select("value_id", "entity_id", "profile_id", F.coalesce("aliases", F.lit(0)).alias("aliases"), F.col("stays").isNull().alias("entity_empties"), F.coalesce("still_known_by", F.lit(0)).alias("still_known_by"))


def policy_summary(values: DataFrame) -> DataFrame:
    """By entity: counts by policy and a line of text."""
    n = {p: F.count_if(F.col("policy") == p) for p in ("Always", "Suggest", "Manual")}
    out = values.groupBy("entity_id").agg(*[c.alias(p.lower()) for p, c in n.items()])
    said = F.concat_ws(" · ", *[F.when(F.col(p) > 0, F.concat_ws(" ", F.col(p), F.lit(p))) for p in ("always", "suggest", "manual")])
    return out.withColumn("summary", said)


def list_sizes(lists: DataFrame, names: DataFrame, values: DataFrame) -> DataFrame:
    """By list: names (person and company values among them) and other values."""
    from_names = names.groupBy("list").agg(F.count("*").alias("taught"))
    from_values = values.groupBy("list").agg(F.count_if(F.col("kind").isin("Person", "Company")).alias("named"), F.count_if(~F.col("kind").isin("Person", "Company")).alias("other"))
    z = F.lit(0)
    met = lists.select(F.col("name").alias("list"), "enabled").join(from_names, "list", "full").join(from_values, "list", "full").where(F.col("list").isNotNull())
    return met.select("list", F.coalesce("enabled", F.lit(True)).alias("enabled"), (F.coalesce("taught", z) + F.coalesce("named", z)).alias("names"), F.coalesce("other", z).alias("values")).orderBy("list")


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Adds 1, 2, … in the order of a column whose values differ: rows are dealt out by sampled ranges, and a number is the place in
    its range plus the rows of the ranges before, so no task sees all rows however alike the values begin."""
    dealt = rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("part__", F.spark_partition_id()).withColumn("at__", F.monotonically_increasing_id())
    dealt = kept(dealt, "numbered")
    ranges = dealt.groupBy("part__").agg(F.count("*").alias("n__"), F.min("at__").alias("first__"))  # a row a range
    before = F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1))
    above = ranges.select("part__", (F.coalesce(before, F.lit(0)) - F.col("first__") + 1).alias("above__"))
    return dealt.join(above, "part__").withColumn(name, (F.col("above__") + F.col("at__")).cast("int")).drop("part__", "at__", "above__")


def upsert_blocks(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """new: kind, value, token, act (when it came: the number orders the rows). The same value gets the token appended and the
    kind of its latest row; blank values and tokens are ignored. New blocks are numbered in the order of their values."""
    good = new.where((F.trim("value") != "") & (F.trim("token") != "")).withColumn("v", nfc("value"))
    none = F.array().cast("array<string>")
    by_value = good.groupBy("v").agg(F.max_by("kind", "act").alias("kind_n"), F.min_by("value", "act").alias("value_n"), F.array_sort(F.collect_set("token")).alias("tokens_n"))
    old = blocks.withColumn("v", nfc("value")).join(by_value, "v", "left").select("block_id", F.coalesce("kind_n", "kind").alias("kind"), "value", F.array_distinct(F.concat(F.coalesce("tokens", none), F.coalesce("tokens_n", none))).alias("tokens"))
    fresh = numbered(by_value.join(blocks.select(nfc("value").alias("v")), "v", "left_anti"), "v", "place")
    top = blocks.agg(F.coalesce(F.max("block_id"), F.lit(0)).alias("top"))
    return old.unionByName(fresh.crossJoin(F.broadcast(top)).select((F.col("top") + F.col("place")).cast("int").alias("block_id"), F.col("kind_n").alias("kind"), F.col("value_n").alias("value"), F.col("tokens_n").alias("tokens")))  # top is one row


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def teach_names(names: DataFrame, new: DataFrame) -> DataFrame:
    """Adds names not there yet (A to Z in any case, same type and profile); of new ones that are alike the least in code
    points; null never equals a profile but null."""
    key = lambda d: d.withColumn("k", F.concat_ws("\x00", "lang", F.translate(F.trim(nfc("name")), _CAPITALS, _SMALL), "type", F.coalesce("profile_id", F.lit("\x01"))))
    fresh = key(new.where(F.trim("name") != "")).join(key(names).select("k"), "k", "left_anti")
    columns = [c for c in names.columns if c in new.columns]
    one = fresh.groupBy("k").agg(F.min_by(F.struct(*columns), "name").alias("row")).select("row.*")
    return names.unionByName(one, allowMissingColumns=True)


def user_names(names: DataFrame, values: DataFrame, new: DataFrame, custom_entity: int) -> tuple[DataFrame, DataFrame]:
    """A person's own names (lang, name, type, always, profile_id, list) -> names and values after them.

    Given and family names are taught, and become Always values only where `always`; persons and companies become values, Always
    or else Suggest. Values that a spelling matches already aren't added again.
    """
    single = F.col("type").isin("given", "family")
    taught = teach_names(names, new.where(single).select("lang", "name", "type", "profile_id", "list"))
    wanted = new.where(~single | F.col("always")).withColumn("s", nfc("name")).where(F.trim("name") != "")
    missing = wanted.join(values.select(nfc("value").alias("s")).distinct(), "s", "left_anti")
    one = missing.groupBy("s").agg(F.min("name").alias("value"), F.max("always").alias("always"), F.min(F.when(F.col("type") == "company", "Company").otherwise("Person")).alias("kind"), F.min("list").alias("list"))
    return taught, values.unionByName(_added(values, one, custom_entity, F.when(F.col("always"), "Always").otherwise("Suggest"), F.col("list")))


def _added(values: DataFrame, fresh: DataFrame, entity: int, policy: Column, list_: Column) -> DataFrame:
    top = values.agg(F.coalesce(F.max("value_id"), F.lit(0)).alias("top"))
    met = numbered(fresh, "s", "place").crossJoin(F.broadcast(top))  # top is one row
    return met.select((F.col("top") + F.col("place")).cast("int").alias("value_id"), F.lit(entity).alias("entity_id"), "kind", "value", policy.alias("policy"), F.lit(0).cast("long").alias("learned_at"), list_.cast("string").alias("list"))


def learn_values(values: DataFrame, aliases: DataFrame, new: DataFrame, custom_entity: int) -> DataFrame:
    """Values answered with Always (kind, value): those no spelling matches yet go to the catch-all entity; of rows that are
    one value the least kind and writing stay."""
    known = spellings(values, aliases).select(nfc("spelling").alias("s")).distinct()
    fresh = new.withColumn("s", nfc("value")).groupBy("s").agg(F.min_by("kind", F.struct("kind", "value")).alias("kind"), F.min("value").alias("value")).join(known, "s", "left_anti")
    return values.unionByName(_added(values, fresh, custom_entity, F.lit("Always"), F.lit(None)))


def add_aliases(values: DataFrame, aliases: DataFrame, new: DataFrame) -> DataFrame:
    """aliases with new ones (value_id, alias): those of values that exist, that aren't blank and that the value isn't known by."""
    known = spellings(values, aliases).select("value_id", nfc("spelling").alias("s"))
    good = new.where(F.trim("alias") != "").withColumn("s", nfc(F.trim("alias"))).join(values.select("value_id"), "value_id", "left_semi")
    fresh = good.join(known, ["value_id", "s"], "left_anti").groupBy("value_id", "s").agg(F.min("alias").alias("alias"))
    return aliases.unionByName(fresh.select("value_id", "alias"))


def answered(findings: DataFrame, decisions: DataFrame, values: DataFrame, aliases: DataFrame, exceptions: DataFrame, custom_entity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A person's answers (doc_id, kind, value, answer, act) -> findings, values and exceptions after them.

    Always learns the value besides protecting it; NotSensitive makes it an exception (kind, value, for all profiles), which is
    never found again.
    """
    learnt = learn_values(values, aliases, decisions.where("answer = 'Always'").select("kind", "value"), custom_entity)
    said = decisions.where("answer = 'NotSensitive'").select("kind", nfc("value").alias("value")).distinct().join(exceptions.where("profile_id IS NULL").select("kind", nfc("value").alias("value")), ["kind", "value"], "left_anti")
    top = exceptions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    more = numbered(said.withColumn("by__", F.concat_ws("\x00", "value", "kind")), "by__", "place").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("place")).cast("int").alias("id"), "kind", "value", F.lit(None).cast("string").alias("profile_id"))  # top is one row
    return decide(findings, decisions), learnt, exceptions.unionByName(more)


def decide(findings: DataFrame, decisions: DataFrame, keys: tuple[str, ...] = ("doc_id", "kind", "value")) -> DataFrame:
    """A person's answers over findings: the latest act on a (document, kind, value) sets the state; NotSensitive drops it."""
    w = Window.partitionBy(*keys).orderBy(F.desc("act"))
    latest = decisions.withColumn("r", F.row_number().over(w)).where("r = 1").select(*keys, "answer")
    met = findings.join(latest, list(keys), "left")
    return met.where(F.coalesce("answer", F.lit("")) != "NotSensitive").withColumn("state", F.when(F.col("answer").isin("Protect", "Always"), "Protected").otherwise(F.col("state"))).drop("answer")
