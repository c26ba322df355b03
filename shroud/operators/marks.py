"""A person's own marks: acts over protections, columns by example, facts about a finding, and what is kept of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .intervals import untouched
from .protect import find_in_document
from .spans import matches


def overlay(protections: DataFrame, acts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Protections after a person's acts: act (its number), op (protect, unprotect or undo), start, end, kind; undo names the
    act that it takes back in `of`. Of the acts left, the latest that touches a place decides; protections no act touches stay."""
    undone = acts.where("op = 'undo'").select(id_col, F.col("of").alias("act"))
    live = acts.where("op != 'undo'").join(undone, [id_col, "act"], "left_anti")
    kept = untouched(protections, live, [id_col]).select(id_col, "start", "end", "kind")
    a = live.select(F.col(id_col).alias("i__"), F.col("act").alias("act__"), F.col("start").alias("s__"), F.col("end").alias("e__"))
    added = live.where("op = 'protect'")
    over = (added[id_col] == F.col("i__")) & (F.col("start") < F.col("e__")) & (F.col("s__") < F.col("end")) & (F.col("act__") > F.col("act"))
    later = added.join(a, over, "left_anti").select(id_col, "start", "end", "kind")  # acts are made by hand, one after the other
    return kept.unionByName(later)


def protect_all_matches(scanned: DataFrame, needle: str, kind: str, act: int, id_col: str = "doc_id") -> DataFrame:
    """Acts (for overlay) that protect every place of a value that isn't protected yet: one act, so one undo takes all back."""
    found = find_in_document(scanned, needle, id_col=id_col).where("state != 'Protected'")
    return found.select(F.col("doc_id").alias(id_col), F.lit(act).alias("act"), F.lit("protect").alias("op"), "start", "end", F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("of"))


def cells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a cell: line, cell, start, end, value. A tab or two spaces part the cells of a line."""
    starts = F.concat(F.array(F.lit(0)), F.transform(matches(F.col(text_col), "\n"), lambda m: m["end"]))
    lines = docs.select(id_col, F.posexplode(F.arrays_zip(starts.alias("at"), F.split(text_col, "\n", -1).alias("l"))).alias("line", "x")).select(id_col, "line", "x.at", "x.l")
    each = lines.select(id_col, "line", "at", F.posexplode(matches(F.col("l"), "[^\t ]+(?: [^\t ]+)*")).alias("cell", "m"))
    return each.select(id_col, "line", "cell", (F.col("at") + F.col("m.start")).alias("start"), (F.col("at") + F.col("m.end")).alias("end"), F.col("m.value").alias("value"))


def column_by_example(cells_: DataFrame, example: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """example: document, first_line, last_line, cell. The cell of the same number on every line of the range."""
    e = example.select(F.col(id_col).alias("i__"), "first_line", "last_line", F.col("cell").alias("c__"))
    on = (cells_[id_col] == F.col("i__")) & (F.col("cell") == F.col("c__")) & F.col("line").between(F.col("first_line"), F.col("last_line"))
    return cells_.join(e, on).select(id_col, "line", "cell", "start", "end", "value")


def line_selection(findings: DataFrame, cells_: DataFrame, first: int, last: int, id_col: str = "doc_id") -> DataFrame:
    """How many findings begin on the lines of a range, by document."""
    return line_selections(findings, cells_, [(first, last)], id_col).select(id_col, "marks")


def line_selections(findings: DataFrame, cells_: DataFrame, ranges: list[tuple[int, int]], id_col: str = "doc_id") -> DataFrame:
    """The same for any number of ranges (first, last), each once, by document and range; findings and cells are gone through once."""
    all_ = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(z).alias("last")) for a, z in dict.fromkeys(ranges)])
    of = F.filter(all_, lambda r: F.col("line").between(r["first"], r["last"]))
    lines = cells_.groupBy(id_col, "line").agg(F.min("start").alias("from_"), F.max("end").alias("to_")).withColumn("r__", of).where(F.size("r__") > 0)
    met = findings.select(id_col, F.col("start").alias("s__")).join(lines, id_col).where((F.col("s__") >= F.col("from_")) & (F.col("s__") < F.col("to_")))
    return met.select(id_col, F.explode("r__").alias("r__")).groupBy(id_col, F.col("r__.first").alias("first"), F.col("r__.last").alias("last")).agg(F.count("*").alias("marks"))


def explain(findings: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """headline and because of each finding, from its kind, state, source and rule; agreeing, the other rules that found it too; and,
    with the vault's entities, owners: the labels of those that a known value belongs to, in order.

    A block (entity -1) says that the value was protected before; a value of several entities says that they claim it.
    """
    of = F.col("entities") if "entities" in findings.columns else F.array().cast("array<int>")
    several, block = F.size(of) > 1, F.array_contains(of, -1)
    vault = F.when(several, F.concat(F.size(of).cast("string"), F.lit(" of your entries claim it"))).when(block, "you protected it before, and it was kept").otherwise("it is a value you keep")
    said = F.when(F.col("source") == "GeneralRule", F.concat(F.lit("the rule for "), F.col("rule"), F.lit(" fits, and its arithmetic comes out"))).when(F.col("source") == "Vault", vault).when(F.col("source") == "Hand", F.lit("you marked it")).otherwise(F.concat(F.lit("a rule of the language fits: "), F.col("rule")))
    head = F.concat(F.col("kind"), F.when(F.col("state") == "Protected", " is protected").otherwise(" is offered for your word"))
    also = F.array_sort(F.array_distinct(F.coalesce("also", F.array().cast("array<string>")))) if "also" in findings.columns else F.array().cast("array<string>")
    told = findings.withColumn("headline", head).withColumn("because", said).withColumn("agreeing", F.array_except(also, F.array("rule")))
    if entities is None:
        return told
    sets = told.select(F.col("entities").alias("e__")).where(F.size("e__") > 0).distinct()  # a row a combination of owners
    named = sets.withColumn("id__", F.explode("e__")).join(entities.select(F.col("entity_id").alias("id__"), "label"), "id__").groupBy("e__").agg(F.array_sort(F.collect_set("label")).alias("owners"))
    return told.join(named, told["entities"] == named["e__"], "left").drop("e__").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))


def newest(payloads: DataFrame, keep: int = 16, by: str = "session") -> DataFrame:
    """The newest payloads of each session (column made), and all that were answered."""
    w = Window.partitionBy(by).orderBy(F.desc("made"), F.desc("payload_id"))
    return payloads.withColumn("r__", F.row_number().over(w)).where((F.col("r__") <= keep) | F.col("answered")).drop("r__")
