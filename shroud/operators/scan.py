"""scan: documents to findings. The general rules run as native expressions; the rest in one Arrow pass over each document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import bank as bank_words, contains, general, vault
from .batches import by_batch, pieces, spread
from .kernel import GENERAL, PACKS, Hint, Hit, Knowledge, Labels, Names, Reading, nfc, scan_document, scan_text
from .lexicon import LABELS, LabelRow, dictionary

#: Columns of the way.
_OWN = ("general__", "known__", "names__")
FINDING = "array<struct<start:int,end:int,kind:string,confidence:string,source:string,rule:string,also:array<string>,entities:array<int>>>"


def knowledge(packs: tuple[str, ...] = ("de",), taught_labels: list[LabelRow] = (), hints: list[Hint] = (), exceptions: set[tuple[str, str]] = frozenset()) -> Knowledge:
    """What all tasks know: packs with their own short name lists, labels, a few known values and exceptions. Name banks and vaults are
    tables, which scan() takes."""
    rows = [*LABELS["zz"], *(r for p in packs for r in LABELS.get(p, [])), *taught_labels]
    known: dict[str, Names] = {p: Names(*dictionary(p)) for p in packs if p in PACKS}
    honorifics = frozenset().union(*(PACKS[p].honorifics for p in packs if p in PACKS))
    return Knowledge(tuple(packs), Labels(rows), honorifics, known, list(hints), frozenset((k, nfc(v)) for k, v in exceptions))


def scan(docs: DataFrame, known: Knowledge | None = None, text_col: str = "text", out_col: str = "findings", hints: DataFrame | None = None, bank: DataFrame | None = None) -> DataFrame:
    """docs with findings (array) and plain_words (words that no finding touches). Null texts have none of either.

    hints: known values as a table of any size (vault.hints); texts meet them by a contains join. bank: lang, name, type (given or
    family), of any size; texts meet it by their words (bank.met_in).
    """
    return by_batch(*walk(docs, known, text_col, out_col, hints, bank))


def walk(docs: DataFrame, known: Knowledge | None = None, text_col: str = "text", out_col: str = "findings", hints: DataFrame | None = None, bank: DataFrame | None = None) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.RecordBatch], T.StructType]:
    """What scan() passes over, the function of a batch, and what that gives; for a pass that does more with each batch, as every
    pass of its own has a worker process beside the others'."""
    known, tabled, banked = known or knowledge(), hints is not None, bank is not None
    base = spread(docs).drop(out_col, "plain_words", *_OWN)
    if tabled:
        base = contains.with_met(base, vault.claims(hints), text_col, "known__")
    if banked:
        base = bank_words.with_names(base, bank.where(F.col("lang").isin(*known.packs)), text_col, "names__")
    base = base.withColumn("general__", general.found(F.col(text_col)))
    schema = T.StructType([*docs.drop(out_col, "plain_words", *_OWN).schema.fields, *T._parse_datatype_string(f"{out_col} {FINDING}, plain_words int").fields])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("confidence", pa.string()), ("source", pa.string()), ("rule", pa.string()), ("also", pa.list_(pa.string())), ("entities", pa.list_(pa.int32()))]))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        k, found, ends, plain = shared.value, [], [0], []
        none = [None] * b.num_rows
        met, named = (b.column(c).to_pylist() if there else none for c, there in (("known__", tabled), ("names__", banked)))
        general_ = b.column("general__")
        for text, spans, spellings, names in zip(b.column(text_col).to_pylist(), general_.to_pylist() if len(general_.flatten()) else none, met, named, strict=True):
            if names:
                k.learn(names)
            doc = Reading(text or "")
            hits = scan_document(doc, [Hit(s["start"], s["end"], s["kind"], s["confidence"] == "auto", GENERAL, s["rule"]) for s in spans or ()], k, spellings or ())
            found += hits
            ends.append(len(found))
            plain.append(doc.plain(hits))
        columns = [h.start for h in found], [h.end for h in found], [h.kind for h in found], ["auto" if h.sure else "suggest" for h in found], [h.source for h in found], [h.rule for h in found], [h.also for h in found], [h.entities for h in found]
        each = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
        keep = [i for i, n in enumerate(b.schema.names) if n not in _OWN]
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), pa.array(plain, pa.int32())], names=[*(b.schema.names[i] for i in keep), out_col, "plain_words"])

    return base, run, schema


#: Characters of a piece that a finding's value is cut from; a place in a long text is then as near as in a short one.
_PIECE = 2048


def findings(scanned: DataFrame, text_col: str = "text", col: str = "findings") -> DataFrame:
    """A row a finding: start, end, kind, state, source, rule, value, how often the same stands in the document, the other rules that
    agree (also), and the entities of a known value.

    All inside the row: values come from the text's pieces, and equal ones are counted as runs of a sorted array, so a
    document with many findings takes n log n.
    """
    rest = [c for c in scanned.columns if c not in (col, text_col, "plain_words", "start", "end", "kind", "state", "source", "rule", "value", "occurrences", "also", "entities")]
    pieces = F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))

    def value(x):
        first, last = F.floor(x["start"] / _PIECE), F.floor((x["end"] - 1) / _PIECE)
        near = F.when(first == last, F.get("p__", first.cast("int"))).otherwise(F.array_join(F.slice("p__", (first + 1).cast("int"), (last - first + 1).cast("int")), ""))
        return F.substr(near, (x["start"] - first * _PIECE + 1).cast("int"), x["end"] - x["start"])

    pieces = F.when(F.length(text_col) > _PIECE, pieces).otherwise(F.array(text_col))
    valued = scanned.where(F.size(col) > 0).withColumn("p__", pieces).withColumn("v__", F.transform(col, lambda x: x.withField("value", value(x))))
    ordered = F.array_sort(F.transform("v__", lambda x, i: F.struct(x["kind"].alias("a"), x["confidence"].alias("b"), x["value"].alias("c"), i.alias("i"))))
    last = F.size("s__")
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    began = F.zip_with("s__", F.slice("s__", F.lit(2), F.greatest(last - 1, F.lit(0))), lambda x, y: ~same(x, y))  # true where a run ends
    ends = F.filter(F.transform(began, lambda e, i: F.when(e, i + 1)), lambda i: i.isNotNull())
    runs = F.zip_with("e__", F.slice(F.concat(F.array(F.lit(0)), F.col("e__")), F.lit(1), F.size("e__")), lambda e, b: F.array_repeat(e - b, e - b))
    counted = F.array_sort(F.zip_with("s__", F.flatten(runs), lambda x, n: F.struct(x["i"].alias("i"), n.alias("n"))))
    met = valued.withColumn("s__", ordered).withColumn("e__", ends)
    each = F.explode(F.zip_with("v__", counted, lambda x, n: F.struct(x.alias("f"), n["n"].cast("long").alias("same"))))
    state = F.when(F.col("f.confidence") == "auto", "Protected").otherwise("Suggested")
    return met.select(*rest, each.alias("x__")).select(*rest, F.col("x__.f").alias("f"), "x__.same").select(*rest, F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.kind").alias("kind"), state.alias("state"), F.col("f.source").alias("source"), F.col("f.rule").alias("rule"), F.col("f.value").alias("value"), F.col("same").alias("occurrences"), F.col("f.also").alias("also"), F.col("f.entities").alias("entities"))


def register(spark: SparkSession, known: Knowledge | None = None) -> None:
    """SQL: pii_scan(TABLE(docs), 'de,en'), a table function over Arrow batches with a row a finding.

    docs has doc_id and text; the packs are an argument (blank: those of `known`, whose names, labels and known values hold in
    any case). Findings of the general rules are among them where docs has the column general__ of readable().
    """
    k = known or knowledge()
    per: dict[str, Knowledge] = {"": k}

    def of(packs: str) -> Knowledge:
        if packs not in per:
            asked = tuple(p.strip() for p in packs.split(",") if p.strip())
            if wrong := [p for p in asked if p not in PACKS]:
                raise ValueError(f"no pack is called {wrong[0]}; there are {', '.join(PACKS)}")
            own = knowledge(asked)
            per[packs] = replace(own, names=own.names | {p: n for p, n in k.names.items() if p in asked}, hints=k.hints, exceptions=k.exceptions)
        return per[packs]

    @F.arrow_udtf(returnType="doc_id long, start int, end int, kind string, confidence string, source string, rule string, value string")
    class PiiScan:
        def eval(self, docs: pa.RecordBatch, packs: pa.Array):
            mine = of((packs[0].as_py() if len(packs) else "") or "")
            for part in pieces(docs):
                rows = []
                general_ = part.column("general__").to_pylist() if "general__" in part.schema.names else [None] * part.num_rows
                for i, text, spans in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), general_, strict=True):
                    hits = scan_text(text or "", [Hit(s["start"], s["end"], s["kind"], s["confidence"] == "auto", GENERAL, s["rule"]) for s in spans or []], mine)
                    rows += [(i, h.start, h.end, h.kind, "auto" if h.sure else "suggest", h.source, h.rule, text[h.start : h.end]) for h in hits]
                kinds = pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 5
                names = "doc_id", "start", "end", "kind", "confidence", "source", "rule", "value"
                yield pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=list(names))

    spark.udtf.register("pii_scan", PiiScan)


def readable(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """docs as a view for pii_scan: doc_id, text and what the general rules find."""
    spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "text", general.found(F.col(text_col)).alias("general__")).createOrReplaceTempView(name)
