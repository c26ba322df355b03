"""Counts over findings, in numbers only: no report carries a value, but for name candidates, which ask about one."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .batches import by_pieces, spread
from .kernel import Knowledge, Reading


def scan_report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """By document: auto, suggested, normal (plain words)."""
    n = lambda c: F.size(F.filter("findings", lambda f: f["confidence"] == c)).cast("long")
    return scanned.select(id_col, n("auto").alias("auto"), n("suggest").alias("suggested"), F.col("plain_words").cast("long").alias("normal"))


def by_layer(protections: DataFrame) -> DataFrame:
    """source, detail (the pack of a language rule), places."""
    detail = F.when(F.col("source") == "LanguagePack", F.regexp_extract("rule", "^([a-z]{2})[:-]", 1)).otherwise("")
    return protections.groupBy("source", detail.alias("detail")).agg(F.count("*").alias("places"))


def by_kind(findings: DataFrame, *more: str) -> DataFrame:
    """Findings by kind and state."""
    return findings.groupBy(*more, "kind", "state").agg(F.count("*").alias("n"))


def import_report(findings: DataFrame) -> DataFrame:
    """kind, protected, suggested; most first, ties by kind."""
    out = findings.groupBy("kind").agg(F.count_if(F.col("state") == "Protected").alias("protected"), F.count_if(F.col("state") != "Protected").alias("suggested"))
    return out.orderBy(F.desc(F.col("protected") + F.col("suggested")), "kind")


def tally(protections: DataFrame, *more: str) -> DataFrame:
    """Distinct tokens by kind."""
    return protections.groupBy(*more, "kind").agg(F.count_distinct("token").alias("tokens"))


def occurrences_of(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Findings with how often the same kind, state and text stands in the document."""
    return findings.withColumn("occurrences", F.count("*").over(Window.partitionBy(id_col, "kind", "state", "value")))


def line_around(text: Column, start: Column, end: Column, most: int = 160) -> Column:
    """The line of a place, cut to `most` characters."""
    before, after = F.substr(text, F.lit(1), start), F.substr(text, start + 1, F.length(text))
    return F.substr(F.concat(F.substring_index(before, "\n", -1), F.substring_index(after, "\n", 1)), F.lit(1), F.lit(most))


#: Lines that stand for a word.
EXAMPLES = 3
_TOP = "top array<struct<here:boolean,doc_id:long,start:int,rule:string,line:string>>"
_PARTIAL = f"word string, doc_id long, page int, n long, pages long, {_TOP}"


def _first(top: list[tuple]) -> list[tuple]:
    return sorted(top, key=lambda x: (x[0], x[1] or 0, *x[2:]))[:EXAMPLES]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("here", pa.bool_()), ("doc_id", pa.int64()), ("start", pa.int32()), ("rule", pa.string()), ("line", pa.string())]))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=["word", "doc_id", "page", "n", "pages", "top"])


def _merged(batches):
    """Partial rows that come in order of their word (and page): one row a word, with its first lines and its different pages."""
    word = page = None
    n = pages = 0
    top: list[tuple] = []
    for b in batches:
        out = []
        for w, doc, at, more, found, lines in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if w != word:
                if word is not None:
                    out.append((word, None, None, n, pages, top))
                word, page, n, pages, top = w, None, 0, 0, []
            n += more
            pages += found if at is None else page != (doc, at)
            page = (doc, at)
            top = _first(top + [tuple(x.values()) for x in lines])
        yield _rows(out)
    if word is not None:
        yield _rows([(word, None, None, n, pages, top)])


def name_candidates(docs: DataFrame, known: Knowledge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, rule, occurrences, pages (at least 1), examples (the first three lines): surnames no dictionary holds.

    A word's lines are an aggregate that can be merged: each text keeps the first three of a page, each task of a word's pages
    the first three of those, and only then a word's partial rows come together, one a task. So a common word is many tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        k = shared.value
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc, found = Reading(text or ""), {}
                classes = k.lexer.of(doc)
                for people in k.people.values():
                    for a, z, _, rule in people.discover(doc, classes):
                        line = text[text.rfind("\n", 0, a) + 1 : (text.find("\n", z) + 1 or len(text) + 1) - 1]
                        found.setdefault((text[a:z], text.count("\f", 0, a) + 1), []).append((i is not None, i, a, rule, line[:160]))
                out += [(word, i, page, len(places), 1, _first(places)) for (word, page), places in found.items()]
            yield _rows(out)

    found = by_pieces(spread(docs.select(F.col(id_col).cast("long"), text_col)), run, _PARTIAL)
    keys = ("word", "doc_id", "page")
    paged = found.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged, _PARTIAL)
    whole = paged.repartition("word").sortWithinPartitions("word").mapInArrow(_merged, _PARTIAL)
    lines = F.transform("top", lambda x: x["line"])
    return whole.select("word", F.get("top", F.lit(0))["rule"].alias("rule"), F.col("n").alias("occurrences"), F.greatest(F.lit(1), "pages").alias("pages"), lines.alias("examples")).orderBy(F.desc("occurrences"), "word")


def chat_so_far(turns: DataFrame) -> DataFrame:
    """conv_id, request, answer of the last turn that has both roles, and how many turns there are; where turns carry `allowed`
    (tokens), also all of them that any turn of the conversation allows, in order."""
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    out = turns.groupBy("conv_id").agg(last("user").alias("request"), last("assistant").alias("answer"), F.count("*").alias("turns"))
    if "allowed" not in turns.columns:
        return out
    tokens = turns.select("conv_id", F.explode("allowed").alias("t")).distinct().groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("allowed"))
    return out.join(tokens, "conv_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
