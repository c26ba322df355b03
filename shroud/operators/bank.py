"""Name banks of any size against the words of texts: a semi-join by words, with what the bank says joined back to each text.

A Bloom filter over the texts' words, in the forms that the rules look names up by, turns names away that no text has before
anything of the bank is shuffled or written. Then words are posted, once each and only those that a filter over the rest of the
bank may hold; they meet it by an equi-join, and each text gets its own names as an array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import contains
from .batches import by_batch, spread
from .bloom import bloom, hashed
from .rules import _folded
from .words import EDGE, Reading, as_read


def forms(text: str) -> set[str]:
    """The lower-case forms of a text's words that rules ask a bank for: bare, as read, and without Arabic marks."""
    out: set[str] = set()
    for word in set(Reading(text).words):
        bare = word.strip(EDGE)
        out.add(bare.lower())
        if not word.isascii():
            out.update((as_read(bare).lower(), _folded(word).lower()))
    out.discard("")
    return out


def _whole(name: str) -> list[str]:
    return [name]


def _standing(names: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The rows whose spelling may stand as a word in some text."""

    def words(b: pa.RecordBatch) -> pa.RecordBatch:
        own = {w for text in b.column(0).to_pylist() for w in forms(text or "")}
        return pa.RecordBatch.from_arrays([pa.array(hashed(np.array(sorted(own), object)).view(np.int64) if own else [], pa.int64())], names=["key"])

    texts = docs.select(text_col)
    n = texts.select(F.explode(F.split(F.lower(text_col), r"\s+")).alias("w")).agg(F.approx_count_distinct("w")).first()[0]  # about
    there = docs.sparkSession.sparkContext.broadcast(bloom(by_batch(spread(texts), words, "key long"), "key", n))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(there.value.may_hold_hashed(hashed(b.column(0).to_numpy(zero_copy_only=False))))) if b.num_rows else b

    return by_batch(names, run, names.schema)


def with_names(docs: DataFrame, bank: DataFrame, text_col: str = "text", out_col: str = "names") -> DataFrame:
    """docs with an array of the bank's names that stand as words in each text: spelling (lower case) and `is`, pairs of lang and type.

    bank: lang, name, type; blank and null names are passed, repeated ones count once. Texts without a name have null.
    """
    rows = bank.select(F.lower(F.trim("name")).alias("spelling"), F.struct("lang", "type").alias("x")).where("spelling != ''")
    names = _standing(rows, docs, text_col).groupBy("spelling").agg(F.array_sort(F.collect_set("x")).alias("is"))  # some languages and two types a name
    return contains.with_met(docs, names, text_col, out_col, keys_of=_whole, keys_in=forms)


def met_in(docs: DataFrame, bank: DataFrame, text_col: str = "text") -> DataFrame:
    """A row a text and name: the columns of docs but the text, name, lang, type."""
    rest = [c for c in docs.columns if c not in (text_col, "name", "lang", "type")]
    met = with_names(docs.select(*rest, text_col), bank, text_col, "n__").select(*rest, F.explode("n__").alias("n__"))
    return met.select(*rest, F.col("n__.spelling").alias("name"), F.explode("n__.is").alias("x__")).select(*rest, "name", "x__.lang", "x__.type")
