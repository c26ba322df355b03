"""Contains join: which texts hold which of any number of spellings, without comparing all with all.

Each spelling can only stand where all of its stretches of letters and digits stand (one in a script that joins words: the
first characters of its first stretch; one of signs: its first signs). So these are its keys, known by their hashes, and texts
post those of their stretches that a Bloom filter takes for keys. Another filter, over the postings, is the end of spellings with a
key that no text has, and counters of the postings, of a fixed size and sent to all tasks, tell each spelling's rarest key without a
shuffle. Spellings meet postings on that key alone, a row each, by a shuffled join in which keys with over HEAVY postings are dealt
out; 64 bits of each side's keys turn most of those away that lack another key. What meets is verified in Arrow by the search for one value: hashes, shared
counters and bits only ever let more through. A text stands for all rows that have it, by its digest, so copies are posted and
met once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .batches import by_batch, by_pieces, pieces, spread
from .bloom import bloom
from .known import _BROKEN, _HYPHENS, _STRETCH, _joins, _same, finder
from .staging import dropped, kept
from .windows import _SLICE, Stretches, hash_strings, may_stand, plain

#: Postings of one key in a group of the join.
HEAVY = 50_000
_SIGNS = re.compile(r"(?:[^\w\s]|_)+")
_PLAIN_SIGNS = re.compile(r"[^0-9a-z\s]+")
_CHAIN = re.compile(r"[^\W_]+(?:[-‐­]\n[^\W_]+)+")
_ONE_HYPHEN = str.maketrans(dict.fromkeys(_HYPHENS, "-"))
_GRAM = 3


def spelling_keys(spelling: str) -> list[str]:
    """What a text must have to hold it; none for a blank one."""
    same = _same(spelling).strip()
    if not same:
        return []
    if same.isascii() and (stretches := _STRETCH.findall(same)):
        return sorted({"s" + x for x in stretches})
    m = _STRETCH.search(same)
    first = same[0]
    if m and m.start() == 0 and _joins(first):
        return ["g" + m[0][:_GRAM]]
    if m and not _joins(first):
        return sorted({"s" + x for x in _STRETCH.findall(same)})
    return ["g" + _SIGNS.match(same.translate(_ONE_HYPHEN))[0][:_GRAM]]


def _plain_keys(b: pa.RecordBatch) -> pa.ListArray | None:
    """Hashes of all spellings' keys at once, where all are plain and have stretches."""
    if not pc.all(plain(b.column("spelling")), min_count=0).as_py():
        return None
    each = [Stretches(p.column(0)) for p in pieces(b.select(["spelling"]), _SLICE)]
    n = np.concatenate([np.zeros(0, np.int64), *(s.n for s in each)])
    if not n.all():
        return None
    h = np.concatenate([np.zeros(0, np.uint64), *(s.hashes(np.arange(len(s.k)), 1, b"\x00s") for s in each)])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(h.view(np.int64)))


def text_keys(text: str) -> set[str]:
    """All keys that spellings in the text can have."""
    same = _same(text)
    runs = set(_STRETCH.findall(same))
    for chain in _CHAIN.findall(same) if _BROKEN.search(same) else ():  # words that line ends cut, put together in all ways
        parts = _BROKEN.split(chain)
        runs.update("".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 2, len(parts) + 1))
    if same.isascii():
        return {"s" + r for r in runs} | {"g" + r[k : k + n] for r in set(_PLAIN_SIGNS.findall(same)) for k in range(len(r)) for n in range(1, _GRAM + 1)}
    signs = {x for x in _SIGNS.findall(same.translate(_ONE_HYPHEN))}
    grams = [r for r in runs if not r.isascii() and any(map(_joins, r))]
    return {"s" + r for r in runs} | {"g" + r[k : k + n] for r in [*grams, *signs] for k in range(len(r)) for n in range(1, _GRAM + 1)}


def standing(text: str, met: Iterable[dict] | None) -> Iterator[tuple[dict, list[tuple[int, int]]]]:
    """Rows of met() whose spelling stands in the text, with its places; in longer texts only those whose keys are all there are
    searched for."""
    if met:
        own, find = text_keys(text) if len(text) > 1000 else None, finder(text)
        for row in met:
            if (own is None or own.issuperset(spelling_keys(row["spelling"]))) and (found := find(row["spelling"])):
                yield row, found


#: Lengths of runs that spellings anywhere are met by: a short one as a whole, so that numbers of few digits don't meet by parts of
#: which there are only thousands.
_RUNS = (12, 8, 7, 6, 5, 4, 3, 2, 1)


def substring_keys(spelling: str) -> list[str]:
    """Keys of a spelling that may stand anywhere, inside words too, in its own writing: all runs of the greatest length that it has."""
    n = next(n for n in _RUNS if n <= len(spelling))
    return sorted({spelling[k : k + n] for k in range(len(spelling) - n + 1)})


def substring_text_keys(text: str) -> set[str]:
    return {text[k : k + n] for n in _RUNS for k in range(len(text) - n + 1)}


def text_key(text_col: str, scope: str | None = None) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(scope).cast("string"), F.lit("")), F.lit("\x00"), text_col) if scope else F.col(text_col)))


def met(docs: DataFrame, spellings: DataFrame, text_col: str = "text", scope: str | None = None, keys_of: Callable = spelling_keys, keys_in: Callable = text_keys) -> DataFrame:
    """text_key, met: for each text that may hold any, its spellings as an array of the rows of `spellings` (column spelling, and
    any others); a superset of what it holds. Blank and null spellings are never met.

    scope: a column of both sides; a text meets only spellings of its own scope (null is one). keys_of and keys_in: what a
    spelling needs and a text has.
    """
    spark, sent = docs.sparkSession, None
    if keys_of is spelling_keys and keys_in is text_keys:
        spellings, sent = may_stand(docs, spellings, text_col)
    at = F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")
    named = spellings.where(F.trim("spelling") != "").withColumn("at__", at).dropDuplicates(["at__", "spelling"])
    shape = T.StructType([*named.schema.fields, T.StructField("keys__", T.ArrayType(T.LongType()))])

    def keyed(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = _plain_keys(b) if keys_of is spelling_keys and not scope else None
        if lists is None:
            keys = [[f"{where}\x00{k}" for k in keys_of(s)] for where, s in zip(b.column("at__").to_pylist(), b.column("spelling").to_pylist(), strict=True)]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(_hashes([k for ks in keys for k in ks]).view(np.int64)))
        return pa.RecordBatch.from_arrays([*b.columns, lists], names=shape.names)

    named = kept(by_batch(named, keyed, shape).where(F.size("keys__") > 0), "contains-spellings")
    if sent:
        sent.unpersist()
    filter_ = spark.sparkContext.broadcast(bloom(named, "keys__", named.agg(F.sum(F.size("keys__"))).first()[0] or 0))

    def posted(batches):
        seen = set()

        def fresh(b):
            for row, (key, text, where) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if key not in seen:
                    _noted(seen, key)
                    yield row, [f"{where}\x00{k}" for k in keys_in(text)]

        for b in batches:
            for rows, own, first in _hashed_lists(fresh(b)):
                held = filter_.value.may_hold_hashed(own)
                n = np.add.reduceat(held.astype(np.int64), first)
                some = n > 0
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n[some]]), pa.int32()), pa.array(own[held].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[some])), lists, pa.array(np.bitwise_or.reduceat(_sign(own), first)[some].view(np.int64))], names=["text_key", "keys", "signs"])

    def once(batches):  # all rows of a text are in one task
        seen = set()
        for b in batches:
            rows = []
            for row, key in enumerate(b.column(0).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    rows.append(row)
            own = b.take(pa.array(rows, pa.int64()))
            of = pa.array(np.repeat(np.arange(len(rows)), own.column(1).value_lengths().to_numpy()))
            yield pa.RecordBatch.from_arrays([own.column(0).take(of), own.column(1).flatten(), own.column(2).take(of)], names=["text_key", "key", "signs"])

    texts = spread(docs.where(F.length(text_col) > 0).select(text_key(text_col, scope).alias("text_key"), text_col, at.alias("at__")))
    lists = by_pieces(texts, posted, "text_key binary, keys array<long>, signs long").repartition("text_key")
    posts = kept(lists.mapInArrow(once, "text_key binary, key long, signs long"), "contains-posts")
    there = spark.sparkContext.broadcast(bloom(posts, "key"))
    counts = spark.sparkContext.broadcast(_counts(posts))
    shape_chosen = T.StructType([*named.schema.fields[:-1], *T._parse_datatype_string("key long, needs long, deals int").fields])

    def rarest(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column("keys__")
        if not b.num_rows:
            return pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32()))], names=shape_chosen.names)
        sizes = lists.value_lengths().to_numpy()
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        keys = lists.flatten().to_numpy().view(np.uint64)
        n = counts.value[(keys & np.uint64(_SLOTS - 1)).astype(np.int64)]
        least = np.where(np.logical_and.reduceat(there.value.may_hold_hashed(keys), first), np.minimum.reduceat(n, first), 0)
        best = np.lexsort((n, np.repeat(np.arange(len(sizes)), sizes)))[first]  # the first of each spelling's keys by count
        new = [pa.array(keys[best].view(np.int64)), pa.array(np.bitwise_or.reduceat(_sign(keys), first).view(np.int64)), pa.array(np.ceil(least / HEAVY).astype(np.int32))]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=shape_chosen.names).filter(pa.array(least > 0))

    chosen = kept(by_batch(named, rarest, shape_chosen), "contains-chosen")
    heavy = chosen.where("deals > 1").select("key", F.col("deals").alias("d")).distinct()  # a few: each has over HEAVY postings
    dealt = posts.join(F.broadcast(heavy), "key", "left").withColumn("deal", F.pmod(F.xxhash64("text_key"), F.coalesce("d", F.lit(1))).cast("int")).drop("d")
    pairs = chosen.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).join(dealt, ["key", "deal"]).where("(needs & ~signs) = 0")
    out = kept(pairs.select("text_key", *spellings.columns), "contains-met")
    dropped(named, posts, chosen)
    for shared in (filter_, there, counts):
        shared.unpersist()
    return out.groupBy("text_key").agg(F.collect_list(F.struct(*spellings.columns)).alias("met"))


#: Counters of postings that are sent to all tasks (16 MB); keys that share one only look more frequent than they are.
_SLOTS = 1 << 22


#: Texts that a task remembers, so that copies among them are posted once; those that it has forgotten go on to be told apart later.
_SEEN = 1 << 18


def _noted(seen: set, key: bytes) -> None:
    if len(seen) >= _SEEN:
        seen.clear()
    seen.add(key)


#: Keys that are hashed at once.
_AT_ONCE = 1 << 16


def _hashed_lists(lists: Iterable[tuple[int, list[str]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows that have keys, all their hashes, and where each row's begin."""
    rows, keys, first = [], [], []
    for row, own in lists:
        if own:
            rows.append(row)
            first.append(len(keys))
            keys += own
            if len(keys) >= _AT_ONCE:
                yield np.array(rows), _hashes(keys), np.array(first)
                rows, keys, first = [], [], []
    if rows:
        yield np.array(rows), _hashes(keys), np.array(first)


def _hashes(keys: list[str]) -> np.ndarray:
    return hash_strings(keys) if keys else np.zeros(0, np.uint64)


def _sign(h: np.ndarray) -> np.ndarray:
    """One bit of 64 for each key: a text that lacks a spelling's bit lacks its key."""
    return np.uint64(1) << (h >> np.uint64(40) & np.uint64(63))


def _counts(posts: DataFrame, block: int = 1 << 16) -> np.ndarray:
    """Postings by slot: tasks count their own, blocks are added up; nothing but the counters is collected."""

    def run(batches):
        own = np.zeros(_SLOTS, np.int64)
        for b in batches:
            np.add.at(own, (b.column(0).to_numpy().view(np.uint64) & np.uint64(_SLOTS - 1)).astype(np.int64), 1)
        parts = np.minimum(own, _MOST).astype(np.int32).reshape(-1, block)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["block", "counts"])

    def added(t: pa.Table) -> pa.Table:
        out = np.zeros(block, np.int64)
        for x in t["counts"]:
            out += np.frombuffer(x.as_py(), np.int32)
        return pa.table({"block": t["block"][:1], "counts": pa.array([np.minimum(out, _MOST).astype(np.int32).tobytes()], pa.binary())})

    counts = np.zeros(_SLOTS, np.int32).reshape(-1, block)
    for r in posts.select("key").mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(added, "block int, counts binary").collect():
        counts[r["block"]] = np.frombuffer(r["counts"], np.int32)
    return counts.ravel()


_MOST = (1 << 31) - 1


def with_met(docs: DataFrame, spellings: DataFrame, text_col: str = "text", out_col: str = "met", scope: str | None = None, **keys) -> DataFrame:
    """docs with an array of the spellings that each text may hold (null: none)."""
    pairs = met(docs, spellings, text_col, scope, **keys).withColumnRenamed("text_key", "text_key__").withColumnRenamed("met", out_col)
    own = docs.drop(out_col).withColumn("text_key__", text_key(text_col, scope))  # a column, so that a text that nobody reads isn't shuffled
    return own.join(pairs, "text_key__", "left").select(*(c for c in docs.columns if c != out_col), out_col)


def places(docs: DataFrame, spellings: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each place of a spelling in a text: the columns of docs but the text, spelling, start, end. Any case, whole words.

    spellings: a column spelling, strings or arrays of them.
    """
    rest = [c for c in docs.columns if c not in (text_col, "spelling", "start", "end", "met__")]
    base = with_met(docs.select(*rest, text_col), spellings.select("spelling"), text_col, "met__").where(F.col("met__").isNotNull())
    schema = T.StructType([*(base.schema[c] for c in rest), *T._parse_datatype_string("at__ array<struct<spelling:string,start:int,end:int>>").fields])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column("met__")
        spellings = lists.flatten().field("spelling")
        rows = [{"spelling": s, "k": k} for k, s in enumerate(spellings.to_pylist())]
        of, spans, ends, at = [], [], [0], 0
        for text, n in zip(b.column(text_col).to_pylist(), lists.value_lengths().to_pylist(), strict=True):
            for row, where in standing(text, rows[at : at + n]):
                of += [row["k"]] * len(where)
                spans += where
            at += n
            ends.append(len(of))
        sides = (pa.array([x[side] for x in spans], pa.int32()) for side in (0, 1))
        each = pa.StructArray.from_arrays([spellings.take(pa.array(of, pa.int64())), *sides], names=["spelling", "start", "end"])
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], names=[*rest, "at__"])

    return by_batch(base, run, schema).select(*rest, F.explode("at__").alias("p__")).select(*rest, "p__.*")
