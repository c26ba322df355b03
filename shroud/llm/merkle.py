"""A Merkle manifest of a table: a leaf for each row, a tree for each group, and one tree over the groups' roots.

A leaf is the hash of its fields, each "-" if null, else its UTF-8 byte count, ":" and its value. Leaves of a group ascend by
id; every ARITY consecutive nodes (the last run: fewer, even one) become the hash of their digests, while there are several.
The groups' roots, ordered by group (null first, bytes), are the leaves of the upper tree.

How: rows are dealt out by ranges of (group, id), and two sums over the partitions' totals give each leaf its index and each
group its size. Then digests are combined by key, driven by events: a task keeps partial parents with the indexed digests
that have arrived; once a parent holds as many as the sizes say, it is hashed and becomes an event of the level above. Ranges
are sorted, so nearly all parents close where their leaves lie; only those at the edges of partitions are left, and this
frontier is shuffled by parent and combined again until nothing is left, at most once a level. Every closed parent is kept
with its children's digests, and proofs follow these links backwards from the root, a join a level, so a leaf brings along
what it needs to be folded up to the root by itself.

Defined cases: a null id stands before all others and is told by "-"; rows with equal ids are ordered by their leaf digest;
repeated rows are a leaf each; null and empty texts differ ("-" and "0:"); an empty table has no rows; a table of one row
has its leaf as root and the hash of nothing as proof. Further columns are not read.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import arrow, drop_staged, fold, staged

ARITY, BITS = 16, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "grp string, n long, level int, idx long, digest string, kids string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields.values())), 256)


def size_at(level: int | Column) -> Column:
    """Nodes of a level of a tree with n leaves."""
    if isinstance(level, int):
        return F.expr(f"shiftright(n + {(1 << BITS * level) - 1}L, {BITS * level})")
    return F.ceil(F.col("n") / F.pow(F.lit(float(ARITY)), level)).cast("long")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx, the place of a row in its grp by `order` (from 0), and n, the rows of its grp; staged.

    One sort by ranges; then only totals, one a range and group, are summed up.
    """
    keys = ["grp", *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = staged(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "merkle-order")
    totals = dealt.groupBy("grp", "part").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("grp").alias("g"), F.col("part").alias("p"), (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("base"), F.sum("here").over(whole).alias("n"))
    met = dealt.join(totals, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    out = staged(met.withColumn("idx", F.col("base") + F.col("at")).drop("g", "p", "part", "at", "base"), "merkle-numbers")
    drop_staged(dealt)
    return out


def combined(events: DataFrame) -> DataFrame:
    """One step of combining by parent: closed parents (with kids), and the events (kids null) that wait for others elsewhere."""

    def run(batches):
        open_: dict[tuple, dict[int, str]] = {}
        out: list[tuple] = []

        def arrive(grp, n, level, idx, digest):
            while (n - 1) >> BITS * level:  # several nodes on this level
                key = (grp, n, level, idx >> BITS)
                held = open_.setdefault(key, {})
                held[idx & ARITY - 1] = digest
                on_level = (n - 1 >> BITS * level) + 1
                if len(held) < min(ARITY, on_level - (idx >> BITS << BITS)):
                    return
                kids = "".join(held[k] for k in range(len(held)))
                del open_[key]
                level, idx, digest = level + 1, idx >> BITS, sha256(kids.encode()).hexdigest()
                out.append((grp, n, level, idx, digest, kids))

        def give():
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["grp", "n", "level", "idx", "digest", "kids"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                arrive(*row)
            yield give()
            out.clear()
        for (grp, n, level, parent), held in open_.items():
            out += [(grp, n, level, (parent << BITS) + k, digest, None) for k, digest in held.items()]
            if len(out) >= 4096:
                yield give()
                out.clear()
        yield give()

    return events.select("grp", "n", "level", "idx", "digest").transform(arrow, run, _NODE)


def tree(leaves: DataFrame) -> list[DataFrame]:
    """All parents (grp, n, level from 1, idx, digest, kids) of numbered leaves, as the tables of the rounds."""
    rounds = [staged(combined(leaves.withColumn("level", F.lit(0))), "merkle-nodes")]
    while not rounds[-1].where(F.col("kids").isNull()).isEmpty():
        waiting = rounds[-1].where(F.col("kids").isNull())
        rounds.append(staged(combined(waiting.repartition("grp", "level", F.shiftright("idx", BITS))), "merkle-nodes"))
        if len(rounds) > 64 // BITS + 2:
            raise RuntimeError("parents without all of their children are left")
    return [r.where(F.col("kids").isNotNull()) for r in rounds]


def _roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    return leaves.where("n = 1").select("grp", "n", "digest").union(nodes.where(size_at(F.col("level")) == 1).select("grp", "n", "digest"))


_STEP = "struct<kids: string, at: int>"


def _step(kids: Column) -> Column:
    return F.array(F.struct(kids.alias("kids"), F.col("idx").bitwiseAND(ARITY - 1).cast("int").alias("at")))


def _ways(leaves: DataFrame, nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Adds to each leaf `way`: the runs that it and its ancestors stand in, up to its tree's root and on by that root's own way.

    tops: g, root, beyond (the way of a tree's root).
    """
    depth = nodes.agg(F.max("level")).first()[0] or 0
    met = None
    for level in range(depth, -1, -1):
        here = nodes.where(F.col("level") == level) if level else leaves
        alone = size_at(level) == 1
        found = here.where(alone).join(tops, F.col("grp").eqNullSafe(F.col("g"))).withColumn("way", F.col("beyond")).drop("g", "beyond")
        if met is not None:
            above = met.select(F.col("grp").alias("g"), F.col("idx").alias("i"), F.col("kids").alias("k"), "root", F.col("way").alias("w"))
            inner = here.where(~alone).join(above, F.col("grp").eqNullSafe(F.col("g")) & (F.shiftright("idx", BITS) == F.col("i")))
            inner = inner.withColumn("way", F.concat(_step(F.col("k")), F.col("w"))).drop("g", "i", "k", "w")
            found = found.unionByName(inner)
        met = found
    return met


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """`order`, leaf, subroot, root, way (array of kids and place), and found: the leaf as the rows have it now.

    `tampered` gives other values for fields of the rows in `where`: their `found` is the leaf of those values, whereas the
    manifest is that of the original ones.
    """
    columns = {f: F.col(f) for f in fields}
    now = F.when(F.coalesce(where, F.lit(False)), leaf(columns | tampered)) if tampered else F.lit(None).cast("string")
    rows = docs.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("id"), leaf(columns).alias("digest"), now.alias("now"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    leaves = numbered(rows, ["id", "digest", "row"])
    drop_staged(rows)
    nodes = reduce(DataFrame.union, tree(leaves))
    upper = numbered(_roots(leaves, nodes).select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
    upper_nodes = reduce(DataFrame.union, tree(upper))
    root = _roots(upper, upper_nodes).first()
    whole = F.lit(root["digest"] if root else None).cast("string")
    none = F.expr(f"CAST(array() AS array<{_STEP}>)")
    top = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("g"), whole.alias("root"), none.alias("beyond"))
    tops = staged(_ways(upper, upper_nodes, top).select(F.col("name").alias("g"), F.col("digest").alias("root"), F.col("way").alias("beyond")), "merkle-tops")
    got = _ways(leaves, nodes, tops)
    return got.select(F.col("id").alias(order), F.col("digest").alias("leaf"), F.col("root").alias("subroot"), whole.alias("root"), "way", F.coalesce("now", "digest").alias("found"))


def _others(kids: Column, at: Column) -> tuple[Column, Column]:
    """Digests before and after a place."""
    return kids.substr(F.lit(1), 64 * at), kids.substr(64 * at + 65, F.lit(64 * ARITY))


def proof(way: Column) -> Column:
    """The siblings' digests, level by level to the root, left to right."""
    return F.concat_ws("", F.transform(way, lambda s: F.concat(*_others(s["kids"], s["at"]))))


def folded(start: Column, way: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""

    def up(digest: Column, s: Column) -> Column:
        left, right = _others(s["kids"], s["at"])
        return F.sha2(F.concat(left, digest, right), 256)

    return F.aggregate(way, start, up)


def verified(docs: DataFrame) -> DataFrame:
    """The contract's figures: a fifth of the rows (by crc32 of the id, a null one as empty text) has its text lower-cased."""
    lower = F.translate("text", _UPPER, _LOWER)
    made = manifest(docs, tampered={"text": lower}, where=fold(F.col("doc_id"), 5) == 0)
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("way")), 256).alias("proof_sha256"), folded(F.col("found"), F.col("way")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
