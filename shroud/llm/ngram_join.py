"""N-gram Jaccard join: texts whose sets of five-word shingles have a similarity of 0.8 or more.

1. Equal texts fold into one; each text gets HASHES MinHash values. Candidates share all values of a band; with 24 bands
   of 4, a pair of similarity 0.8 shares none with probability 3e-6 (0.85: 2e-8).
2. Texts that share a band's bucket are joined only where all their MinHash values leave the threshold a posterior above
   TOLERANCE (in a bucket, each text is compared with those that nothing reached yet, so copies of one text cost one pass).
   Chance meetings at half the similarity thus never chain a corpus into one component.
3. The components left are worked through in groups of bounded size: small ones bundled, large ones as pairs of blocks. In a group, MinHash values are compared a few at a time and a pair is dropped once the posterior probability that its
   similarity reaches the threshold (uniform prior) is below TOLERANCE; the rest is verified on the whole shingle sets. Links are counted and united there; no pair leaves the group.

Words are lower-cased stretches between white space. A text of one to four words is one shingle; a text without words
(null, empty) links to nothing, not even to its copies. Rows with the same text count as copies, also under one id.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import by_size
from .features import _ODD, Text, _table, mixed, runs
from .graph import components
from .shared import arrow, drop_staged, release, staged, text_or_empty

WORDS, THRESHOLD = 5, 0.8
BANDS, BAND = 24, 4
HASHES = BANDS * BAND
STEP, TOLERANCE = 8, 1e-6
BLOCK, MEMBERS = 256, 4096  # texts of a component's block; rows of buckets in a group
_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SOLID = ~_table([*range(9, 14), 32])


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in a row, sorted, and how many each text has."""
    t = Text([x.lower() for x in texts])
    total, down = t.sums(t.data)
    a, b = runs(_SOLID[t.data])
    if not len(a):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    word, doc = mixed((total[b] - total[a]) * down[a]), t.doc_of(a)
    n = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    left = n[doc] - place
    h = np.zeros(len(word), np.uint64)
    for k in range(words):
        part = np.zeros(len(word), np.uint64)
        part[: len(word) - k] = word[k:]
        h = h * _ODD + np.where(left > k, part, np.uint64(k + 1))
    whole = (left >= words) | (place == 0)
    h, doc = mixed(h[whole]), doc[whole]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    return h[new], np.bincount(doc[new], minlength=len(texts))


def minhash(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """HASHES 32-bit values for each text that has shingles."""
    first = (np.cumsum(n) - n)[n > 0]
    out = np.empty((len(first), HASHES), np.uint32)
    if len(first):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(((h ^ (h >> np.uint64(31))) * _FACTORS[k]) >> np.uint64(32), first)
    return out


def least_agreeing(threshold: float, tolerance: float, steps: range) -> dict[int, int]:
    """How many of n compared values must agree for the posterior P(similarity >= threshold) to be tolerance at least.

    With a uniform prior it is the chance of at most m successes in n + 1 trials of chance `threshold`.
    """
    out = {}
    for n in steps:
        below = 0.0
        for m in range(n + 2):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                out[n] = m
                break
    return out


_LEAST = least_agreeing(THRESHOLD, TOLERANCE, range(STEP, HASHES + 1, STEP))


def linked(sig: np.ndarray, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those whose similarity reaches the threshold."""
    agree = np.zeros(len(i), np.int32)
    for a in range(0, HASHES, STEP):
        agree += (sig[i, a : a + STEP] == sig[j, a : a + STEP]).sum(1, dtype=np.int32)
        keep = agree >= _LEAST[a + STEP]
        i, j, agree = i[keep], j[keep], agree[keep]
        if not len(i):
            return i, j
    size = np.array([len(s) for s in sets])
    fit = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
    i, j = i[fit], j[fit]
    if not len(i):
        return i, j
    if len(i) < 64:
        both = np.array([np.intersect1d(sets[x], sets[y], assume_unique=True).size for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        both = _common(sets, np.unique(np.r_[i, j]))[i, j]
    keep = both >= threshold * (size[i] + size[j] - both) - 1e-9
    return i[keep], j[keep]


def _common(sets: list[np.ndarray], used: np.ndarray, wide: int = 8192) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices of so many shingles at a time."""
    out = np.zeros((len(sets), len(sets)), np.int64)
    owner = np.repeat(used, [len(sets[k]) for k in used])
    _, at, n = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    shared = n[at] > 1
    owner, at = owner[shared], at[shared]
    at = np.unique(at, return_inverse=True)[1] if len(at) else at
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, wide):
        a, z = np.searchsorted(at, [lo, lo + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[owner[a:z], at[a:z] - lo] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            return root


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, md5, n (distinct shingles), sig."""

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in by_size(texts, 500_000):
                h, n = shingles(texts[lo:hi])
                sig = iter(minhash(h, n))
                yield pa.RecordBatch.from_arrays([pa.array(np.int64(part << 33) + np.arange(row, row + hi - lo)), b.column(0)[lo:hi], b.column(2)[lo:hi], pa.array(n.astype(np.int64)), pa.array([next(sig).tobytes() if k else b"" for k in n], pa.binary())], names=["row", "doc_id", "md5", "n", "sig"])
                row += hi - lo

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("md5")).transform(arrow, run, "row long, doc_id long, md5 binary, n long, sig binary")


def reached(sig: np.ndarray, least: int) -> np.ndarray:
    """For each text of a bucket the first text of its component, where texts join that agree on `least` values."""
    top, left, root, front = np.zeros(len(sig), np.int64), np.arange(1, len(sig)), 0, [0]
    while len(left):
        if not front:
            root, left = int(left[0]), left[1:]
            top[root], front = root, [root]
            continue
        near = (sig[left] == sig[front.pop()]).sum(1) >= least
        joined, left = left[near], left[~near]
        top[joined] = root
        front.extend(joined.tolist())
    return top


def _candidates(one: DataFrame) -> DataFrame:
    """Edges (a, b) from each text to the first text of its component in a bucket that it shares; one: t, sig of the distinct texts."""

    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, BAND).astype(np.uint64)
            h = np.zeros(sig.shape[:2], np.uint64)
            for k in range(BAND):
                h = mixed(h ^ (sig[:, :, k] + np.uint64(1)) * _ODD)
            h = mixed(h + np.arange(BANDS, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["bucket", "t"])

    banded = one.select("t", "sig").transform(arrow, run, "bucket long, t long")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = staged(banded.join(shared, "bucket"), "join-shared")
    bundles = max(1, met.count() // MEMBERS)
    blocks = F.when(F.col("n") > MEMBERS, F.ceil(F.col("n") * 2 / MEMBERS).cast("int")).otherwise(1)
    placed = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("t"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    whole = F.col("blocks") == 1
    keyed = placed.select(
        F.when(whole, F.pmod(F.xxhash64("bucket"), F.lit(bundles))).otherwise(F.col("bucket")).alias("key"),
        F.when(whole, -1).otherwise(F.least("block", "other")).alias("x"), F.when(whole, -1).otherwise(F.greatest("block", "other")).alias("y"), "bucket", "t",
    ).join(one.select("t", "sig"), "t")

    def meet(g: pa.Table) -> pa.Table:
        g = g.sort_by([("bucket", "ascending"), ("t", "ascending")])
        bucket, t = g["bucket"].to_numpy(), g["t"].to_numpy()
        sig = np.frombuffer(b"".join(g["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        size = np.diff(np.r_[starts, len(t)])
        first = np.arange(len(t))
        two = starts[size == 2]
        near = (sig[two] == sig[two + 1]).sum(1) >= _LEAST[HASHES]
        first[two[near] + 1] = two[near]
        for a, n in zip(starts[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            first[a : a + n] = a + reached(sig[a : a + n], _LEAST[HASHES])
        edge = np.unique(np.stack([t, t[first]])[:, t != t[first]], axis=1)
        return pa.table({"a": edge[0], "b": edge[1]})

    return keyed.groupBy("key", "x", "y").applyInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, md5, class_row, n_links, n_text_links, n_copies for each row of docs.

    class_row: the first row of its class (its own if it has no link). n_links: other rows that it is linked to, copies
    included; n_text_links: other texts; n_copies: rows with its text.
    """
    signed = staged(signatures(docs, id_col, text_col), "join-signatures")
    texts = staged(signed.where("n > 0").groupBy("md5").agg(F.min("row").alias("t"), F.count("*").alias("copies")), "join-texts")
    one = staged(signed.where("n > 0").join(texts.select(F.col("t").alias("row"), "copies"), "row").select(F.col("row").alias("t"), "doc_id", "md5", "sig", "copies"), "join-distinct")
    edges = staged(_candidates(one), "join-candidates")
    comp = staged(components(edges), "join-components")
    sizes = comp.groupBy("root").agg(F.count("*").alias("size"))
    bundles = max(1, int(comp.count() // 2000))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = comp.join(sizes, "root").select(F.col("node").alias("t"), "root", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    members = one.join(placed, "t")
    whole = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("m", F.unhex(F.md5("text")))
    known = members.join(whole, (members["md5"] == whole["m"]) & members["doc_id"].eqNullSafe(whole["id"])).select("t", "root", "blocks", "block", "sig", "copies", "text")
    spread = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.col("root")).alias("key"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.least("block", "other")).alias("x"), F.when(F.col("blocks") == 1, -1).otherwise(F.greatest("block", "other")).alias("y"),
        "t", "root", "block", "sig", "copies", "text",
    )

    def meet(g: pa.Table) -> pa.Table:
        g = g.sort_by([("root", "ascending"), ("t", "ascending")])
        t, root, block, copies = (g[c].to_numpy() for c in ("t", "root", "block", "copies"))
        new = np.r_[True, t[1:] != t[:-1]]  # a row repeated whole brings its text twice
        keep = np.flatnonzero(new)
        t, root, block, copies = t[keep], root[keep], block[keep], copies[keep]
        sig = np.frombuffer(b"".join(g["sig"].take(pa.array(keep)).to_pylist()), np.uint32).reshape(-1, HASHES)
        h, n = shingles(g["text"].take(pa.array(keep)).to_pylist())
        sets = np.split(h, np.cumsum(n)[:-1])
        x, y = g["x"][0].as_py(), g["y"][0].as_py()
        out = []
        starts = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(t)], strict=True):
            if x < 0 or x == y:
                i, j = np.triu_indices(z - a, 1)
            else:
                i, j = (v.ravel() for v in np.meshgrid(np.flatnonzero(block[a:z] == x), np.flatnonzero(block[a:z] == y), indexing="ij"))
            i, j = linked(sig[a:z], sets[a:z], i, j)
            if not len(i):
                continue
            top, c = _roots(z - a, i, j), copies[a:z]
            links = np.bincount(i, minlength=z - a) + np.bincount(j, minlength=z - a)
            weight = np.bincount(i, c[j], z - a) + np.bincount(j, c[i], z - a)
            who = np.flatnonzero(links)
            out.append((t[a:z][who], t[a:z][top[who]], links[who], weight[who].astype(np.int64), np.full(len(who), x >= 0)))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4 + [np.empty(0, bool)]
        release()
        return pa.table(dict(zip(("t", "top", "links", "weight", "cut"), cols, strict=True)))

    found = staged(keyed.groupBy("key", "x", "y").applyInArrow(meet, "t long, top long, links long, weight long, cut boolean"), "join-links")
    drop_staged(one, edges, comp)
    large = components(found.where("cut").select(F.col("t").alias("a"), F.col("top").alias("b")))
    classes = found.where(~F.col("cut")).select("t", F.col("top").alias("first")).union(large.select(F.col("node").alias("t"), F.col("root").alias("first")))
    links = found.groupBy("t").agg(F.sum("links").alias("links"), F.sum("weight").alias("weight"))
    by_text = texts.join(classes, "t", "left").join(links, "t", "left").select("md5", F.coalesce("first", "t").alias("class_row"), (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_text_links"), F.col("copies").alias("n_copies"))
    rows = signed.select("row", "doc_id", "md5").join(by_text, "md5", "left")
    return rows.select("row", "doc_id", "md5", F.coalesce("class_row", "row").alias("class_row"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), n_links, n_text_links, n_copies."""
    rows = staged(near_duplicates(docs, id_col, text_col), "join-rows")
    names = staged(rows.groupBy("class_row").agg(F.min("doc_id").alias("class_id")), "join-names")  # a table of its own, so a large class's rows can be split
    return rows.join(names, "class_row").select("doc_id", "class_id", "n_links", "n_text_links", "n_copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class: its first row. Texts without words all stay."""
    rows = staged(near_duplicates(docs, id_col, text_col), "join-rows")
    kept = rows.where("row = class_row").select(F.col("doc_id").alias("id__"), F.col("md5").alias("md5__")).distinct()
    keyed = docs.withColumn("m__", F.unhex(F.md5(text_or_empty(text_col))))
    worded = text_or_empty(text_col).rlike(r"[^\x20\x09-\x0D]")
    met = keyed.where(worded).join(kept, (F.col("m__") == F.col("md5__")) & F.col(id_col).cast("long").eqNullSafe(F.col("id__")), "left_semi").dropDuplicates([id_col, "m__"])
    return met.unionByName(keyed.where(~worded)).select(*docs.columns)
