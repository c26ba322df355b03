"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(word | before) = P(class | before) * P(slot | class, before) * P(word | slot). Words are ranked by count over all training
texts; the commonest stand in slots of classes, alone or, further down, several to a slot, where their share is that
of their counts plus one half; all rarer words and the unknown word share the last class by a hash, so no list of words
beyond `head` leaves the executors and every text's probabilities sum to one. Class and slot are softmaxes over sums of rows
of one hashed weight table: previous word, word before it (skip), both together, and bias for the class; previous word
with the class, and bias, for the slot.

Training is distributed: in each round every partition takes AdaGrad steps over its part of all training texts from
the shared weights and emits its changes; a change's mean over the partitions that made it is added to the weights. Changes
are added up by a tree of fixed width.
Scoring runs in numpy batches; rare words get their counts by a join. Null and empty texts have the end token alone.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import by_size
from .shared import arrow, drop_staged, parts_for, staged

END = b""
CLASSES = SLOTS = 32
LEAVES = (CLASSES - 1) * SLOTS  # of ranked words; the last class is for the rest
ALONE = LEAVES * 3 // 4  # words that have a slot of their own
TERMS, PAIRS, NEAR = 8192, 32768, 512
START = TERMS - 1
#: Rows of the weight table: previous, skip, pair, class bias, slot by class and previous, slot bias by class.
AT_SKIP, AT_PAIR, AT_BIAS = TERMS, 2 * TERMS, 2 * TERMS + PAIRS
AT_SLOT = AT_BIAS + 1
AT_SLOT_BIAS = AT_SLOT + CLASSES * NEAR
ROWS = AT_SLOT_BIAS + CLASSES
BLOCK = 1024
LONGEST = 64  # bytes of a word that can be in the head


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z lower-cased, then the end."""
    return [*(text or "").encode().lower().split(), END]


def counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """token, n over all rows of the column text; pre-aggregated in the workers."""

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(tokens(t))
                if len(seen) > most:
                    yield from give(seen)
                    seen.clear()
        yield from give(seen)

    def give(seen):
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    return docs.select("text").transform(arrow, run, "token binary, n long").repartition(parts_for(docs), "token").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The head: words by falling count, and what a leaf holds."""

    words: list[bytes]
    n: np.ndarray
    total: int
    distinct: int
    rest: np.ndarray  # sum of n + 0.5 over the words beyond the head, by slot of the last class

    def __post_init__(self) -> None:
        size = len(self.words)
        alone = min(size, ALONE)
        leaf = np.arange(size)
        if size > alone:
            leaf[alone:] = alone + (np.arange(size - alone) * (LEAVES - alone)) // (size - alone)
        self.leaf = leaf
        weight = np.bincount(leaf, self.n + 0.5, LEAVES)
        self.mass = np.r_[weight, self.rest + 0.5]  # each slot of the last class also holds the unknown
        self.share = np.log10((self.n + 0.5) / self.mass[leaf]) if size else np.empty(0)
        self.below = np.log10(self.total + 0.5 * (self.distinct + 1))
        self.code = dict(zip(self.words, range(size), strict=True))
        term = np.arange(size)
        self.term = np.where(term < 6144, term, 6144 + term % 1024)

    def bias(self) -> np.ndarray:
        """Weights that give the leaves' own shares."""
        table = np.zeros((ROWS, CLASSES), np.float32)
        mass = np.maximum(self.mass.reshape(CLASSES, SLOTS), 1e-3)
        table[AT_BIAS] = np.log(mass.sum(1) / mass.sum())
        table[AT_SLOT_BIAS : AT_SLOT_BIAS + CLASSES] = np.log(mass / mass.sum(1, keepdims=True))
        return table


def slot_of(word: bytes) -> int:
    return zlib.crc32(word) % SLOTS


def vocabulary(counted: DataFrame, head: int = 1 << 18) -> tuple[Vocabulary, Column]:
    """From the staged counts; and the condition that tells words beyond the head."""
    all_n, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    short = F.length("token") <= LONGEST
    top = counted.where(short).orderBy(F.desc("n"), "token").limit(head).toArrow()
    words, n = [bytes(w) for w in top["token"].to_pylist()], top["n"].to_numpy().astype(np.int64)
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    words, n = [words[k] for k in order], n[order]
    if words:
        least, last = int(n[-1]), F.lit(words[-1])
        beyond = ~(short & ((F.col("n") > least) | ((F.col("n") == least) & (F.col("token") <= last))))
    else:
        beyond = F.lit(True)
    rest = np.zeros(SLOTS)
    for r in counted.where(beyond).groupBy((F.crc32("token") % SLOTS).alias("slot")).agg(F.sum(F.col("n") + 0.5).alias("w")).collect():
        rest[r["slot"]] = r["w"]
    return Vocabulary(words, n, int(all_n), int(distinct), rest), beyond


@dataclass
class Batch:
    code: np.ndarray  # rank of each token, -1 beyond the head
    leaf: np.ndarray
    prev: np.ndarray
    skip: np.ndarray
    ends: np.ndarray  # where each text ends
    far: list[tuple[int, bytes]]  # place and bytes of the tokens beyond the head


def batch(texts: list, v: Vocabulary) -> Batch:
    split = [tokens(t) for t in texts]
    flat = list(chain.from_iterable(split))
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
    code = np.fromiter(map(v.code.get, flat, repeat(-1)), np.int64, len(flat))
    missing = np.flatnonzero(code < 0)
    far = [(k, flat[k]) for k in missing.tolist()]
    slot = np.fromiter((slot_of(w) for _, w in far), np.int64, len(far))
    leaf, term = (v.leaf[code], v.term[code]) if len(v.words) else (np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64))
    leaf[missing], term[missing] = LEAVES + slot, 7168 + slot
    prev, skip = np.r_[START, term[:-1]], np.r_[START, START, term[:-2]]
    begins = np.r_[0, ends[:-1]]
    prev[begins] = START
    skip[begins] = START
    skip[begins[np.diff(np.r_[begins, len(flat)]) > 1] + 1] = START
    return Batch(code, leaf, prev, skip[: len(flat)], ends, far)


def _rows(b: Batch, a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    p, s = b.prev[a:z], b.skip[a:z]
    kind, slot = b.leaf[a:z] // SLOTS, b.leaf[a:z] % SLOTS
    pair = AT_PAIR + (p * 40503 + s * 30011) % PAIRS
    return np.stack([p, AT_SKIP + s, pair]), np.stack([AT_SLOT + kind * NEAR + np.minimum(p, NEAR - 1), AT_SLOT_BIAS + kind]), kind, slot


def _logits(table: np.ndarray, f: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of classes and of slots; far below where single precision overflows, so no maximum has to be taken off."""
    z, y = np.take(table, f[0], 0, mode="clip"), np.take(table, g[0], 0, mode="clip")
    z += np.take(table, f[1], 0, mode="clip")
    z += np.take(table, f[2], 0, mode="clip")
    z += table[AT_BIAS]
    y += np.take(table, g[1], 0, mode="clip")
    return np.minimum(z, 80, out=z), np.minimum(y, 80, out=y)


def log_probability(table: np.ndarray, b: Batch, step: int = 8192) -> np.ndarray:
    """log10 P(class, slot | before) of each token."""
    out = np.empty(len(b.leaf))
    for a in range(0, len(b.leaf), step):
        f, g, kind, slot = _rows(b, a, a + step)
        me, got = np.arange(len(kind)), np.zeros(len(kind))
        for logits, at in zip(_logits(table, f, g), (kind, slot), strict=True):
            got += logits[me, at]
            got -= np.log(np.exp(logits, out=logits).sum(1))
        out[a : a + step] = got
    return out / np.log(10)


def learn(table: np.ndarray, grown: np.ndarray, b: Batch, rate: float = 0.1, step: int = 16384) -> None:
    """AdaGrad steps in place; grown: the sum of squared gradients of each row."""
    for a in range(0, len(b.leaf), step):
        f, g, kind, slot = _rows(b, a, a + step)
        n = len(kind)
        me = np.arange(n)
        dz, dy = (_shares(x) for x in _logits(table, f, g))
        dz[kind, me] -= 1
        dy[slot, me] -= 1
        for rows, base, d in ((f[0], 0, dz), (f[1], AT_SKIP, dz), (f[2], AT_PAIR, dz), (g[0], AT_SLOT, dy)):
            near = (rows - base).astype(np.uint16)  # numpy sorts these by radix
            order = np.argsort(near, kind="stable")
            at = near[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            grad = np.add.reduceat(np.take(d, order, 1, mode="clip"), first, axis=1).T
            at = at[first].astype(np.int64) + base
            grad /= np.sqrt(np.diff(np.r_[first, n])).astype(np.float32)[:, None]
            grown[at] += np.einsum("ij,ij->i", grad, grad) / CLASSES
            grad *= (rate / np.sqrt(grown[at]))[:, None]
            table[at] -= grad


def _shares(logits: np.ndarray) -> np.ndarray:
    """The softmax, a column a token: sums over tokens run along memory."""
    out = np.exp(logits, out=logits).T.copy()
    out /= out.sum(0)
    return out


#: Changes that are added up in one group, and groups in one task: a task reads about WIDE * GROUPS * 132 KB at any size of corpus.
WIDE, GROUPS = 8, 12
_CHANGE = "block int, part int, change binary, made binary"


def _added(t: pa.Table) -> pa.Table:
    """One block's changes added up, and how many partitions made each row of it."""
    total, made = np.zeros((1, 1), np.float32), 0
    for c, m in zip(t["change"].to_pylist(), t["made"].to_pylist(), strict=True):
        x = np.frombuffer(c, "<f4" if m else "<f2").astype(np.float32).reshape(-1, CLASSES)
        total = total + x
        made = made + (np.frombuffer(m, "<i4") if m else x.any(1).astype("<i4"))
    return pa.table({"block": t["block"][:1], "part": t["part"][:1], "change": pa.array([total.astype("<f4").tobytes()], pa.binary()), "made": pa.array([made.astype("<i4").tobytes()], pa.binary())})


def _summed(changes: DataFrame, parts: int, blocks: int) -> DataFrame:
    """A row a block: the sum over all `parts` partitions, by a tree WIDE changes broad, so no group grows with the corpus."""
    while True:
        parts = -(-parts // WIDE)
        groups = changes.withColumn("part", F.floor(F.col("part") / WIDE).cast("int")).repartition(max(1, parts * blocks // GROUPS), "block", "part")
        changes = groups.groupBy("block", "part").applyInArrow(_added, _CHANGE)
        if parts <= 1:
            return changes


def train(docs: DataFrame, v: Vocabulary, rounds: int = 2) -> np.ndarray:
    """The weight table after `rounds` rounds, each over another part of the texts (by a hash); all are learnt from once."""
    spark = docs.sparkSession
    table = v.bias()
    words = spark.sparkContext.broadcast(v)  # the head has a fixed largest size
    blocks = -(-ROWS // BLOCK)
    for r in range(rounds):
        now = spark.sparkContext.broadcast(table)

        def run(batches, now=now):
            own, grown, any_rows = now.value.copy(), np.full(ROWS, 1.0, np.float32), False
            for b in batches:
                texts = b.column(0).to_pylist()
                for lo, hi in by_size(texts, 1_000_000):
                    learn(own, grown, batch(texts[lo:hi], words.value))
                    any_rows = True
            if any_rows:
                own -= now.value
                part = TaskContext.get().partitionId()
                data = [own[k * BLOCK : (k + 1) * BLOCK].astype("<f2").tobytes() for k in range(blocks)]
                yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([part] * blocks, pa.int32()), pa.array(data, pa.binary()), pa.array([b""] * blocks, pa.binary())], names=["block", "part", "change", "made"])

        part = docs.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(rounds)) == r) if rounds > 1 else docs
        changes = staged(part.select("text").transform(arrow, run, _CHANGE), "lm-changes", "snappy")
        last = changes.agg(F.max("part")).first()[0]
        table = table.copy()
        for row in _summed(changes, 0 if last is None else last + 1, blocks).collect():  # a row a block of the table, whose size is fixed
            made = np.frombuffer(row["made"], "<i4")
            change = np.frombuffer(row["change"], "<f4").reshape(-1, CLASSES) / np.maximum(made, 1)[:, None]
            table[row["block"] * BLOCK : row["block"] * BLOCK + len(change)] += change
        drop_staged(changes)
    return table


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows where not held_out (a null condition is false), and scores all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learnt = rows.where(~F.col("held_out"))
    counted = staged(counts(learnt), "lm-counts")
    v, beyond = vocabulary(counted)
    table = train(learnt, v)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((v, table))
    rare = "array<struct<token: binary, n: long>>"

    def run(batches):
        v, table = model.value
        known = np.log10(v.n + 0.5) - v.below
        part, row = TaskContext.get().partitionId(), 0
        rests = np.log10(v.mass[LEAVES:])
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in by_size(texts, 1_000_000):
                x = batch(texts[lo:hi], v)
                in_head = x.code >= 0
                own = log_probability(table, x)
                base = np.full(len(own), -v.below)
                base[in_head] = known[x.code[in_head]]
                own[in_head] += v.share[x.code[in_head]]
                own[~in_head] -= rests[x.leaf[~in_head] - LEAVES]
                first = np.r_[0, x.ends[:-1]]
                where = np.searchsorted(x.ends, np.array([k for k, _ in x.far], np.int64), "right")
                seen = list(Counter(zip(where.tolist(), (w for _, w in x.far), strict=True)).items())  # in the order of documents
                cut = np.searchsorted(np.array([d for (d, _), _ in seen], np.int64), np.arange(hi - lo + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array([w for (_, w), _ in seen], pa.binary()), pa.array([n for _, n in seen], pa.int64())], names=["token", "n"])
                far = pa.ListArray.from_arrays(pa.array(cut), pairs)
                ids = pa.array(np.int64(part << 33) + np.arange(row, row + hi - lo))
                row += hi - lo
                yield pa.RecordBatch.from_arrays(
                    [ids, b.column(0)[lo:hi], b.column(2)[lo:hi], pa.array(np.diff(np.r_[0, x.ends])), pa.array(np.add.reduceat(in_head.astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(own, first)), far],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "far"],
                )

    kinds = f"row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, far {rare}"
    scored = staged(rows.transform(arrow, run, kinds), "lm-scores")
    words = scored.select("row", F.explode("far").alias("f")).select("row", "f.token", F.col("f.n").alias("times"))
    met = words.join(counted.where(beyond), "token", "left")
    late = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("far").join(late, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))
