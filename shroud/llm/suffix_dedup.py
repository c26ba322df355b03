"""Suffix-array dedup: removes every byte that a repeated string of 400 bytes covers.

Suffixes are put into buckets by content, so equal strings of 400 bytes share one: the bucket of a start is the hash of
the least 80-byte string among those that begin in its 400 bytes (leftmost of equals). Starts next to each other mostly
share it, so a bucket is filled with short stretches of text. A bucket of one stretch can hold no repeat and is never
built; the rest is sorted bucket by bucket, in groups of bounded size:

* stretches are laid out so that the bucket's own string stands at a multiple of PERIOD, hence equal strings at equal residues;
* the suffixes at a difference cover of residues are ranked first, to 32, 64, ... 512 bytes, by doubling;
* each residue's suffixes are sorted by their first 8 bytes, ties by the rank of the cover suffix 0 to 8 bytes on;
* neighbours that agree on 400 bytes (read off the ranks, and 16 bytes compared) are repeats.

Equal texts stand for each other, and equal stretches are sorted once with their number, so copies cost no more than one.
A bucket of more than HOT stretches is cut by the 128-bit fingerprint of each start's 400 bytes and counted by it instead.
Texts are UTF-8 bytes; null counts as empty; a text under 400 bytes keeps everything. Matches never cross documents.

On request (`words`) repeated strings of so many words are found too, however short; those of 400 bytes are found already.
Windows of so many words get buckets in the same way, by the least key of half as many words, and those of shared buckets
are counted by their 128-bit fingerprints. They count in n_passage_bytes and in what the pipeline keeps, not in the figures
of the 400-byte rule.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .features import _ODD, _SOLID, _table, mixed, powers
from .shared import arrow, drop_staged, release, staged, text_or_empty

LENGTH, KEY = 400, 80
SPAN = LENGTH - KEY + 1  # how many keys begin in a string
PERIOD, REACH = 32, 8
HOT = 50_000
GROUP_BYTES, BATCH_BYTES = 2_000_000, 1 << 19
_LETTER = _table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def difference_cover(period: int = PERIOD, reach: int = REACH) -> np.ndarray:
    """A small set of residues whose differences give all residues, with no gap over `reach`."""
    for size in range(2, period + 1):
        for rest in combinations(range(1, period), size - 1):
            d = (0, *rest)
            if max(b - a for a, b in zip(d, (*rest, period), strict=True)) <= reach and len({(a - b) % period for a in d for b in d}) == period:
                return np.array(d)
    raise ValueError("no cover")


_COVER = difference_cover()
_NEXT = np.array([min((c - r) % PERIOD for c in _COVER) for r in range(PERIOD)])  # from a residue to the cover


def _least(hash_: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost least of `width` hashes (their upper halves) from each place on stands."""
    low = np.uint64(0xFFFFFFFF)
    key = (hash_ & ~low) | np.arange(len(hash_), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    return (key & low).astype(np.int64)


class Starts:
    """All starts of strings of LENGTH bytes in a few documents: the document, the place, where its least key stands, and its hash."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.size, self.first = size, np.cumsum(size) - size
        n = len(self.data)
        up, self.down = powers(n + 1)
        values = self.data.astype(np.uint64) + np.uint64(1)
        self.total = np.r_[np.uint64(0), np.cumsum(values * up[:-1])]
        if n < LENGTH:
            self.at = self.doc = self.key_at = np.empty(0, np.int64)
            self.hash = np.empty(0, np.uint64)
            return
        keys = mixed((self.total[KEY:] - self.total[:-KEY]) * self.down[: n + 1 - KEY])
        where = _least(keys, SPAN)
        room = np.maximum(size - LENGTH + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), room)
        self.at = np.arange(len(self.doc)) + np.repeat(self.first - (np.cumsum(room) - room), room)
        self.key_at = where[self.at]
        self.hash = keys[self.key_at]

    def fingerprint(self, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each stretch of bytes."""
        if not hasattr(self, "other"):
            up, _ = powers(len(self.data) + 1)
            self.other = np.r_[np.uint64(0), np.cumsum(mixed(self.data.astype(np.uint64) + np.uint64(77)) * up[:-1])]
        n = (z - a).astype(np.uint64)
        return mixed((self.total[z] - self.total[a]) * self.down[a] + n), mixed((self.other[z] - self.other[a]) * self.down[a] ^ n)


def _marks(data: np.ndarray) -> np.ndarray:
    """Bytes of the marks of Latin-1 (U+0080 to U+00BF) and of general and CJK punctuation (U+2000 to U+207F, U+3000 to U+303F)."""
    second = np.r_[data[1:], np.uint8(0)]
    three = (data == 0xE2) & ((second == 0x80) | (second == 0x81)) | (data == 0xE3) & (second == 0x80)
    lead = three | (data == 0xC2)
    out = lead.copy()
    out[1:] |= lead[:-1]
    out[2:] |= three[:-2]
    return out


class Windows:
    """All strings of so many words (runs without white space, marks at the string's ends left out) under LENGTH bytes: the
    document, from where to where, where the least key stands, and its hash; n_words of each document."""

    def __init__(self, s: Starts, words: int) -> None:
        owner = np.repeat(np.arange(len(s.size)), s.size)
        solid = _SOLID[s.data]
        joined = solid[1:] & solid[:-1] & (owner[1:] == owner[:-1])
        a, z = np.flatnonzero(solid & ~np.r_[False, joined][: len(solid)]), np.flatnonzero(solid & ~np.r_[joined, False][: len(solid)]) + 1
        doc = owner[a]
        self.n_words = np.bincount(doc, minlength=len(s.size))
        letters = np.r_[np.flatnonzero(_LETTER[s.data] & ~_marks(s.data)), len(s.data)]
        low, high = np.searchsorted(letters, a), np.searchsorted(letters, z)
        some = high > low
        a, z = np.where(some, letters[low], a), np.where(some, letters[high - 1] + 1, z)
        if len(a) < words:
            self.at = self.end = self.doc = self.key_at = np.empty(0, np.int64)
            self.hash = np.empty(0, np.uint64)
            return
        key = (words + 1) // 2
        from_, to = a[: len(a) - key + 1], z[key - 1 :]
        keys = mixed((s.total[to] - s.total[from_]) * s.down[from_] + (to - from_).astype(np.uint64))
        last = z[words - 1 :]
        keep = np.flatnonzero((doc[: len(last)] == doc[words - 1 :]) & (last - a[: len(last)] < LENGTH))
        self.at, self.end, self.doc = a[keep], last[keep], doc[keep]
        self.key_at = _least(keys, words - key + 1)[keep]
        self.hash = keys[self.key_at]


def _asked(doc: np.ndarray, hash_: np.ndarray, keys: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Which strings have a bucket that their document's list in keys names, and where in the flat list it stands."""
    want, who = keys.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy())
    tag = lambda d, h: mixed(h + d.astype(np.uint64) * _ODD)
    known = tag(who, want)
    order = np.argsort(known)
    known = known[order]
    mine = tag(doc, hash_)
    at = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
    keep = np.flatnonzero(known[at] == mine) if len(known) and len(mine) else np.empty(0, np.int64)
    return keep, order[at[keep]]


def _folded(f: np.ndarray, g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal fingerprints together, and where in it each begins."""
    order = np.lexsort((at, g, f))
    same = np.r_[False, (f[order][1:] == f[order][:-1]) & (g[order][1:] == g[order][:-1])]
    return order, np.flatnonzero(~same)


def _batches(b: pa.RecordBatch, column: int):
    """(from, to) of runs of rows of about BATCH_BYTES."""
    size = [x or 0 for x in pc.binary_length(b.column(column)).to_pylist()]
    at = 0
    while at < len(size):
        to, n = at + 1, size[at]
        while to < len(size) and (n := n + size[to]) <= BATCH_BYTES:
            to += 1
        yield at, to
        at = to


def _anchors(docs: DataFrame, words: int | None = None) -> DataFrame:
    """row, doc_id, md5, n_bytes, sha, long (of LENGTH bytes), wordy (of so many words), and the hashes of the text's buckets with 1 or 2 (more than one stretch)."""

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi in _batches(b, 2):
                texts = b.column(2)[lo:hi].to_pylist()
                s = Starts(texts)
                new = np.flatnonzero(np.r_[True, (s.key_at[1:] != s.key_at[:-1]) | (s.doc[1:] != s.doc[:-1])]) if len(s.at) else np.empty(0, np.int64)
                doc, h, long, wordy = s.doc[new], s.hash[new], s.size >= LENGTH, np.zeros(hi - lo, bool)
                if words:
                    w = Windows(s, words)
                    new = np.flatnonzero(np.r_[True, (w.key_at[1:] != w.key_at[:-1]) | (w.doc[1:] != w.doc[:-1])]) if len(w.at) else np.empty(0, np.int64)
                    doc, h, wordy = np.r_[doc, w.doc[new]], np.r_[h, w.hash[new]], w.n_words >= words
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.empty(0, np.int64)
                times = np.minimum(np.diff(np.r_[first, len(h)]), 2)
                doc, h = doc[first], h[first].view(np.int64)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.int64(part << 33) + np.arange(row, row + hi - lo)), b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(long), pa.array(wordy), pa.ListArray.from_arrays(pa.array(cut), pa.array(h)), pa.ListArray.from_arrays(pa.array(cut), pa.array(times.astype(np.int32)))],
                    names=["row", "doc_id", "md5", "n_bytes", "sha", "long", "wordy", "keys", "times"],
                )
                row += hi - lo

    return docs.select("doc_id", "md5", "data").transform(arrow, run, "row long, doc_id long, md5 binary, n_bytes long, sha string, long boolean, wordy boolean, keys array<long>, times array<int>")


def _stretches(texts: DataFrame) -> DataFrame:
    """From row, data, keys, hot: a row for each different stretch of a batch of documents, with where it stands.

    key, lead (from the stretch's start to the bucket's own string), data, rows, ats (document and place of each occurrence).
    Hot starts come one by one with a fingerprint (f, g) and no data.
    """

    def run(batches):
        for b in batches:
            for lo, hi in _batches(b, 1):
                s = Starts(b.column(1)[lo:hi].to_pylist())
                rows = b.column(0)[lo:hi].to_numpy()
                hot = b.column(3)[lo:hi].flatten().to_numpy(zero_copy_only=False).astype(bool)
                keep, which = _asked(s.doc, s.hash, b.column(2)[lo:hi])
                if not len(keep):
                    continue
                start, key_at, h, d, warm = s.at[keep], s.key_at[keep], s.hash[keep], s.doc[keep], hot[which]
                new = np.flatnonzero(np.r_[True, (key_at[1:] != key_at[:-1]) | (d[1:] != d[:-1]) | (start[1:] != start[:-1] + 1) | warm[1:] | warm[:-1]])
                last = np.r_[new[1:], len(start)] - 1
                a, z = start[new], start[last] + LENGTH
                f, g = s.fingerprint(a, z)
                order, first = _folded(f, g, a)
                one = order[first]
                cut = pa.array(np.r_[first, len(order)].astype(np.int32))
                warm = warm[new]
                owner = d[new][order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[new][one].view(np.int64)), pa.array((key_at[new] - a)[one].astype(np.int32)), pa.array([b"" if w else s.data[x:y].tobytes() for x, y, w in zip(a[one].tolist(), z[one].tolist(), warm[one].tolist(), strict=True)], pa.binary()), pa.ListArray.from_arrays(cut, pa.array(rows[owner])), pa.ListArray.from_arrays(cut, pa.array(a[order] - s.first[owner])), pa.array(f[one].view(np.int64)), pa.array(g[one].view(np.int64)), pa.array(warm[one])],
                    names=["key", "lead", "data", "rows", "ats", "f", "g", "hot"],
                )

    return texts.select("row", "data", "keys", "hot").transform(arrow, run, "key long, lead int, data binary, rows array<long>, ats array<long>, f long, g long, hot boolean")


def _windows(texts: DataFrame, words: int) -> DataFrame:
    """From row, data, keys: a row for each different string of so many words of a batch of documents whose bucket is shared:
    its fingerprint (f, g), its bytes, and the document and place of each occurrence."""

    def run(batches):
        for b in batches:
            for lo, hi in _batches(b, 1):
                s = Starts(b.column(1)[lo:hi].to_pylist())
                w = Windows(s, words)
                keep, _ = _asked(w.doc, w.hash, b.column(2)[lo:hi])
                if not len(keep):
                    continue
                a, z, d = w.at[keep], w.end[keep], w.doc[keep]
                f, g = s.fingerprint(a, z)
                order, first = _folded(f, g, a)
                one, owner = order[first], d[order]
                cut = pa.array(np.r_[first, len(order)].astype(np.int32))
                rows = b.column(0)[lo:hi].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f[one].view(np.int64)), pa.array(g[one].view(np.int64)), pa.array(z[one] - a[one]), pa.ListArray.from_arrays(cut, pa.array(rows[owner])), pa.ListArray.from_arrays(cut, pa.array(a[order] - s.first[owner]))],
                    names=["f", "g", "bytes", "rows", "ats"],
                )

    return texts.select("row", "data", "keys").transform(arrow, run, "f long, g long, bytes long, rows array<long>, ats array<long>")


def sort_bucket(data: list[bytes], lead: np.ndarray, many: np.ndarray) -> list[np.ndarray]:
    """For each stretch, which of its starts (len - LENGTH + 1 of them) are repeated, by suffix sorting.

    lead: where the bucket's own string stands in the stretch; many: whether the stretch itself occurs more than once.
    """
    size = np.fromiter(map(len, data), np.int64, len(data))
    place, end = np.empty(len(data), np.int64), 0
    for k, (n, at) in enumerate(zip(size.tolist(), lead.tolist(), strict=True)):
        place[k] = end + (-(end + at)) % PERIOD
        end = int(place[k]) + n
    text = np.zeros(end + LENGTH + PERIOD, np.uint8)
    flat = np.frombuffer(b"".join(data), np.uint8)
    text[np.arange(len(flat)) + np.repeat(place - (np.cumsum(size) - size), size)] = flat
    words = np.zeros(len(text), np.uint64)  # the 8 bytes from each place on, first byte highest
    for k in range(8):
        words[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    last = len(text) - PERIOD
    cover = np.flatnonzero(np.isin(np.arange(last) % PERIOD, _COVER))
    index = np.full(len(text) + 1, -1, np.int32)
    index[cover] = np.arange(len(cover))
    parts = [words[cover + 8 * k] for k in range(PERIOD // 8)]
    order = np.lexsort(parts[::-1])
    step = np.zeros(len(cover), bool)
    for p in parts:
        step[1:] |= p[order][1:] != p[order][:-1]
    rank = np.empty(len(cover), np.int64)
    rank[order] = np.cumsum(step)
    ranks, width = {}, PERIOD
    while width < 512:  # twice the width a round
        ranks[width] = rank
        further = index[np.minimum(cover + width, len(text))]
        pair = rank * (len(cover) + 1) + np.where(further >= 0, rank[further] + 1, 0)
        rank = np.unique(pair, return_inverse=True)[1]
        width *= 2
    room = size - LENGTH + 1
    start = np.arange(room.sum()) + np.repeat(place - (np.cumsum(room) - room), room)
    repeated = np.repeat(many, room)
    for residue in range(PERIOD):  # one bucket of suffixes at a time
        mine = np.flatnonzero(start % PERIOD == residue)
        if len(mine) < 2:
            continue
        p = start[mine]
        on = index[p + _NEXT[residue]]
        order = np.lexsort((rank[on], words[p]))
        p, on = p[order], on[order]
        tail = index[p + _NEXT[residue] + 256]
        equal = (words[p][1:] == words[p][:-1]) & (ranks[256][on][1:] == ranks[256][on][:-1]) & (ranks[128][tail][1:] == ranks[128][tail][:-1])
        for k in (LENGTH - 16, LENGTH - 8):
            equal &= words[p + k][1:] == words[p + k][:-1]
        repeated[mine[order]] |= np.r_[False, equal] | np.r_[equal, False]
    return np.split(repeated, np.cumsum(room)[:-1])


def _merged(row: np.ndarray, a: np.ndarray, z: np.ndarray) -> pa.Table:
    """A row for each document, with its stretches of bytes in order, those that touch made one."""
    order = np.lexsort((a, row))
    row, a, z = row[order], a[order], z[order]
    names, who = np.unique(row, return_inverse=True)
    far = who.astype(np.int64) << np.int64(40)
    reach = np.maximum.accumulate(z + far)
    first = np.flatnonzero(np.r_[True, a[1:] + far[1:] > reach[:-1]]) if len(a) else np.empty(0, np.int64)
    ends = np.maximum.reduceat(z, first) if len(a) else z
    spans = pa.StructArray.from_arrays([pa.array(a[first]), pa.array(ends)], names=["a", "z"])
    cut = np.searchsorted(who[first], np.arange(len(names) + 1)).astype(np.int32)
    return pa.table({"row": pa.array(names.astype(np.int64)), "spans": pa.ListArray.from_arrays(pa.array(cut), spans)})


def _sorted(stretches: DataFrame, groups: int) -> DataFrame:
    """row, spans (array of a, z): bytes that repeated strings of a group's buckets cover."""

    def meet(g: pa.Table) -> pa.Table:
        key, lead, data = g["key"].to_numpy(), g["lead"].to_numpy(), g["data"].to_pylist()
        rows, ats = g["rows"].combine_chunks(), g["ats"].combine_chunks()
        own, n = np.zeros(len(data), np.int64), rows.value_lengths().to_numpy()
        seen: dict = {}
        for k, what in enumerate(zip(key.tolist(), data, strict=True)):
            own[k] = seen.setdefault(what, len(seen))
        first = np.unique(own, return_index=True)[1]
        many = np.bincount(own, n) > 1
        found = sort_bucket([data[k] for k in first.tolist()], lead[first], many)
        out_row, out_a, out_z = [], [], []
        cut = np.r_[0, np.cumsum(n)]
        rows, ats = rows.flatten().to_numpy(), ats.flatten().to_numpy()
        spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, u in enumerate(own.tolist()):
            if u not in spans:
                edge = np.diff(np.r_[np.int8(0), found[u].view(np.int8), np.int8(0)])
                spans[u] = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + LENGTH
            a, z = spans[u]
            if len(a):
                here = ats[cut[k] : cut[k + 1]]
                out_row.append(np.repeat(rows[cut[k] : cut[k + 1]], len(a)))
                out_a.append((here[:, None] + a[None]).ravel())
                out_z.append((here[:, None] + z[None]).ravel())
        out = _merged(*(np.concatenate(c) if c else np.empty(0, np.int64) for c in (out_row, out_a, out_z)))
        release()
        return out

    return stretches.where(~F.col("hot")).withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).select("group", "key", "lead", "data", "rows", "ats").groupBy("group").applyInArrow(meet, "row long, spans array<struct<a:long,z:long>>")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, rows). texts: row, data, keys, hot: each different text that shares a bucket, and which; rows: row, doc_id, md5,
    n_bytes, sha, long, wordy, first (the first row with that text), copies for each row of docs."""
    data = F.col("text").cast("binary")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).select("doc_id", F.unhex(F.md5(data)).alias("md5"), data.alias("data"))
    marked = staged(_anchors(keyed, words), "suffix-anchors")
    texts = staged(marked.groupBy("md5").agg(F.min("row").alias("row"), F.count("*").alias("copies")), "suffix-copies")  # a table of its own, so one text's many rows can be split
    rows = staged(marked.select("row", "doc_id", "md5", "n_bytes", "sha", "long", "wordy").join(texts.select("md5", F.col("row").alias("first"), "copies"), "md5"), "suffix-rows")
    one = marked.where(F.size("keys") > 0).join(rows.where("row = first").select("row"), "row", "left_semi")
    buckets = one.select("row", F.explode(F.arrays_zip("keys", "times")).alias("k")).select("row", F.col("k.keys").alias("key"), F.col("k.times").alias("times"))
    shared = buckets.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1")
    wanted = staged(buckets.join(shared, "key").groupBy("row").agg(F.collect_list(F.struct("key", (F.col("n") > hot).alias("hot"))).alias("k")), "suffix-wanted")
    named = wanted.join(rows.select("row", "doc_id", "md5"), "row")
    k = F.col("k")
    met = named.join(keyed.withColumnRenamed("doc_id", "id").withColumnRenamed("md5", "m"), (F.col("md5") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("id")))
    once = met.dropDuplicates(["md5", "doc_id"])  # a row repeated whole brings its text twice
    held = staged(once.select("row", "data", F.transform(k, lambda x: x["key"]).alias("keys"), F.transform(k, lambda x: x["hot"]).alias("hot")), "suffix-texts")
    drop_staged(marked, texts, wanted)
    return held, rows


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, words: int | None = None, with_kept: bool = True) -> DataFrame:
    """row, doc_id, md5, n_bytes; n_removed, n_spans, kept_sha256 by the rule of 400 bytes; n_passage_bytes: bytes that it or, with
    `words`, repeated strings of so many words cover (all of a copied text that has as many); and kept: what these leave where
    that is less than all, else null (always null without with_kept)."""
    held, rows = candidates(docs, id_col, text_col, hot, words)
    pieces = held.select(F.sum(F.size("keys"))).first()[0] or 0
    groups = max(1, int(pieces * (LENGTH + SPAN // 2) // GROUP_BYTES))
    made = _stretches(held)
    if held.where(F.exists("hot", lambda h: h)).limit(1).count():
        made = staged(made, "suffix-stretches")
        warm = made.where("hot").select("f", "g", F.explode(F.arrays_zip("rows", "ats")).alias("o"))
        twice = warm.groupBy("f", "g").count().where("count > 1")
        one_by_one = warm.join(twice, ["f", "g"]).select(F.col("o.rows").alias("row"), F.array(F.struct(F.col("o.ats").alias("a"), (F.col("o.ats") + LENGTH).alias("z"))).alias("spans"))
        covered = _sorted(made, groups).union(one_by_one)
    else:
        covered = _sorted(made, groups)
    covered = covered.withColumn("exact", F.lit(True))
    if words:
        alike = staged(_windows(held, words), "suffix-windows")
        twice = alike.groupBy("f", "g").agg(F.sum(F.size("rows")).alias("n")).where("n > 1").select("f", "g")
        at = alike.join(twice, ["f", "g"]).select("bytes", F.explode(F.arrays_zip("rows", "ats")).alias("o"))
        covered = covered.union(at.select(F.col("o.rows").alias("row"), F.array(F.struct(F.col("o.ats").alias("a"), (F.col("o.ats") + F.col("bytes")).alias("z"))).alias("spans"), F.lit(False)))
    gathered = lambda exact: F.flatten(F.collect_list(F.when(F.col("exact") == exact, F.col("spans"))))
    spans = covered.groupBy("row").agg(gathered(True).alias("spans"), gathered(False).alias("passages"))

    def left(data: bytes, spans: list) -> tuple[bytes, int]:
        """What the spans leave, and how many runs they make."""
        out, end, n = [], 0, 0
        for s in sorted(spans, key=lambda s: s["a"]):
            if s["a"] > end or not n:
                n += 1
                out.append(data[end : s["a"]])
            end = max(end, s["z"])
        return b"".join([*out, data[end:]]), n

    def cut(batches):
        for b in batches:
            out = []
            for row, data, spans, passages in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kept, n = left(data, spans)
                both = left(data, spans + passages)[0] if passages else kept
                out.append((row, len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), len(data) - len(both), both if with_kept else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["first", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "kept"])

    shape = "first long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, kept binary"
    done = held.select("row", "data").join(spans, "row").transform(arrow, cut, shape)
    whole = (F.col("copies") > 1) & F.col("long")
    gone = (F.col("copies") > 1) & (F.col("long") | F.col("wordy"))
    nothing = F.lit(b"" if with_kept else None).cast("binary")
    figure = lambda name, other: F.coalesce(name, other).alias(name)
    met = rows.where(~gone).join(done, "first", "left").select("row", "doc_id", "md5", "n_bytes", figure("n_removed", F.lit(0)), figure("n_spans", F.lit(0)), figure("kept_sha256", F.col("sha")), figure("n_passage_bytes", F.lit(0)), "kept")
    sha = F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.col("sha")).alias("kept_sha256")
    return met.union(rows.where(gone).select("row", "doc_id", "md5", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0), F.when(whole, 1).otherwise(0), sha, "n_bytes", nothing))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """docs with repeated bytes cut from the text; a character that a cut leaves incomplete goes too. All rows and other columns stay."""
    changed = dedup(docs, id_col, text_col, words=words).where(F.col("kept").isNotNull()).select(F.col("doc_id").alias("id__"), F.col("md5").alias("md5__"), "kept")
    once = staged(changed.groupBy("id__", "md5__").agg(F.first("kept").alias("kept__")), "suffix-kept")

    def join(batches):
        for b in batches:
            k, kept = b.schema.get_field_index(text_col), b.column(b.num_columns - 1).to_pylist()
            text = [t if x is None else x.decode("utf-8", "ignore") for t, x in zip(b.column(k).to_pylist(), kept, strict=True)]
            columns = [pa.array(text, pa.string()) if i == k else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    keyed = docs.withColumn("m__", F.unhex(F.md5(text_or_empty(text_col).cast("binary"))))
    met = keyed.join(once, (F.col("m__") == F.col("md5__")) & F.col(id_col).cast("long").eqNullSafe(F.col("id__")), "left").select(*docs.columns, "kept__")
    return met.transform(arrow, join, docs.schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 by the rule of 400 bytes; with words also n_passage_bytes: bytes that it
    or repeated passages of so many words cover."""
    made = dedup(docs, id_col, text_col, words=words, with_kept=False)
    figures = [F.col(c).cast("long").alias(c) for c in ("n_removed", "n_spans")]
    return made.select("doc_id", "n_bytes", *figures, "kept_sha256", *([F.col("n_passage_bytes").cast("long").alias("n_passage_bytes")] if words else []))
