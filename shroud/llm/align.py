"""Alignment of two tokenizers: which tokens of A and of B cover the same bytes of a text.

A is a byte-level BPE that reads a space and the text, B a piece model that reads the text and sets the space itself, so both
spell the same bytes. Ends of tokens are bits in a packed bitset over the bytes of a batch of texts, one set a tokenizer.
Where both end is the AND of the two sets; how many tokens of A and of B end up to such a cut is its rank, counted by
popcounts of whole words and of the cut's own word under a mask. So a cut in bytes becomes a range of tokens on either side,
and the links of a group are all pairs of its tokens.

Distinct links of a document are counted over the corpus with their documents. The HEAD commonest go to all tasks (a fixed
number, so their size is bounded); the rest is met by a join, in which no key is heavy since each is rarer than the head.

Ids of A come from the same vocabulary as ranks, which a faster library reads; tests hold them against the vocabulary's own
file. That library's pattern gives up on endless white space, so texts with runs of LONG_RUN take the file's own library.

Defined cases: null and empty texts, and texts whose tokens of A or of B don't spell the space and the text, have no tokens: zeros
and ''. Rows are taken one by one: rows with equal or null ids are documents of their own. An empty table has no rows;
further columns are not read.
"""

from __future__ import annotations

import base64
import json
import os
import re
from hashlib import sha256
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import _byte_chars, _Store, by_size
from .shared import arrow, staged

#: Links that all tasks know the counts of; pairs of a group that are expanded one by one; white space that stands in for an endless run.
HEAD, WIDE, LONG_RUN = 1 << 18, 4096, 2000
_RUN = re.compile(r"\s{%d}" % LONG_RUN)
_SPACE = "▁"
_WORDS = re.compile(" +[^ ]*")
_INNER = re.compile(f"[^{_SPACE}]{_SPACE}")


def bits(places: np.ndarray, size: int) -> np.ndarray:
    """A packed set of places as 64-bit words."""
    flags = np.zeros(-(-size // 64) * 64, np.uint8)
    flags[places] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def members(words: np.ndarray) -> np.ndarray:
    """The places of a set, ascending: its select map."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def rank(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many members are at or before each place."""
    ones = np.bitwise_count(words).astype(np.int64)
    before = np.cumsum(ones) - ones
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
    return before[word] + np.bitwise_count(words[word] & mask)


class _Spelling:
    """The bytes of each id in one array."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids in a row, and where each token ends in them."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)], ends


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n


class Aligner:
    """Both tokenizers. file: byte-level BPE as JSON; ranks: the same vocabulary as ranks, if there; pieces: a piece model with byte fallback."""

    def __init__(self, file: str, pieces: str, ranks: str | None = None, pattern: str | None = None) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(file)
        self.library.encode_special_tokens = True  # their strings are plain text
        with open(file, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        to_byte = {c: b for b, c in enumerate(_byte_chars())}
        tokens = [b""] * max(self.library.get_vocab_size(), max(vocab.values()) + 1)
        for token, k in vocab.items():
            tokens[k] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.a = _Spelling(tokens)
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(word): int(k) for word, k in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.by_word = not any(map(_INNER.search, names))  # then no merge crosses the space before a word
        self.words, self.lone = _Store(), self.model.piece_to_id(_SPACE)
        self.b = _Spelling([bytes([int(p[3:-1], 16)]) if self.model.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(names)])
        sizes = len(self.a.size), len(self.b.size)
        self.written = np.array([f"{k}{sign}" for n, last in zip(sizes, "|;", strict=True) for sign in ("," + last) for k in range(n)], object)
        self.at_b = 2 * sizes[0]

    def ids_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if self.fast is None:
            return _flat([e.ids for e in self.library.encode_batch([" " + t for t in texts], add_special_tokens=False)])
        return _flat([self.library.encode(" " + t, add_special_tokens=False).ids if _RUN.search(t) else self.fast.encode_ordinary(" " + t) for t in texts])

    def ids_b(self, texts: list[str], most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
        """The same; where no piece goes on over a space, a word with the spaces before it is encoded once a worker."""
        if not self.by_word:
            return _flat(self.model.encode(texts, num_threads=1))
        split = [[w[1:] for w in _WORDS.findall(" " + t)] if "  " in t or t[0] == " " or t[-1] == " " else t.split(" ") for t in texts]
        self.words.trim(most)
        flat, known = list(chain.from_iterable(split)), self.words.code
        code = np.fromiter(map(known.get, flat, repeat(-1)), np.int64, len(flat))
        if len(missing := np.flatnonzero(code < 0)):
            new = list(dict.fromkeys(flat[k] for k in missing.tolist()))
            self.words.add(new, *_flat([ids if w else [self.lone] for w, ids in zip(new, self.model.encode(new, num_threads=1), strict=True)]))
            code[missing] = np.fromiter((known[flat[k]] for k in missing.tolist()), np.int64, len(missing))
        ids, size = self.words.take(code)
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return ids.astype(np.int64), np.diff(np.r_[0, np.r_[0, np.cumsum(size)][ends]])

    def align(self, texts: list[str | None]) -> Aligned:
        """Groups of all texts; those without tokens have none."""
        some = [k for k, t in enumerate(texts) if t]
        known = [texts[k] for k in some]
        raw = [b" " + t.encode() for t in known]
        both = []
        for (flat, n), spelling in ((self.ids_a(known), self.a), (self.ids_b(known), self.b)):
            spelt, ends = spelling.spell(flat)
            upto = np.r_[0, ends][np.cumsum(n)]
            both.append((flat, n, spelt.tobytes(), upto.tolist()))
        same = np.ones(len(known), bool)
        for _, _, spelt, upto in both:
            same &= np.fromiter((spelt[x:y] == r for x, y, r in zip([0, *upto[:-1]], upto, raw, strict=True)), bool, len(raw))
        counts, kept = [], []
        for flat, n, *_ in both:
            kept.append(flat[np.repeat(same, n)])
            full = np.zeros(len(texts), np.int64)
            full[some] = n * same
            counts.append(full)
        size = int(sum(len(r) for r, s in zip(raw, same, strict=True) if s))
        sets = [bits(np.cumsum(spelling.size[ids]) - 1, size) for ids, spelling in zip(kept, (self.a, self.b), strict=True)]
        cuts = members(sets[0] & sets[1])
        return Aligned(*kept, *counts, *(rank(s, cuts) for s in sets))

    def texts_of(self, x: Aligned) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        na, nb = np.diff(np.r_[0, x.ends_a]), np.diff(np.r_[0, x.ends_b])
        word = np.empty(len(x.a) + len(x.b), np.int64)
        at_a, at_b = np.arange(len(x.a)) + np.repeat(x.ends_b - nb, na), np.arange(len(x.b)) + np.repeat(x.ends_a, nb)
        word[at_a], word[at_b] = x.a, x.b + self.at_b
        for ends, at, size in ((x.ends_a, at_a, self.a.size), (x.ends_b, at_b, self.b.size)):
            word[at[ends - 1]] += len(size)  # the same with the sign after a group's last
        ends = np.cumsum(x.n_a + x.n_b)
        parts = self.written[word].tolist()
        return ["".join(parts[u:v])[:-1] for u, v in zip((ends - x.n_a - x.n_b).tolist(), ends.tolist(), strict=True)]


class Aligned:
    """Ids of both tokenizers in a row, tokens a text, and the tokens up to the end of each group."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> None:
        self.a, self.b, self.n_a, self.n_b, self.ends_a, self.ends_b = a, b, n_a, n_b, ends_a, ends_b

    def groups(self) -> np.ndarray:
        """The number of groups of each text."""
        upto = np.searchsorted(self.ends_a, np.cumsum(self.n_a), "right")
        return np.diff(np.r_[0, upto])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, pair (a * 2^32 + b), and how often the text links them; ascending by both."""
        na, nb = np.diff(np.r_[0, self.ends_a]), np.diff(np.r_[0, self.ends_b])
        text = np.repeat(np.arange(len(self.n_a)), self.groups())
        wide = na * nb > WIDE
        found = [self._all(na, nb, text, ~wide)]
        for g in np.flatnonzero(wide).tolist():  # here ids repeat: pairs of different ids with the product of their numbers
            (u, n), (v, m) = (np.unique(ids[e - k : e], return_counts=True) for ids, e, k in ((self.a, self.ends_a[g], na[g]), (self.b, self.ends_b[g], nb[g])))
            pair = (u[:, None] << 32 | v[None]).ravel()
            found.append((np.full(len(pair), text[g]), pair, (n[:, None] * m[None]).ravel()))
        if len(found) == 1 and max(self.a.max(initial=0), self.b.max(initial=0)) < 1 << 16 and len(self.n_a) < 1 << 31:
            text, pair, _ = found[0]  # one number a link sorts faster
            key, times = np.unique(text << 32 | pair >> 32 << 16 | pair & 0xFFFF, return_counts=True)
            return key >> 32, (key >> 16 & 0xFFFF) << 32 | key & 0xFFFF, times
        text, pair, times = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((pair, text))
        text, pair, times = text[order], pair[order], times[order]
        first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])][: len(text)])
        return text[first], pair[first], np.add.reduceat(times, first) if len(first) else times

    def _all(self, na: np.ndarray, nb: np.ndarray, text: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = (na * nb)[take]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide_b = np.repeat(nb[take], n)
        a = self.a[np.repeat((self.ends_a - na)[take], n) + k // wide_b]
        b = self.b[np.repeat((self.ends_b - nb)[take], n) + k % wide_b]
        return np.repeat(text[take], n), a << 32 | b, np.ones(len(a), np.int64)


_loaded: dict[tuple, Aligner] = {}


def loaded(*paths: str | None) -> Aligner:
    """One per Python worker."""
    if paths not in _loaded:
        _loaded[paths] = Aligner(*paths)
    return _loaded[paths]


_LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, file: str, pieces: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A row a document: row (a number of its own), doc_id, n_a, n_b, n_groups, groups (as text; with `digest` its sha256), and its distinct links with their numbers."""

    def run(batches):
        both, part, row = loaded(file, pieces, ranks, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in by_size(texts):
                x = both.align(texts[lo:hi])
                groups = both.texts_of(x)
                if digest:
                    groups = [sha256(g.encode()).hexdigest() if g else "" for g in groups]
                text, pair, times = x.links()
                cut = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32))
                rows = np.int64(part << 33) + np.arange(row, row + hi - lo)
                row += hi - lo
                columns = [pa.array(rows), batch.column(0)[lo:hi], pa.array(x.n_a), pa.array(x.n_b), pa.array(x.groups()), pa.array(groups), *(pa.ListArray.from_arrays(cut, pa.array(c)) for c in (pair, times))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.strip().split()[0] for c in _LINKED.split(",")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(arrow, run, _LINKED)


def link_counts(linked: DataFrame) -> DataFrame:
    """pair, n (documents that hold it), best (n is the highest of its id of A)."""
    counted = staged(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "align-counts")
    most = counted.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))  # a row an id of A at most
    return counted.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(docs: DataFrame, file: str, pieces: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    linked = staged(aligned(docs, file, pieces, ranks, pattern, id_col, text_col, digest=True), "align-links")
    counted = staged(link_counts(linked), "align-best")
    top = counted.orderBy(F.desc("n"), "pair").limit(HEAD).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    kinds = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long, far array<struct<pair: long, times: long>>"

    def run(batches):
        pairs, n, best = known.value
        for b in batches:
            size, flat, times = b.column(6).value_lengths().to_numpy(), b.column(6).flatten().to_numpy(), b.column(7).flatten().to_numpy()
            at = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
            head = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
            at = at[head]
            doc = np.repeat(np.arange(len(size)), size)
            sums = [np.zeros(len(size), np.int64) for _ in range(3)]
            for s, where, what in zip(sums, (doc, doc[head], doc[head]), (times, times[head] * best[at], times[head] * n[at]), strict=True):
                np.add.at(s, where, what)
            cut = pa.array(np.searchsorted(doc[~head], np.arange(len(size) + 1)).astype(np.int32))
            far = pa.StructArray.from_arrays([pa.array(flat[~head]), pa.array(times[~head])], names=["pair", "times"])
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *map(pa.array, sums), pa.ListArray.from_arrays(cut, far)], names=[c.split(":")[0].split()[0] for c in kinds.split(", ")[:10]])

    near = staged(linked.transform(arrow, run, kinds), "align-near")
    far = near.select("row", F.explode("far").alias("f")).select("row", "f.pair", "f.times").join(counted, "pair")
    late = far.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_count"))
    out = near.drop("far").join(late, "row", "left")
    more = {c: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_count"))}
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", more["n_best"], more["count_sum"], "groups_sha256")
