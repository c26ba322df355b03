"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words stand in one flat array. Each round looks every neighbouring pair up by binary search in the
sorted pair keys, takes each word's lowest rank, and merges that pair wherever the word has it, from left to right.
Words leave the array when no pair is left. Text is split at white space first, so each distinct chunk is encoded once
per worker; what is rare leaves the full cache, which changes speed only. Words of more than LONG symbols go through a heap
instead of rounds, so that one endless word doesn't cost a round per merge.

Null and empty texts have no ids. Strings of special tokens inside a text become their ids, as in the public library.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .shared import arrow

#: White space as the tokenizer file's \s means it; str.split() also cuts at the four separators below.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Code points of plane 3 without a letter, which the regex module counts as letters and the tokenizer's own doesn't.
_UNASSIGNED = re.compile("[\U000323B0-\U0003FFFD]")
LONG = 256
NONE = np.int64(1 << 40)


def chunks(text: str) -> list[str]:
    """The text between white space."""
    if any(c in text for c in _SEPARATORS):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte, by the public rule of byte-level BPE."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in keep)
    table = {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class _Store:
    """Ids of many keys in one flat array."""

    def __init__(self) -> None:
        self.code: dict = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.hits = np.zeros(1 << 14, np.int32)

    def add(self, keys: list, flat: np.ndarray, size: np.ndarray) -> None:
        at, to = len(self.code), len(self.code) + len(keys)
        self.flat, self.start, self.size = (_room(a, n) for a, n in ((self.flat, self.used + len(flat)), (self.start, to), (self.size, to)))
        self.hits = _room(self.hits, to)
        self.hits[at:to] = 0
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[at:to], self.start[at:to] = size, self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.code.update(zip(keys, range(at, to), strict=True))

    def trim(self, most: int, ids: int = 1 << 24) -> None:
        """Over so many keys or ids, only those asked for again since the last time stay, at most half of `most`."""
        if len(self.code) <= most and self.used <= ids:
            return
        hits = self.hits[: len(self.code)]
        least = max(2, int(np.partition(hits, -most // 2)[-most // 2]) + 1 if len(hits) > most // 2 else 2)
        stay = np.flatnonzero((hits >= least) & (self.size[: len(hits)] <= LONG))
        keys, (flat, size) = list(self.code), self.take(stay)
        self.__init__()
        self.add([keys[k] for k in stay.tolist()], flat, size)

    def take(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.hits[: len(self.code)] += np.bincount(code, minlength=len(self.code)).astype(np.int32)
        size, start = self.size[code], self.start[code]
        total = np.cumsum(size)
        return self.flat[np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size)], size


class WordBpe:
    """A tokenizer file with word ends: NFC, lower case, pieces by pattern, byte-level symbols, merges by rank."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model.get("end_of_word_suffix") or ""
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(pattern)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.tokens = np.empty(max([*vocab.values(), *self.special.values()]) + 1, dtype=object)
        for t, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = t
        letters = _byte_chars()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        self.wide = np.int64(len(self.tokens))
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in side], np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = left * self.wide + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made.astype(np.int32)
        self.cut_words = regex.compile(pattern + "|\n")
        strict = pattern.replace("[\\p{L}]", "[\\p{L}--[\U000323B0-\U0003FFFD]]").replace("[^\\s\\p{L}\\p{N}]", "[[^\\s\\p{L}\\p{N}]||[\U000323B0-\U0003FFFD]]")
        self.strict = regex.compile(strict, regex.V1)
        self.reset()

    def reset(self) -> None:
        self.chunks, self.words = _Store(), _Store()

    # -- encoding

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.wide + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def pieces(self, chunk: str) -> list:
        """Words, or ids of special tokens."""
        parts = self.cut.split(chunk) if self.cut and "<" in chunk else [chunk]
        out: list = []
        for p in parts:
            if p in self.special:
                out.append(self.special[p])
            elif p:
                low = p.lower() if p.isascii() else unicodedata.normalize("NFC", p).replace("Σ", "σ").lower()
                out += (self.strict if _UNASSIGNED.search(low) else self.piece).findall(low)
        return out

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and how many each word has."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size) - 1
        sym, word = self.inner[raw], np.repeat(np.arange(len(words), dtype=np.int32), size)
        sym[ends] = self.last[raw[ends]]
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        if len(long := np.flatnonzero(size > LONG)):
            for k in long.tolist():
                ids = self._by_heap(words[k])
                kept.append((np.full(len(ids), k, np.int32), ids))
            short = ~np.isin(word, long)
            sym, word = sym[short], word[short]
        pair = np.full(len(sym), NONE)
        self._look(pair, sym, word, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(pair, first)
            best = np.repeat(best, np.diff(np.r_[first, len(sym)]))
            going = best < NONE
            if not going.all():
                kept.append((word[~going], sym[~going]))
                sym, word, pair, best = sym[going], word[going], pair[going], best[going]
            hit = np.flatnonzero(pair == best)
            if len(hit) > 1 and (near := np.diff(hit) == 1).any():  # a a a: every second of a run of overlapping pairs
                lead = np.r_[True, ~near]
                place = np.arange(len(hit)) - np.maximum.accumulate(np.where(lead, np.arange(len(hit)), 0))
                hit = hit[place % 2 == 0]
            sym[hit] = self.made[pair[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, word, pair = sym[stay], word[stay], pair[stay]
            now = hit - np.arange(len(hit))  # one symbol goes at each earlier place
            self._look(pair, sym, word, now)
            self._look(pair, sym, word, now[now > 0] - 1)
        w, s = np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])
        return s[np.argsort(w, kind="stable")], np.bincount(w, minlength=len(words))

    def _look(self, pair: np.ndarray, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> None:
        """Sets the rank of the pairs that start there."""
        pair[at] = NONE
        at = at[at + 1 < len(sym)]
        at = at[word[at] == word[at + 1]]
        pair[at] = self.ranks(sym[at], sym[at + 1])

    def _by_heap(self, w: bytes) -> np.ndarray:
        raw = np.frombuffer(w, np.uint8)
        sym = self.inner[raw].tolist()
        sym[-1] = int(self.last[raw[-1]])
        n = len(sym)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        first = self.ranks(np.array(sym[:-1]), np.array(sym[1:]))
        heap = [(int(r), k, sym[k], sym[k + 1]) for k, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)
        lookup: dict[tuple[int, int], int] = {}
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if sym[k] != a or j < 0 or sym[j] != b:
                continue
            sym[k], sym[j] = int(self.made[r]), -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0:
                    p = (sym[x], sym[y])
                    if p not in lookup:
                        lookup[p] = int(self.ranks(np.array(p[:1]), np.array(p[1:]))[0])
                    if lookup[p] < NONE:
                        heapq.heappush(heap, (lookup[p], x, *p))
        return np.array([s for s in sym if s >= 0], np.int32)

    def _learn(self, new: list[str]) -> None:
        """Adds chunks to the cache: all are cut into words at once, and words not seen before are merged."""
        low = "\n".join([*new, ""])
        if (self.cut and "<" in low and self.cut.search(low)) or (not low.isascii() and _UNASSIGNED.search(low)):
            parts = list(chain.from_iterable([*self.pieces(c), "\n"] for c in new))
        else:
            parts = self.cut_words.findall(low.lower() if low.isascii() else unicodedata.normalize("NFC", low).replace("Σ", "σ").lower())
        if ids := [x for x in dict.fromkeys(parts) if isinstance(x, int) and x not in self.words.code]:
            self.words.add(ids, np.array(ids, np.int32), np.ones(len(ids), np.int64))
        if words := [x for x in dict.fromkeys(parts) if x != "\n" and x not in self.words.code]:
            self.words.add(words, *self.merge_words([w.encode() for w in words]))
        self.words.code["\n"] = -1
        code = np.fromiter(map(self.words.code.__getitem__, parts), np.int64, len(parts))
        del self.words.code["\n"]
        stop = code < 0
        chunk = np.cumsum(stop)[~stop]
        ids, size = self.words.take(code[~stop])
        self.chunks.add(new, ids, np.bincount(chunk, size, len(new)).astype(np.int64))

    def encode(self, texts: list[str | None], most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text ends in them."""
        split = [chunks(t) if t else [] for t in texts]
        self.chunks.trim(most)
        self.words.trim(most)
        flat = list(chain.from_iterable(split))
        known = self.chunks.code
        code = np.fromiter(map(known.get, flat, repeat(-1)), np.int64, len(flat))
        if len(missing := np.flatnonzero(code < 0)):
            new = [flat[k] for k in missing.tolist()]
            self._learn(list(dict.fromkeys(new)))
            code[missing] = np.fromiter(map(known.__getitem__, new), np.int64, len(new))
        ids, size = self.chunks.take(code)
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return ids, np.r_[0, np.cumsum(size)][ends]

    def decode(self, ids) -> str:
        """As the public library without a decoder: the tokens, with a space between."""
        return " ".join(self.tokens[ids].tolist())


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.empty(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def by_size(texts: list, chars: int = 2_000_000):
    """(from, to) of runs of texts of about so many characters; a longer text stands alone."""
    at = 0
    while at < len(texts):
        to, n = at + 1, len(texts[at] or "")
        while to < len(texts) and (n := n + len(texts[to] or "")) <= chars:
            to += 1
        yield at, to
        at = to


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One per Python worker, so that the cache of words serves all its tasks."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def bpe(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded text; a row for each row."""

    def run(batches):
        model = loaded(tokenizer)
        for b in batches:
            names, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in by_size(texts):
                ids, ends = model.encode(texts[lo:hi])
                each = np.split(ids, ends[:-1])
                yield pa.RecordBatch.from_arrays([names[lo:hi], pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids)), pa.array([model.decode(x) for x in each])], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).transform(arrow, run, "doc_id long, ids array<int>, decoded string")


def bpe_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens and the hashes of ids and decoded text: what bpe() gives, hashed before it leaves the worker."""

    def run(batches):
        from hashlib import sha256

        model = loaded(tokenizer)
        for b in batches:
            names, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in by_size(texts):
                ids, ends = model.encode(texts[lo:hi])
                words = model.tokens[ids].tolist()
                wide = ids.astype("<u4")
                cuts = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([names[lo:hi], pa.array([y - x for x, y in cuts], pa.int64()), pa.array([sha256(wide[x:y].tobytes()).hexdigest() for x, y in cuts]), pa.array([sha256(" ".join(words[x:y]).encode()).hexdigest() for x, y in cuts])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(arrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
