"""Spellings that no text holds are turned away before anything of them is shuffled or written, however many there are.

Where a spelling stands, its stretches of letters and digits stand one right after the other. So a text has windows of up to MOST
stretches on end, of the lengths that spellings usually have (and with their first stretches, where these are few), and a spelling
with such windows that are not all in a filter over those of the texts stands in none. A window goes by its letters alone, without what parts its stretches: a stretch that
a line's end hyphen cuts has the same letters as a whole one. Its hash is a difference of running sums over a batch's bytes, so
nothing is done in Python for a single spelling or text of ASCII; others, and texts with cut stretches, are taken one by one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import by_batch, by_pieces, pieces, spread
from .bloom import _GATHERED, bloom
from .known import _BROKEN, _STRETCH, _joins, _same
from .staging import dropped, kept

#: Spellings from which on a pass over them and one over the texts are worth their while; those whose lengths and first stretches are
#: looked at beforehand, and so many different first stretches that texts post the windows of these alone.
MANY, FIRST, FEW = 1 << 20, 1 << 16, 1 << 10
#: Stretches of a window.
MOST = 4
#: Bytes that are hashed at once (one string can have more), and bytes of a string from which on it is taken by itself.
_SLICE, _LONG = 128 << 10, 1 << 20
#: Letters and digits in small letters, all else as a zero.
_PLAIN = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 0 for c in range(256))
_SIGNS = bytes(c for c in range(256) if not _PLAIN[c])
_WORTH = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _bases(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, _SLICE)
        _powers[:] = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, b, np.uint64))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def _sums(letters: np.ndarray) -> np.ndarray:
    out = np.zeros(len(letters) + 1, np.uint64)
    worth = _WORTH.take(letters)
    worth *= _bases(len(letters))[0][: len(letters)]
    np.cumsum(worth, out=out[1:])
    return out


def _hash(sums: np.ndarray, first: np.ndarray, end: np.ndarray, before: bytes = b"") -> np.ndarray:
    """Of letters first:end, the same wherever they stand; with others before them."""
    h = (sums[end] - sums[first]) * _bases(len(sums))[1][first]
    if before:
        h = h * _bases(len(before))[0][len(before)] + _sums(np.frombuffer(before, np.uint8))[-1]
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(times)
    return h ^ h >> np.uint64(31)


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Their UTF-8 on end, and where each begins and the last ends."""
    strings = strings.cast(pa.large_string())
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), at - at[0]


class Stretches:
    """Stretches of ASCII strings without nulls: sums over their letters, where each begins in these, its string, its number in there."""

    def __init__(self, strings: pa.Array) -> None:
        data, at = _bytes(strings)
        raw = data.tobytes()
        letter = np.frombuffer(raw.translate(_PLAIN), np.uint8) != 0
        starts = letter.copy()
        starts[1:] &= ~letter[:-1]
        row_starts = at[:-1][at[:-1] < at[1:]]
        starts[row_starts] = letter[row_starts]
        where = np.flatnonzero(starts)
        self.sums = _sums(np.frombuffer(raw.translate(_PLAIN, _SIGNS), np.uint8))
        self.first = np.append(np.cumsum(letter)[where] - 1, len(self.sums) - 1)
        begin = np.searchsorted(where, at)
        self.n = np.diff(begin)  # stretches of each string
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.k = np.arange(len(where)) - begin[:-1][self.row]

    def hashes(self, of: np.ndarray, n: np.ndarray | int, before: bytes = b"") -> np.ndarray:
        """Of windows of n stretches from those numbered `of`, each with the same letters before it."""
        return _hash(self.sums, self.first[of], self.first[of + n], before)


def hash_strings(strings: list[str]) -> np.ndarray:
    """As the same letters are hashed in a window."""
    out = [np.zeros(0, np.uint64)]
    for p in pieces(pa.RecordBatch.from_arrays([pa.array(strings, pa.large_string())], names=["s"]), _SLICE):
        data, at = _bytes(p.column(0))
        out.append(_hash(_sums(data), at[:-1], at[1:]))
    return np.concatenate(out)


def plain(strings: pa.Array) -> pa.Array:
    """Which of them Stretches are made of at once."""
    return pc.and_(pc.string_is_ascii(strings), pc.less(pc.binary_length(strings), _LONG))


def _words(spelling: str) -> list[str]:
    """The stretches that a spelling needs on end; none where it may begin or end inside of one."""
    same = _same(spelling).strip()
    return _STRETCH.findall(same) if same and (same.isascii() or not _joins(same[0])) else []


class Windows:
    """All windows of a batch's spellings: hash, hash of the first stretch, number of stretches, row."""

    def __init__(self, spellings: pa.Array) -> None:
        spellings = spellings.fill_null("")
        at_once = plain(spellings)
        s = Stretches(pc.if_else(at_once, spellings, ""))
        n = np.minimum(s.n, MOST)
        of = np.flatnonzero(s.k <= (s.n - n)[s.row])
        self.row, self.n = s.row[of], n[s.row[of]]
        self.hash, self.head = s.hashes(of, self.n), s.hashes(of, 1)
        if other := np.flatnonzero(~at_once.to_numpy(zero_copy_only=False)).tolist():
            found = [(k, words[i : i + MOST]) for k in other if (words := _words(spellings[k].as_py())) for i in range(max(1, len(words) - MOST + 1))]
            self.row = np.concatenate([self.row, np.array([k for k, _ in found], np.int64)])
            self.n = np.concatenate([self.n, np.array([len(w) for _, w in found], np.int64)])
            self.hash = np.concatenate([self.hash, hash_strings(["".join(w) for _, w in found])])
            self.head = np.concatenate([self.head, hash_strings([w[0] for _, w in found])])


def _among(h: np.ndarray, heads: np.ndarray | None) -> np.ndarray:
    """heads: ascending; without any, all are."""
    return np.ones(len(h), bool) if heads is None else heads.take(np.searchsorted(heads, h), mode="clip") == h


def _cut(text: str, lengths: list[int], heads: np.ndarray | None) -> set[str]:
    """Windows of one text; a cut stretch counts as one and as several, and may be the rest of one that begins before the window."""
    same = _same(text)
    found = list(_STRETCH.finditer(same))
    words = [m[0] for m in found]
    cut = [bool(_BROKEN.fullmatch(same, a.end(), b.start())) for a, b in zip(found, found[1:])] + [False]
    begins = _among(hash_strings(words), heads).tolist() if words else []
    out = set()
    for i in range(len(words)):
        if begins[i] or cut[i]:
            least = 0  # stretches if all that are cut are whole
            for j in range(i, len(words)):
                least += j == i or not cut[j - 1]
                if least > lengths[-1]:
                    break
                if any(least <= n <= j - i + 1 for n in lengths):
                    out.add("".join(words[i : j + 1]))
    return out


def text_windows(texts: pa.Array, lengths: list[int], heads: np.ndarray | None) -> np.ndarray:
    """Hashes of the windows of these texts that spellings of such lengths (ascending) and first stretches can have; repeated ones once."""
    at_once = pc.and_not(plain(texts), pc.match_substring(texts, "-\n"))
    s = Stretches(pc.if_else(at_once, texts, ""))
    begin = np.flatnonzero(_among(s.hashes(np.arange(len(s.k)), 1), heads))
    out = [s.hashes(begin[s.k[begin] + n <= s.n[s.row[begin]]], n) for n in lengths]
    other = texts.filter(pc.invert(at_once)).to_pylist()
    return np.unique(np.concatenate([*out, *(hash_strings(sorted(w)) for t in other if (w := _cut(t, lengths, heads)))]))


def _once(hashes: Callable[[pa.RecordBatch], np.ndarray]) -> Callable:
    """A row a hash, each once among about _GATHERED of a task."""

    def run(batches):
        held = [np.zeros(0, np.uint64)]
        for b in batches:
            held += map(hashes, pieces(b, _SLICE))
            if sum(map(len, held)) >= _GATHERED:
                held = [np.unique(np.concatenate(held))]
                if len(held[0]) >= _GATHERED // 2:
                    yield _rows(held[0])
                    held = [np.zeros(0, np.uint64)]
        yield _rows(np.unique(np.concatenate(held)))

    return run


def _rows(h: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["key"])


def _usual(spellings: DataFrame) -> tuple[list[int], np.ndarray | None]:
    """Lengths and first stretches of the windows of FIRST spellings; None where the latter are many. Spellings with others are
    not turned away, so nothing but time hangs on which these are."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        w = Windows(b.column(0))
        heads, at = np.unique(np.stack([w.head, w.n.astype(np.uint64)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(heads.view(np.int64)), pa.array(at.astype(np.int64))], names=["head", "n"])

    found = by_batch(spellings.select("spelling").limit(FIRST), run, "head long, n long").distinct().collect()
    heads = np.array(sorted({r["head"] for r in found}), np.int64)
    return sorted({r["n"] for r in found}), np.sort(heads.view(np.uint64)) if len(heads) <= FEW else None


def may_stand(docs: DataFrame, spellings: DataFrame, text_col: str = "text") -> tuple[DataFrame, Broadcast | None]:
    """The rows of `spellings` (column spelling, and any others) that may stand in a text: no fewer, and of many hardly any other; and
    what the pass over them has sent to the workers.

    A row may have an array of spellings, which costs less on the way to Python; each gets a row of its own. All are taken where they
    are under MANY. Some are read before all are: what is dear to make is better kept first.
    """
    lists = isinstance(spellings.schema["spelling"].dataType, T.ArrayType)
    each = spellings.withColumn("spelling", F.explode_outer("spelling")) if lists else spellings  # outer, else all arrays are made for a filter first
    if each.select("spelling").limit(MANY).count() < MANY:
        return each, None
    lengths, heads = _usual(each)
    if not lengths:
        return each, None
    texts = spread(docs.select(text_col).where(F.length(text_col) > 0))
    windows = kept(by_pieces(texts, _once(lambda b: text_windows(b.column(0), lengths, heads)), "key long"), "standing-windows")
    there = docs.sparkSession.sparkContext.broadcast(bloom(windows, "key"))
    dropped(windows)

    def stay(strings: pa.Array) -> np.ndarray:
        w = Windows(strings)
        lacks = np.flatnonzero(np.isin(w.n, lengths) & _among(w.head, heads))
        out = np.ones(len(strings), bool)
        out[w.row[lacks[~there.value.may_hold_hashed(w.hash[lacks])]]] = False
        return out

    def held(b: pa.RecordBatch) -> pa.RecordBatch:
        own = b.column("spelling")
        if not lists:
            return b.filter(pa.array(stay(own)))
        strings = own.flatten()
        left = stay(strings)
        ends = np.append(0, np.cumsum(own.value_lengths().fill_null(0).to_numpy()))
        ends = np.append(0, np.cumsum(left))[ends]  # of those that stay
        column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), strings.filter(pa.array(left)))
        return b.set_column(b.schema.get_field_index("spelling"), "spelling", column).filter(pa.array(np.diff(ends) > 0))

    def run(batches):
        for b in batches:
            yield from map(held, pieces(b, _SLICE))

    rest = by_pieces(spellings, run, spellings.schema)
    return rest.withColumn("spelling", F.explode("spelling")) if lists else rest, there
