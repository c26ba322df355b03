"""Hashed text features, made for many texts at once on one array of bytes."""

from __future__ import annotations

import numpy as np

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b)]) for b in (_ODD, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class Text:
    """The texts' bytes with a line feed after each, and prefix sums from which any stretch is hashed in one step."""

    def __init__(self, texts: list[str | None]) -> None:
        raw = [(t or "").encode() for t in texts]
        self.data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        self.ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))

    def sums(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = powers(len(data) + 1)
        return np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])], down

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")


def _table(keep) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[*keep]] = True
    return t


_WORD = _table([*range(48, 58), *range(97, 123), *range(128, 256)])
_SOLID = ~_table([*range(9, 14), 32])
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(97, 123), *range(128, 256)]], _SHAPE[[*range(65, 91)]], _SHAPE[[*range(48, 58)]] = ord("x"), ord("X"), ord("9")


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True."""
    edge = np.diff(np.r_[np.int8(0), inside.astype(np.int8), np.int8(0)])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def distinct(doc: np.ndarray, term: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (document, bucket) pairs in order, and how often each occurs."""
    key, n = np.unique((doc.astype(np.int64) << bits) | (term >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), n


def term_features(texts: list[str | None], bits: int, stems: tuple[int, ...] = (4, 5, 6)) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of its distinct lower-cased words and of the first bytes of longer ones."""
    t = Text([(x or "").lower() for x in texts])
    total, down = t.sums(t.data)
    a, b = runs(_WORD[t.data])
    doc = t.doc_of(a)
    docs, terms = [doc], [mixed((total[b] - total[a]) * down[a])]
    for n in stems:
        long = b - a > n
        s = a[long]
        docs.append(doc[long])
        terms.append(mixed((total[s + n] - total[s]) * down[s] ^ np.uint64((n * int(_MIX)) & (2**64 - 1))))
    d, k, _ = distinct(np.concatenate(docs), np.concatenate(terms), bits)
    return d, k


def style_features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value): shapes of its words (values: square roots of shares), words, and binned figures of the text."""
    t = Text(texts)
    n_docs = len(texts)
    a, b = runs(_SOLID[t.data])
    doc = t.doc_of(a)
    each = np.maximum(np.bincount(doc, minlength=n_docs), 1)
    total, down = t.sums(t.data)
    word = mixed((total[b] - total[a]) * down[a])
    shape = _SHAPE[t.data]
    turn = np.r_[True, (shape[1:] != shape[:-1])]  # of a run of one class, one stays
    up, _ = powers(len(shape) + 1)
    count = np.r_[0, np.cumsum(turn)]
    kept = np.r_[np.uint64(0), np.cumsum(np.where(turn, (shape.astype(np.uint64) + np.uint64(1)) * up[count[:-1]], np.uint64(0)))]
    form = mixed((kept[b] - kept[a]) * down[count[a]] + _ODD)
    fdoc, fkey, fn = distinct(doc, form, bits)
    wdoc, wkey, wn = distinct(doc, word, bits)
    figures = [np.log2(each), np.bincount(wdoc, minlength=n_docs) / each * 16, np.bincount(doc, (b - a), n_docs) / each, *(np.bincount(t.doc_of(p := np.flatnonzero(_kind(t.data, k))), minlength=n_docs) / np.maximum(np.diff(np.r_[0, t.ends]), 1) * 32 for k in "Xxs9")]
    line_a, line_b = runs(t.data != 10)
    line = mixed((total[line_b] - total[line_a]) * down[line_a] + _MIX)
    ldoc, _, ln = distinct(t.doc_of(line_a), line, bits)
    figures.append(np.bincount(ldoc, ln - 1, n_docs) / np.maximum(np.bincount(ldoc, ln, n_docs), 1) * 8)
    bins = [mixed(np.minimum(np.maximum(f, 0), 63).astype(np.uint64) ^ np.uint64((1 + 64 * k) * int(_ODD) & (2**64 - 1))) >> np.uint64(64 - bits) for k, f in enumerate(figures)]
    docs = np.concatenate([fdoc, wdoc, *[np.arange(n_docs)] * len(bins)])
    keys = np.concatenate([fkey, wkey, *[x.astype(np.int64) for x in bins]])
    values = np.concatenate([np.sqrt(fn / each[fdoc]), 0.3 * np.sqrt(wn / each[wdoc]), np.ones(n_docs * len(bins))])
    order = np.argsort(docs, kind="stable")
    return docs[order], keys[order], values[order]


def _kind(data: np.ndarray, k: str) -> np.ndarray:
    s = _SHAPE[data]
    return s == ord(k) if k != "s" else ~np.isin(s, [ord("x"), ord("X"), ord("9")]) & _SOLID[data]
