"""Toxicity: a factorization machine over hashed terms.

A text is the set of its hashed words and word beginnings. score = sigmoid(w0 + sum w + sum over pairs of <v_i, v_j>), so
a pair of terms (an insult and a group) can weigh what neither does alone. Fitted on the driver on at most `max_rows`
labelled rows (those with the smallest id hashes), of which terms kept are the `kept` most telling: those that tell alone,
and those of the `paired` commonest that tell together with another. Scored on executors; whole texts are read.

Null and empty texts have no terms and get the prior's score. Label rows with a null label or id are left out; of several
labels of one id the largest counts. Repeated rows are scored as often as they stand there, alike. Without labels every score
is a half. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import by_size
from .features import term_features
from .shared import arrow

BITS = 20


@dataclass
class Machine:
    terms: np.ndarray  # the kept buckets, sorted
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Rows of distinct (document, bucket), any order; score of documents 0 to n-1."""
        at = np.minimum(np.searchsorted(self.terms, bucket), max(len(self.terms) - 1, 0))
        if len(self.terms):
            hit = self.terms[at] == bucket
            doc, at = doc[hit], at[hit]
        z = np.full(n, self.bias)
        if len(doc) and len(self.terms):
            z += np.bincount(doc, self.w[at], n)
            for f in range(self.v.shape[1]):
                x = self.v[at, f]
                z += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def together(doc: np.ndarray, at: np.ndarray, label: np.ndarray, common: np.ndarray, alone: np.ndarray, least: float = 6.0, times: int = 8) -> np.ndarray:
    """Of the terms `common`, those in a pair whose texts are labelled more or less often than either term's own texts are.

    alone: the share of labels among each common term's texts. A pair counts from `times` texts on; `least` is high, as some
    half a million pairs are tested.
    """
    place = np.full(int(at.max(initial=0)) + 1, -1)
    place[common] = np.arange(len(common))
    own = place[at] if len(at) else at
    doc, own = doc[own >= 0], own[own >= 0]
    both, marked = np.zeros((2, len(common), len(common)), np.float32)
    for lo in range(0, len(label), 2000):  # a few thousand texts at a time bound the memory
        a, z = np.searchsorted(doc, [lo, lo + 2000])
        x = np.zeros((min(2000, len(label) - lo), len(common)), np.float32)
        x[doc[a:z] - lo, own[a:z]] = 1
        both += x.T @ x
        marked += (x * label[lo : lo + 2000, None].astype(np.float32)).T @ x
    np.fill_diagonal(both, 0)
    rate = np.clip(alone, 0.01, 0.99)
    off = [np.abs(marked - both * r) / np.sqrt(np.maximum(both * r * (1 - r), 1e-9)) for r in (rate[:, None], rate[None, :])]
    telling = (np.minimum(*off) >= least) & (both >= times)
    return common[telling.any(0)]


def fit(rows: list[np.ndarray], label: np.ndarray, kept: int = 4096, rank: int = 8, rounds: int = 60, seed: int = 7, paired: int = 1024) -> Machine:
    """rows: distinct buckets of each text. Terms are chosen by tests, alone and in pairs, then learnt by AdaGrad."""
    n = len(rows)
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    all_terms, at = np.unique(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), return_inverse=True)
    prior = (label.sum() + 0.5) / (n + 1)
    df, pos = np.bincount(at, minlength=len(all_terms)), np.bincount(at, label[doc], len(all_terms))
    z = np.abs(pos - df * prior) / np.sqrt(np.maximum(df * prior * (1 - prior), 1e-9))
    z[df < 4] = 0
    chosen = np.argsort(-z, kind="stable")[:kept]
    chosen = chosen[z[chosen] > 3.0]
    common = np.argsort(-df, kind="stable")[:paired]
    common = np.sort(common[df[common] >= 8])
    if len(common) > 1:
        chosen = np.unique(np.r_[chosen[: kept - paired], together(doc, at, label, common, pos[common] / df[common])])
    chosen = np.sort(chosen)
    place = np.full(len(all_terms), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[at] >= 0
    doc, at = doc[keep], place[at][keep]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    m = Machine(all_terms[chosen], float(np.log(prior / (1 - prior))), np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), rank)))
    g0, gw, gv = 1e-6, np.full(len(chosen), 1e-6), np.full(m.v.shape, 1e-6)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(n), max(1, n // 512)):
            size = bounds[part + 1] - bounds[part]
            row = np.repeat(np.arange(len(part)), size)
            t = at[np.arange(size.sum()) + np.repeat(bounds[part] - (np.cumsum(size) - size), size)]
            v = m.v[t]
            total = np.zeros((len(part), rank))
            np.add.at(total, row, v)
            out = m.bias + np.bincount(row, m.w[t], len(part)) + 0.5 * ((total**2).sum(1) - np.bincount(row, (v * v).sum(1), len(part)))
            err = 1 / (1 + np.exp(-np.clip(out, -40, 40))) - label[part]
            err /= len(part)
            d0, dw = err.sum(), np.bincount(t, err[row], len(m.w)) + 1e-5 * m.w
            dv = 1e-5 * m.v
            np.add.at(dv, t, err[row, None] * (total[row] - v))
            g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
            m.bias -= 0.1 * d0 / g0**0.5
            m.w -= 0.1 * dw / np.sqrt(gw)
            m.v -= 0.02 * dv / np.sqrt(gv)
    return m


def sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, among: Column | None, id_col: str = "doc_id") -> DataFrame:
    """text, label of at most max_rows labelled documents: those with the smallest hashes of their id."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if among is not None:
        chosen = chosen.where(among)
    chosen = chosen.groupBy(id_col).agg(F.max(label_col).alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    return docs.select(id_col, "text").join(F.broadcast(chosen), id_col).select("text", F.col("label").cast("long"))  # max_rows bounds what is broadcast


def train(docs: DataFrame, labels: DataFrame, among: Column | None = None, label_col: str = "toxic", max_rows: int = 12_000, bits: int = BITS) -> Machine:
    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in by_size(texts, 500_000):
                doc, key = term_features(texts[lo:hi], bits)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([pa.array([key[x:y].astype("<u4").tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), b.column(1)[lo:hi]], names=["terms", "label"])

    got = sample(docs, labels, label_col, max_rows, among).transform(arrow, run, "terms binary, label long").collect()
    got.sort(key=lambda r: (bytes(r["terms"]), r["label"]))  # rows arrive in any order
    return fit([np.frombuffer(r["terms"], "<u4") for r in got], np.array([float(r["label"] > 0) for r in got]))


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, score for each row."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in by_size(texts, 500_000):
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(model.score(*term_features(texts[lo:hi], bits), hi - lo))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(arrow, run, "doc_id long, score double")
