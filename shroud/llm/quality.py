"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w.x - t_k) with one shared weight vector over hashed text features and ordered thresholds t; the
grades are the distinct ratings in order. Gives the expected grade and the tail probability of reaching `least`.
Fitted on the driver on at most `max_rows` rated rows (those with the smallest id hashes); scored on executors. Null and
empty texts are scored by their figures alone. Rows with a null rating or id are left out of the fit; of several ratings of
one id the largest counts. Repeated rows are graded as often as they stand there, alike. Without ratings, or with one grade
alone, every text is expected to have that grade (0 without any). An empty table gives no rows; whole texts are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .bpe import by_size
from .features import style_features
from .shared import arrow
from .toxicity import sample

BITS = 18


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Ordinal:
    grades: np.ndarray  # the ratings, ascending
    w: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def above(self, doc: np.ndarray, key: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """P(grade > grades[k]) of documents 0 to n-1, a column for each k."""
        return _sigmoid(np.bincount(doc, self.w[key] * value, n)[:, None] - self.thresholds[None, :])

    def expected(self, above: np.ndarray) -> np.ndarray:
        return self.grades[0] + above @ np.diff(self.grades)

    def tail(self, above: np.ndarray, least: float) -> np.ndarray:
        """P(grade >= least)."""
        k = int(np.searchsorted(self.grades, least))
        return np.ones(len(above)) if k == 0 else np.zeros(len(above)) if k > above.shape[1] else above[:, k - 1]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], rating: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 7, l2: float = 1e-5) -> Ordinal:
    """AdaGrad on the likelihood; thresholds are a first one and positive steps, so they stay ordered."""
    grades, y = np.unique(rating, return_inverse=True)
    if len(grades) < 2:
        return Ordinal(grades if len(grades) else np.zeros(1), np.zeros(1 << bits), np.empty(0))
    n, cuts = len(rows), len(grades) - 1
    share = np.clip([(y > k).mean() for k in range(cuts)], 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    first, steps = start[0], np.log(np.maximum(np.diff(start), 1e-2))
    w, gw, gt = np.zeros(1 << bits), np.full(1 << bits, 1e-6), np.full(cuts, 1e-6)
    size = np.array([len(k) for k, _ in rows])
    keys, values, bounds = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows]), np.r_[0, np.cumsum(size)]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(n), max(1, n // 512)):
            s = size[part]
            row = np.repeat(np.arange(len(part)), s)
            at = np.arange(s.sum()) + np.repeat(bounds[part] - (np.cumsum(s) - s), s)
            k, x = keys[at], values[at]
            t = np.r_[first, first + np.cumsum(np.exp(steps))]
            z = np.bincount(row, w[k] * x, len(part))
            up = np.c_[np.ones(len(part)), _sigmoid(z[:, None] - t), np.zeros(len(part))]  # P(grade >= k)
            slope = up * (1 - up)
            me = np.arange(len(part)), y[part]
            p = np.maximum(up[me] - up[me[0], me[1] + 1], 1e-9)
            lo, hi = slope[me] / p / len(part), slope[me[0], me[1] + 1] / p / len(part)
            dt = np.bincount(y[part], lo, cuts + 1)[1:] - np.bincount(y[part] + 1, hi, cuts + 2)[1 : cuts + 1]
            used, back = np.unique(k, return_inverse=True)
            dw = np.bincount(back, (hi - lo)[row] * x, len(used)) + l2 * w[used]
            gw[used] += dw * dw
            w[used] -= 0.2 * dw / np.sqrt(gw[used])
            d = np.r_[dt.sum(), np.cumsum(dt[::-1])[::-1][1:] * np.exp(steps)]
            gt += d * d
            move = 0.1 * d / np.sqrt(gt)
            first, steps = first - move[0], steps - move[1:]
    return Ordinal(grades, w, np.r_[first, first + np.cumsum(np.exp(steps))])


def train(docs: DataFrame, labels: DataFrame, among: Column | None = None, label_col: str = "quality", max_rows: int = 8_000, bits: int = BITS) -> Ordinal:
    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in by_size(texts, 500_000):
                doc, key, value = style_features(texts[lo:hi], bits)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                cuts = list(zip(cut[:-1], cut[1:], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([key[x:y].astype("<u4").tobytes() for x, y in cuts], pa.binary()), pa.array([value[x:y].astype("<f4").tobytes() for x, y in cuts], pa.binary()), b.column(1)[lo:hi]], names=["k", "v", "label"])

    got = sample(docs, labels, label_col, max_rows, among).transform(arrow, run, "k binary, v binary, label long").collect()
    got.sort(key=lambda r: (bytes(r["k"]), r["label"]))
    return fit([(np.frombuffer(r["k"], "<u4").astype(np.int64), np.frombuffer(r["v"], "<f4").astype(float)) for r in got], np.array([float(r["label"]) for r in got]), bits)


def grade(docs: DataFrame, model: Ordinal, least: float = 1.0, text_col: str = "text", bits: int = BITS, out: tuple[str, str] = ("expected_grade", "tail_probability")) -> DataFrame:
    """docs with the expected grade and P(grade >= least); columns already so named are replaced."""
    base = docs.drop(*out)
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, T.DoubleType()) for c in out)])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(text_col).to_pylist()
            for lo, hi in by_size(texts, 500_000):
                above = m.above(*style_features(texts[lo:hi], bits), hi - lo) if len(m.thresholds) else np.empty((hi - lo, 0))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.expected(above) if above.shape[1] else np.full(hi - lo, m.grades[0])), pa.array(m.tail(above, least))], names=[*part.schema.names, *out])

    return base.transform(arrow, run, schema)


def keep_good(docs: DataFrame, model: Ordinal, least: float = 1.0, probability: float = 0.5) -> DataFrame:
    """Documents whose probability of grade `least` or better reaches `probability`, with their own columns."""
    cols = docs.columns
    tail = "tail_probability__"
    return grade(docs, model, least, out=("expected_grade__", tail)).where(F.col(tail) >= probability).select(*cols)
