"""Exact top-k by integer inner product over a pivot-distance index.

Each vector is keyed by its nearest pivot and its distance from it; rings of distances cut a pivot's vectors into groups
of bounded size. From |q - x| >= | |q - p| - |x - p| | follows an upper bound of q.x for a whole ring, since
2 q.x = |q|^2 + |x|^2 - |q - x|^2. A query goes only to rings whose bound reaches the k-th score it has in a small fixed
sample; inside a group the annuli are expanded from the best bound and the search stops at the first that can't matter.
Components are floor(scale * x). Scores are exact: sums stay within 2**53, else whole-number arithmetic is used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import arrow, staged
from .vectors import GROUP_ROWS, best_rows, chunk, every_chunk, matrix, some, usable

PIVOTS, SAMPLE, ANNULUS = 16, 512, 256


def _bound(q: np.ndarray, q2: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Upper bounds of q.x: a row a query, a column a ring (its pivot, nearest and farthest distance, largest norm2)."""
    d = np.sqrt(np.maximum(q2[:, None] + (pivot**2).sum(1)[None] - 2 * q @ pivot.T, 0))
    gap = np.maximum(np.maximum(low[None] - d, d - high[None]), 0)
    bound = np.minimum((q2[:, None] + x2[None] - gap**2) / 2, q @ pivot.T + np.sqrt(q2)[:, None] * high[None])
    return bound + 1e-6 * (1 + np.abs(bound))


def _exact(q: np.ndarray, x: np.ndarray, q2: np.ndarray, x2: np.ndarray) -> np.ndarray:
    if len(q) and len(x) and q2.max() * x2.max() < 2.0**104:
        return q @ x.T
    return (q.astype(np.int64) @ x.astype(np.int64).T).astype(np.float64)


def exact_search(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long) for queries whose id is divisible by `every`, against all other rows.

    A query that stands in several rows counts once (the least vector); candidates count as often as they stand there.
    """
    made, dim = usable(vectors, id_col, vector_col, lambda x: np.floor(scale * x), zero=True)
    rows = staged(made, "exact-rows")
    schema = "query_id long, vec_id long, score long"
    pivot_ids, pivots = some(rows, PIVOTS, dim)
    spark = vectors.sparkSession
    if not len(pivots):
        return best_rows(spark.createDataFrame([], schema), k)
    sample_ids, sample = some(rows, SAMPLE, dim)

    def key(batches):
        for b in batches:
            x, x2 = matrix(b.column(1), dim), b.column(2).to_numpy()
            d = np.sqrt(np.maximum(x2[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T, 0))
            p = d.argmin(1) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(x)), p])], names=[*b.schema.names, "pivot", "r"])

    keyed = staged(rows.transform(arrow, key, "vec_id long, vec binary, norm2 double, pivot int, r double"), "exact-index")
    steps = [i / 256 for i in range(257)]
    marks = {r["pivot"]: (r["n"], r["q"]) for r in keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("r", steps, 2000).alias("q")).collect()}
    cuts = {p: sorted({q[round(256 * i / m)] for i in range(1, m)}) for p, (n, q) in marks.items() if (m := min(256, -(-n // GROUP_ROWS))) > 1}
    ring = F.lit(0)
    for p, edges in cuts.items():
        ring = F.when(F.col("pivot") == p, F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("r")))).otherwise(ring)
    ringed = keyed.withColumn("ring", ring.cast("int"))
    groups = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"), F.max("norm2").alias("x2")).orderBy("pivot", "ring").collect()
    salts = [-(-g["n"] // (2 * GROUP_ROWS)) for g in groups]
    gp, low, high, x2 = (np.array([g[c] for g in groups]) for c in ("pivot", "low", "high", "x2"))
    places = spark.createDataFrame([(g["pivot"], g["ring"], i, salts[i]) for i, g in enumerate(groups)], "pivot int, ring int, g int, salts int")  # 257 rings a pivot at most
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by("vec", "vec").alias("vec"), F.min_by("norm2", "vec").alias("norm2"))
    n_queries = queries.count()

    def send(batches):
        for b in batches:
            ids, q, q2 = b.column(0).to_numpy(), matrix(b.column(1), dim), b.column(2).to_numpy()
            if not len(ids):
                continue
            s = _exact(q, sample, q2, (sample**2).sum(1))
            s[ids[:, None] == sample_ids[None]] = -np.inf
            least = np.partition(s, -k, axis=1)[:, -k] if len(sample_ids) > k else np.full(len(q), -np.inf)
            who, to = np.nonzero(_bound(q, q2, pivots[gp], low, high, x2) >= least[:, None])
            many = np.array(salts)[to]
            first = np.repeat(np.arange(len(to)), many)
            salt = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
            who, to = who[first], to[first]
            take = pa.array(who)
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(salt.astype(np.int32)), b.column(3).take(take), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(least[who])], names=["g", "salt", "chunk", "query_id", "vec", "norm2", "least"])

    sent = chunk(queries, n_queries).select("vec_id", "vec", "norm2", "chunk").transform(arrow, send, "g int, salt int, chunk int, query_id long, vec binary, norm2 double, least double")
    index = ringed.join(F.broadcast(places), ["pivot", "ring"]).select("g", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("salts")).cast("int").alias("salt"), every_chunk(n_queries), "vec_id", "vec", "norm2", "pivot", "r")

    def meet(qs: pa.Table, xs: pa.Table) -> pa.Table:
        out = []
        if qs.num_rows and xs.num_rows:
            xs = xs.sort_by([("r", "ascending"), ("vec_id", "ascending")])
            ids, x, n2, r = xs["vec_id"].to_numpy(), matrix(xs["vec"], dim), xs["norm2"].to_numpy(), xs["r"].to_numpy()
            p = pivots[xs["pivot"][0].as_py()]
            starts = np.arange(0, len(ids), ANNULUS)
            lo, hi = r[starts], r[np.minimum(starts + ANNULUS, len(r)) - 1]
            big = np.maximum.reduceat(n2, starts)
            for a in range(0, qs.num_rows, 512):
                part = qs.slice(a, 512)
                qi, q, q2, least = part["query_id"].to_numpy(), matrix(part["vec"], dim), part["norm2"].to_numpy(), part["least"].to_numpy().copy()
                bound = _bound(q, q2, np.broadcast_to(p, (len(starts), dim)), lo, hi, big)
                kept = [np.full((len(qi), k), -np.inf), np.zeros((len(qi), k), np.int64)]
                for j in np.argsort(-bound.max(0), kind="stable"):
                    on = np.flatnonzero(bound[:, j] >= least)
                    if not len(on):
                        continue
                    here = slice(starts[j], starts[j] + ANNULUS)
                    s = _exact(q[on], x[here], q2[on], n2[here])
                    s[qi[on][:, None] == ids[here][None]] = -np.inf
                    score = np.c_[kept[0][on], s]
                    who = np.c_[kept[1][on], np.broadcast_to(ids[here], s.shape)]
                    order = np.lexsort((who, -score), axis=1)[:, :k]
                    kept[0][on], kept[1][on] = np.take_along_axis(score, order, 1), np.take_along_axis(who, order, 1)
                    least[on] = np.maximum(least[on], kept[0][on][:, -1])
                row, col = np.nonzero(np.isfinite(kept[0]))
                out.append((qi[row], kept[1][row, col], kept[0][row, col].astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    keys = ("g", "salt", "chunk")
    return best_rows(sent.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(meet, schema), k)
