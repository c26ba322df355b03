"""Approximate nearest neighbours by inner product over an inverted multi-index.

Both halves of a vector are quantised by codebooks of their own; a cell is a pair of centroids. A query takes the pairs
in order of summed distance until the cells hold `share` of the rows, and the rows of those cells are ranked by their exact
inner product. The order comes from a heap over square blocks of the two sorted lists of centroids: a block is opened once
its nearest pair could be next, so most blocks are never looked at. Distances are taken after the usual lift that turns
the largest inner product into the smallest distance: each row gets one more component, sqrt(M^2 - |x|^2), and queries get 0.
Codebooks are fitted on at most `fit_rows` rows; every row is indexed.

A query travels as its vector and the distance that it reaches to; the cells themselves are found again where the rows are.
Rows are grouped by SHELF neighbouring centroids of the first half, split further where a group is large.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import arrow, staged
from .vectors import GROUP_ROWS, best_rows, chunk, every_chunk, matrix, some, top, usable


#: Neighbouring first-half centroids whose rows share a group; centroids in an edge of a block of the traversal.
SHELF, EDGE = 32, 32


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means on the sample, sorted along the centroids' main axis; an empty centroid takes a random row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, column, k) for column in x.T], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    axis = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0]
    return c[np.argsort(c @ axis, kind="stable")]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)


def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances but for the query's own square."""
    return (c**2).sum(1)[None] - 2 * q @ c.T


def reach(d1: np.ndarray, d2: np.ndarray, count: np.ndarray, least: int, edge: int = EDGE) -> float:
    """The summed distance to which pairs of centroids, taken in its order, hold `least` rows (all of them: infinite)."""
    if least >= count.sum():
        return np.inf
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, grid = d1[o1], d2[o2], count[np.ix_(o1, o2)]
    sums, rows, held, bound = [], [], 0, np.inf
    heap = [(s1[0] + s2[0], 0, 0)]
    while heap and heap[0][0] < bound:
        _, i, j = heapq.heappop(heap)
        n = grid[i : i + edge, j : j + edge]
        full = np.nonzero(n)
        sums.append(s1[i + full[0]] + s2[j + full[1]])
        rows.append(n[full])
        held += int(rows[-1].sum())
        if i + edge < len(s1) and j == 0:  # each block is entered from one other only
            heapq.heappush(heap, (s1[i + edge] + s2[0], i + edge, 0))
        if j + edge < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + edge], i, j + edge))
        if held >= least and bound == np.inf:  # blocks that begin beyond can't hold a nearer pair
            bound = _held_to(sums, rows, least)
    return _held_to(sums, rows, least)


def _held_to(sums: list[np.ndarray], rows: list[np.ndarray], least: int) -> float:
    s, n = np.concatenate(sums), np.concatenate(rows)
    order = np.argsort(s, kind="stable")
    return float(s[order[np.searchsorted(np.cumsum(n[order]), least)]])


def near_search(vectors: DataFrame, k: int = 20, every: int = 20, share: float = 0.3, centroids: int = 512, fit_rows: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (double) for queries whose id is divisible by `every`, against all other rows.

    A query that stands in several rows counts once (the least vector); candidates count as often as they stand there. The
    cells hold 5 (k + 1) rows at least, so that k can be given.
    """
    made, dim = usable(vectors, id_col, vector_col)
    rows = staged(made, "near-rows")
    schema = "query_id long, vec_id long, score double"
    _, sample = some(rows, fit_rows, dim)
    if not len(sample):
        return best_rows(vectors.sparkSession.createDataFrame([], schema), k)
    largest = float(rows.agg(F.max("norm2")).first()[0])
    half = max(1, dim // 2)

    def lifted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :half], np.c_[x[:, half:], np.sqrt(np.maximum(largest - (x * x).sum(1), 0))]

    books = [codebook(h, centroids) for h in lifted(sample)]

    def towards(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(q[:, :half], books[0]), distances(np.c_[q[:, half:], np.zeros(len(q))], books[1])

    def assign(batches):
        for b in batches:
            a, c = lifted(matrix(b.column(1), dim)) if b.num_rows else (np.empty((0, half)), np.empty((0, dim - half + 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest(a, books[0]).astype(np.int32)), pa.array(nearest(c, books[1]).astype(np.int32))], names=["vec_id", "vec", "a", "b"])

    index = staged(rows.transform(arrow, assign, "vec_id long, vec binary, a int, b int"), "near-index")
    count = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in index.groupBy("a", "b").count().collect():  # a row a cell: centroids squared at most
        count[r["a"], r["b"]] = r["count"]
    shelves = np.add.reduceat(count.sum(1), np.arange(0, len(count), SHELF))
    salts = np.maximum(1, -(-shelves // GROUP_ROWS))
    least = max(5 * (k + 1), int(np.ceil(share * count.sum())))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    n_queries = queries.count()

    def send(batches):
        for b in batches:
            q = matrix(b.column(1), dim)
            d1, d2 = towards(q)
            who, to, salt, far = [], [], [], []
            for i in range(len(q)):
                r = reach(d1[i], d2[i], count, least)
                for shelf in np.unique(np.flatnonzero(d1[i] + d2[i].min() <= r) // SHELF).tolist():
                    for s in range(salts[shelf] if shelves[shelf] else 0):
                        who.append(i)
                        to.append(shelf)
                        salt.append(s)
                        far.append(r)
            take = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(salt, pa.int32()), b.column(2).take(take), b.column(0).take(take), b.column(1).take(take), pa.array(far, pa.float64())], names=["shelf", "salt", "chunk", "query_id", "vec", "far"])

    sent = chunk(queries, n_queries).select("vec_id", "vec", "chunk").repartition(max(1, min(n_queries // 64, 4096)), "vec_id").transform(arrow, send, "shelf int, salt int, chunk int, query_id long, vec binary, far double")
    salt_of = F.lit(1)
    for shelf, s in enumerate(salts.tolist()):
        if s > 1:
            salt_of = F.when(F.col("shelf") == shelf, s).otherwise(salt_of)
    shelved = index.withColumn("shelf", F.floor(F.col("a") / SHELF).cast("int"))
    placed = shelved.select("shelf", F.pmod(F.xxhash64("vec_id", F.lit(5)), salt_of).cast("int").alias("salt"), every_chunk(n_queries), "vec_id", "vec", "a", "b")

    def meet(qs: pa.Table, xs: pa.Table) -> pa.Table:
        out = []
        if qs.num_rows and xs.num_rows:
            ids, x, a, c = xs["vec_id"].to_numpy(), matrix(xs["vec"], dim), xs["a"].to_numpy(), xs["b"].to_numpy()
            for at in range(0, qs.num_rows, 128):
                part = qs.slice(at, 128)
                qi, q, far = part["query_id"].to_numpy(), matrix(part["vec"], dim), part["far"].to_numpy()
                d1, d2 = towards(q)
                s = np.where(d1[:, a] + d2[:, c] <= far[:, None] + 1e-9, q @ x.T, -np.inf)  # sums may differ in the last bit from the sender's
                s[qi[:, None] == ids[None]] = -np.inf
                row, col = top(s, k, 1e-9)  # near ties are settled on the exact figures
                exact = np.einsum("ij,ij->i", q[row], x[col])
                order = np.lexsort((ids[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                keep = rank < k
                out.append((qi[row[keep]], ids[col[keep]], exact[keep]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    keys = ("shelf", "salt", "chunk")
    return best_rows(sent.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(meet, schema), k)
