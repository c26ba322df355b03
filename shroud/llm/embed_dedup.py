"""Near duplicates of vectors by cosine over an inverted multi-index.

Vectors are brought to length one. Each half is quantised by a codebook of its own; a cell is a pair of centroids, and the
product of both books is the grid. A vector looks for its duplicates in the cells whose summed distance to its halves is
least, and stops where a duplicate at the threshold itself would have been met with the probability `target`. How far that
is has been measured beforehand: vectors of the sample are turned away by exactly the threshold's angle, at random and
towards other vectors, and the excess of their cell's distance over the nearest cell's is noted; the `target` quantile of
that excess is the stop. All that is met is verified in double precision.

The traversal goes along both sorted lists of centroids: of the k-th nearest centroid of the first half it passes those of
the second whose sum stays below the stop, which is what pops off a heap of pairs until then. Neighbouring centroids stand
next to each other in their books (by repeated halving), so a square of them forms a tile; squares are as large as makes a
tile of about TILE_ROWS rows, a single cell in large tables. Rows are stored by tile, and a vector travels once to each tile above
its own that has a cell it reaches; all vectors in it are compared with it, so each pair is looked at once. Tiles and
visitors are dealt into groups of a bounded size.

Equal vectors are folded into one with their number before anything is compared. No pair leaves a group: only the number
of links of a vector, and the edges of a forest that joins what is linked there. Components grow from those edges.
A cluster of n different vectors takes n^2/2 comparisons in n^2/GROUP_ROWS^2 groups, since each link has to be counted.

Defined cases: vectors that are null, empty, zero, of another length than the commonest (the shorter of equals), or with null or
non-finite components link with nothing. Each row is a vector: rows with equal ids are others to each other, and their
component is the smallest id reached. A row without an id links with nothing, has no component and is kept. An empty table
has no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .near_search import nearest
from .shared import arrow, drop_staged, staged
from .vectors import GROUP_ROWS, commonest_length, matrix, some

#: Rows of a mean tile; neighbouring centroids a side of a tile at most; visitors compared at once.
TILE_ROWS, WIDEST, STEP = 1024, 32, 512
_FOUND = "uid long, links long, root long"


def halving(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k centroids at most: k-means from the middles of k parts, made by halving the sample along its longest axis. Neighbours stand together."""
    parts = [x]
    while len(parts) < k and any(len(p) > 1 for p in parts):
        cut = []
        for p in parts:
            if len(p) < 2:
                cut.append(p)
                continue
            d = p - p.mean(0)
            axis = np.linalg.eigh(d.T @ d)[1][:, -1]
            order = np.argsort(d @ axis, kind="stable")
            cut += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
        parts = cut
    c = np.stack([p.mean(0) for p in parts])
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, column, len(c)) for column in x.T], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class Grid:
    """Two codebooks and how far a traversal goes."""

    def __init__(self, sample: np.ndarray, centroids: int, threshold: float, target: float, draws: int = 4, seed: int = 7) -> None:
        self.half = max(1, sample.shape[1] // 2)
        self.books = [halving(h, centroids) for h in (sample[:, : self.half], sample[:, self.half :]) if h.shape[1]]
        if len(self.books) < 2:
            self.books.append(np.zeros((1, 0)))
        rng = np.random.default_rng(seed)
        x = sample[rng.permutation(len(sample))[:4096]]
        spread = (rng.normal(size=x.shape), sample[rng.integers(len(sample), size=len(x))] - x)
        self.slack = max(self._excess(x, way, threshold, target) for way in [*spread, *(rng.normal(size=x.shape) for _ in range(draws - 2))])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x[:, : self.half], self.books[0]), nearest(x[:, self.half :], self.books[1])

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to all centroids but for the halves' own squares."""
        return tuple((c**2).sum(1)[None] - 2 * h @ c.T for h, c in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True))

    def _excess(self, x: np.ndarray, way: np.ndarray, threshold: float, target: float) -> float:
        way = way - (way * x).sum(1)[:, None] * x
        long = np.sqrt((way**2).sum(1))
        x, way = x[long > 1e-9], way[long > 1e-9] / long[long > 1e-9, None]
        if not len(x):
            return 0.0
        a, b = self.cells(threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * way)
        d1, d2 = self.distances(x)
        me = np.arange(len(x))
        return float(np.quantile(d1[me, a] + d2[me, b] - d1.min(1) - d2.min(1), target, method="higher"))

    def passed(self, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of centroids that one vector's traversal passes before its stop."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2 = d1[o1], d2[o2]
        upto = np.searchsorted(s2, s1[0] + s2[0] + self.slack - s1, "right")
        upto = upto[: np.searchsorted(-upto, 0)]  # falls along the first list
        return np.repeat(o1[: len(upto)], upto), o2[np.arange(upto.sum()) - np.repeat(np.cumsum(upto) - upto, upto)]


def edge_for(rows: int, cells: int) -> int:
    """A power of two."""
    edge = 1
    while edge < WIDEST and rows * (2 * edge) ** 2 <= TILE_ROWS * cells:
        edge *= 2
    return edge


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after nodes a[k] and b[k] are linked: the smallest node of each component. Labels are components so far."""
    while True:
        u, v = label[a], label[b]
        apart = u != v
        if not apart.any():
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, target: float = 0.999, centroids: int = 256, fit_rows: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row."""
    spark = vectors.sparkSession
    all_rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    dim = commonest_length(all_rows)

    def unit(batches):
        for b in batches:
            out = []
            for v in b.column(1):
                x = np.array(v.values.fill_null(np.nan)) if v.is_valid and len(v) == dim else np.zeros(0)
                size = np.sqrt(x @ x) if len(x) and np.isfinite(x).all() else 0.0
                if not np.isfinite(size) or 0 < size < 1e-150:  # squares leave the range of doubles
                    x = x / np.abs(x).max()
                    size = np.sqrt(x @ x)
                out.append((x / size + 0.0).tobytes() if size else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    rows = staged(all_rows.transform(arrow, unit, "vec_id long, vec binary").withColumn("key", F.unhex(F.sha2("vec", 256))), "embed-rows")
    usable = F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
    folded = rows.where(usable).groupBy("key").agg(F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"))
    folded = staged(folded.withColumn("uid", F.monotonically_increasing_id()), "embed-folded")
    _, sample = some(folded, fit_rows, dim)
    blank = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not len(sample):
        return blank
    grid = Grid(sample, centroids, threshold, target)

    def assign(batches):
        for b in batches:
            a, c = grid.cells(matrix(b.column(2), dim)) if b.num_rows else (np.empty(0, np.int32),) * 2
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(a.astype(np.int32)), pa.array(c.astype(np.int32))], names=["uid", "copies", "vec", "a", "b"])

    index = staged(folded.select("uid", "copies", "vec").transform(arrow, assign, "uid long, copies long, vec binary, a int, b int"), "embed-index")
    full = np.zeros((len(grid.books[0]), len(grid.books[1])), np.int64)
    for r in index.groupBy("a", "b").count().collect():  # a row a cell: centroids squared at most
        full[r["a"], r["b"]] = r["count"]
    edge = edge_for(int(full.sum()), full.size)
    n1, n2 = (-(-n // edge) for n in full.shape)
    tiles = np.add.reduceat(np.add.reduceat(full, np.arange(0, len(full), edge), 0), np.arange(0, full.shape[1], edge), 1).ravel()

    def send(batches):
        for b in batches:
            x = matrix(b.column(2), dim)
            home = b.column(3).to_numpy() // edge * n2 + b.column(4).to_numpy() // edge
            who, to = [], []
            for at in range(0, len(x), STEP):
                d1, d2 = grid.distances(x[at : at + STEP])
                for i in range(len(d1)):
                    p, q = grid.passed(d1[i], d2[i])
                    held = full[p, q] > 0
                    seen = np.unique(p[held] // edge * n2 + q[held] // edge)
                    seen = np.r_[home[at + i], seen[seen > home[at + i]]]
                    who.append(np.full(len(seen), at + i))
                    to.append(seen)
            take = pa.array(np.concatenate(who) if who else np.empty(0, np.int64))
            tile = pa.array((np.concatenate(to) if to else np.empty(0)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([tile, b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(home.astype(np.int32)).take(take)], names=["tile", "uid", "copies", "vec", "home"])

    visits = staged(index.transform(arrow, send, "tile int, uid long, copies long, vec binary, home int"), "embed-visits")
    visitors = np.zeros(n1 * n2, np.int64)
    for r in visits.groupBy("tile").count().collect():  # a row a tile
        visitors[r["tile"]] = r["count"]
    shelves, chunks = (np.maximum(1, -(-n // GROUP_ROWS)) for n in (tiles, visitors))
    split = spark.createDataFrame([(t, int(shelves[t]), int(chunks[t])) for t in np.flatnonzero(visitors).tolist()], "tile int, shelves int, chunks int")  # a row a tile
    deal = F.broadcast(split)

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one(n, salt):
        return F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(n)).cast("int")

    placed = index.withColumn("tile", (F.floor(F.col("a") / edge) * n2 + F.floor(F.col("b") / edge)).cast("int")).join(deal, "tile")
    placed = placed.select("tile", one("shelves", 5).alias("shelf"), every("chunks").alias("chunk"), "uid", "copies", "vec")
    sent = visits.join(deal, "tile").select("tile", every("shelves").alias("shelf"), one("chunks", 3).alias("chunk"), "uid", "copies", "vec", "home")

    def meet(qs: pa.Table, xs: pa.Table) -> pa.Table:
        return compare(qs, xs, dim, threshold)

    keys = ("tile", "shelf", "chunk")
    found = staged(sent.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(meet, _FOUND), "embed-found")
    drop_staged(visits, index)
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    edges = found.where(F.col("root") != F.col("uid")).select(F.col("uid").alias("a"), F.col("root").alias("b"))
    roots = components(edges).select(F.col("node").alias("uid"), "root")
    texts = folded.drop("vec").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    least = texts.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = staged(texts.join(least, "root").join(links, "uid", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "embed-classes")
    return rows.where(usable).select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).union(blank)


def compare(qs: pa.Table, xs: pa.Table, dim: int, threshold: float) -> pa.Table:
    """Links of a group's vectors with each other, and the least vector of what they join; those without a link are left out."""
    uid, at = np.unique(np.r_[qs["uid"].to_numpy(), xs["uid"].to_numpy()], return_inverse=True)
    label, links = np.arange(len(uid)), np.zeros(len(uid), np.int64)
    if qs.num_rows and xs.num_rows:
        q, x, many, copies = at[: qs.num_rows], at[qs.num_rows :], qs["copies"].to_numpy(), xs["copies"].to_numpy()
        there, at_home = matrix(xs["vec"], dim), qs["home"].to_numpy() == qs["tile"].to_numpy()
        for lo in range(0, len(q), STEP):
            part = slice(lo, lo + STEP)
            here = matrix(qs["vec"].slice(lo, STEP), dim)
            near = here @ there.T >= threshold
            near &= (q[part, None] < x[None]) | ~at_home[part, None]
            np.add.at(links, q[part], near @ copies)
            np.add.at(links, x, many[part] @ near)
            i, j = np.nonzero(near)
            label = joined(label, q[part][i], x[j])
    keep = links > 0
    return pa.table({"uid": uid[keep], "links": links[keep], "root": uid[label[keep]]})
