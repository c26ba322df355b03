"""What the two vector searches share: usable vectors, groups of bounded size, and the best rows of a block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import arrow

#: Rows of the index, and queries, that meet in one task at most (more only where one id has them).
GROUP_ROWS, CHUNK_QUERIES = 8192, 16384


def usable(vectors: DataFrame, id_col: str, vector_col: str, change: Callable[[np.ndarray], np.ndarray] | None = None, zero: bool = False) -> tuple[DataFrame, int]:
    """vec_id, vec (float64 bytes), norm2; and the dimension.

    Left out: null ids, null or empty vectors, null or non-finite components, zero vectors unless `zero`, and vectors of
    another length than the commonest (the shorter of equals).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    dim = commonest_length(rows)

    def run(batches):
        for b in batches:
            flat = b.column(1).flatten()
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim) if len(flat) else np.empty((0, dim))
            keep = np.isfinite(x).all(1)
            if not zero:
                keep &= (x != 0).any(1)
            x = x[keep] if change is None else change(x[keep])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array((x * x).sum(1), pa.float64())], names=["vec_id", "vec", "norm2"])

    return rows.where(F.size("v") == dim).transform(arrow, run, "vec_id long, vec binary, norm2 double"), dim


def commonest_length(rows: DataFrame) -> int:
    """Of the non-empty arrays in column v; the shorter of equals, 1 if there are none."""
    most = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return most[0]["d"] if most else 1


def matrix(column, dim: int) -> np.ndarray:
    """Rows of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def some(rows: DataFrame, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the n rows whose ids hash lowest: the same ones every time."""
    got = rows.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(n).collect()
    return np.array([r["vec_id"] for r in got], np.int64), np.frombuffer(b"".join(bytes(r["vec"]) for r in got), np.float64).reshape(-1, dim)


def chunks(n: int) -> int:
    """Groups that n queries are worked through in."""
    return max(1, -(-n // CHUNK_QUERIES))


def chunk(queries: DataFrame, n: int) -> DataFrame:
    """Adds `chunk`: which of the groups of queries a query is in."""
    return queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(chunks(n))).cast("int"))


def every_chunk(n: int) -> Column:
    """For rows of the index: one row for each group of queries."""
    return F.explode(F.sequence(F.lit(0), F.lit(chunks(n) - 1))).alias("chunk")


def best_rows(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: highest score first, ties to the smaller vec_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top(score: np.ndarray, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest finite scores and of all that come within `slack` of the k-th."""
    if score.shape[1] > k:
        least = np.partition(score, -k, axis=1)[:, -k] - slack
    else:
        least = np.full(len(score), -np.inf)
    return np.nonzero((score >= least[:, None]) & np.isfinite(score))
