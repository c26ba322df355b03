"""Arrow passes over whole documents: batches of bounded bytes, and small inputs dealt out to all cores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that a function sees at once (one row can have more); bytes a core under which an input is dealt out anew, and bytes
#: that are worth a task of their own.
BATCH_BYTES, SMALL_SHARE, LEAST_SHARE = 4 << 20, 8 << 20, 64 << 10


def pieces(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes."""
    rows = max(1, batch.num_rows * most // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def by_pieces(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow whose batches are slices of bounded bytes."""

    def each(batches):
        yield from run(p for b in batches for p in pieces(b))

    return df.mapInArrow(each, schema)


def by_batch(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """The same where a function makes one batch of each."""
    return by_pieces(df, lambda batches: map(run, batches), schema)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out so that all cores have work and no task has much of it.

    A file of one row group is one task however many cores wait, and of a large file a task is as large as a core's share of it. So
    the rows are shuffled once before work that costs far more than that: into some tasks a core where the input (by the plan's own
    estimate) is under SMALL_SHARE bytes a core, else into a task for each SMALL_SHARE bytes of the files that are read. Only the
    layout hangs on this, never a result.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if _dealt(plan):
        return df
    size = int(str(plan.stats().sizeInBytes()))
    if size < cores * SMALL_SHARE:
        tasks = min(4 * cores, size // LEAST_SHARE)
        return df.repartition(tasks) if 1 < tasks else df
    leaves = plan.collectLeaves()  # estimates of joins are not used: they multiply
    read = sum(n for n in (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())) if n < _UNKNOWN)
    return df.repartition(max(4 * cores, -(-read // SMALL_SHARE)))


#: What leaves rows in the tasks they are in.
_IN_PLACE = {"Project", "Filter", "ArrowEvalPython", "BatchEvalPython", "MapInArrow", "Generate"}


def _dealt(plan) -> bool:
    """Whether nothing but work on single rows stands between these rows and a shuffle that dealt them out."""
    while plan.nodeName() in _IN_PLACE:
        plan = plan.children().apply(0)
    return plan.nodeName() == "Repartition" and plan.shuffle()


#: What a plan says of rows whose size it doesn't know is more than this.
_UNKNOWN = 1 << 50
