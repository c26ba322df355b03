"""The scan over a stream. It is stateless and tokens are keyed, so every micro-batch names a value alike, and a batch that
runs again gives the same rows; sinks that replace by batch id are exactly-once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import general
from ..operators.protect import protect
from ..operators.scan import scan


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_a_batch: int = 64) -> DataFrame:
    """Parquet files as they arrive under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def protect_stream(stream: DataFrame, known, secret: str) -> DataFrame:
    return protect(scan(stream, known), secret).select("doc_id", "protected", "protections")


def counts_by_window(stream: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """General findings by window and kind, for a stream with event times; rows later than `late` are dropped by the watermark."""
    rows = general.general(stream.withWatermark(time_col, late))
    return rows.groupBy(F.window(time_col, window), "kind").agg(F.count("*").alias("n"))


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """write gets each micro-batch and its id, and must replace what an earlier try of that id wrote."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
