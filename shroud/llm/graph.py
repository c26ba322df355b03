"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import drop_staged, staged


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> node, root: the smallest node of its component. Nodes without an edge don't appear.

    Each round hangs neighbours on their smallest neighbour from both sides and is written to the shared folder; it ends
    when a round changes nothing, that is when every edge leads to its root. No group of edges is gathered anywhere.
    """
    now = staged(_oriented(edges), "edges")
    seen = None
    for _ in range(most_rounds):
        made = [now]
        small = staged(_small(_large(now, made), made), "edges")
        for table in made:
            drop_staged(table)
        now = small
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _oriented(edges: DataFrame) -> DataFrame:
    """a > b, each once."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Larger neighbours of each node go to its smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")  # a table of its own, so a hub's edges can be split
    made.append(least)
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them."""
    edges = staged(edges, "large")
    least = staged(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    made += [edges, least]
    met = edges.join(least, "a")
    return _oriented(met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))
