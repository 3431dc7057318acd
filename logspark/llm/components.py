"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import few, saved

#: Edges (16 bytes each) up to which a round runs in one partition instead of shuffles.
SMALL_EDGES = 200_000


def _pairs(df: DataFrame, *pairs: tuple) -> DataFrame:
    """(a, b) rows of several column pairs of each row; unlike a union it keeps the partitions."""
    made = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])
    return df.select(F.explode(made).alias("e")).select("e.a", "e.b")


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (itself included)."""
    both = _pairs(edges, ("a", "b"), ("b", "a"))
    low = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("low"))
    return both.join(low, F.col("a") == F.col("node")).where("b > a").select(F.col("low").alias("a"), "b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    low = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low"))
    joined = edges.join(low, F.col("b") == F.col("node"))
    return _pairs(joined, ("low", "a"), ("low", "b")).where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): each node with edges and the smallest id it reaches; edges: (a, b), a <> b.

    Every round writes its edges as a table, so a lost executor costs one round. The rounds end
    when the edges stay the same; their number grows with the logarithm of the longest path.
    Counted edges of at most SMALL_EDGES stand in one partition, more are spread by node.
    """
    now = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    small = few(now, SMALL_EDGES)
    state = None
    while True:
        now = now.coalesce(1) if small else now
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state = mark
        now = saved(_small(_large(now)), "edges")
    return now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
