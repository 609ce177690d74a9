"""Connected components of an edge table, by alternating stars, all in DataFrames.

In a large-star step every node links its larger neighbours to the smallest of its
neighbourhood; in a small-star step it links its smaller neighbours, and itself, to the
smallest of them. The edge count never grows, and after a number of rounds logarithmic in
a component's size each component is one star around its smallest node. Each step is a
grouped minimum and a join back, written out in between, so a node with very many
neighbours is a skewed join that Spark splits. Tables of a round go when the next has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over stored edges (a, b), a > b, which go."""
    around = edges.union(edges.select("b", "a")).toDF("a", "b") if large else edges
    least = materialize(around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("c", "m").alias("m")))
    joined = around.join(least, F.col("a") == F.col("c"))
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    made = materialize(moved.where("a > b").distinct())
    discard(least, edges)
    return made


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the smallest node reachable.

    Loops, repeated edges, either direction and edges with a null end are all fine; the latter count for nothing.
    """
    big, small = F.greatest(a, b), F.least(a, b)
    now = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(big.alias("a"), small.alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        now = _star(_star(now, True), False)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
