"""Connected components of a graph given as an edge table, in rounds of star contractions.

Each round hooks the larger neighbours of every node to the least node around it, then the
smaller neighbours likewise, which leaves a forest of stars after a few rounds. A round
is made of grouped minima and joins, so a node of any degree is only ever summed up. The
rounds end once stars are left, without another one that changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.tables import cut_lineage, release_shuffles


def _rows_of(*pairs: tuple[Column, Column]) -> Column:
    """Several rows (a, b) for each row."""
    return F.inline(F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in pairs]))


def _hook_larger(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node with the least node around it, which is always smaller than that neighbour."""
    both = edges.select(_rows_of((F.col("a"), F.col("b")), (F.col("b"), F.col("a"))))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).hint("merge")  # shuffled by then, and a broadcast would be one more step
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _hook_smaller(down: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours with the least of them, of edges (a, b) with b < a."""
    least = down.groupBy("a").agg(F.min("b").alias("m")).hint("merge")
    return down.join(least, "a").select(_rows_of((F.col("a"), F.col("m")), (F.col("b"), F.col("m")))).where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of the edges (a, b), b < a, either has one smaller neighbour and no larger one, or larger ones only."""
    ends = edges.select(_rows_of((F.col("a"), F.col("b")), (F.col("b"), F.lit(None).cast("long"))))
    around = ends.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max(F.col("b").isNull()).alias("centre"))
    return around.where("low <> high or low is not null and centre").isEmpty()


def stars(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b) that a smaller one can be reached from; component is the least node reachable.

    Loops and repeated edges are fine; rows with a null end are left out.
    """
    now, done = cut_lineage(edges.select("a", "b").where("a <> b").distinct()), False
    while not done:
        now = cut_lineage(_hook_smaller(_hook_larger(now)))
        release_shuffles(edges.sparkSession)
        done = _are_stars(now)
    return now.toDF("node", "component")


def connected_components(edges: DataFrame) -> DataFrame:
    """``stars`` with the least nodes themselves: (node, component) for every node of ``edges``, loops left out."""
    others = stars(edges)
    return others.unionByName(others.select(F.col("component").alias("node"), "component").distinct())
