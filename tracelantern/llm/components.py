"""Connected components of a graph that is a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelantern.functions.stages import kept
from tracelantern.llm.shared import hot_join


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links(a, b)``; root is the smallest node reached.

    Large-star and small-star steps in turn: each step links the neighbours of a
    node to the smallest of them, until every component is a star around its
    smallest node.  Each step is written to the shared folder, so the lineage stays
    short.  Nodes with very many neighbours are joined in place (``hot_join``).
    """
    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = kept(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        edges = kept(_linked(both, both.where("v > u")).distinct())
        edges = kept(_linked(edges, edges, itself=True).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )


def _linked(neighbours: DataFrame, moved: DataFrame, itself: bool = False) -> DataFrame:
    """The neighbours ``moved`` of each node (and the node) linked to its smallest neighbour."""
    smallest = kept(neighbours.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    smallest = smallest.withColumn("m", F.least("m", "u"))
    total = smallest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    new = hot_join(moved, smallest, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if itself:
        new = new.unionByName(smallest.select("u", F.col("m").alias("v")))
    return new.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _state(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
