"""Connected components of an undirected graph by alternating large and small stars.

Every step replaces edges by edges to the least neighbour known, so a component ends as a star
around its least node, in about log2(nodes) rounds whatever the diameter. A node of very many neighbours is
never gathered: the least neighbour is a partial aggregate, and the join back is an equi-join that
adaptive execution splits where a key is hot. Each round's edges are written to the shared
folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.storage import drop, scratch


def _stars(e: DataFrame, n: int | None = None) -> tuple[DataFrame, int, int]:
    """(e written once, its rows, their digest); n is about how many there will be, if known: a file holds half a million."""
    e = scratch(e.distinct() if n is None else e.distinct().coalesce(max(1, n >> 19)), even=True)
    got = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return e, got["n"], got["x"] or 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component): each node that has an edge to another node, with the least node it reaches.

    Self loops and null ends are no edges; repeated edges count once; an empty table gives an empty result.
    Fewer ``rounds`` than it takes give finer groups, each inside one component.
    """
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e = ends.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
    e, n, x = _stars(e)
    settled = not n
    for _ in range(rounds):
        if settled:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = large.repartition("a").distinct()  # dealt by a, which the two steps below use too; a node leads to few others here
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, large["a"] == low["k"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        before = e
        e, n2, x2 = _stars(small.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))), n)
        drop(before)
        settled = (n2, x2) == (n, x)
        n, x = n2, x2
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component"))
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(roots.distinct()) if settled else found.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
