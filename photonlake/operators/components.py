"""Connected components of an edge table, by alternating star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialise


def _to_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and all its v as m.

    Of a hot u only partial minima are shuffled for the aggregate. It is by a struct, not by u itself, so the join
    can't take its partitions over and both sides are dealt out for the join alone: then adaptive execution splits the
    rows of a hot u over tasks and gives each the one row of its minimum.
    """
    least = pairs.groupBy(F.struct("u").alias("k")).agg(F.min("v").alias("m")).select(F.col("k.u").alias("w"), F.least("k.u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    return _to_least(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    found = _to_least(down)
    moved = found.select(F.col("v").alias("a"), F.col("m").alias("b")).union(found.select("u", "m"))
    return moved.where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(pmod(xxhash64(b, a), 1000003))")).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (the least node that can be reached) for each node of an edge.

    Edges with a null end and loops don't count; repeated edges are one. The number of rounds grows with the
    logarithm of the longest path. Every round is written to the shared folder, so its lineage stays short.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now)
    mark = _mark(now)
    while mark[0]:
        now = materialise(_small_star(_large_star(now)))
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def forest_roots(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (where its way ends) for each ``a`` of a table of edges (a, b), at most one for each a and without rings.

    Each round goes twice as far as all before it, so a way of n edges takes the logarithm of n rounds of one join.
    """
    now = materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("component"), F.lit(True).alias("on")))
    while not now.where("on").isEmpty():
        on = now.select(F.col("node").alias("at"), F.col("component").alias("next"))
        further = now.join(on, F.col("component") == F.col("at"), "left")
        now = materialise(further.select("node", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("on")))
    return now.select("node", "component")
