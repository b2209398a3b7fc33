"""Connected components of an edge table by alternating star contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetry.session import cut

EDGES = 50_000              # edges that one task reads, about


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point every node at the least node seen around it; `large` moves greater neighbours, else smaller ones.

    The least neighbour is an aggregate that partial sums shrink before the shuffle; the join back splits hot nodes
    under adaptive execution.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b")


def _state(edges: DataFrame) -> tuple[int, int]:
    """Tasks for (greater, lesser) edges; nodes that keep them from being stars around their least nodes."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("points"), F.lit(False).alias("met")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("points"), F.lit(True).alias("met")))).alias("end"))
    nodes = ends.groupBy("end.node").agg(F.sum("end.points").alias("points"), F.max("end.met").alias("met"))
    n, unsettled = nodes.agg(F.sum("points"), F.count_if(F.expr("points > 1 or (points = 1 and met)"))).first()
    return -(-(n or 0) // EDGES) or 1, unsettled


def components(edges: DataFrame, a="a", b="b") -> DataFrame:
    """(node, component) for every node of an edge; the component is the least node id of its class.

    Each round is two joins and shrinks the classes' diameters geometrically, so rounds grow with the logarithm of
    the longest chain. Every round is cut with a reliable checkpoint. The rounds end when each node points at one
    other node that itself points nowhere, which one aggregate over nodes tells; classes found earlier, given as
    (node, component) edges, are in that state already.
    """
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    tasks = -(-now.count() // EDGES) or 1
    now = now.coalesce(tasks)
    tasks, unsettled = _state(now)
    while unsettled:
        large = _star(now.coalesce(tasks), True).coalesce(tasks)
        now = cut(_star(large, False).coalesce(tasks).distinct().coalesce(tasks))
        tasks, unsettled = _state(now)
    now = now.coalesce(tasks)
    # Every edge is (node, least node) now.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
