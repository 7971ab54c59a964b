"""Connected components by hooking, pointer jumping and contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges`` (pairs of longs); root is one node of the component.

    In each round every node hooks to its smallest smaller neighbour, parents
    are replaced by grandparents twice, and edges are rewritten to the parents;
    edges inside one tree vanish and the rest are made distinct. Every hook is
    an edge and maps to an edge, so no connection is lost, and at least half
    of the nodes that still have edges go each round. All tables are written
    between rounds. Loops are ignored; an empty input gives an empty result.
    """
    normal = lambda df, x, y: df.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a <> b").distinct()
    live = materialize(normal(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), F.col(a), F.col(b)), "edges")
    labels = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("root", F.col("node"))
    rounds = []
    while not live.isEmpty():
        parent = materialize(live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "hooks")
        for _ in range(2):
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            parent = materialize(parent.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent")), "jumps")
        rounds.append(parent)
        to = lambda x, y, p=parent: p.select(F.col("node").alias(x), F.col("parent").alias(y))
        moved = live.join(to("a", "pa"), "a").join(to("b", "pb"), "b", "left")
        live = materialize(normal(moved, F.col("pa"), F.coalesce("pb", "b")), "edges")
    for parent in rounds:
        labels = labels.join(parent.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
    return labels
