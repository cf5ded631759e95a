"""Connected components of an edge table by hooking roots and shortening pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b); the root is the smallest node of the component.

    Every round looks up the roots of both ends of each edge, hooks the larger root below the
    smallest one it meets and points all nodes at the new root; edges inside one tree are dropped.
    All rounds are joins of written tables, so a hub's rows can be split. Only counts reach the driver.
    """
    live = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(), "edges")
    roots = None
    while True:
        # each larger end below the smallest end it is joined to; chains are then shortened to their end
        hooks = stored(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
            step = stored(hooks.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "hooks")
            hooks = step.select("node", "root")
            if step.filter("moved").isEmpty():
                break
        if roots is None:
            ends = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
            roots = ends.join(hooks, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        else:
            up = hooks.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
            roots = roots.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_up", "root").alias("root"))
        roots = stored(roots, "roots")
        one = hooks.select(F.col("node").alias("a"), F.col("root").alias("_ra"))
        two = hooks.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
        moved = live.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("_ra", "a").alias("x"), F.coalesce("_rb", "b").alias("y"))
        live = stored(moved.filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if live.isEmpty():
            return roots
