"""Nearest parent by position, exact, without comparing every pair.

Few parents are compared inside each row. Many are put in a hierarchy of cells with tight boxes;
each child descends it, keeping only cells that can still hold its nearest parent. Cells are cut at
quartiles of what they hold, first across, then along, so they stay small however dense a spot is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

IN_ROW = 512          # distinct parent positions compared inside a row
LEAF = 16             # positions a lowest cell holds at most
QUARTILES = [0.25, 0.5, 0.75]
FAN = 16              # cells a level cuts a cell into
BROADCAST_CELLS = 100_000


def nearest_parent(children: DataFrame, parents: DataFrame, in_row: int = IN_ROW) -> DataFrame:
    """(id, x, y, parent, px, py, dist) for positioned children; ties go to the least parent id."""
    kids = children.dropna(subset=["x", "y"]).select("id", "x", "y")
    # Parents at one spot are interchangeable but for the tie rule, so one stands for all.
    spots = parents.dropna(subset=["x", "y"]).groupBy(F.col("x").alias("px"), F.col("y").alias("py")).agg(
        F.min("id").alias("parent"))
    if spots.limit(in_row + 1).count() <= in_row:
        return _compare_in_row(kids, spots)
    return _descend(kids, spots)


def _compare_in_row(kids: DataFrame, spots: DataFrame) -> DataFrame:
    listed = spots.agg(F.collect_list(F.struct("parent", "px", "py")))  # at most `in_row` entries
    best = F.array_min(F.transform("__p", lambda p: F.struct(
        F.hypot(F.col("x") - p["px"], F.col("y") - p["py"]).alias("dist"), p["parent"].alias("parent"),
        p["px"].alias("px"), p["py"].alias("py"))))
    found = kids.withColumn("__p", listed.scalar()).withColumn("__b", best).where(F.col("__b").isNotNull())
    return found.select("id", "x", "y", "__b.parent", "__b.px", "__b.py", "__b.dist")


def _cut(spots: DataFrame, axis: str, n: int) -> DataFrame:
    """Cells cut in four at the approximate quartiles of their positions on an axis; `n` cells there are."""
    bounds = spots.groupBy("cell").agg(F.percentile_approx(axis, QUARTILES, 1_000).alias("__q"))
    met = spots.join(F.broadcast(bounds) if n <= BROADCAST_CELLS else bounds, "cell")
    part = F.size(F.filter("__q", lambda q: F.col(axis) > q)).cast("long")
    return met.withColumn("cell", F.col("cell") * 4 + part).drop("__q")


def cell_levels(spots: DataFrame, leaf: int = LEAF) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """Per level the cells (cell, its box) with their number, and the spots with their lowest cell.

    A cell is `cell / FAN` of the level above. Positions are distinct, so a cut by quartiles on both
    axes leaves at most about a quarter of a cell in one place, whatever the density: the levels end
    when no cell holds more than `leaf`.
    """
    spots, n, levels = spots.withColumn("cell", F.lit(0).cast("long")), 1, []
    while True:
        across = _cut(spots, "px", n)
        spots = cut_lineage(_cut(across, "py", 4 * n))
        seen = Observation()
        boxes = spots.groupBy("cell").agg(
            F.min("px").alias("ax"), F.max("px").alias("bx"), F.min("py").alias("ay"), F.max("py").alias("by"), F.count(F.lit(1)).alias("held"))
        cells = cut_lineage(boxes.observe(seen, F.count(F.lit(1)).alias("n"), F.max("held").alias("held"))).drop("held")
        n = seen.get["n"]
        levels.append((cells, n))
        if seen.get["held"] <= leaf:
            return levels, spots


def _descend(kids: DataFrame, spots: DataFrame) -> DataFrame:
    levels, leaves = cell_levels(spots)
    cand = kids.withColumn("cell", F.lit(0).cast("long"))
    for cells, n in levels:
        inside = cells.select(F.shiftright("cell", 4).alias("__up"), F.col("cell").alias("__cell"), "ax", "bx", "ay", "by")
        cand = cand.join(F.broadcast(inside) if n <= BROADCAST_CELLS else inside, F.col("cell") == F.col("__up"))
        least = F.hypot(_gap("x", "ax", "bx"), _gap("y", "ay", "by"))
        most = F.hypot(_far("x", "ax", "bx"), _far("y", "ay", "by"))
        reach = F.min(most).over(Window.partitionBy("id"))
        cand = cand.withColumn("__reach", reach).where(least <= F.col("__reach") * F.lit(1 + 1e-12)).select(
            "id", "x", "y", F.col("__cell").alias("cell"))
    dist = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    best = F.min(F.struct(dist.alias("dist"), "parent", "px", "py")).alias("b")
    return cand.join(leaves, "cell").groupBy("id", "x", "y").agg(best).select(
        "id", "x", "y", "b.parent", "b.px", "b.py", "b.dist")


def _gap(at: str, low: str, high: str) -> Column:
    """Distance on one axis from a point to an interval, 0 inside."""
    return F.greatest(F.col(low) - F.col(at), F.col(at) - F.col(high), F.lit(0.0))


def _far(at: str, low: str, high: str) -> Column:
    return F.greatest(F.abs(F.col(at) - F.col(low)), F.abs(F.col(at) - F.col(high)))
