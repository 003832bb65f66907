"""The k nearest nodes of many places, by a tree of cells that is searched from the top, level by level, for all places at once.

Each cell knows how many nodes it holds, a middle, and a radius that all of them are within. A place keeps the cells that can
hold one of its k nearest: those whose least possible distance isn't beyond the greatest possible one of cells that hold k
nodes together. What is kept stays small however crowded or far away the nodes are, and all steps are joins on cells. Places
with the same coordinates are searched for once, and what is found goes to all of their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnline.functions import zorder
from tarnline.functions.geo import haversine

from .blocks import Keep

#: Nodes of a cell that isn't cut further.
LEAF = 32
#: Halvings between one level of the tree and the next.
STEP = 3
#: Metres by which bounds are widened against rounding.
SLACK = 1e-3


def _cells(own: DataFrame, deep: int, keep: Keep) -> list[DataFrame]:
    """cell, n, cx, cy and radius of every cell, for each of the levels above the lowest one, and that, from the top; radii are made from the level below."""
    centre = [F.avg("x").alias("cx"), F.avg("y").alias("cy")]
    lowest = own.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *centre)
    far = own.join(lowest, "cell").groupBy("cell").agg(F.first("n").alias("n"), F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.max(haversine(F.col("y"), F.col("x"), F.col("cy"), F.col("cx"))).alias("radius"))
    out = [keep(far)]
    for _ in range(deep):
        below = out[0].select(F.shiftright("cell", 2 * STEP).alias("cell"), F.col("n").alias("m"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("radius").alias("r"))
        middle = below.groupBy("cell").agg(F.sum("m").alias("n"), (F.sum(F.col("x") * F.col("m")) / F.sum("m")).alias("cx"), (F.sum(F.col("y") * F.col("m")) / F.sum("m")).alias("cy"))
        reach = below.join(middle, "cell").groupBy("cell").agg(F.first("n").alias("n"), F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.max(haversine(F.col("y"), F.col("x"), F.col("cy"), F.col("cx")) + F.col("r")).alias("radius"))
        out.insert(0, keep(reach))
    return out


def nearest_join(places: DataFrame, nodes: DataFrame, k: int, keep: Keep, id_col: str = "id", within: float | None = None, leaf: int = LEAF) -> DataFrame:
    """id, node_id, dist_m and rank (from 1) of the k nodes nearest to every place (id, x, y) by great-circle metres, of at most within metres if that is given; ties by node_id. Fewer if there are fewer. Places and nodes without coordinates are left out; places of one id need to be one place."""
    known = nodes.filter("x is not null and y is not null").select("node_id", "x", "y")
    asked = keep(places.filter("x is not null and y is not null").select(id_col, (F.col("x") + 0.0).alias("px"), (F.col("y") + 0.0).alias("py")).distinct())
    box = known.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side")).first()
    west, south, side = box.x or 0.0, box.y or 0.0, (box.side or 0.0) * (1 + 1e-9) or 1.0
    coded = keep(known.withColumn("z", zorder.code(F.col("x"), F.col("y"), west, south, side)))
    deep = -(-zorder.depth(coded, leaf) // STEP)
    own = coded.withColumn("cell", zorder.cell("z", STEP * deep)).drop("z")
    levels = _cells(own, deep, keep)
    middle = haversine(F.col("py"), F.col("px"), F.col("cy"), F.col("cx"))
    front = keep(asked.select("px", "py").distinct()).withColumn("up", F.lit(0).cast("long"))
    by_place = Window.partitionBy("px", "py")
    for i, cells in enumerate(levels):
        met = front.join(cells.withColumn("up", F.shiftright("cell", 2 * STEP)) if i else cells.withColumn("up", F.lit(0).cast("long")), "up").withColumn("d", middle)
        met = met.withColumn("least", F.greatest(F.col("d") - F.col("radius") - SLACK, F.lit(0.0))).withColumn("most", F.col("d") + F.col("radius") + SLACK)
        held = F.sum("n").over(by_place.orderBy("most", "cell").rowsBetween(Window.unboundedPreceding, 0))
        # the first cell by which k nodes are certain bounds the distance; without k nodes nothing does
        bound = F.min(F.when(F.col("held") >= k, F.col("most"))).over(by_place)
        kept = met.withColumn("held", held).withColumn("bound", bound).filter("bound is null or least <= bound")
        if within is not None:
            kept = kept.filter(F.col("least") <= within)
        front = keep(kept.select("px", "py", F.col("cell").alias("up")))
    found = front.withColumnRenamed("up", "cell").join(own, "cell").withColumn("dist_m", haversine(F.col("py"), F.col("px"), F.col("y"), F.col("x")))
    if within is not None:
        found = found.filter(F.col("dist_m") <= within)
    rank = F.row_number().over(by_place.orderBy("dist_m", "node_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("px", "py", "node_id", "dist_m", "rank")
    return asked.join(best, ["px", "py"]).select(id_col, "node_id", "dist_m", "rank")
