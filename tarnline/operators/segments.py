"""Segments of routes: pieces of a walk with their paths, their metrics, and edits of segment lists.

A segment is a row (route_id, seg, path): path holds the nodes in order, and neighbours share their joint node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnline.functions.geo import bearing, compass, haversine

HOPS = 4


def walks(route: DataFrame) -> DataFrame:
    """route_id and its nodes in order."""
    rows = route.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id"))).alias("x"))
    return rows.select("route_id", F.col("x.node_id").alias("nodes"))


def cut(walk: DataFrame, hops: int = HOPS) -> DataFrame:
    """Segments of so many steps; the last one takes what is left. A route of one node has none."""
    n = F.floor((F.size("nodes") - 2) / hops)
    rows = walk.filter(F.size("nodes") >= 2).select("route_id", "nodes", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("seg"))
    return rows.select("route_id", "seg", F.slice("nodes", (F.col("seg") * hops + 1).cast("int"), F.lit(hops + 1)).alias("path"))


def placed(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for every node of every path: route_id, seg, i (from 1), node_id, x, y, elevation and d, metres from the node before in the path (0 for the first)."""
    rows = segments.select("route_id", "seg", F.posexplode("path").alias("at", "node_id")).select("route_id", "seg", (F.col("at") + 1).cast("long").alias("i"), "node_id")
    w = Window.partitionBy("route_id", "seg").orderBy("i")
    on = rows.join(nodes.select("node_id", "x", "y", F.coalesce("elevation", F.lit(0.0)).alias("elevation")), "node_id")
    d = F.coalesce(haversine(F.lag("y").over(w), F.lag("x").over(w), F.col("y"), F.col("x")), F.lit(0.0))
    return on.withColumn("d", d)


def properties(segments: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Metrics of every segment: ends, km, gain, loss, net, grades, steep steps, heights, mean degree (connectivity), direction and validity.

    A segment with an unknown node or a missing edge isn't valid; its sums are over what is known.
    """
    w = Window.partitionBy("route_id", "seg").orderBy("i")
    degree = edges.groupBy(F.col("u").alias("node_id")).agg(F.count_distinct("v").alias("degree"))
    rows = placed(segments, nodes).join(degree, "node_id", "left")
    for c in ("node_id", "elevation"):
        rows = rows.withColumn(f"from_{c}", F.lag(c).over(w))
    hop = edges.groupBy("u", "v").agg(F.min("length").alias("length"))
    own = rows.join(hop, (F.col("u") == F.col("from_node_id")) & (F.col("v") == F.col("node_id")), "left")
    rise, step = F.col("elevation") - F.col("from_elevation"), F.col("from_node_id").isNotNull()
    grade = F.when(F.col("length") > 0, F.abs(rise) / F.col("length") * 100)
    at = lambda c, pick: pick(c, "i")
    out = own.groupBy("route_id", "seg").agg(
        at("node_id", F.min_by).alias("start_node"), at("node_id", F.max_by).alias("end_node"), F.count(F.lit(1)).alias("n_nodes"),
        (F.sum("length") / 1000).alias("km"), F.sum(F.when(rise > 0, rise).otherwise(0.0)).alias("gain"), F.sum(F.when(rise <= 0, -rise).otherwise(0.0)).alias("loss"),
        F.coalesce(F.max(grade), F.lit(0.0)).alias("max_grade"), F.coalesce(F.avg(grade), F.lit(0.0)).alias("avg_grade"), F.count_if(grade > 8).alias("steep"),
        F.min("elevation").alias("low"), F.max("elevation").alias("high"), F.avg(F.coalesce("degree", F.lit(0))).alias("connectivity"),
        F.bool_and(~step | F.col("length").isNotNull()).alias("is_valid"),
        *(at(c, f).alias(f"{n}_{c}") for n, f in (("a", F.min_by), ("b", F.max_by)) for c in ("x", "y")),
    )
    turned = compass(bearing(F.col("a_y"), F.col("a_x"), F.col("b_y"), F.col("b_x")))
    return out.withColumn("net", F.col("gain") - F.col("loss")).withColumn("direction", turned).drop("a_x", "a_y", "b_x", "b_y")


def route_totals(props: DataFrame) -> DataFrame:
    """Sums over a route's segments; grades and connectivity are weighted by nodes, the time is 8 km an hour. Routes are connected where each segment starts at the end of the one before."""
    w = Window.partitionBy("route_id").orderBy("seg")
    rows = props.withColumn("linked", F.coalesce(F.col("start_node") == F.lag("end_node").over(w), F.lit(True)))
    mean = lambda c: (F.sum(F.col(c) * F.col("n_nodes")) / F.sum("n_nodes")).alias(c)
    return rows.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("km").alias("km"), F.sum("gain").alias("gain"), F.sum("loss").alias("loss"), F.sum("net").alias("net"), F.max("max_grade").alias("max_grade"),
        mean("avg_grade"), mean("connectivity"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("steep").alias("steep"),
        (F.min_by("start_node", "seg") == F.max_by("end_node", "seg")).alias("is_circular"), F.bool_and(F.col("linked") & F.col("is_valid")).alias("is_valid"),
        (F.sum("km") / 8 * 60).alias("minutes"),
    )


def key(path: Column, direction: Column, km: Column) -> Column:
    """A segment's key: its path, direction and length; hashed where it is over 100 characters."""
    text = F.concat_ws("_", F.concat_ws("-", path.cast("array<string>")), direction, F.format_string("%.6f", km))
    return F.when(F.length(text) > 100, F.md5(text.cast("binary"))).otherwise(text)


def append(paths: Column, path: Column) -> Column:
    return F.concat(paths, F.array(path))


def insert(paths: Column, at: int, path: Column) -> Column:
    """The list with a path put before index at (from 0); beyond the end it is appended."""
    return F.concat(F.slice(paths, 1, at), F.array(path), F.slice(paths, at + 1, F.greatest(F.size(paths) - at, F.lit(0))))


def remove(paths: Column, at: int) -> Column:
    """The list without index at (from 0); as it is where there is none."""
    return F.when(F.size(paths) > at, F.concat(F.slice(paths, 1, at), F.slice(paths, at + 2, F.greatest(F.size(paths) - at - 1, F.lit(0))))).otherwise(paths)


def complete(paths: Column) -> Column:
    """All nodes of a list of paths in order; where a path starts at the end of the one before, the joint stands once."""
    step = lambda acc, p: F.concat(acc, F.when(F.try_element_at(acc, F.lit(-1)) == F.try_element_at(p, F.lit(1)), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p))
    return F.aggregate(paths, F.array().cast("array<bigint>"), step)


def waypoints(paths: Column) -> Column:
    """The first node of the first path, then the end of every path."""
    ends = F.transform(paths, lambda p: F.element_at(p, -1))
    return F.when(F.size(paths) > 0, F.concat(F.array(F.element_at(paths, 1)[0]), ends)).otherwise(F.array().cast("array<bigint>"))


def results(totals: DataFrame, fitness: DataFrame, objective: str) -> DataFrame:
    """Result rows of routes: cost is the negated fitness, null where that is missing or 0; the target is the actual distance."""
    own = totals.join(fitness.select("route_id", "fitness"), "route_id", "left")
    cost = F.when(F.coalesce("fitness", F.lit(0.0)) != 0, -F.col("fitness"))
    return own.select("route_id", cost.alias("cost"), F.lit(objective).alias("objective"), F.col("km").alias("target_distance_km"), "km", "gain", "loss", "minutes", "is_circular", F.lit("genetic_algorithm").alias("solver"))
