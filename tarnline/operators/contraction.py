"""Contracted networks: chains made one edge, close intersections made one node, with the edges rebuilt around them.

Edges are rows (u, v, length, highway) and may carry geometry, the points from u to v (an array of x and y); without one
it is the straight line. Speeds, travel times and bearings come from columns of the edges and places of the nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnline.functions.geo import bearing, haversine

from .network import by_sorting, consolidated

POINTS = "array<struct<x:double,y:double>>"
MPH = 1.609344


def with_geometry(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with their points; those without any get their ends. Edges to unknown nodes have null geometry."""
    at = lambda end: nodes.select(F.col("node_id").alias(end), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias(f"_{end}"))
    own = edges if "geometry" in edges.columns else edges.withColumn("geometry", F.lit(None).cast(POINTS))
    straight = F.when(F.col("_u").isNotNull() & F.col("_v").isNotNull(), F.array("_u", "_v"))
    return own.join(by_sorting(at("u")), "u", "left").join(by_sorting(at("v")), "v", "left").withColumn("geometry", F.coalesce("geometry", straight)).drop("_u", "_v")


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length", F.reverse("geometry").alias("geometry"))
    both = edges.select("u", "v", "length", "geometry").unionByName(turned).filter("u <> v and length is not null")
    return both.groupBy("u", "v").agg(F.min(F.struct("length", "geometry")).alias("x")).select("u", "v", "x.length", "x.geometry")


def _followed(steps: DataFrame, middle: DataFrame, keep) -> DataFrame:
    """Each step (s0, s1) with the last step (e0, e1) of the chain that it begins or goes on with, metres and nodes between; by doubling."""
    chain = keep(steps.select(F.col("u").alias("s0"), F.col("v").alias("s1"), F.col("u").alias("e0"), F.col("v").alias("e1"), "length", F.lit(0).cast("long").alias("inner")))
    while True:
        ends = chain.join(middle.select(F.col("node_id").alias("e1"), F.lit(1).alias("m")), "e1", "left")
        nxt = chain.select(F.col("s0").alias("n0"), F.col("s1").alias("n1"), F.col("e0").alias("t0"), F.col("e1").alias("t1"), F.col("length").alias("more"), F.col("inner").alias("also"))
        grown = ends.join(nxt, F.col("m").isNotNull() & (F.col("e1") == F.col("n0")) & (F.col("e0") != F.col("n1")), "left")
        go = F.col("t1").isNotNull()
        chain = keep(grown.select("s0", "s1", F.coalesce("t0", "e0").alias("e0"), F.coalesce("t1", "e1").alias("e1"), (F.col("length") + F.coalesce("more", F.lit(0.0))).alias("length"), (F.col("inner") + F.when(go, F.col("also") + 1).otherwise(0)).alias("inner")))
        # rings without a node to stay never end; only chains that begin at one are waited for
        open_ = chain.join(middle.select(F.col("node_id").alias("e1")), "e1", "left_semi").join(middle.select(F.col("node_id").alias("s0")), "s0", "left_anti")
        if open_.isEmpty():
            return chain


def simplified(nodes: DataFrame, edges: DataFrame, keep, fixed: DataFrame | None = None) -> DataFrame:
    """u, v, length, inner and geometry, both ways, with every chain through nodes of two neighbours made one edge; of chains between the same ends the shortest.

    Nodes of fixed (node_id) stay; rings without any other node vanish. A chain's points are put together from its steps,
    each of which finds the chain's first step, and its own place, by following the chain backwards.
    """
    steps = keep(_both_ways(with_geometry(nodes, edges)))
    middle = steps.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(F.col("u").alias("node_id"))
    if fixed is not None:
        middle = middle.join(fixed.select("node_id"), "node_id", "left_anti")
    middle = keep(middle)
    stays = lambda df, c: df.join(middle.select(F.col("node_id").alias(c)), c, "left_anti")
    chain = keep(stays(_followed(steps.drop("geometry"), middle, keep), "e1"))
    back = chain.select(F.col("s0").alias("v"), F.col("s1").alias("u"), F.col("e1").alias("first"), F.col("e0").alias("second"), F.col("inner").alias("place"))
    pieces = steps.select("u", "v", "geometry").join(back, ["u", "v"]).groupBy("first", "second").agg(F.array_sort(F.collect_list(F.struct("place", "geometry"))).alias("p"))
    # each piece begins where the one before ends
    points = F.flatten(F.transform("p", lambda p, i: F.when(i == 0, p["geometry"]).otherwise(F.slice(p["geometry"], F.lit(2), F.greatest(F.size(p["geometry"]) - 1, F.lit(0))))))
    lines = pieces.select(F.col("first").alias("s0"), F.col("second").alias("s1"), points.alias("geometry"))
    whole = stays(chain, "s0").join(lines, ["s0", "s1"])
    return whole.groupBy(F.col("s0").alias("u"), F.col("e1").alias("v")).agg(F.min(F.struct("length", "inner", "geometry")).alias("x")).select("u", "v", "x.length", "x.inner", "x.geometry")


def rebuilt(nodes: DataFrame, edges: DataFrame, keep, metres: float = 10.0, plane: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with intersections linked by steps of less than so many metres (on the globe, or in a plane as in close_pairs) made one.

    Nodes: node_id (the least of the merged ones), their mean place (and elevation, if there is one), members and n. Edges
    lead from merged node to merged node; where several became one, the way to its place is added to the length and to the
    geometry. Edges inside a merged node vanish, but for loops that were there before. Parallel edges become the shortest,
    with the number merged; its other columns stay.
    """
    label = keep(consolidated(nodes, keep, metres, plane))
    own = by_sorting(nodes).join(label.select("node_id", "cluster", F.col("x").alias("cx"), F.col("y").alias("cy"), "n"), "node_id")
    height = [F.avg("elevation").alias("elevation")] if "elevation" in nodes.columns else []
    merged = own.groupBy(F.col("cluster").alias("node_id")).agg(F.first("cx").alias("x"), F.first("cy").alias("y"), *height, F.array_sort(F.collect_list("node_id")).alias("members"), F.first("n").alias("n"))
    lines = with_geometry(nodes, edges)
    at = lambda end: own.select(F.col("node_id").alias(end), F.col("cluster").alias(f"{end}_to"), F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")).alias(f"{end}_at"), F.when(F.col("n") > 1, haversine(F.col("y"), F.col("x"), F.col("cy"), F.col("cx"))).otherwise(0.0).alias(f"{end}_m"))
    rewired = lines.join(by_sorting(at("u")), "u").join(by_sorting(at("v")), "v").filter((F.col("u_to") != F.col("v_to")) | (F.col("u") == F.col("v")))
    longer = lambda end: F.when(F.col(f"{end}_m") > 0, F.array(f"{end}_at")).otherwise(F.lit(None).cast(POINTS))
    empty = F.array().cast(POINTS)
    geometry = F.concat(F.coalesce(longer("u"), empty), F.col("geometry"), F.coalesce(longer("v"), empty))
    others = [c for c in edges.columns if c not in ("u", "v", "length", "geometry")]
    moved = rewired.select(F.col("u_to").alias("u"), F.col("v_to").alias("v"), (F.col("length") + F.col("u_m") + F.col("v_m")).alias("length"), geometry.alias("geometry"), *others)
    best = moved.groupBy("u", "v").agg(F.min(F.struct("length", *others, "geometry")).alias("x"), F.count(F.lit(1)).alias("merged"))
    return merged, best.select("u", "v", "x.*", "merged")


def speed(text: Column) -> Column:
    """Kilometres an hour of a maxspeed value: the mean of the numbers in it, miles turned; null without any."""
    numbers = F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)).cast("array<double>")
    mean = F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))
    return F.when(text.contains("mph"), mean * MPH).otherwise(mean)


def with_speeds(edges: DataFrame, fallback: float = 50.0) -> DataFrame:
    """Edges with speed_kph: that of maxspeed, else the mean of edges of the same highway, else that of all, else the fallback."""
    own = edges.withColumn("_kph", speed(F.col("maxspeed")) if "maxspeed" in edges.columns else F.lit(None).cast("double"))
    kinds = own.groupBy(F.col("highway").alias("_kind")).agg(F.sum("_kph").alias("_s"), F.count("_kph").alias("_n"))  # a row a kind of highway
    every = kinds.agg((F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))).alias("_all"))
    means = kinds.select("_kind", (F.col("_s") / F.nullif("_n", F.lit(0))).alias("_mean"))
    met = own.join(means, own["highway"].eqNullSafe(F.col("_kind")), "left").crossJoin(F.broadcast(every))  # one row
    return met.withColumn("speed_kph", F.coalesce("_kph", "_mean", "_all", F.lit(fallback))).drop("_kph", "_kind", "_mean", "_all")


def with_travel_times(edges: DataFrame) -> DataFrame:
    """Edges with travel_time in seconds, from length and speed_kph."""
    return edges.withColumn("travel_time", F.col("length") / (F.nullif("speed_kph", F.lit(0.0)) / 3.6))


def with_bearings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with their initial bearing in degrees; null for loops and unknown nodes."""
    at = lambda end: nodes.select(F.col("node_id").alias(end), F.col("x").alias(f"_{end}x"), F.col("y").alias(f"_{end}y"))
    way = bearing(F.col("_uy"), F.col("_ux"), F.col("_vy"), F.col("_vx"))
    return edges.join(by_sorting(at("u")), "u", "left").join(by_sorting(at("v")), "v", "left").withColumn("bearing", F.when(F.col("u") != F.col("v"), way)).drop("_ux", "_uy", "_vx", "_vy")


def for_routing(nodes: DataFrame, edges: DataFrame, keep, metres: float = 10.0, fallback: float = 50.0, plane: float | None = None) -> tuple[DataFrame, DataFrame]:
    """A network made ready for routing: both ways, speeds, merged intersections, travel times, bearings."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *(c for c in edges.columns if c not in ("u", "v")))
    if "geometry" in edges.columns:
        turned = turned.withColumn("geometry", F.reverse("geometry"))
    merged, ways = rebuilt(nodes, with_speeds(edges.unionByName(turned), fallback), keep, metres, plane)
    return merged, with_bearings(merged, with_travel_times(ways))
