"""Network preparation and lookup: enrichment, weights, filters, spatial predicates, elevation sources, shortest paths."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnline.functions.geo import haversine, planar

#: Factors of highway and surface kinds in routing weights (fixed values).
HIGHWAY = {"path": 0.8, "residential": 0.9, "living_street": 0.8, "unclassified": 1.0, "tertiary": 1.1, "secondary": 1.3, "primary": 1.5}
SURFACE = {"asphalt": 0.9, "concrete": 0.9, "paved": 0.9, "compacted": 1.0, "gravel": 1.2, "dirt": 1.3, "grass": 1.4, "sand": 2.0}


def edge_elevation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with signed gain, loss, climb and unsigned grade in percent; missing elevations are 0, a missing length is 1 in the grade."""
    at = lambda end: nodes.select(F.col("node_id").alias(end), F.coalesce("elevation", F.lit(0.0)).alias(f"{end}_elevation"))
    joined = edges.join(at("u"), "u").join(at("v"), "v")
    gain, length = F.col("v_elevation") - F.col("u_elevation"), F.coalesce("length", F.lit(1.0))
    out = joined.withColumn("elevation_gain", gain).withColumn("elevation_loss", F.greatest(F.lit(0.0), -gain)).withColumn("elevation_climb", F.greatest(F.lit(0.0), gain))
    return out.withColumn("grade", F.when(length > 0, F.abs(gain) / length * 100).otherwise(0.0)).drop("u_elevation", "v_elevation")


def running_weight(edges: DataFrame, elevation_weight: float = 0.1, grade_penalty: float = 2.0) -> DataFrame:
    gain, grade, length = (F.coalesce(c, F.lit(0.0)) for c in ("elevation_gain", "grade", "length"))
    return edges.withColumn("running_weight", length + F.when(gain > 0, gain * elevation_weight).otherwise(0.0) + F.when(grade > 5, length * (grade / 100) * grade_penalty).otherwise(0.0))


def _factor(kind: Column, table: dict[str, float]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), kind), F.lit(1.0))


def routing_weight(edges: DataFrame, surface: str | None = None) -> DataFrame:
    """Weights from grade (a fraction), highway and surface; a missing length is 100."""
    g, length = F.abs(F.col("grade_frac")), F.coalesce("length", F.lit(100.0))
    steep = F.when(g > 0.05, 1.2 + (g - 0.05) * 2).otherwise(1.0)
    ground = _factor(F.col(surface), SURFACE) if surface else F.lit(1.0)
    return edges.withColumn("running_weight", length * steep * _factor(F.col("highway"), HIGHWAY) * ground).withColumn("elevation_weight", length * (1 + g * 0.5))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with the number of their edges, counted once for both directions."""
    counted = edges.groupBy(F.col("u").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(counted, "node_id", "left").fillna(0, ["degree"])


def without_footways(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = edges.filter(F.col("highway").isNull() | (F.col("highway") != "footway"))
    ends = kept.select(F.col("u").alias("node_id")).unionByName(kept.select(F.col("v").alias("node_id"))).distinct()
    return nodes.join(ends, "node_id", "left_semi"), kept


def nodes_within(nodes: DataFrame, edges: DataFrame, lat: float, lon: float, km: float, start: int | None = None) -> DataFrame:
    """Nodes in a radius that aren't of degree 2, and the start; the box of the radius is pushed to the scan."""
    near = nearby(nodes, lat, lon, km)
    kept = degrees(near, edges).filter((F.col("degree") != 2) | (F.col("node_id") == F.lit(start)) if start is not None else F.col("degree") != 2)
    return kept


def nearby(nodes: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    from math import cos, radians

    dlat = km / 111.0 * 1.01
    dlon = dlat / max(0.01, cos(radians(lat)))
    box = nodes.filter(F.col("y").between(lat - dlat, lat + dlat) & F.col("x").between(lon - dlon, lon + dlon))
    return box.withColumn("dist_m", haversine(F.lit(lat), F.lit(lon), F.col("y"), F.col("x"))).filter(F.col("dist_m") <= km * 1000)


def nearest(nodes: DataFrame, lat: float, lon: float, km: float = 2.0, k: int = 50) -> DataFrame:
    """The k nearest nodes in a radius; ties by id."""
    return nearby(nodes, lat, lon, km).orderBy("dist_m", "node_id").limit(k)


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(nodes, edges).agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if(F.col("degree") > 2).alias("intersection_count"), F.count_if(F.col("degree") == 1).alias("dead_end_count"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.round(F.stddev_samp("degree"), 6).alias("std_degree"), F.min("y").alias("south"), F.max("y").alias("north"), F.min("x").alias("west"), F.max("x").alias("east"))
    e = edges.agg(F.count(F.lit(1)).alias("total_edges"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.round(F.avg("length"), 4).alias("avg_length"), F.round(F.sum("length"), 2).alias("sum_length"))
    return d.withColumn("one", F.lit(1)).join(e.withColumn("one", F.lit(1)), "one").drop("one").withColumn("edge_node_ratio", F.round(F.col("total_edges") / F.col("total_nodes"), 6))


def covering_tile(points: DataFrame, tiles: DataFrame, cell: float = 0.01) -> DataFrame:
    """Each point's finest covering tile (ties by path), by an equi-join on grid cells and the exact box after it."""
    at = lambda c: F.floor(F.col(c) / cell)
    cells = tiles.withColumn("cx", F.explode(F.sequence(at("west"), at("east")))).withColumn("cy", F.explode(F.sequence(at("south"), at("north"))))
    met = points.withColumn("cx", at("x")).withColumn("cy", at("y")).join(cells, ["cx", "cy"])
    inside = met.filter(F.col("x").between(F.col("west"), F.col("east")) & F.col("y").between(F.col("south"), F.col("north")))
    return inside.groupBy("node_id").agg(F.min(F.struct("resolution", "tile_path")).alias("t")).select("node_id", "t.tile_path", "t.resolution")


def hybrid_elevation(points: DataFrame, sources: list[tuple[str, DataFrame]], zero_is_missing: bool = True) -> DataFrame:
    """Elevation from the first source that has one, 0 if none does, and the name of that source."""
    out = points
    for name, source in sources:
        value = F.nullif(F.col("elevation"), F.lit(0.0)) if zero_is_missing else F.col("elevation")
        out = out.join(source.select("node_id", value.alias(f"_{name}")), "node_id", "left")
    named = reduce(lambda c, n: c.when(F.col(f"_{n}").isNotNull(), n), [n for n, _ in sources[1:]], F.when(F.col(f"_{sources[0][0]}").isNotNull(), sources[0][0]))
    return out.select(*points.columns, F.coalesce(*(F.col(f"_{n}") for n, _ in sources), F.lit(0.0)).alias("elevation"), named.otherwise("none").alias("source"))


def shortest_distances(edges: DataFrame, start: int, cutoff: float, keep, nodes: DataFrame) -> DataFrame:
    """node_id and network metres from the start, up to a cutoff. keep writes a frame and reads it back, which cuts the lineage (a shared folder on a cluster)."""
    from .blocks import reached

    one = edges.sparkSession.sql(f"SELECT {int(start)}L AS node_id")
    return reached(edges, cutoff, keep, nodes, one).select("node_id", "dist")


def distance_band(distances: DataFrame, target: float, tolerance: float = 0.3, k: int = 20) -> DataFrame:
    """The k nodes closest to a distance, within a tolerance."""
    return distances.filter(F.col("dist").between(target * (1 - tolerance), target * (1 + tolerance))).withColumn("off", F.abs(F.col("dist") - target)).orderBy("off", "node_id").limit(k)


#: Kinds of way, of ground and of access that a running network keeps or leaves out (fixed values).
RUNNABLE = ("primary", "secondary", "tertiary", "residential", "path", "living_street", "unclassified")
NOT_RUNNABLE = ("motorway", "trunk", "motorway_link", "trunk_link", "footway", "cycleway")
SOFT_GROUND, CLOSED = ("sand", "mud", "gravel"), ("private",)
#: Kinds of node that are intersections whatever is near them (fixed values).
REAL_CROSSINGS = ("crossing", "traffic_signals", "stop", "mini_roundabout")


def runnable(edges: DataFrame, with_footways: bool = False) -> DataFrame:
    """Edges of a running network, by highway, access and surface; words may stand anywhere in the value, a missing one excludes nothing but a missing highway."""
    barred = tuple(k for k in NOT_RUNNABLE if not (with_footways and k in ("footway", "cycleway")))
    kept = RUNNABLE + (("footway", "cycleway") if with_footways else ())
    none_of = lambda c, words: F.coalesce(~F.col(c).rlike("|".join(words)), F.lit(True))
    return edges.filter(F.col("highway").rlike("|".join(kept)) & none_of("highway", barred) & none_of("access", CLOSED) & none_of("surface", SOFT_GROUND))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges in both directions, each pair once by its shortest."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length")
    return edges.select("u", "v", "length").unionByName(turned).groupBy("u", "v").agg(F.min("length").alias("length"))


def subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    own = nodes.select("node_id").distinct()
    return edges.join(own.withColumnRenamed("node_id", "u"), "u", "left_semi").join(own.withColumnRenamed("node_id", "v"), "v", "left_semi")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, heights, and grades in percent (edges with grade) over 5 and 10."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.min("elevation").alias("low"), F.max("elevation").alias("high"), (F.max("elevation") - F.min("elevation")).alias("range"), F.avg("elevation").alias("mean"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.sum("length").alias("length"), F.max("grade").alias("max_grade"), F.avg("grade").alias("mean_grade"), F.count_if(F.col("grade") > 5).alias("over_5"), F.count_if(F.col("grade") > 10).alias("over_10"))
    return n.crossJoin(F.broadcast(e))  # one row each


def start_node(nodes: DataFrame, lat: float, lon: float, wanted: int | None = None) -> DataFrame:
    """The wanted node, or the nearest to a place (ties by id), as one row; a wanted node that isn't there raises."""
    if wanted is not None:
        found = nodes.filter(F.col("node_id") == wanted)
        if found.isEmpty():
            raise ValueError(f"no node {wanted}")
        return found.select("node_id", F.lit(0.0).alias("dist_m")).limit(1)
    d = haversine(F.lit(lat), F.lit(lon), F.col("y"), F.col("x"))
    return nodes.agg(F.min(F.struct(d.alias("d"), "node_id")).alias("x")).select("x.node_id", F.col("x.d").alias("dist_m"))


def intersections(nodes: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """The first nodes by id that aren't of degree 2, with degree."""
    return degrees(nodes, edges).filter("degree <> 2").orderBy("node_id").limit(most)


def best_start(nodes: DataFrame, edges: DataFrame, lat: float, lon: float, at_intersections: bool = True) -> DataFrame:
    """The nearest of the first intersections, or of all nodes."""
    return start_node(intersections(nodes, edges) if at_intersections else nodes, lat, lon)


def node_frame(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with degree and defaults: elevation 0, highway empty."""
    highway = F.coalesce("highway", F.lit("")) if "highway" in nodes.columns else F.lit("")
    return degrees(nodes, edges).select("node_id", "x", "y", F.coalesce("elevation", F.lit(0.0)).alias("elevation"), highway.alias("highway"), "degree")


def edge_frame(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the coordinates of their ends."""
    at = lambda end: nodes.select(F.col("node_id").alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y"))
    return edges.join(at("u"), "u").join(at("v"), "v").select("u", "v", F.coalesce("length", F.lit(0.0)).alias("length"), F.coalesce("highway", F.lit("")).alias("highway"), "u_x", "u_y", "v_x", "v_y")


def nearby_planar(nodes: DataFrame, lat: float, lon: float, km: float = 2.0, k: int = 50) -> DataFrame:
    """The k nodes nearest to a place among those less than km / 111 degrees away in the plane of coordinates; ties by id."""
    r = km / 111.0
    box = nodes.filter(F.col("y").between(lat - r, lat + r) & F.col("x").between(lon - r, lon + r))
    inside = box.filter((F.col("x") - lon) * (F.col("x") - lon) + (F.col("y") - lat) * (F.col("y") - lat) < r * r)
    return inside.withColumn("dist_m", haversine(F.lit(lat), F.lit(lon), F.col("y"), F.col("x"))).orderBy("dist_m", "node_id").limit(k)


def within_road_distance(candidates: DataFrame, distances: DataFrame, start: int, most: float) -> DataFrame:
    """Candidates (node_id) that a distance map reaches within so many metres; the start always stays."""
    near = distances.filter(F.col("dist") <= most).select("node_id")
    return candidates.join(near, "node_id", "left_semi").unionByName(candidates.filter(F.col("node_id") == start)).distinct()


def by_sorting(df: DataFrame) -> DataFrame:
    """A frame of a row a node or an edge, for joins that never broadcast: ids pack so well in files that Spark takes millions of them for a small table, which the driver would have to hold."""
    return df.hint("merge")


def close_pairs(points: DataFrame, metres: float, plane: float | None = None) -> DataFrame:
    """a < b: points (node_id, x, y) less than so many metres apart, by an equi-join on grid cells, four times as wide as that.

    Bands of y have cells of their own width, from the least length of a degree of x near them; bands at a pole are one cell.
    Points of a network that was projected to one plane, that of a latitude (plane), are as far apart as they are in it: a
    degree of x is as long everywhere as there, also where y comes near a pole of the globe or goes beyond it.
    """
    dy = 1.01 * metres / 111_000
    band = lambda y: F.floor(y / (4 * dy))
    if plane is None:
        # degrees of x are no shorter than this share of those of y in a band and next to it
        share = F.abs(F.cos(F.radians((F.col("cy") + 0.5) * (4 * dy)))) - F.radians(F.lit(4 * dy))
        dx = F.when(share > dy / 10, F.lit(dy) / share).otherwise(360.0)
        apart = haversine(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx"))
    else:
        dx = F.lit(dy / math.cos(math.radians(plane)))
        apart = planar(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx"), plane)
    column = lambda x: F.floor(x / (4 * dx))
    known = points.select("node_id", "x", "y")
    own = known.withColumn("cy", band(F.col("y"))).withColumn("cx", column(F.col("x")))
    spread = known.withColumn("cy", F.explode(F.sequence(band(F.col("y") - dy), band(F.col("y") + dy)))).withColumn("cx", F.explode(F.sequence(column(F.col("x") - dx), column(F.col("x") + dx))))
    met = by_sorting(own.withColumnsRenamed({"node_id": "a", "x": "ax", "y": "ay"})).join(spread.withColumnsRenamed({"node_id": "b", "x": "bx", "y": "by"}), ["cx", "cy"]).filter("a < b")
    return met.filter(apart < metres).select("a", "b")


def thinned(nodes: DataFrame, edges: DataFrame, keep, metres: float = 20.0) -> DataFrame:
    """node_id and kind of intersections: real ones (by highway) all stay; of the others those stay, in the order of ids, that are near no real one and none that stays.

    A round settles every node whose nearer ones with lesser ids are settled; rounds end when all are.
    """
    own = degrees(nodes, edges).filter("degree <> 2")
    real = F.coalesce(F.col("highway").isin(*REAL_CROSSINGS), F.lit(False))
    marked = keep(own.select("node_id", "x", "y", real.alias("real")))
    pairs = keep(close_pairs(marked, metres))
    by_real = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(marked.filter("real").select(F.col("node_id").alias("a")), "a", "left_semi").select(F.col("b").alias("node_id")).distinct()
    left = keep(marked.filter("not real").select("node_id").join(by_real, "node_id", "left_anti"))
    kept = marked.filter("real").select("node_id", F.lit("real").alias("kind"))
    open_ = keep(pairs.join(left.withColumnRenamed("node_id", "a"), "a", "left_semi").join(left.withColumnRenamed("node_id", "b"), "b", "left_semi"))
    while not left.isEmpty():
        free = keep(left.join(open_.select(F.col("b").alias("node_id")), "node_id", "left_anti"))
        kept = kept.unionByName(free.withColumn("kind", F.lit("other")))
        gone = open_.join(free.select(F.col("node_id").alias("a")), "a", "left_semi").select(F.col("b").alias("node_id")).distinct()
        left = keep(left.join(free, "node_id", "left_anti").join(gone, "node_id", "left_anti"))
        open_ = keep(open_.join(left.withColumnRenamed("node_id", "a"), "a", "left_semi").join(left.withColumnRenamed("node_id", "b"), "b", "left_semi"))
    return kept


def simplified(edges: DataFrame, keep, fixed: DataFrame | None = None) -> DataFrame:
    """Edges with every chain through nodes of two neighbours made one: u, v, length, inner (nodes left out). Nodes of fixed (node_id) stay; rings without any other node vanish.

    Chains are followed by pointer doubling: the number of rounds is the logarithm of the longest chain.
    """
    steps = keep(both_ways(edges).filter("u <> v"))
    middle = steps.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(F.col("u").alias("node_id"))
    if fixed is not None:
        middle = middle.join(fixed.select("node_id"), "node_id", "left_anti")
    middle = keep(middle)
    inner = F.col("m").isNotNull()
    chain = keep(steps.select(F.col("u").alias("s0"), F.col("v").alias("s1"), F.col("u").alias("e0"), F.col("v").alias("e1"), "length", F.lit(0).cast("long").alias("inner")))
    for _ in range(64):
        ends = chain.join(middle.select(F.col("node_id").alias("e1"), F.lit(1).alias("m")), "e1", "left")
        nxt = chain.select(F.col("s0").alias("n0"), F.col("s1").alias("n1"), F.col("e0").alias("t0"), F.col("e1").alias("t1"), F.col("length").alias("more"), F.col("inner").alias("also"))
        grown = ends.join(nxt, inner & (F.col("e1") == F.col("n0")) & (F.col("e0") != F.col("n1")), "left")
        go = F.col("t1").isNotNull()
        new = keep(grown.select("s0", "s1", F.coalesce("t0", "e0").alias("e0"), F.coalesce("t1", "e1").alias("e1"), (F.col("length") + F.coalesce("more", F.lit(0.0))).alias("length"), (F.col("inner") + F.when(go, F.col("also") + 1).otherwise(0)).alias("inner"), go.alias("go"), F.col("length").alias("was")))
        chain = new.drop("go", "was")
        open_ = new.join(middle.select(F.col("node_id").alias("e1")), "e1", "left_semi").join(middle.select(F.col("node_id").alias("s0")), "s0", "left_anti")
        if open_.isEmpty():
            break
    starts = chain.join(middle.select(F.col("node_id").alias("s0")), "s0", "left_anti").join(middle.select(F.col("node_id").alias("e1")), "e1", "left_anti")
    return starts.groupBy(F.col("s0").alias("u"), F.col("e1").alias("v")).agg(F.min(F.struct("length", "inner")).alias("x")).select("u", "v", "x.length", "x.inner")


def consolidated(nodes: DataFrame, keep, metres: float = 10.0, plane: float | None = None) -> DataFrame:
    """node_id and cluster (least id of nodes linked by steps of less than so many metres, on the globe or in a plane as in close_pairs), with the cluster's mean place: x, y, n."""
    label = keep(nodes.select("node_id", F.col("node_id").alias("cluster")))
    pairs = keep(close_pairs(nodes, metres, plane))
    both = keep(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    while True:
        near = by_sorting(both).join(label.select(F.col("node_id").alias("a"), F.col("cluster").alias("c")), "a").groupBy(F.col("b").alias("node_id")).agg(F.min("c").alias("c"))
        stepped = by_sorting(label).join(near, "node_id", "left").select("node_id", F.least("cluster", "c").alias("new"), "cluster")
        jump = by_sorting(stepped).join(label.select(F.col("node_id").alias("new"), F.col("cluster").alias("far")), "new").select("node_id", F.least("new", "far").alias("new"), "cluster")
        after = keep(jump)
        label = after.select("node_id", F.col("new").alias("cluster"))
        if after.filter("new <> cluster").isEmpty():
            break
    placed = by_sorting(nodes.select("node_id", "x", "y")).join(label, "node_id")
    centre = placed.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    return by_sorting(label).join(centre, "cluster").select("node_id", "cluster", "x", "y", "n")


def validated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: numbers of nodes and edges, of those that lack what they need, and whether the network can be used."""
    lacks = F.col("x").isNull() | F.col("y").isNull() | F.col("elevation").isNull()
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(lacks).alias("bad_nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("length").isNull()).alias("bad_edges"))
    return n.crossJoin(F.broadcast(e)).withColumn("valid", (F.col("n_nodes") > 0) & (F.col("bad_nodes") == 0) & (F.col("bad_edges") == 0))  # one row each


def route_bounds(route: DataFrame, nodes: DataFrame) -> DataFrame:
    """The box of every route's known nodes; zeros without any."""
    on = route.join(nodes.select("node_id", "x", "y"), "node_id", "left")
    return on.groupBy("route_id").agg(*(F.coalesce(f(c), F.lit(0.0)).alias(n) for n, f, c in (("south", F.min, "y"), ("north", F.max, "y"), ("west", F.min, "x"), ("east", F.max, "x"))))


def adjacent(route: DataFrame, edges: DataFrame) -> DataFrame:
    """Of every route (route_id, ord, node_id): its steps, those that no edge allows, and whether it is connected."""
    from pyspark.sql import Window

    w = Window.partitionBy("route_id").orderBy("ord")
    steps = route.withColumn("u", F.lag("node_id").over(w)).join(edges.select("u", F.col("v").alias("node_id"), F.lit(1).alias("ok")).distinct(), ["u", "node_id"], "left")
    return steps.groupBy("route_id").agg(F.count("u").alias("steps"), F.count_if(F.col("u").isNotNull() & F.col("ok").isNull()).alias("missing")).withColumn("connected", F.col("missing") == 0)


def route_statistics(route: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Network distance over the edges there are, gain, loss, net, heights and number of nodes of every route."""
    from pyspark.sql import Window

    w = Window.partitionBy("route_id").orderBy("ord")
    hop = edges.groupBy("u", "v").agg(F.min("length").alias("length"))
    on = route.join(nodes.select("node_id", "elevation"), "node_id")
    steps = on.withColumn("u", F.lag("node_id").over(w)).withColumn("rise", F.col("elevation") - F.lag("elevation").over(w)).withColumnRenamed("node_id", "v").join(hop, ["u", "v"], "left")
    up, down = F.sum(F.greatest(F.coalesce("rise", F.lit(0.0)), F.lit(0.0))), F.sum(F.greatest(-F.coalesce("rise", F.lit(0.0)), F.lit(0.0)))
    return steps.groupBy("route_id").agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"), up.alias("gain"), down.alias("loss"), (up - down).alias("net"), F.max("elevation").alias("high"), F.min("elevation").alias("low"), F.count(F.lit(1)).alias("n_nodes"))
