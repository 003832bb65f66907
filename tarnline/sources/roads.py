"""Graph tables: schemas, storage, exports, and the road network that the TPC-like tables stand for.

A network is two frames, nodes (node_id, x, y, elevation) and edges (u, v, key, length, highway); a route is rows
(route_id, ord, node_id). The derivation from part and events is deterministic, so SQL can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tarnline.functions.geo import grade_percent, haversine

from . import versions

NODE = StructType([StructField("node_id", LongType()), StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("elevation", DoubleType())])
EDGE = StructType([StructField("u", LongType()), StructField("v", LongType()), StructField("key", IntegerType()), StructField("length", DoubleType()), StructField("highway", StringType())])
WIDTH = 20


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> int:
    """Writes a network as a new version of a folder and makes it current; its number. Readers of older versions keep them (see versions)."""
    return versions.write(nodes.sparkSession, path, {"nodes": nodes.select(NODE.names), "edges": edges.select(EDGE.names)})


def load_graph(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A stored network, the current version or one by number; a missing table or column raises. Two tables without versions are read as they are."""
    where = versions.folder(spark, path, version) or path
    return spark.read.schema(NODE).parquet(f"{where}/nodes"), spark.read.schema(EDGE).parquet(f"{where}/edges")


def graph_path(base: str, lat: float, lon: float, radius_m: int, kind: str = "all") -> str:
    """Where a network around a point is kept."""
    return f"{base}/network_type={kind}/radius_m={radius_m}/{lat:.4f}_{lon:.4f}"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    return part.select(k.alias("node_id"), (F.lit(7.3906) + (k % WIDTH) * F.lit(0.001)).alias("x"), (F.lit(46.2299) + F.floor(k / WIDTH) * F.lit(0.001)).alias("y"), (F.lit(580.0) + (F.col("p_retailprice") - 900.0) + F.col("p_size") * 0.5).alias("elevation"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid neighbours in both directions; lengths from 1 to 1.45 times the air line."""
    own = nodes(spark, sf_dir)
    a = F.col("node_id")
    around = F.array(F.when(a % WIDTH < WIDTH - 1, a + 1), F.when(a % WIDTH > 0, a - 1), a + WIDTH, a - WIDTH)
    pairs = own.select(a.alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.explode(F.array_compact(around)).alias("v"))
    joined = pairs.join(own.select(a.alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
    low, high = F.least("u", "v"), F.greatest("u", "v")
    length = F.round(haversine(F.col("uy"), F.col("ux"), F.col("vy"), F.col("vx")) * (F.lit(1.0) + ((low * 31 + high * 17) % 10) / F.lit(20.0)), 3)
    kind = F.element_at(F.array(*map(F.lit, ("footway", "primary", "path", "tertiary", "residential", "residential"))), ((low * 7 + high) % 6 + 1).cast("int"))
    return joined.select("u", "v", F.lit(0).alias("key"), length.alias("length"), kind.alias("highway"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One walk over the grid for every user of events."""
    size = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.floor(F.count(F.lit(1)) / WIDTH).alias("h"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = lambda plus, minus: F.sum(F.when(F.col("event_id") % 4 == plus, 1).when(F.col("event_id") % 4 == minus, -1).otherwise(0)).over(w)
    moved = events.select(F.col("user_id").alias("route_id"), F.row_number().over(w).alias("ord"), ((F.col("user_id") * 7) % 38 + 3800 + step(0, 1)).alias("c"), ((F.col("user_id") * 13) % 198 + 198000 + step(2, 3)).alias("r"))
    top = F.col("h") - 1
    column, row = F.lit(19) - F.abs(F.col("c") % 38 - 19), top - F.abs(F.col("r") % (2 * top) - top)
    return moved.crossJoin(F.broadcast(size)).select("route_id", "ord", (column + WIDTH * row).alias("node_id"))


def with_profile(route: DataFrame, own: DataFrame, order: str = "ord", closed: bool = False) -> DataFrame:
    """Route points with coordinates, metres from the point before (0 for the first), cumulative metres, rise and grade.

    Points whose node is unknown are left out. closed adds the way back to the first point.
    """
    placed = route.join(own, "node_id").select("route_id", order, "node_id", "x", "y", "elevation")
    if closed:
        back = placed.groupBy("route_id").agg(F.min_by(F.struct("node_id", "x", "y", "elevation"), order).alias("f"), (F.max(order) + 1).alias(order))
        placed = placed.unionByName(back.select("route_id", order, "f.node_id", "f.x", "f.y", "f.elevation"))
    w = Window.partitionBy("route_id").orderBy(order)
    before = lambda c: F.lag(c).over(w)
    d = F.coalesce(haversine(before("y"), before("x"), F.col("y"), F.col("x")), F.lit(0.0))
    out = placed.withColumn("d", d).withColumn("rise", F.coalesce(F.col("elevation") - before("elevation"), F.lit(0.0)))
    return out.withColumn("cum_m", F.sum("d").over(w)).withColumn("grade", grade_percent(F.col("rise"), F.col("d")))


def points(spark: SparkSession, sf_dir: str, closed: bool = False) -> DataFrame:
    return with_profile(routes(spark, sf_dir), nodes(spark, sf_dir), closed=closed)


def geojson(points_: DataFrame) -> DataFrame:
    """route_id and a GeoJSON feature collection of one line."""
    rows = points_.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("p"), F.round(F.max("cum_m"), 1).alias("m"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("m").alias("distance_m"), F.size("p").alias("total_nodes"), F.lit("circular").alias("route_type")).alias("properties"), F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda q: F.array(F.round(q["x"], 6), F.round(q["y"], 6))).alias("coordinates")).alias("geometry"))
    return rows.select("route_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("geojson"))


def gpx(points_: DataFrame, name: Column | None = None) -> DataFrame:
    """route_id and a GPX 1.1 track."""
    point = F.format_string('<trkpt lat="%.6f" lon="%.6f"><ele>%.1f</ele></trkpt>', "y", "x", "elevation")
    rows = points_.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("ord", point.alias("t")))).alias("p"))
    title = name if name is not None else F.concat(F.lit("route "), F.col("route_id").cast("string"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'), title, F.lit("</name><trkseg>"))
    return rows.select("route_id", F.concat(head, F.array_join(F.transform("p", lambda q: q["t"]), ""), F.lit("</trkseg></trk></gpx>")).alias("gpx"))
