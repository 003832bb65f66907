"""Street networks from stored map extracts (the JSON of the Overpass interpreter), and the preparation of networks for routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnline.functions.geo import haversine
from tarnline.operators import elevation as E
from tarnline.operators import network as N

ELEMENT = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"


def read_extract(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, x, y, elevation: null, highway) that ways use, and edges (u, v, key, length, highway, surface, access), one for every step of a way that both ends are known of, and one back unless the way is one-way."""
    found = spark.read.schema(ELEMENT).option("multiLine", "true").json(path).select(F.explode("elements").alias("e")).select("e.*")
    places = found.filter("type = 'node'").select(F.col("id").alias("node_id"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("tags")["highway"].alias("highway")).dropDuplicates(["node_id"])
    ways = found.filter("type = 'way'").select("id", "tags", F.posexplode("nodes").alias("i", "u"))
    steps = ways.withColumn("v", F.lead("u").over(Window.partitionBy("id").orderBy("i"))).filter("v is not null and u <> v")
    one_way = F.coalesce(F.col("tags")["oneway"].isin("yes", "true", "1"), F.lit(False))
    dealt = steps.withColumn("_d", F.explode(F.when(one_way, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    turned = lambda a, b: F.when(F.col("_d"), F.col(b)).otherwise(F.col(a))
    tag = lambda name: F.col("tags")[name].alias(name)
    own = dealt.select(turned("u", "v").alias("u"), turned("v", "u").alias("v"), "id", "i", tag("highway"), tag("surface"), tag("access"))
    at = lambda end: places.select(F.col("node_id").alias(end), F.col("x").alias(f"{end}x"), F.col("y").alias(f"{end}y"))
    met = own.join(at("u"), "u").join(at("v"), "v")
    key = F.row_number().over(Window.partitionBy("u", "v").orderBy("id", "i")) - 1
    edges = met.select("u", "v", key.alias("key"), haversine(F.col("uy"), F.col("ux"), F.col("vy"), F.col("vx")).alias("length"), "highway", "surface", "access")
    used = edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return places.join(used, "node_id", "left_semi").withColumn("elevation", F.lit(None).cast("double")), edges


def write_extract(nodes: DataFrame, edges: DataFrame, path: str, per_file: int = 50_000) -> None:
    """Writes a network as map extracts that read_extract reads: a file for every so many ids, with its nodes and one way for each edge that begins there; both ways of a street are two one-way ones."""
    tags = lambda *pairs: F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(v for _, v in pairs))), lambda _, v: v.isNotNull())
    kind = F.col("highway").cast("string") if "highway" in nodes.columns else F.lit(None).cast("string")
    places = nodes.select(F.floor(F.col("node_id") / per_file).alias("part"), F.struct(F.lit("node").alias("type"), F.col("node_id").alias("id"), F.col("y").alias("lat"), F.col("x").alias("lon"), F.lit(None).cast("array<bigint>").alias("nodes"), tags(("highway", kind)).alias("tags")).alias("e"))
    ways = edges.select(F.floor(F.col("u") / per_file).alias("part"), F.struct(F.lit("way").alias("type"), F.xxhash64("u", "v").alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.array("u", "v").alias("nodes"), tags(("highway", F.col("highway")), ("oneway", F.lit("yes"))).alias("tags")).alias("e"))
    files = places.unionByName(ways).groupBy("part").agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)


def prepared(nodes: DataFrame, edges: DataFrame, with_footways: bool = False) -> tuple[DataFrame, DataFrame]:
    """A network for running: allowed edges with both ends, rise, grade and running weight; nodes that edges use, with degree. Nodes need an elevation, edges highway, surface and access."""
    own = N.subgraph(nodes, N.runnable(edges, with_footways))
    weighted = N.running_weight(N.edge_elevation(own, nodes))
    used = own.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return N.degrees(nodes.join(used, "node_id", "left_semi"), own), weighted


def built(spark: SparkSession, extract: str, rasters: str, fallback: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A prepared network from an extract and a folder of rasters; what they don't cover comes from a fallback (node_id, elevation), or is 0."""
    from . import rasters as R

    nodes, edges = read_extract(spark, extract)
    other = fallback if fallback is not None else spark.createDataFrame([], "node_id long, elevation double")
    high = E.enriched(nodes.drop("elevation"), R.tile_index(spark, rasters), R.pixels(spark, rasters), other, 100.0)
    return prepared(high, edges)


def metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row on a stored network: nodes, edges, share of nodes with an elevation other than 0 in percent, total length."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.try_divide(F.count_if(F.col("elevation") != 0), F.count(F.lit(1))) * 100, F.lit(0.0)).alias("coverage"))
    return n.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"))))  # one row each
