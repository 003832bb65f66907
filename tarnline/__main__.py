"""Command line: route search, starting points, analysis and exports over stored networks."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnline.functions import svg, text
from tarnline.operators import control, generate, network, routes
from tarnline.operators.fitness import WEIGHTS
from tarnline.plans.queries import keeper
from tarnline.sources import roads


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tarnline", description=__doc__)
    out.add_argument("network", help="folder of a stored network (nodes and edges as Parquet)")
    sub = out.add_subparsers(dest="command", required=True)
    starts = sub.add_parser("starts", help="list starting points")
    starts.add_argument("--most", type=int, default=50)
    route = sub.add_parser("route", help="search a route and write it")
    route.add_argument("--start", type=int, help="start node; by default the intersection nearest to --lat and --lon")
    route.add_argument("--lat", type=float, default=0.0)
    route.add_argument("--lon", type=float, default=0.0)
    route.add_argument("--km", type=float, default=5.0)
    route.add_argument("--objective", choices=sorted(WEIGHTS), default="elevation")
    route.add_argument("--with-footways", action="store_true")
    route.add_argument("--seed", type=int, default=42)
    route.add_argument("--out", help="folder for the route as GeoJSON, GPX, texts and drawings")
    return out


def found_route(spark: SparkSession, nodes: DataFrame, edges: DataFrame, start: int, km: float, objective: str, with_footways: bool, seed: int) -> DataFrame:
    """The route of one request; wrong requests raise."""
    asked = spark.createDataFrame([(0, start, km, objective, seed)], "id long, start long, target_km double, objective string, seed long")
    wrong = control.checked(asked.select("id", "start", F.col("target_km").alias("km"), F.lit(None).cast("string").alias("objective"), F.lit("genetic").alias("algorithm")), nodes).first()
    if not wrong.valid:
        raise ValueError("; ".join(wrong.errors))
    own = edges if with_footways else network.without_footways(nodes, edges)[1]
    place = nodes.filter(F.col("node_id") == start).first()
    return generate.search(asked, *generate.surroundings(nodes, own, place.y, place.x, km), keeper(spark))


def profiled(found: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = found.filter("nodes is not null").select(F.col("id").alias("route_id"), F.posexplode("nodes").alias("i", "node_id")).select("route_id", (F.col("i") + 1).alias("ord"), "node_id")
    return roads.with_profile(rows, nodes)


def write(points: DataFrame, folder: str) -> None:
    """GeoJSON, GPX, drawing of the profile and the map, one row a route each."""
    for name, made in (("geojson", roads.geojson(points)), ("gpx", roads.gpx(points)), ("profile", svg.profiles(points)), ("map", svg.maps(points))):
        made.select(made.columns[1]).write.mode("overwrite").text(f"{folder}/{name}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a command; the lines that were printed."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tarnline").getOrCreate()
    nodes, edges = roads.load_graph(spark, args.network)
    if args.command == "starts":
        first = network.intersections(nodes, edges, args.most).select("node_id", "degree", "elevation").collect()
        lines = [f"{r.node_id}  degree {r.degree}  {r.elevation or 0:.0f} m" for r in first]
    else:
        start = args.start if args.start is not None else network.best_start(nodes, edges, args.lat, args.lon).first().node_id
        found = keeper(spark)(found_route(spark, nodes, edges, start, args.km, args.objective, args.with_footways, args.seed))
        points = profiled(found, nodes)
        stats = routes.profile_stats(points).join(routes.rating(points), "route_id")
        km = F.col("distance_m") / 1000
        told = stats.select(text.statistics(km, F.col("gain"), F.col("loss"), F.col("max_grade"), km / 8 * 60, F.col("n_points"), F.lit(args.objective)).alias("s"), "rating").collect()
        lines = [line for r in told for line in (*r.s.split("\n"), f"Difficulty:      {r.rating}")] or ["no route found"]
        if args.out and told:
            write(points, args.out)
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
