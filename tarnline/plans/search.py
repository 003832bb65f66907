"""Queries over route search, its control and event windows; importing this adds them to tarnline.plans.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnline.operators import generate as G
from tarnline.operators import network as N
from tarnline.operators import paths as P
from tarnline.operators import search as S
from tarnline.operators import tuning as T
from tarnline.operators.fitness import WEIGHTS
from tarnline.plans.control import _H, full_history
from tarnline.plans.queries import _SSSP, CUTOFF, LAT, LON, NET, NODE, PT, ROUTE, START, add, keeper
from tarnline.sources import roads
from tarnline.streaming import activity

TARGET_M, BEST = 5000.0, 30


@add("shortest_paths", _SSSP + ", p AS (SELECT * FROM sd) SELECT node_id, round(dist, 3) AS dist, 110::BIGINT AS first_node, node_id AS last_node FROM p")
def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    found = S.shortest_paths(roads.edges(spark, sf), START, CUTOFF, keeper(spark), roads.nodes(spark, sf))
    return found.select("node_id", F.round("dist", 3).alias("dist"), F.col("path")[0].alias("first_node"), F.element_at("path", -1).alias("last_node"))


@add("k_shortest_paths")
def k_shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty shortest paths from the start to each of five destinations drawn from those within 1.5 km; tested against brute force."""
    keep, edges = keeper(spark), roads.edges(spark, sf)
    drawn = N.shortest_distances(edges, START, 1500.0, keep, roads.nodes(spark, sf)).filter(F.col("node_id") != START).orderBy((F.col("node_id") * 7919) % 10007).limit(5)
    found = P.k_shortest_pairs(edges, drawn.select(F.lit(START).alias("src"), F.col("node_id").alias("dst")), BEST, keep, nodes=roads.nodes(spark, sf))
    return found.select("src", "dst", "rank", F.round("length", 3).alias("length"), F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


@add("out_and_back", _SSSP + ", near AS (SELECT * FROM sd WHERE dist BETWEEN 1575 AND 2925 ORDER BY abs(dist - 2250), node_id LIMIT 5) SELECT node_id, round(2 * dist, 3) AS total_m FROM near WHERE 2 * dist BETWEEN 4250 AND 5750 ORDER BY abs(dist - 2250), node_id LIMIT 1")
def out_and_back(spark: SparkSession, sf: str) -> DataFrame:
    paths = S.shortest_paths(roads.edges(spark, sf), START, CUTOFF, keeper(spark), roads.nodes(spark, sf))
    return S.out_and_back(paths, TARGET_M).select("node_id", F.round("total_m", 3).alias("total_m"))


@add("terrain_bins", f"WITH {NODE}, b AS (SELECT n.elevation - s.elevation AS gain FROM node n, (SELECT elevation FROM node WHERE node_id = {START}) s) SELECT CASE WHEN gain >= 100 THEN 'very_high' WHEN gain >= 30 THEN 'high' ELSE 'moderate' END AS category, count(*) AS n, round(avg(gain), 3) AS mean_gain FROM b WHERE gain >= 0 GROUP BY 1")
def terrain_bins(spark: SparkSession, sf: str) -> DataFrame:
    return S.terrain_bins(roads.nodes(spark, sf), START).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gain"), 3).alias("mean_gain"))


@add("unexplored_peaks", f"WITH {NODE}, {ROUTE} SELECT node_id, elevation FROM node WHERE elevation > (SELECT elevation FROM node WHERE node_id = {START}) + 40 AND node_id <> {START} AND node_id NOT IN (SELECT node_id FROM route) ORDER BY elevation DESC, node_id LIMIT 20")
def unexplored_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return S.unexplored_peaks(roads.nodes(spark, sf), roads.routes(spark, sf), START)


@add("highest_neighbours", NET + ", b AS (SELECT u, arg_max(v, (ve, -v)) AS neighbour, max(ve) - any_value(ue) AS rise FROM edge GROUP BY u) SELECT u AS node_id, neighbour, round(rise, 6) AS rise FROM b WHERE rise > 2")
def highest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    found = S.highest_neighbours(roads.nodes(spark, sf), roads.edges(spark, sf), 2.0)
    return found.select("node_id", "neighbour", F.round("rise", 6).alias("rise"))


_WALK = f"WITH {NODE}, {ROUTE}, w AS (SELECT route_id, list(node_id ORDER BY ord) AS nodes FROM route GROUP BY route_id)"


def _walks(spark: SparkSession, sf: str) -> DataFrame:
    rows = roads.routes(spark, sf).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id"))).alias("x"))
    return rows.select("route_id", F.col("x.node_id").alias("nodes"))


@add("path_splice", _WALK + ", s AS (SELECT a.route_id, a.nodes[1:len(a.nodes) // 2] || b.nodes[len(b.nodes) // 2 + 1:] AS nodes FROM w a JOIN w b ON b.route_id = a.route_id + 1) SELECT route_id, len(nodes) AS n, md5(array_to_string(nodes, ',')) AS digest FROM s")
def path_splice(spark: SparkSession, sf: str) -> DataFrame:
    w = _walks(spark, sf)
    both = w.join(w.select((F.col("route_id") - 1).alias("route_id"), F.col("nodes").alias("other")), "route_id")
    half = lambda c: F.floor(F.size(c) / 2).cast("int")
    spliced = both.select("route_id", S.splice(F.col("nodes"), F.col("other"), half("nodes"), half("other")).alias("nodes"))
    return spliced.select("route_id", F.size("nodes").cast("long").alias("n"), F.md5(F.array_join(F.col("nodes").cast("array<string>"), ",").cast("binary")).alias("digest"))


@add("loop_removal", _WALK + ", s AS (SELECT route_id, nodes, nodes[len(nodes) // 2] AS node FROM w), c AS (SELECT route_id, CASE WHEN node = nodes[1] THEN nodes ELSE nodes[1:list_position(nodes, node)] || nodes[len(nodes) + 2 - list_position(list_reverse(nodes), node):] END AS nodes FROM s) SELECT route_id, len(nodes) AS n, md5(array_to_string(nodes, ',')) AS digest FROM c")
def loop_removal(spark: SparkSession, sf: str) -> DataFrame:
    cut = _walks(spark, sf).select("route_id", S.without_loop(F.col("nodes"), F.floor(F.size("nodes") / 2).cast("int")).alias("nodes"))
    return cut.select("route_id", F.size("nodes").cast("long").alias("n"), F.md5(F.array_join(F.col("nodes").cast("array<string>"), ",").cast("binary")).alias("digest"))


@add("adaptive_rates", _H + ", ar AS (SELECT run, generation, 0.15::DOUBLE * CASE WHEN stale >= 10 THEN least(1.5::DOUBLE, 1 + (stale - 10) * 0.1::DOUBLE) ELSE 1 END * CASE WHEN diversity < 0.3::DOUBLE THEN 1 + (0.3::DOUBLE - diversity) * 1.8::DOUBLE ELSE 1 END * CASE WHEN stale >= 10 AND diversity < 0.3::DOUBLE THEN 2 ELSE 1 END * pow(0.95::DOUBLE, generation) AS rate FROM hh) SELECT run, generation, round(greatest(0.05, least(0.5, rate)), 6) AS rate FROM ar")
def adaptive_rates(spark: SparkSession, sf: str) -> DataFrame:
    """The mutation rate after every generation of every history."""
    own = full_history(spark, sf)
    return own.select("run", "generation", F.round(T.adaptive_rate(F.col("diversity"), F.col("stale"), F.pow(F.lit(0.95), F.col("generation"))), 6).alias("rate"))


_SIZES = "CASE WHEN km < 3 THEN 50 WHEN km > 20 THEN 33 WHEN km > 8 THEN 150 ELSE 100 END"


@add("adapted_sizes", PT + f", az AS (SELECT route_id, max(cum_m) / 1000 AS km FROM pt GROUP BY route_id), ap AS (SELECT route_id, {_SIZES} AS population, CASE WHEN km < 3 THEN 100 WHEN km > 20 THEN 100 WHEN km > 8 THEN 300 ELSE 200 END AS generations FROM az) SELECT *, greatest(5, population // 10) AS elite, greatest(3, population // 20) AS tournament FROM ap")
def adapted_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of a search for the length of every route."""
    km = roads.points(spark, sf).groupBy("route_id").agg((F.max("cum_m") / 1000).alias("km"))
    return km.select("route_id", *T.sizes_for(F.col("km")))


@add("random_trials", "WITH rg AS (SELECT CAST(min(l_quantity) AS BIGINT) AS pl, CAST(max(l_quantity) AS BIGINT) AS ph, min(l_discount) AS cl, max(l_discount) AS ch FROM lineitem), kd AS (SELECT list(event_type ORDER BY event_type) AS kinds FROM (SELECT DISTINCT event_type FROM events)), dr AS (SELECT s_suppkey AS id, (s_suppkey * 7919 + 104729 * 0) % 10007 / 10007.0::DOUBLE AS a, (s_suppkey * 7919 + 104729 * 1) % 10007 / 10007.0::DOUBLE AS b, (s_suppkey * 7919 + 104729 * 2) % 10007 / 10007.0::DOUBLE AS c FROM supplier), tl AS (SELECT id, pl + CAST(floor(a * (ph - pl + 1)) AS BIGINT) AS population, round(cl + b * (ch - cl), 9) AS crossover, kinds[1 + CAST(floor(c * len(kinds)) AS INT)] AS kind FROM dr, rg, kd) SELECT *, population * (1 - crossover) >= 10 AS meets FROM tl")
def random_trials(spark: SparkSession, sf: str) -> DataFrame:
    """A trial drawn for every supplier: a whole number, a number and a value from a list, from the ranges that occur; and whether it meets the constraint."""
    items, events = spark.read.parquet(f"{sf}/lineitem.parquet"), spark.read.parquet(f"{sf}/events.parquet")
    ranges = items.agg(F.struct(F.min("l_quantity").cast("long").alias("low"), F.max("l_quantity").cast("long").alias("high")).alias("population"), F.struct(F.min("l_discount").alias("low"), F.max("l_discount").alias("high")).alias("crossover"))
    kinds = events.agg(F.array_sort(F.collect_set("event_type")).alias("kind"))
    share = lambda k: (F.col("id") * 7919 + 104729 * k) % 10007 / 10007.0
    ids = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    met = ids.crossJoin(F.broadcast(ranges)).crossJoin(F.broadcast(kinds))  # one row each
    out = met.select("id", T.sampled(F.col("population"), share(0), "whole").alias("population"), F.round(T.sampled(F.col("crossover"), share(1), "number"), 9).alias("crossover"), T.sampled(F.col("kind"), share(2), "list").alias("kind"))
    return out.withColumn("meets", F.expr("population * (1 - crossover) >= 10"))


@add("population_stats", PT + ", k AS (SELECT route_id % 5 AS gen, route_id, max(cum_m) / 1000 AS km FROM pt GROUP BY route_id) SELECT gen, count(*) AS n, round(max(km), 6) AS best, round(avg(km), 6) AS mean, round(min(km), 6) AS worst, round(stddev_pop(km) / greatest(avg(km), 1), 6) AS diversity FROM k GROUP BY gen")
def population_stats(spark: SparkSession, sf: str) -> DataFrame:
    km = roads.points(spark, sf).groupBy("route_id").agg((F.max("cum_m") / 1000).alias("km"))
    v = F.col("km")
    return km.groupBy((F.col("route_id") % 5).alias("gen")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(v), 6).alias("best"), F.round(F.avg(v), 6).alias("mean"), F.round(F.min(v), 6).alias("worst"), F.round(F.stddev_pop(v) / F.greatest(F.avg(v), F.lit(1.0)), 6).alias("diversity"))


@add("parameter_sensitivity", "WITH t AS (SELECT event_type, event_id AS setting, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(coalesce(abs(corr(value, setting)), 0), 6) AS sensitivity, min(setting) FILTER (i <= greatest(1, n // 10)) AS low, max(setting) FILTER (i <= greatest(1, n // 10)) AS high FROM t GROUP BY event_type")
def parameter_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    trials = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.col("event_id").alias("setting"), "value")
    return T.sensitivity(trials, "event_type", "setting", "value")


@add("event_windows", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    found = activity.windows(spark.read.parquet(f"{sf}/events.parquet"))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


STRATEGIES = tuple(dict.fromkeys(name for mix in G.MIXES.values() for name, _ in mix)) + ("fallback",)


@add("initial_routes")
def initial_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Routes of 5 km from the start by every strategy, ten seeds each."""
    edges = N.without_footways(roads.nodes(spark, sf), roads.edges(spark, sf))[1]
    seeds = spark.range(10 * len(STRATEGIES)).select("id", F.lit(START).cast("long").alias("start"), F.lit(TARGET_M).alias("target_m"), F.element_at(F.array(*map(F.lit, STRATEGIES)), (F.col("id") % len(STRATEGIES) + 1).cast("int")).alias("strategy"), F.lit(42).alias("seed"))
    own = G.surroundings(roads.nodes(spark, sf), edges, LAT, LON, TARGET_M / 1000)
    return G.initial_routes(seeds, *own, keeper(spark))


@add("route_search")
def route_search(spark: SparkSession, sf: str) -> DataFrame:
    """Searches of 5 km from the start for every objective, with the sizes that follow from the distance."""
    edges = N.without_footways(roads.nodes(spark, sf), roads.edges(spark, sf))[1]
    asked = spark.createDataFrame([(i, START, TARGET_M / 1000, name, 42) for i, name in enumerate(WEIGHTS)], "id long, start long, target_km double, objective string, seed long")
    own = G.surroundings(roads.nodes(spark, sf), edges, LAT, LON, TARGET_M / 1000)
    return G.search(asked, *own, keeper(spark)).drop("history")
