"""Queries over the derived road network and its routes, by name, and the same in DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnline.operators import network as N
from tarnline.operators import routes as R
from tarnline.sources import roads

LAT, LON, TARGET_KM, START, CUTOFF = 46.2340, 7.4000, 7.0, 110, 8000.0


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new name in the cluster's shared folder. A session on one machine (tests) that names none gets a folder of its own; a cluster that names none raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tarnline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def keeper(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes frames to the cluster's shared folder and reads them back."""

    def keep(df: DataFrame) -> DataFrame:
        path = shared_folder(spark, "paths")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}

_HAV = "12742000.0::DOUBLE * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return _HAV.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


NODE = """node AS (SELECT p_partkey AS node_id, 7.3906::DOUBLE + (p_partkey % 20) * 0.001::DOUBLE AS x, 46.2299::DOUBLE + (p_partkey // 20) * 0.001::DOUBLE AS y, 580.0::DOUBLE + (p_retailprice - 900.0::DOUBLE) + p_size * 0.5::DOUBLE AS elevation FROM part)"""
EDGE = f"""pair AS (SELECT a.node_id AS u, b.node_id AS v, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy, a.elevation AS ue, b.elevation AS ve, least(a.node_id, b.node_id) AS lo, greatest(a.node_id, b.node_id) AS hi FROM node a JOIN node b ON (b.node_id = a.node_id + 1 AND a.node_id % 20 < 19) OR (b.node_id = a.node_id - 1 AND a.node_id % 20 > 0) OR b.node_id = a.node_id + 20 OR b.node_id = a.node_id - 20),
edge AS (SELECT u, v, ue, ve, round({hav("uy", "ux", "vy", "vx")} * (1.0::DOUBLE + ((lo * 31 + hi * 17) % 10) / 20.0::DOUBLE), 3) AS length, CASE (lo * 7 + hi) % 6 WHEN 0 THEN 'footway' WHEN 1 THEN 'primary' WHEN 2 THEN 'path' WHEN 3 THEN 'tertiary' ELSE 'residential' END AS highway FROM pair)"""
ROUTE = """size AS (SELECT count(*) // 20 AS h FROM part),
moved AS (SELECT user_id AS route_id, row_number() OVER w AS ord, (user_id * 7) % 38 + 3800 + sum(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) OVER w AS c, (user_id * 13) % 198 + 198000 + sum(CASE event_id % 4 WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END) OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
route AS (SELECT route_id, ord, CAST((19 - abs(c % 38 - 19)) + 20 * ((h - 1) - abs(r % (2 * (h - 1)) - (h - 1))) AS BIGINT) AS node_id FROM moved, size)"""
POINT = f"""placed AS (SELECT route_id, ord, node_id, x, y, elevation, lag(x) OVER w AS bx, lag(y) OVER w AS byy, lag(elevation) OVER w AS be, lag(node_id) OVER w AS u FROM route JOIN node USING (node_id) WINDOW w AS (PARTITION BY route_id ORDER BY ord)),
stepped AS (SELECT *, coalesce({hav("byy", "bx", "y", "x")}, 0) AS d, coalesce(elevation - be, 0) AS rise FROM placed),
pt AS (SELECT *, sum(d) OVER (PARTITION BY route_id ORDER BY ord) AS cum_m, CASE WHEN d > 0 THEN rise / d * 100 ELSE 0 END AS grade FROM stepped)"""
PT = f"WITH {NODE}, {ROUTE}, {POINT}"
NET = f"WITH {NODE}, {EDGE}"
ALL = f"WITH {NODE}, {EDGE}, {ROUTE}, {POINT}"
W = "(PARTITION BY route_id ORDER BY ord)"
GAIN, LOSS = "sum(greatest(rise, 0))", "sum(greatest(-rise, 0))"
SEG_DIR = f"""seg AS (SELECT route_id, ord, u, node_id AS v, rise, d, ['N','NE','E','SE','S','SW','W','NW'][CAST(round_even(((degrees(atan2(sin(radians(x - bx)) * cos(radians(y)), cos(radians(byy)) * sin(radians(y)) - sin(radians(byy)) * cos(radians(y)) * cos(radians(x - bx)))) + 360) % 360) / 45, 0) AS INT) % 8 + 1] AS direction FROM pt WHERE u IS NOT NULL)"""


def add(name: str, sql: str | None = None) -> Callable[[Q], Q]:
    def put(f: Q) -> Q:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def over_points(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, PT + sql)(lambda spark, sf: make(roads.points(spark, sf)))


over_points("route_profile_stats", R.profile_stats, f" SELECT route_id, count(*) AS n_points, round(max(cum_m), 3) AS distance_m, min(elevation) AS min_elevation, max(elevation) AS max_elevation, round(avg(elevation), 3) AS avg_elevation, round({GAIN}, 3) AS gain, round({LOSS}, 3) AS loss, round(max(grade) FILTER (d > 0), 3) AS max_grade, round(min(grade) FILTER (d > 0), 3) AS min_grade, round(avg(grade) FILTER (d > 0), 3) AS avg_grade, count(*) FILTER (d > 0 AND abs(grade) > 8) AS n_steep FROM pt GROUP BY route_id")
over_points("route_spatial_stats", R.spatial_stats, f" SELECT route_id, round(stddev_samp(elevation), 3) AS std_elevation, round(median(elevation), 3) AS median_elevation, round({GAIN} - {LOSS}, 3) AS net, count(*) FILTER (grade > 2) AS uphill, count(*) FILTER (grade < -2) AS downhill, count(*) FILTER (abs(grade) <= 2) AS level, count(*) FILTER (grade > 8) AS steep_up, count(*) FILTER (grade < -8) AS steep_down FROM pt GROUP BY route_id")
over_points("route_zones", R.zones, f", z AS (SELECT *, least(5, count(*) OVER (PARTITION BY route_id)) AS k, count(*) OVER (PARTITION BY route_id) AS n, coalesce(lead(cum_m) OVER {W}, cum_m) AS next_m FROM pt) SELECT route_id, CAST(least((ord - 1) // (n // k), k - 1) + 1 AS BIGINT) AS zone, count(*) AS n_points, round(min(cum_m), 3) AS start_m, round(max(next_m), 3) AS end_m, min(elevation) AS min_elevation, max(elevation) AS max_elevation, round(avg(elevation), 3) AS avg_elevation FROM z GROUP BY ALL")
over_points("route_peaks", R.extremes, f", n AS (SELECT *, lead(elevation) OVER {W} AS ne FROM pt), s AS (SELECT *, least(elevation - be, elevation - ne) AS up, least(be - elevation, ne - elevation) AS down FROM n WHERE be IS NOT NULL AND ne IS NOT NULL) SELECT route_id, ord, node_id, CASE WHEN up >= 10 THEN 'peak' ELSE 'valley' END AS kind, round(greatest(up, down), 3) AS prominence FROM s WHERE up >= 10 OR down >= 10")
over_points("route_climbs", R.climbs, f", i AS (SELECT *, sum(CASE WHEN rise > 0 THEN 0 ELSE 1 END) OVER {W} AS island FROM pt), c AS (SELECT route_id, island, min(ord) - 1 AS start_ord, max(ord) AS end_ord, sum(rise) AS g, sum(d) AS m FROM i WHERE rise > 0 GROUP BY ALL) SELECT route_id, start_ord, end_ord, round(g, 3) AS gain, round(m, 3) AS length_m, round(CASE WHEN m > 0 THEN g / m * 100 ELSE 0 END, 3) AS avg_grade FROM c WHERE g >= 20")
over_points("route_terrain", R.terrain_distribution, ", t AS (SELECT route_id, CASE WHEN grade > 15 THEN 'very_steep_uphill' WHEN grade > 8 THEN 'steep_uphill' WHEN grade > 2 THEN 'uphill' WHEN grade > -2 THEN 'level' WHEN grade > -8 THEN 'downhill' WHEN grade > -15 THEN 'steep_downhill' ELSE 'very_steep_downhill' END AS terrain, count(*) AS n FROM pt GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY route_id) * 100, 3) AS percent FROM t")
over_points("rolling_elevation", R.rolling_elevation, " SELECT route_id, ord, round(avg(elevation) OVER (PARTITION BY route_id ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 3) AS smooth FROM pt")
over_points("steep_sections", R.steep_sections, ", s AS (SELECT *, CASE WHEN grade > 8 THEN 'uphill' WHEN grade < -8 THEN 'downhill' END AS kind FROM pt), i AS (SELECT *, ord - row_number() OVER (PARTITION BY route_id, kind ORDER BY ord) AS island FROM s WHERE kind IS NOT NULL) SELECT route_id, kind, min(ord) AS start_ord, max(ord) AS end_ord, round(max(abs(grade)), 3) AS max_grade, round(avg(abs(grade)), 3) AS avg_grade, round(sum(d), 3) AS length_m FROM i GROUP BY route_id, kind, island")
over_points("densify_profile", lambda p: R.densify(p).groupBy("route_id").agg(F.count(F.lit(1)).alias("n_points"), R.r(F.avg("elevation")).alias("avg_elevation"), R.r(F.max("cum_m")).alias("end_m")), f", s AS (SELECT *, CASE WHEN t <= 2000 THEN 1.0::DOUBLE WHEN t <= 5000 THEN 2.0::DOUBLE WHEN t <= 10000 THEN 5.0::DOUBLE ELSE 10.0::DOUBLE END AS spacing FROM (SELECT *, max(cum_m) OVER (PARTITION BY route_id) AS t, lead(cum_m) OVER {W} AS nm, lead(elevation) OVER {W} AS ne FROM pt)), k AS (SELECT *, CASE WHEN nm - cum_m > 2 * spacing THEN CAST(floor((nm - cum_m) / spacing) AS BIGINT) ELSE 1 END AS n FROM s), e AS (SELECT *, unnest(range(n)) AS j FROM k) SELECT route_id, count(*) AS n_points, round(avg(coalesce(elevation + (ne - elevation) * (j / n), elevation)), 3) AS avg_elevation, round(max(coalesce(cum_m + (nm - cum_m) * (j / n), cum_m)), 3) AS end_m FROM e GROUP BY route_id")
over_points("difficulty_score", R.difficulty, f", o AS (SELECT route_id, {GAIN} AS g, {LOSS} AS l, max(abs(grade)) AS m, max(cum_m) / 1000 AS km FROM pt GROUP BY route_id), s AS (SELECT *, CASE WHEN km > 0 THEN least(m / 15 * 30, 30) + least(g / km / 50 * 40, 40) + least(l / km / 50 * 20, 20) + least((g + l) / km / 100 * 10, 10) ELSE 0 END AS score FROM o) SELECT route_id, round(score, 3) AS score, CASE WHEN km <= 0 THEN 'flat' WHEN score < 20 THEN 'easy' WHEN score < 40 THEN 'moderate' WHEN score < 60 THEN 'hard' WHEN score < 80 THEN 'very_hard' ELSE 'extreme' END AS rating FROM s")
_CYC = f", c AS (SELECT route_id, {hav('y', 'x', 'ny', 'nx')} AS m, ne - elevation AS up FROM (SELECT *, coalesce(lead(x) OVER {W}, first_value(x) OVER {W}) AS nx, coalesce(lead(y) OVER {W}, first_value(y) OVER {W}) AS ny, coalesce(lead(elevation) OVER {W}, first_value(elevation) OVER {W}) AS ne FROM pt)), g AS (SELECT *, CASE WHEN m > 0 THEN up / m * 100 END AS g FROM c), cyc AS (SELECT route_id, count(*) AS segments, count(*) FILTER (g > 2) AS uphill, count(*) FILTER (g < -2) AS downhill, count(*) FILTER (abs(g) <= 2) AS level, round(greatest(max(g), 0), 3) AS steepest_uphill, round(least(min(g), 0), 3) AS steepest_downhill, round(count(*) FILTER (g > 2) / count(*) * 100, 3) AS uphill_percent FROM g GROUP BY route_id)"
over_points("route_segment_stats", R.cyclic_stats, _CYC + " SELECT * FROM cyc")
over_points("difficulty_rating", R.rating, _CYC + f", o AS (SELECT route_id, max(cum_m) / 1000 AS km, {GAIN} AS g FROM pt GROUP BY route_id), s AS (SELECT route_id, CAST(CASE WHEN km > 10 THEN 25 WHEN km > 5 THEN 15 WHEN km > 2 THEN 5 ELSE 0 END + CASE WHEN g / km > 100 THEN 30 WHEN g / km > 50 THEN 20 WHEN g / km > 20 THEN 10 ELSE 0 END + CASE WHEN uphill_percent > 50 THEN 25 WHEN uphill_percent > 30 THEN 15 WHEN uphill_percent > 15 THEN 5 ELSE 0 END + CASE WHEN greatest(steepest_uphill, -steepest_downhill) > 15 THEN 20 WHEN greatest(steepest_uphill, -steepest_downhill) > 10 THEN 15 WHEN greatest(steepest_uphill, -steepest_downhill) > 5 THEN 5 ELSE 0 END AS INT) AS score FROM o JOIN cyc USING (route_id)) SELECT route_id, score, CASE WHEN score >= 70 THEN 'very_hard' WHEN score >= 50 THEN 'hard' WHEN score >= 30 THEN 'moderate' WHEN score >= 15 THEN 'easy' ELSE 'very_easy' END AS rating FROM s")
over_points("route_directions", R.directions, " SELECT route_id, ord AS step, CASE WHEN ord = 1 THEN 'start' WHEN ord = max(ord) OVER (PARTITION BY route_id) THEN 'finish' ELSE 'continue' END AS type, CASE WHEN rise > 5 THEN 'uphill' WHEN rise < -5 THEN 'downhill' ELSE 'level' END AS terrain, round(rise, 3) AS elevation_change, round(d / 1000, 5) AS distance_km, round(cum_m / 1000, 5) AS cumulative_km FROM pt")
over_points("terrain_kind", R.terrain_kind, f", m AS (SELECT *, lead(elevation) OVER {W} AS ne FROM pt), o AS (SELECT route_id, stddev_pop(elevation) AS s, count(*) FILTER (elevation > be AND elevation > ne AND elevation - least(be, ne) > 5) AS n_peaks, count(*) FILTER (elevation < be AND elevation < ne AND greatest(be, ne) - elevation > 5) AS n_valleys FROM m GROUP BY route_id) SELECT route_id, CASE WHEN s < 5 THEN 'flat' WHEN s < 15 THEN 'rolling' WHEN s < 30 THEN 'hilly' ELSE 'mountainous' END AS terrain_type, round(s, 3) AS std_elevation, n_peaks, n_valleys FROM o")
over_points("micro_terrain", R.micro_terrain, f", m AS (SELECT *, lead(elevation) OVER {W} AS ne, CASE WHEN ord > 2 THEN abs(grade / 100 - lag(grade / 100) OVER {W}) END AS ch FROM pt) SELECT route_id, count(*) FILTER (elevation > be AND elevation > ne AND elevation - least(be, ne) >= 2) AS peaks, count(*) FILTER (elevation < be AND elevation < ne AND greatest(be, ne) - elevation >= 2) AS valleys, count(*) FILTER (abs(grade / 100) >= 0.03) AS steep_steps, count(*) FILTER (ch >= 0.03) AS grade_changes FROM m GROUP BY route_id")
_FIT = f"o AS (SELECT route_id, max(cum_m) / 1000 AS km, {GAIN} AS g, max(abs(grade)) AS m, count(DISTINCT node_id) AS nodes FROM pt GROUP BY route_id), ue AS (SELECT route_id, greatest(0, 1 - sum(n - 1) / sum(n)) AS loops FROM (SELECT route_id, count(*) AS n FROM pt WHERE u IS NOT NULL GROUP BY route_id, least(u, node_id), greatest(u, node_id)) GROUP BY route_id), fit AS (SELECT route_id, round(CASE WHEN km <= 0 THEN 0 WHEN abs(km - 7.0::DOUBLE) > 1.05::DOUBLE THEN 0.01::DOUBLE WHEN abs(km - 7.0::DOUBLE) <= 0.7::DOUBLE THEN 1 - abs(km - 7.0::DOUBLE) / 0.7::DOUBLE * 0.1::DOUBLE ELSE greatest(0, 0.9::DOUBLE - least(0.8::DOUBLE, (abs(km - 7.0::DOUBLE) - 0.7::DOUBLE) / 7.0::DOUBLE * 3)) END, 6) AS distance_score, round(CASE WHEN g <= 0 THEN 0 ELSE greatest(0, ln(1 + g / 10) / ln(501.0::DOUBLE) - CASE WHEN m > 15 THEN least(0.3::DOUBLE, (m - 15) / 100) ELSE 0 END) END, 6) AS elevation_score, round((CASE WHEN nodes <= 1 THEN 0 ELSE least(1.0::DOUBLE, nodes / 20) END + coalesce(loops, 1)) / 2, 6) AS diversity_score FROM o LEFT JOIN ue USING (route_id))"
over_points("fitness_terms", lambda p: R.fitness_terms(p, TARGET_KM), f", {_FIT} SELECT * FROM fit")
over_points("survivors", lambda p: R.survivors(R.fitness_terms(p, TARGET_KM).withColumn("gen", F.col("route_id") % 5), "distance_score"), f", {_FIT}, s AS (SELECT route_id, route_id % 5 AS gen, distance_score, distance_score >= 0.1 AS ok FROM fit), k AS (SELECT *, max(ok) OVER (PARTITION BY gen) AS hit, count(*) FILTER (ok) OVER (PARTITION BY gen) AS n, row_number() OVER (PARTITION BY gen ORDER BY ok DESC, distance_score DESC, route_id) AS rank FROM s) SELECT gen, route_id, rank FROM k WHERE CASE WHEN hit THEN ok AND rank <= greatest(1, floor(n * 0.8::DOUBLE)) ELSE rank = 1 END")
over_points("elevation_trend", lambda p: R.fitness_trend(p.select("route_id", "ord", F.col("elevation").alias("value"))), " SELECT route_id, ord, round(CASE WHEN count(*) OVER w < 3 THEN 0 ELSE regr_slope(elevation, ord) OVER w END, 6) + 0.0::DOUBLE AS slope FROM pt WINDOW w AS (PARTITION BY route_id ORDER BY ord ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
over_points("direction_diversity", lambda p: R.direction_diversity(R.steps(p)), f", {SEG_DIR}, b AS (SELECT *, lead(direction) OVER {W} = map(['N','NE','E','SE','S','SW','W','NW'], ['S','SW','W','NW','N','NE','E','SE'])[direction] AS back FROM seg) SELECT route_id, round(greatest(0, count(DISTINCT direction) / 8 - 0.1::DOUBLE * count(*) FILTER (back)), 6) AS diversity FROM b GROUP BY route_id")
over_points("edge_usage", lambda p: R.edge_usage(R.steps(p)), ", g AS (SELECT route_id, count(*) FILTER (u < node_id) AS f, count(*) FILTER (u >= node_id) AS w FROM pt WHERE u IS NOT NULL GROUP BY route_id, least(u, node_id), greatest(u, node_id)) SELECT route_id, count(*) AS unique_edges, count(*) FILTER (f > 0 AND w > 0) AS bidirectional_edges, round((count(*) - count(*) FILTER (f > 0 AND w > 0)) / greatest(count(*), 1), 6) AS efficiency, max(greatest(f, w)) <= 1 AS is_valid FROM g GROUP BY route_id")


@add("route_loop", f"WITH {NODE}, {ROUTE}, looped AS (SELECT * FROM route UNION ALL SELECT route_id, max(ord) + 1, min_by(node_id, ord) FROM route GROUP BY route_id), {POINT.replace('FROM route JOIN', 'FROM looped JOIN')} SELECT route_id, count(*) AS n_points, round(max(cum_m), 3) AS distance_m, round({GAIN}, 3) AS gain, round({LOSS}, 3) AS loss FROM pt GROUP BY route_id")
def route_loop(spark: SparkSession, sf: str) -> DataFrame:
    return roads.points(spark, sf, closed=True).groupBy("route_id").agg(F.count(F.lit(1)).alias("n_points"), R.r(F.max("cum_m")).alias("distance_m"), R.r(R.gain()).alias("gain"), R.r(R.loss()).alias("loss"))


@add("segment_metrics", ALL + f", j AS (SELECT p.route_id, e.length, p.rise, CASE WHEN e.length > 0 THEN abs(p.rise) / e.length * 100 END AS g FROM pt p LEFT JOIN edge e ON e.u = p.u AND e.v = p.node_id WHERE p.u IS NOT NULL) SELECT route_id, round(sum(length), 3) AS length, round({GAIN}, 3) AS gain, round({LOSS}, 3) AS loss, round(max(g), 3) AS max_grade, round(avg(g), 3) AS avg_grade, count(*) FILTER (g > 8) AS steep_sections, bool_and(length IS NOT NULL) AS is_valid FROM j GROUP BY route_id")
def segment_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return R.segment_metrics(R.steps(roads.points(spark, sf)), roads.edges(spark, sf))


_ELEV = ", el AS (SELECT u, v, length, highway, ve - ue AS gain, CASE WHEN length > 0 THEN abs(ve - ue) / length * 100 ELSE 0 END AS grade FROM edge)"


@add("edge_elevation", NET + _ELEV + " SELECT u, v, round(gain, 6) AS elevation_gain, round(greatest(0, -gain), 6) AS elevation_loss, round(greatest(0, gain), 6) AS elevation_climb, round(grade, 6) AS grade FROM el")
def edge_elevation(spark: SparkSession, sf: str) -> DataFrame:
    out = N.edge_elevation(roads.edges(spark, sf), roads.nodes(spark, sf))
    return out.select("u", "v", *(F.round(c, 6).alias(c) for c in ("elevation_gain", "elevation_loss", "elevation_climb", "grade")))


@add("running_weight", NET + _ELEV + " SELECT u, v, round(length + CASE WHEN gain > 0 THEN gain * 0.1::DOUBLE ELSE 0 END + CASE WHEN grade > 5 THEN length * (grade / 100) * 2.0::DOUBLE ELSE 0 END, 6) AS running_weight FROM el")
def running_weight(spark: SparkSession, sf: str) -> DataFrame:
    out = N.running_weight(N.edge_elevation(roads.edges(spark, sf), roads.nodes(spark, sf)))
    return out.select("u", "v", F.round("running_weight", 6).alias("running_weight"))


@add("routing_weight", NET + _ELEV + " SELECT u, v, round(length * CASE WHEN grade / 100 > 0.05 THEN 1.2::DOUBLE + (grade / 100 - 0.05::DOUBLE) * 2 ELSE 1 END * CASE highway WHEN 'path' THEN 0.8::DOUBLE WHEN 'residential' THEN 0.9::DOUBLE WHEN 'tertiary' THEN 1.1::DOUBLE WHEN 'primary' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS running_weight, round(length * (1 + grade / 100 * 0.5::DOUBLE), 6) AS elevation_weight FROM el")
def routing_weight(spark: SparkSession, sf: str) -> DataFrame:
    own = N.edge_elevation(roads.edges(spark, sf), roads.nodes(spark, sf)).withColumn("grade_frac", F.col("grade") / 100)
    return N.routing_weight(own).select("u", "v", F.round("running_weight", 6).alias("running_weight"), F.round("elevation_weight", 6).alias("elevation_weight"))


@add("footway_filter", NET + ", k AS (SELECT u, v FROM edge WHERE highway <> 'footway') SELECT node_id, (SELECT count(*) FROM k) AS n_edges FROM node WHERE node_id IN (SELECT u FROM k UNION SELECT v FROM k)")
def footway_filter(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = N.without_footways(roads.nodes(spark, sf), roads.edges(spark, sf))
    return nodes.select("node_id").crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("n_edges"))))  # one row


@add("nearest_nodes", f"WITH {NODE}, k AS (SELECT node_id, {hav('46.2340::DOUBLE', '7.4000::DOUBLE', 'y', 'x')} AS m FROM node) SELECT node_id, round(m, 3) AS dist_m FROM k WHERE m <= 2000 ORDER BY m, node_id LIMIT 50")
def nearest_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return N.nearest(roads.nodes(spark, sf), LAT, LON).select("node_id", F.round("dist_m", 3).alias("dist_m"))


_DEG = ", dg AS (SELECT node_id, x, y, coalesce(n, 0) AS degree FROM node LEFT JOIN (SELECT u, count(*) AS n FROM edge GROUP BY u) ON u = node_id)"


@add("nodes_within_distance", NET + _DEG + f" SELECT node_id, degree FROM dg WHERE (degree <> 2 OR node_id = {START}) AND {hav('46.2340::DOUBLE', '7.4000::DOUBLE', 'y', 'x')} <= 1500")
def nodes_within_distance(spark: SparkSession, sf: str) -> DataFrame:
    return N.nodes_within(roads.nodes(spark, sf), roads.edges(spark, sf), LAT, LON, 1.5, START).select("node_id", "degree")


@add("intersections", NET + _DEG + " SELECT node_id, degree FROM dg WHERE degree <> 2")
def intersections(spark: SparkSession, sf: str) -> DataFrame:
    return N.degrees(roads.nodes(spark, sf), roads.edges(spark, sf)).filter("degree <> 2").select("node_id", "degree")


@add("connectivity", NET + _DEG + ", a AS (SELECT count(*) AS total_nodes, count(*) FILTER (degree > 2) AS intersection_count, count(*) FILTER (degree = 1) AS dead_end_count, min(degree) AS min_degree, max(degree) AS max_degree, round(avg(degree), 6) AS avg_degree, round(stddev_samp(degree), 6) AS std_degree, min(y) AS south, max(y) AS north, min(x) AS west, max(x) AS east FROM dg), b AS (SELECT count(*) AS total_edges, min(length) AS min_length, max(length) AS max_length, round(avg(length), 4) AS avg_length, round(sum(length), 2) AS sum_length FROM edge) SELECT *, round(total_edges / total_nodes, 6) AS edge_node_ratio FROM a, b")
def connectivity(spark: SparkSession, sf: str) -> DataFrame:
    return N.connectivity(roads.nodes(spark, sf), roads.edges(spark, sf))


@add("bbox_nodes", f"WITH {NODE} SELECT node_id, elevation FROM node WHERE y BETWEEN 46.2315::DOUBLE AND 46.2365::DOUBLE AND x BETWEEN 7.3935::DOUBLE AND 7.4035::DOUBLE")
def bbox_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return roads.nodes(spark, sf).filter(F.col("y").between(46.2315, 46.2365) & F.col("x").between(7.3935, 7.4035)).select("node_id", "elevation")


@add("tile_lookup", f"WITH {NODE}, cells AS (SELECT DISTINCT res, floor((x - 7.39::DOUBLE) / (0.007::DOUBLE * res))::BIGINT AS i, floor((y - 46.229::DOUBLE) / (0.007::DOUBLE * res))::BIGINT AS j FROM node, (VALUES (1), (3)) r(res)), tile AS (SELECT printf('t%d_%d_%d', res, i, j) AS tile_path, res AS resolution, 7.39::DOUBLE + i * 0.007::DOUBLE * res AS west, 7.39::DOUBLE + (i + 1) * 0.007::DOUBLE * res AS east, 46.229::DOUBLE + j * 0.007::DOUBLE * res AS south, 46.229::DOUBLE + (j + 1) * 0.007::DOUBLE * res AS north FROM cells) SELECT node_id, min_by(tile_path, (resolution, tile_path)) AS tile_path, min(resolution) AS resolution FROM node JOIN tile ON x BETWEEN west AND east AND y BETWEEN south AND north GROUP BY node_id")
def tile_lookup(spark: SparkSession, sf: str) -> DataFrame:
    own = roads.nodes(spark, sf)
    cell = lambda c, base: F.floor((F.col(c) - base) / (F.lit(0.007) * F.col("resolution")))
    at = own.withColumn("resolution", F.explode(F.array(F.lit(1), F.lit(3)))).select("resolution", cell("x", 7.39).alias("i"), cell("y", 46.229).alias("j")).distinct()
    box = lambda base, k: F.lit(base) + k * F.lit(0.007) * F.col("resolution")
    tiles = at.select(F.format_string("t%d_%d_%d", "resolution", "i", "j").alias("tile_path"), "resolution", box(7.39, F.col("i")).alias("west"), box(7.39, F.col("i") + 1).alias("east"), box(46.229, F.col("j")).alias("south"), box(46.229, F.col("j") + 1).alias("north"))
    return N.covering_tile(own, tiles)


@add("hybrid_elevation", f"WITH {NODE}, h AS (SELECT node_id, CASE WHEN node_id % 7 = 0 THEN NULL WHEN node_id % 13 = 0 THEN 0 ELSE elevation END AS a, CASE WHEN node_id % 11 = 0 THEN NULL ELSE elevation + 3 END AS b FROM node) SELECT node_id, coalesce(nullif(a, 0), b, 0) AS elevation, CASE WHEN nullif(a, 0) IS NOT NULL THEN 'primary' WHEN b IS NOT NULL THEN 'fallback' ELSE 'none' END AS source FROM h")
def hybrid_elevation(spark: SparkSession, sf: str) -> DataFrame:
    own, k = roads.nodes(spark, sf), F.col("node_id")
    first = own.select("node_id", F.when(k % 7 == 0, None).when(k % 13 == 0, 0.0).otherwise(F.col("elevation")).alias("elevation"))
    second = own.select("node_id", F.when(k % 11 != 0, F.col("elevation") + 3).alias("elevation"))
    return N.hybrid_elevation(own.select("node_id"), [("primary", first), ("fallback", second)])


@add("elevation_sources", f"WITH t AS ({ORACLES['hybrid_elevation']}) SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 3) AS percent FROM t GROUP BY source")
def elevation_sources(spark: SparkSession, sf: str) -> DataFrame:
    counted = hybrid_elevation(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("source", "n", F.round(F.col("n") / F.col("total") * 100, 3).alias("percent"))  # one row


@add("elevation_compare", f"WITH {NODE}, t AS (SELECT abs(elevation - CASE WHEN node_id % 3 = 0 THEN elevation ELSE elevation + node_id % 5 END) AS d FROM node) SELECT count(*) FILTER (d = 0) AS identical, round(avg(d) FILTER (d <> 0), 6) AS mean_diff, round(max(d) FILTER (d <> 0), 6) AS max_diff, round(min(d) FILTER (d <> 0), 6) AS min_diff FROM t")
def elevation_compare(spark: SparkSession, sf: str) -> DataFrame:
    a, k = roads.nodes(spark, sf), F.col("node_id")
    b = a.select("node_id", F.when(k % 3 == 0, F.col("elevation")).otherwise(F.col("elevation") + k % 5).alias("other"))
    d = F.abs(F.col("elevation") - F.col("other"))
    differing = F.when(d != 0, d)
    return a.join(b, "node_id").agg(F.count_if(d == 0).alias("identical"), F.round(F.avg(differing), 6).alias("mean_diff"), F.round(F.max(differing), 6).alias("max_diff"), F.round(F.min(differing), 6).alias("min_diff"))


_JAC = f"WITH {NODE}, {ROUTE}, own AS (SELECT route_id, route_id // 50 AS gen, list(DISTINCT node_id) AS s FROM route GROUP BY route_id), jac AS (SELECT x.route_id AS a, y.route_id AS b, round(1 - len(list_intersect(x.s, y.s)) / len(list_distinct(x.s || y.s)), 6) AS distance FROM own x JOIN own y ON y.gen = x.gen AND x.route_id < y.route_id)"


@add("jaccard_pairs", _JAC + " SELECT * FROM jac")
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return R.jaccard_pairs(roads.routes(spark, sf))


@add("hamming_next", f"WITH {NODE}, {ROUTE}, n AS (SELECT route_id, count(*) AS n FROM route GROUP BY route_id), s AS (SELECT p.route_id, count(*) AS k FROM route p JOIN route q ON q.route_id = p.route_id + 1 AND q.ord = p.ord AND q.node_id = p.node_id GROUP BY p.route_id) SELECT x.route_id, greatest(x.n, y.n) - coalesce(k, 0) AS hamming FROM n x JOIN n y ON y.route_id = x.route_id + 1 LEFT JOIN s ON s.route_id = x.route_id")
def hamming_next(spark: SparkSession, sf: str) -> DataFrame:
    return R.hamming_to_next(roads.routes(spark, sf))


_SSSP = NET.replace("WITH ", "WITH RECURSIVE ", 1).replace("edge AS (", "edge AS MATERIALIZED (") + f", sd(node_id, dist) USING KEY (node_id) AS (SELECT {START}::BIGINT, 0.0::DOUBLE UNION (SELECT e.v, min(sd.dist + e.length) FROM sd JOIN edge e ON e.u = sd.node_id LEFT JOIN recurring.sd k ON k.node_id = e.v WHERE sd.dist + e.length <= {CUTOFF} AND sd.dist + e.length < coalesce(k.dist, 1e18) GROUP BY e.v))"


@add("shortest_distances", _SSSP + " SELECT node_id, round(dist, 3) AS dist FROM sd")
def shortest_distances(spark: SparkSession, sf: str) -> DataFrame:
    return N.shortest_distances(roads.edges(spark, sf), START, CUTOFF, keeper(spark), roads.nodes(spark, sf)).select("node_id", F.round("dist", 3).alias("dist"))


@add("distance_band", _SSSP + " SELECT node_id, round(dist, 3) AS dist FROM sd WHERE dist BETWEEN 700 AND 1300 ORDER BY abs(dist - 1000), node_id LIMIT 20")
def distance_band(spark: SparkSession, sf: str) -> DataFrame:
    found = N.shortest_distances(roads.edges(spark, sf), START, CUTOFF, keeper(spark), roads.nodes(spark, sf))
    return N.distance_band(found, 1000.0).select("node_id", F.round("dist", 3).alias("dist"))


@add("node_neighbours", NET + " SELECT u AS node_id, count(*) AS neighbor_count, array_to_string(list_sort(list(v))[1:10], ',') AS neighbors, round(max(abs(ve - ue)), 6) AS max_step FROM edge GROUP BY u")
def node_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    own = N.edge_elevation(roads.edges(spark, sf), roads.nodes(spark, sf))
    return own.groupBy(F.col("u").alias("node_id")).agg(F.count(F.lit(1)).alias("neighbor_count"), F.array_join(F.slice(F.array_sort(F.collect_list("v")), 1, 10).cast("array<string>"), ",").alias("neighbors"), F.round(F.max(F.abs("elevation_gain")), 6).alias("max_step"))


@add("param_grid", "SELECT DISTINCT CAST(l_quantity AS BIGINT) * 5 AS population, l_tax * 2.5::DOUBLE AS mutation FROM lineitem WHERE CAST(l_quantity AS BIGINT) * 5 * (l_tax * 2.5::DOUBLE) >= 5 AND l_discount <= 0.08")
def param_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of two parameters that occur and meet the constraints; line items stand for settings."""
    population, mutation = F.col("l_quantity").cast("long") * 5, F.col("l_tax") * 2.5
    return spark.read.parquet(f"{sf}/lineitem.parquet").filter((population * mutation >= 5) & (F.col("l_discount") <= 0.08)).select(population.alias("population"), mutation.alias("mutation")).distinct()


@add("route_gpx")
def route_gpx(spark: SparkSession, sf: str) -> DataFrame:
    return roads.gpx(roads.points(spark, sf))


