"""Queries over profiles, texts and exports of routes; importing this adds them to tarnline.plans.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnline.functions import svg
from tarnline.functions import text as X
from tarnline.operators import network as N
from tarnline.operators import profiles as PR
from tarnline.operators import routes as R
from tarnline.plans.evolution import RNET, near
from tarnline.plans.population import r, rounded
from tarnline.plans.queries import _CYC, _DEG, ALL, GAIN, LOSS, NODE, ORACLES, PT, ROUTE, W, _ELEV, add, hav, over_points
from tarnline.sources import roads

_TERRAIN = "CASE WHEN grade > 15 THEN 'very_steep_uphill' WHEN grade > 8 THEN 'steep_uphill' WHEN grade > 2 THEN 'uphill' WHEN grade > -2 THEN 'level' WHEN grade > -8 THEN 'downhill' WHEN grade > -15 THEN 'steep_downhill' ELSE 'very_steep_downhill' END"
_FRAME = f", fr AS (SELECT *, {_TERRAIN} AS terrain, avg(elevation) OVER (PARTITION BY route_id ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM pt)"


over_points("route_frame", lambda p: rounded(PR.frame(p).select("route_id", "ord", "node_id", "d", "cum_m", "elevation_diff", "grade", "terrain", "smooth"), 4), _FRAME + " SELECT route_id, ord, node_id, round(d, 4) AS d, round(cum_m, 4) AS cum_m, round(rise, 4) + 0.0::DOUBLE AS elevation_diff, round(grade, 4) + 0.0::DOUBLE AS grade, terrain, round(smooth, 4) AS smooth FROM fr")
over_points("closed_profile", lambda p: rounded(R.profile_stats(PR.closed(p))), f", e AS (SELECT route_id, arg_min(x, ord) AS fx, arg_min(y, ord) AS fy, arg_min(elevation, ord) AS fe, arg_max(x, ord) AS lx, arg_max(y, ord) AS ly, arg_max(elevation, ord) AS le, max(cum_m) AS lm FROM pt GROUP BY route_id), b AS (SELECT *, {hav('ly', 'lx', 'fy', 'fx')} AS bd FROM e), c AS (SELECT route_id, elevation, rise, d, cum_m, grade FROM pt UNION ALL SELECT route_id, fe, fe - le, bd, lm + bd, CASE WHEN bd > 0 THEN (fe - le) / bd * 100 ELSE 0 END FROM b) SELECT route_id, count(*) AS n_points, round(max(cum_m), 3) AS distance_m, min(elevation) AS min_elevation, max(elevation) AS max_elevation, round(avg(elevation), 3) AS avg_elevation, round({GAIN}, 3) AS gain, round({LOSS}, 3) AS loss, round(max(grade) FILTER (d > 0), 3) AS max_grade, round(min(grade) FILTER (d > 0), 3) AS min_grade, round(avg(grade) FILTER (d > 0), 3) AS avg_grade, count(*) FILTER (d > 0 AND abs(grade) > 8) AS n_steep FROM c GROUP BY route_id")
over_points("between_points", lambda p: rounded(PR.between(p, 3), 4), f", n AS (SELECT *, lead(elevation) OVER {W} AS ne, lead(cum_m) OVER {W} AS nm FROM pt), e AS (SELECT *, unnest(CASE WHEN nm IS NULL THEN [0] ELSE [0, 1, 2, 3] END) AS j FROM n) SELECT route_id, ord, j, round(CASE WHEN j = 0 THEN elevation ELSE elevation + (ne - elevation) * (j / 4) END, 4) AS elevation, round(CASE WHEN j = 0 THEN cum_m ELSE cum_m + (nm - cum_m) * (j / 4) END, 4) AS cum_m, round(CASE WHEN j = 0 THEN grade ELSE 0 END, 4) + 0.0::DOUBLE AS grade FROM e")
over_points("smoothed_extremes", lambda p: rounded(PR.smoothed_extremes(p)), _FRAME + f", s AS (SELECT *, smooth - lag(smooth) OVER {W} AS l, smooth - lead(smooth) OVER {W} AS t FROM fr), k AS (SELECT *, CASE WHEN least(l, t) >= 10 THEN 'peak' WHEN least(-l, -t) >= 10 THEN 'valley' END AS kind FROM s WHERE l IS NOT NULL AND t IS NOT NULL) SELECT route_id, ord, kind, round(greatest(least(l, t), least(-l, -t)), 6) AS prominence, round(abs(l) + abs(t), 6) AS total_prominence FROM k WHERE kind IS NOT NULL")
over_points("spatial_zones", lambda p: rounded(PR.zones(p), 4), _FRAME + f", z AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS n, least(5, count(*) OVER (PARTITION BY route_id)) AS k, row_number() OVER {W} AS i FROM fr), y AS (SELECT *, CAST(least((i - 1) // (n // k), k - 1) + 1 AS BIGINT) AS zone FROM z), c AS (SELECT route_id, zone, terrain, count(*) AS m FROM y GROUP BY ALL), u AS (SELECT route_id, zone, arg_min(terrain, (-m, terrain)) AS terrain FROM c GROUP BY ALL), s AS (SELECT route_id, zone, count(*) AS n_points, min(cum_m) AS start_m, max(cum_m) AS end_m, min(elevation) AS low, max(elevation) AS high, avg(elevation) AS mean, {GAIN} AS gain, {LOSS} AS loss, max(grade) AS max_grade, avg(grade) AS mean_grade FROM y GROUP BY ALL) SELECT route_id, zone, n_points, {', '.join(f'round({c}, 4) + 0.0::DOUBLE AS {c}' for c in 'start_m end_m low high mean gain loss max_grade mean_grade'.split())}, terrain FROM s JOIN u USING (route_id, zone)")
over_points("ultra_profile", lambda p: rounded(PR.fine(p).groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.avg("elevation").alias("mean"), F.max("cum_m").alias("end_m")), 4), f", n AS (SELECT *, lead(elevation) OVER {W} AS ne, lead(cum_m) OVER {W} AS nm FROM pt), k AS (SELECT *, CASE WHEN nm - cum_m > 1 THEN greatest(CAST(floor(nm - cum_m) AS BIGINT), 1) ELSE 1 END AS g FROM n), e AS (SELECT *, unnest(range(g)) AS j FROM k) SELECT route_id, count(*) AS n, round(avg(coalesce(elevation + (ne - elevation) * (j / g), elevation)), 4) AS mean, round(max(coalesce(cum_m + (nm - cum_m) * (j / g), cum_m)), 4) AS end_m FROM e GROUP BY route_id")
over_points("rounded_stats", PR.rounded_stats, f" SELECT route_id, round(min(elevation), 1) AS low, round(max(elevation), 1) AS high, round(max(elevation) - min(elevation), 1) AS range, round(avg(elevation), 1) AS mean, round({GAIN}, 1) AS gain, round({LOSS}, 1) AS loss, round(max(abs(grade)), 1) AS max_grade, count(*) FILTER (abs(grade) > 8) AS steep, 90.0::DOUBLE AS resolution_m, 16.0::DOUBLE AS accuracy_m FROM pt GROUP BY route_id")
_COUNT = "greatest(100, CASE WHEN t <= 2000 THEN least(floor(t), 2000) WHEN t <= 5000 THEN least(floor(t / 2), 2500) WHEN t <= 10000 THEN least(floor(t / 5), 2000) ELSE least(floor(t / 10), 1000) END)"
over_points("resampled_profile", lambda p: rounded(PR.resampled(p).groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.avg("elevation").alias("mean"), F.max("m").alias("end_m")), 4), f", q AS (SELECT route_id, max(cum_m) AS t FROM pt GROUP BY route_id), g AS (SELECT route_id, t, {_COUNT} AS c FROM q WHERE t > 0), x AS (SELECT route_id, i, least(i * (t / (c - 1)), t) AS m FROM (SELECT *, unnest(range(CAST(c AS BIGINT))) AS i FROM g)), s AS (SELECT * FROM (SELECT *, lead(cum_m) OVER {W} AS nm, lead(elevation) OVER {W} AS ne FROM pt) WHERE nm > cum_m), v AS (SELECT x.route_id, x.i, x.m, s.elevation + (s.ne - s.elevation) * least(1, (x.m - s.cum_m) / (s.nm - s.cum_m)) AS e FROM x ASOF JOIN s ON s.route_id = x.route_id AND s.cum_m <= x.m) SELECT route_id, count(*) AS n, round(avg(e), 4) AS mean, round(max(m), 4) AS end_m FROM v GROUP BY route_id")
over_points("slopes", lambda p: rounded(PR.slopes(p)), " SELECT route_id, count(*) FILTER (grade > 5) AS climbing, count(*) FILTER (grade < -5) AS falling, round(coalesce(avg(grade) FILTER (d > 0), 0), 6) + 0.0::DOUBLE AS mean_grade FROM pt GROUP BY route_id")
over_points("route_info", PR.info, " SELECT route_id, count(*) AS length, arg_min(node_id, ord) AS start, arg_max(node_id, ord) AS end, arg_min(node_id, ord) = arg_max(node_id, ord) AS is_loop FROM pt GROUP BY route_id")
over_points("last_visits", lambda p: rounded(PR.by_last_visit(p).withColumn("ord", F.col("ord").cast("long")), 4), f", l AS (SELECT route_id, node_id, CAST(max(ord) AS BIGINT) AS ord, any_value(x) AS x, any_value(y) AS y, any_value(elevation) AS elevation FROM pt GROUP BY ALL), b AS (SELECT *, lag(x) OVER {W} AS px, lag(y) OVER {W} AS py, lag(elevation) OVER {W} AS pe FROM l), c AS (SELECT *, coalesce({hav('py', 'px', 'y', 'x')}, 0) AS d, coalesce(elevation - pe, 0) AS e FROM b) SELECT route_id, node_id, ord, round(d, 4) AS d, round(sum(d) OVER {W}, 4) AS cum_m, round(e, 4) + 0.0::DOUBLE AS elevation_diff, round(CASE WHEN d > 0 THEN e / d * 100 ELSE 0 END, 4) + 0.0::DOUBLE AS grade FROM c")
over_points("spatial_summary", lambda p: rounded(PR.spatial_summary(p), 4), ", s AS (SELECT route_id, sum(d) AS distance_m, count(*) FILTER (grade > 2) AS uphill, count(*) FILTER (grade < -2) AS downhill, count(*) FILTER (abs(grade) <= 2) AS level, greatest(count(*) - 1, 1) AS n, max(grade) AS max_grade, min(grade) AS min_grade, avg(grade) AS mean_grade, count(*) FILTER (grade > 8) AS steep_up, count(*) FILTER (grade < -8) AS steep_down, stddev_samp(elevation) AS std_elevation FROM pt GROUP BY route_id) SELECT route_id, round(distance_m, 4) AS distance_m, uphill, downhill, level, round(uphill / n * 100, 4) AS uphill_percent, round(downhill / n * 100, 4) AS downhill_percent, round(level / n * 100, 4) AS level_percent, round(max_grade, 4) + 0.0::DOUBLE AS max_grade, round(min_grade, 4) + 0.0::DOUBLE AS min_grade, round(mean_grade, 4) + 0.0::DOUBLE AS mean_grade, steep_up, steep_down, round(std_elevation, 4) AS std_elevation FROM s")
over_points("terrain_shares", lambda p: rounded(PR.terrain_shares(p)), _FRAME + ", k(i, terrain) AS (VALUES (0, 'very_steep_uphill'), (1, 'steep_uphill'), (2, 'uphill'), (3, 'level'), (4, 'downhill'), (5, 'steep_downhill'), (6, 'very_steep_downhill')), e AS (SELECT * FROM (SELECT DISTINCT route_id FROM fr), k), c AS (SELECT e.route_id, e.i, e.terrain, count(fr.ord) AS n FROM e LEFT JOIN fr ON fr.route_id = e.route_id AND fr.terrain = e.terrain GROUP BY ALL) SELECT route_id, terrain, n, round(n / sum(n) OVER (PARTITION BY route_id) * 100, 6) AS percent, first_value(terrain) OVER (PARTITION BY route_id ORDER BY n DESC, i) AS dominant, count(*) FILTER (n > 0) OVER (PARTITION BY route_id) AS classes FROM c")
over_points("route_line", PR.line, " SELECT route_id, string_agg(printf('%.6f %.6f', x, y), ', ' ORDER BY ord) || ', ' || printf('%.6f %.6f', arg_min(x, ord), arg_min(y, ord)) AS line FROM pt GROUP BY route_id HAVING count(*) >= 2")


@add("network_profile", f"{RNET}, {ROUTE}, wp AS (SELECT route_id, ord, node_id, x, y, elevation FROM route JOIN node USING (node_id) WHERE ord % 4 = 1), wc AS (FROM wp UNION ALL SELECT route_id, max(ord) + 1, arg_min(node_id, ord), arg_min(x, ord), arg_min(y, ord), arg_min(elevation, ord) FROM wp GROUP BY route_id), wl AS (SELECT *, lag(node_id) OVER w AS src, lag(x) OVER w AS bx, lag(y) OVER w AS byy, coalesce(elevation - lag(elevation) OVER w, 0) AS rise FROM wc WINDOW w AS (PARTITION BY route_id ORDER BY ord)), wd AS (SELECT wl.*, CASE WHEN wl.src IS NULL THEN 0 ELSE coalesce(np.dist, {hav('byy', 'bx', 'y', 'x')}) END AS d FROM wl LEFT JOIN np ON np.src = wl.src AND np.node_id = wl.node_id) SELECT route_id, CAST(ord AS BIGINT) AS ord, node_id, round(d, 4) AS d, round(sum(d) OVER (PARTITION BY route_id ORDER BY ord), 4) AS cum_m, round(CASE WHEN d > 0 THEN rise / d * 100 ELSE 0 END, 4) + 0.0::DOUBLE AS grade FROM wd")
def network_profile(spark: SparkSession, sf: str) -> DataFrame:
    way, nodes = roads.routes(spark, sf).filter("ord % 4 = 1"), roads.nodes(spark, sf)
    own = PR.over_network(way, near(spark, sf, PR.over_network_pairs(way, nodes)), nodes)
    return rounded(own.select("route_id", F.col("ord").cast("long").alias("ord"), "node_id", "d", "cum_m", "grade"), 4)


_SEGS = f"sg AS (SELECT route_id, ax, ay, bx, byy FROM (SELECT route_id, x AS ax, y AS ay, lead(x) OVER {W} AS bx, lead(y) OVER {W} AS byy FROM pt) WHERE bx IS NOT NULL), st AS (SELECT sg.route_id, node_id, degree, greatest(0, least(1, CASE WHEN (bx - ax) * (bx - ax) + (byy - ay) * (byy - ay) > 0 THEN ((x - ax) * (bx - ax) + (y - ay) * (byy - ay)) / ((bx - ax) * (bx - ax) + (byy - ay) * (byy - ay)) ELSE 0 END)) AS t, x - ax AS px, y - ay AS py, bx - ax AS dx, byy - ay AS dy FROM sg JOIN dg ON x BETWEEN least(ax, bx) - 0.0023 AND greatest(ax, bx) + 0.0023 AND y BETWEEN least(ay, byy) - 0.0023 AND greatest(ay, byy) + 0.0023)"


@add("near_line", ALL + f"{_DEG}, {_SEGS}, f AS (SELECT DISTINCT route_id, node_id, degree FROM st WHERE (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy) <= (230.0::DOUBLE / 111000) * (230.0::DOUBLE / 111000)) SELECT route_id, count(*) AS nodes, count(*) FILTER (degree > 2) AS intersections, round(count(*) / any_value(n), 6) AS density FROM f JOIN (SELECT route_id, count(*) AS n FROM pt GROUP BY route_id) USING (route_id) GROUP BY route_id")
def near_line(spark: SparkSession, sf: str) -> DataFrame:
    own, edges = roads.nodes(spark, sf), roads.edges(spark, sf)
    return rounded(PR.near_line(roads.points(spark, sf), own, N.degrees(own, edges), 230.0))


_TOTAL = f"tot AS (SELECT route_id, max(cum_m) / 1000 AS km, {GAIN} AS gain, {LOSS} AS loss, max(abs(grade)) AS max_grade, count(*) AS n, min(elevation) AS low, max(elevation) AS high, count(*) FILTER (abs(grade) > 8) AS steep FROM pt GROUP BY route_id)"


def _totals(points: DataFrame) -> DataFrame:
    return points.groupBy("route_id").agg((F.max("cum_m") / 1000).alias("km"), R.gain().alias("gain"), R.loss().alias("loss"), F.max(F.abs("grade")).alias("max_grade"), F.count(F.lit(1)).alias("n"), F.min("elevation").alias("low"), F.max("elevation").alias("high"), F.count_if(F.abs("grade") > 8).alias("steep"))


def _texts(points: DataFrame) -> DataFrame:
    c = F.col
    own = _totals(points)
    return own.select("route_id", X.statistics(c("km"), c("gain"), c("loss"), c("max_grade"), c("km") / 8 * 60, c("n"), F.lit("elevation")).alias("stats"), X.summary(c("km"), c("gain"), c("km") / 8 * 60).alias("summary"), X.profile(c("low"), c("high"), c("max_grade"), c("steep")).alias("profile"))


_RULE = "=" * 50
over_points("route_texts", _texts, f", {_TOTAL} SELECT route_id, 'Route statistics' || chr(10) || '{_RULE}' || chr(10) || 'Distance:        ' || printf('%.2f', round(round(km, 9), 2)) || ' km' || chr(10) || 'Elevation gain:  ' || printf('%.0f', round(round(gain, 9), 0)) || ' m' || chr(10) || 'Elevation loss:  ' || printf('%.0f', round(round(loss, 9), 0)) || ' m' || chr(10) || 'Net elevation:   ' || printf('%+.0f', round(round(gain - loss, 9), 0)) || ' m' || chr(10) || 'Max grade:       ' || printf('%.1f', round(round(max_grade, 9), 1)) || '%' || chr(10) || 'Time:            ' || printf('%.0f', round(round(km / 8 * 60, 9), 0)) || ' minutes' || chr(10) || 'Points:          ' || n || ' intersections' || chr(10) || 'Objective:       elevation' || chr(10) || '{_RULE}' AS stats, printf('%.1f', round(round(km, 9), 1)) || 'km, ' || printf('%.0f', round(round(gain, 9), 0)) || 'm gain, ~' || printf('%.0f', round(round(km / 8 * 60, 9), 0)) || 'min' AS summary, 'Elevation profile:' || chr(10) || '   Min: ' || printf('%.0f', round(round(low, 9), 0)) || 'm' || chr(10) || '   Max: ' || printf('%.0f', round(round(high, 9), 0)) || 'm' || chr(10) || '   Range: ' || printf('%.0f', round(round(high - low, 9), 0)) || 'm' || chr(10) || '   Max grade: ' || printf('%.1f', round(round(max_grade, 9), 1)) || '%' || chr(10) || '   Steep sections: ' || steep AS profile FROM tot")


def _direction_texts(points: DataFrame) -> DataFrame:
    steps = R.directions(points).withColumnRenamed("step", "ord").join(points.select("route_id", "ord", "elevation", "rise", "cum_m"), ["route_id", "ord"])
    return steps.select("route_id", "ord", X.direction(F.col("ord"), F.col("type"), F.col("terrain"), F.col("elevation"), F.col("rise"), F.col("cum_m") / 1000).alias("text"))


over_points("direction_texts", _direction_texts, " SELECT route_id, ord, ord || '. ' || CASE WHEN ord = 1 THEN 'Start here' WHEN ord = max(ord) OVER (PARTITION BY route_id) THEN 'Finish' ELSE 'Continue ' || CASE WHEN rise > 5 THEN 'uphill' WHEN rise < -5 THEN 'downhill' ELSE 'level' END END || chr(10) || '   Elevation: ' || printf('%.0f', round(round(elevation, 9), 0)) || 'm (' || printf('%+.0f', round(round(rise, 9), 0)) || 'm)' || chr(10) || '   Distance: ' || printf('%.2f', round(round(cum_m / 1000, 9), 2)) || ' km' AS text FROM pt")
over_points("difficulty_badges", lambda p: R.rating(p).select("route_id", X.badge(F.col("rating"), F.col("score")).alias("b")).select("route_id", "b.*"), "")
ORACLES["difficulty_badges"] = f"WITH rt AS ({ORACLES['difficulty_rating']}) SELECT route_id, rating AS text, score || '/100' AS score, CASE rating WHEN 'very_easy' THEN '#4CAF50' WHEN 'easy' THEN '#8BC34A' WHEN 'moderate' THEN '#FF9800' WHEN 'hard' THEN '#FF5722' WHEN 'very_hard' THEN '#F44336' ELSE '#9E9E9E' END AS color, 'Difficulty: ' || rating || ' (' || score || '/100)' AS description FROM rt"


@add("map_colours", f"WITH {NODE}, b AS (SELECT min(elevation) AS lo, max(elevation) AS hi FROM node) SELECT node_id, CASE WHEN elevation > 625 THEN 'red' WHEN elevation > 615 THEN 'orange' WHEN elevation > 605 THEN 'yellow' ELSE 'green' END AS bin, '#' || repeat(printf('%02x', CAST(round((elevation - lo) / (hi - lo) * 255) AS INT)), 3) AS shade, 'hsl(' || printf('%.0f', node_id % 37 / 37 * 360) || ', 70%, 60%)' AS hue FROM node, b")
def map_colours(spark: SparkSession, sf: str) -> DataFrame:
    own = roads.nodes(spark, sf)
    ends = own.agg(F.min("elevation").alias("lo"), F.max("elevation").alias("hi"))
    return own.crossJoin(F.broadcast(ends)).select("node_id", X.height_colour(F.col("elevation")).alias("bin"), X.shade(F.col("elevation"), F.col("lo"), F.col("hi")).alias("shade"), X.route_colour(F.col("node_id") % 37, 37).alias("hue"))  # one row


@add("file_names", "SELECT event_id, 'route_' || user_id || '_' || printf('%.1f', round(round(value, 9), 1)) || 'km_' || strftime(ts, '%Y%m%d_%H%M%S') || '.png' AS name FROM events")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", X.file_name(F.lit("route"), F.col("user_id"), F.col("value"), F.col("ts"), "png").alias("name"))


@add("starting_points", f"{ALL}{_DEG} SELECT dg.node_id, degree, elevation, round({hav('46.2340::DOUBLE', '7.4000::DOUBLE', 'dg.y', 'dg.x')}, 3) AS dist_m FROM dg JOIN node USING (node_id) WHERE degree <> 2 ORDER BY node_id LIMIT 50")
def starting_points(spark: SparkSession, sf: str) -> DataFrame:
    from tarnline.functions.geo import haversine

    first = N.intersections(roads.nodes(spark, sf), roads.edges(spark, sf), 50)
    return first.select("node_id", "degree", "elevation", F.round(haversine(F.lit(46.2340), F.lit(7.4), F.col("y"), F.col("x")), 3).alias("dist_m"))


def _exports(points: DataFrame) -> DataFrame:
    """The route as one JSON text: totals, rating and format version."""
    own = _totals(points).join(R.rating(points), "route_id")
    whole_ = lambda c: F.round(c).cast("long")
    body = F.struct(F.struct(F.col("route_id").alias("route"), whole_(F.col("km") * 1000).alias("meters"), whole_("gain").alias("gain"), F.col("n").alias("points")).alias("route_result"), F.struct(F.col("rating").alias("rating"), F.col("score").alias("score")).alias("analysis"), F.lit("1.0").alias("format_version"))
    return own.select("route_id", F.to_json(body).alias("json"))


over_points("route_json", _exports, _CYC + f", {_TOTAL}, o AS (SELECT route_id, max(cum_m) / 1000 AS km, {GAIN} AS g FROM pt GROUP BY route_id), s AS (SELECT route_id, CAST(CASE WHEN km > 10 THEN 25 WHEN km > 5 THEN 15 WHEN km > 2 THEN 5 ELSE 0 END + CASE WHEN g / km > 100 THEN 30 WHEN g / km > 50 THEN 20 WHEN g / km > 20 THEN 10 ELSE 0 END + CASE WHEN uphill_percent > 50 THEN 25 WHEN uphill_percent > 30 THEN 15 WHEN uphill_percent > 15 THEN 5 ELSE 0 END + CASE WHEN greatest(steepest_uphill, -steepest_downhill) > 15 THEN 20 WHEN greatest(steepest_uphill, -steepest_downhill) > 10 THEN 15 WHEN greatest(steepest_uphill, -steepest_downhill) > 5 THEN 5 ELSE 0 END AS INT) AS score FROM o JOIN cyc USING (route_id)) SELECT route_id, printf('{{\"route_result\":{{\"route\":%d,\"meters\":%d,\"gain\":%d,\"points\":%d}},\"analysis\":{{\"rating\":\"%s\",\"score\":%d}},\"format_version\":\"1.0\"}}', route_id, CAST(round(km * 1000) AS BIGINT), CAST(round(gain) AS BIGINT), n, CASE WHEN score >= 70 THEN 'very_hard' WHEN score >= 50 THEN 'hard' WHEN score >= 30 THEN 'moderate' WHEN score >= 15 THEN 'easy' ELSE 'very_easy' END, score) AS json FROM tot JOIN s USING (route_id)")
ORACLES["route_gpx"] = PT + """ SELECT route_id, '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>route ' || route_id || '</name><trkseg>' || string_agg(printf('<trkpt lat="%.6f" lon="%.6f"><ele>%.1f</ele></trkpt>', y, x, elevation), '' ORDER BY ord) || '</trkseg></trk></gpx>' AS gpx FROM pt GROUP BY route_id"""


@add("route_geojson", PT + """ SELECT route_id, '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"distance_m":' || printf('%.1f', max(cum_m)) || ',"total_nodes":' || count(*) || ',"route_type":"circular"},"geometry":{"type":"LineString","coordinates":[' || string_agg(printf('[%.4f,%.4f]', x, y), ',' ORDER BY ord) || ']}}]}' AS geojson FROM pt GROUP BY route_id""")
def route_geojson(spark: SparkSession, sf: str) -> DataFrame:
    return roads.geojson(roads.points(spark, sf))


def _svg_sql(x: str, y: str) -> str:
    scale = lambda c, size: f"CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) * {size} ELSE {size / 2}::DOUBLE END"
    return f""", sv AS (SELECT route_id, ord, {scale(x, 800)} AS px, 240 - ({scale(y, 240)}) AS py FROM pt WINDOW w AS (PARTITION BY route_id)) SELECT route_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 800 240"><polyline fill="none" stroke="black" points="' || string_agg(CAST(round(px) AS BIGINT) || ',' || CAST(round(py) AS BIGINT), ' ' ORDER BY ord) || '"/></svg>' AS svg FROM sv GROUP BY route_id HAVING count(*) >= 3"""


over_points("profile_drawings", svg.profiles, _svg_sql("cum_m", "elevation"))
over_points("map_drawings", svg.maps, _svg_sql("x", "y"))
over_points("compared_drawings", lambda p: svg.compared(svg.profiles(p), F.expr("route_id div 3")), "")
ORACLES["compared_drawings"] = f"""WITH dr AS ({ORACLES["profile_drawings"]}), nd AS (SELECT *, row_number() OVER (PARTITION BY route_id // 3 ORDER BY route_id) - 1 AS i FROM dr) SELECT route_id // 3 AS key, CAST(count(*) AS INT) AS n, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 800 ' || count(*) * 240 || '">' || string_agg('<g transform="translate(0,' || i * 240 || ')">' || regexp_replace(regexp_replace(svg, '^<svg[^>]*>', ''), '</svg>$', '') || '</g>', '' ORDER BY i) || '</svg>' AS svg FROM nd GROUP BY route_id // 3"""
