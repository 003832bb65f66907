"""Queries over segments and fitness of routes; importing this adds them to tarnline.plans.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnline.operators import fitness as FT
from tarnline.operators import segments as SG
from tarnline.plans.queries import _DEG, EDGE, NODE, PT, ROUTE, TARGET_KM, add, hav, keeper
from tarnline.sources import roads

WALK = "wk AS (SELECT route_id, list(node_id ORDER BY ord) AS nodes FROM route GROUP BY route_id)"
SEG = "sg AS (SELECT route_id, s AS seg, nodes[4 * s + 1:4 * s + 5] AS path FROM (SELECT route_id, nodes, unnest(range((len(nodes) - 2) // 4 + 1)) AS s FROM wk WHERE len(nodes) >= 2))"
SN = f"""sl AS (SELECT route_id, seg, i, node_id, x, y, elevation, lag(x) OVER w AS bx, lag(y) OVER w AS byy, lag(elevation) OVER w AS be, lag(node_id) OVER w AS u FROM (SELECT route_id, seg, unnest(path) AS node_id, generate_subscripts(path, 1) AS i FROM sg) JOIN node USING (node_id) WINDOW w AS (PARTITION BY route_id, seg ORDER BY i)),
sn AS (SELECT *, coalesce({hav("byy", "bx", "y", "x")}, 0) AS d FROM sl)"""
COMPASS = "['N','NE','E','SE','S','SW','W','NW'][CAST(round_even(((degrees(atan2(sin(radians({x2} - {x1})) * cos(radians({y2})), cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos(radians({x2} - {x1})))) + 360) % 360) / 45, 0) AS INT) % 8 + 1]"
_BASE = f"WITH {NODE}, {EDGE}, {ROUTE}, {WALK}, {SEG}, {SN}{_DEG}"
PROPS = _BASE + f""", pr0 AS (SELECT route_id, seg, min_by(node_id, i) AS start_node, max_by(node_id, i) AS end_node, count(*) AS n_nodes, sum(length) / 1000 AS km, sum(CASE WHEN elevation > be THEN elevation - be ELSE 0 END) AS gain, sum(CASE WHEN elevation <= be THEN be - elevation ELSE 0 END) AS loss, coalesce(max(g), 0) AS max_grade, coalesce(avg(g), 0) AS avg_grade, count(*) FILTER (g > 8) AS steep, min(elevation) AS low, max(elevation) AS high, avg(coalesce(degree, 0)) AS connectivity, bool_and(u IS NULL OR length IS NOT NULL) AS is_valid, min_by(x, i) AS ax, min_by(y, i) AS ay, max_by(x, i) AS zx, max_by(y, i) AS zy FROM (SELECT sn.*, e.length, dg.degree, CASE WHEN e.length > 0 THEN abs(elevation - be) / e.length * 100 END AS g FROM sn LEFT JOIN edge e ON e.u = sn.u AND e.v = sn.node_id LEFT JOIN dg ON dg.node_id = sn.node_id) GROUP BY route_id, seg),
pr AS (SELECT *, gain - loss AS net, {COMPASS.format(x1="ax", y1="ay", x2="zx", y2="zy")} AS direction FROM pr0)"""
TOTALS = PROPS + """, tl AS (SELECT *, coalesce(start_node = lag(end_node) OVER (PARTITION BY route_id ORDER BY seg), true) AS linked FROM pr),
tt AS (SELECT route_id, count(*) AS n_segments, sum(km) AS km, sum(gain) AS gain, sum(loss) AS loss, sum(net) AS net, max(max_grade) AS max_grade, sum(avg_grade * n_nodes) / sum(n_nodes) AS avg_grade, sum(connectivity * n_nodes) / sum(n_nodes) AS connectivity, max(high) AS high, min(low) AS low, CAST(sum(steep) AS BIGINT) AS steep, min_by(start_node, seg) = max_by(end_node, seg) AS is_circular, bool_and(linked AND is_valid) AS is_valid, sum(km) / 8 * 60 AS minutes FROM tl GROUP BY route_id)"""
PROFILE = f"""mp AS (SELECT *, sum(d) OVER (PARTITION BY route_id ORDER BY seg, i) AS m FROM sn),
mg AS (SELECT *, lag(m) OVER w AS pm, lag(elevation) OVER w AS pe FROM mp WINDOW w AS (PARTITION BY route_id ORDER BY seg, i)),
mi AS (SELECT route_id, seg, i, 0 AS last, j, pm + (m - pm) * (j * 10.0::DOUBLE / (m - pm)) AS m, pe + (elevation - pe) * (j * 10.0::DOUBLE / (m - pm)) AS elevation FROM (SELECT *, unnest(range(1, CAST(floor((m - pm) / 10.0::DOUBLE) AS BIGINT) + 1)) AS j FROM mg WHERE m - pm > 10) UNION ALL SELECT route_id, seg, i, 1, 0, m, elevation FROM mg),
mk AS (SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY seg, i, last, j) AS k, m, elevation FROM mi)"""
FEATURES = """mn AS (SELECT *, lag(elevation) OVER w AS a, lead(elevation) OVER w AS b, m - lag(m) OVER w AS run, count(*) OVER (PARTITION BY route_id) AS n FROM mk WINDOW w AS (PARTITION BY route_id ORDER BY k)),
mf0 AS (SELECT *, CASE WHEN elevation > a AND elevation > b AND elevation - least(a, b) >= 2 THEN elevation - least(a, b) END AS peak, CASE WHEN elevation < a AND elevation < b AND greatest(a, b) - elevation >= 2 THEN greatest(a, b) - elevation END AS valley, CASE WHEN run > 0 THEN (elevation - a) / run WHEN run IS NOT NULL THEN 0 END AS grade FROM mn WHERE n >= 3),
mf AS (SELECT *, abs(grade - lag(grade) OVER (PARTITION BY route_id ORDER BY k)) AS change FROM mf0)"""
SCORES = """ms1 AS (SELECT route_id, least(coalesce(sum(least(peak / 10, 1)), 0) / 5, 1) AS p, (coalesce(sum(least(abs(grade) * 100 / 15, 1)) FILTER (abs(grade) >= 0.03::DOUBLE AND abs(grade) * 100 BETWEEN 3 AND 15), 0) + least(count(*) FILTER (change >= 0.03::DOUBLE AND change * 100 >= 3) / 10, 1)) / 2 AS v FROM mf GROUP BY route_id),
ms2 AS (SELECT route_id, (least(stddev_pop(elevation) / 20, 1) + least((max(elevation) - min(elevation)) / 100, 1) + least(var_pop(step) / 5, 1)) / 3 AS c FROM (SELECT *, elevation - lag(elevation) OVER (PARTITION BY route_id ORDER BY k) AS step FROM mk) GROUP BY route_id),
ms AS (SELECT route_id, p AS peaks_score, v AS variety_score, c AS complexity_score, greatest(0, least(1, (p + v + c) / 3)) AS micro_score FROM ms1 JOIN ms2 USING (route_id))"""
CONN = "cs AS (SELECT route_id, CASE WHEN bool_and(is_valid) AND coalesce(bool_and(l = 1), true) THEN coalesce(0.5::DOUBLE + 0.5::DOUBLE * avg(l), 1) ELSE 0 END AS connectivity_score FROM (SELECT *, CAST(start_node = lag(end_node) OVER (PARTITION BY route_id ORDER BY seg) AS INT) AS l FROM pr) GROUP BY route_id)"
DIV = "dv1 AS (SELECT route_id, count(DISTINCT n) AS places FROM (SELECT route_id, unnest([start_node, end_node]) AS n FROM pr) GROUP BY route_id), dv2 AS (SELECT route_id, greatest(0, 1 - sum(n - 1) / sum(n)) AS loops FROM (SELECT route_id, count(*) AS n FROM pr GROUP BY route_id, least(start_node, end_node), greatest(start_node, end_node)) GROUP BY route_id), dv AS (SELECT route_id, (CASE WHEN places <= 1 THEN 0 ELSE least(1, places / 20) END + loops) / 2 AS diversity_score FROM dv1 JOIN dv2 USING (route_id))"
TERMS = f"""tm AS (SELECT tt.*, CASE WHEN km <= 0 THEN 0 WHEN abs(km - 7.0::DOUBLE) > 1.05::DOUBLE THEN 0.01::DOUBLE WHEN abs(km - 7.0::DOUBLE) <= 0.7::DOUBLE THEN 1 - abs(km - 7.0::DOUBLE) / 0.7::DOUBLE * 0.1::DOUBLE ELSE greatest(0, 0.9::DOUBLE - least(0.8::DOUBLE, (abs(km - 7.0::DOUBLE) - 0.7::DOUBLE) / 7.0::DOUBLE * 3)) END AS distance_score, CASE WHEN gain <= 0 THEN 0 ELSE greatest(0, ln(1 + gain / 10) / ln(501.0::DOUBLE) - CASE WHEN max_grade > 15 THEN least(0.3::DOUBLE, (max_grade - 15) / 100) ELSE 0 END) END AS elevation_score, connectivity_score, diversity_score, micro_score FROM tt JOIN cs USING (route_id) JOIN dv USING (route_id) JOIN ms USING (route_id)),
wt(objective, wd, we, wc, wv, wm) AS (VALUES ('distance', 0.6::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.1::DOUBLE, 0.0::DOUBLE), ('elevation', 0.15, 0.4, 0.2, 0.1, 0.15), ('balanced', 0.25, 0.25, 0.2, 0.2, 0.1), ('scenic', 0.1, 0.3, 0.15, 0.25, 0.2), ('efficiency', 0.5, 0.2, 0.2, 0.1, 0.0)),
ev AS (SELECT route_id, objective, CASE WHEN NOT is_valid THEN 0 WHEN abs(km - 7.0::DOUBLE) <= 1.05::DOUBLE THEN greatest(0, least(1, wd * distance_score + we * elevation_score + wc * connectivity_score + wv * diversity_score + wm * micro_score)) ELSE least(0.05::DOUBLE, 0.1::DOUBLE * (we * elevation_score + wc * connectivity_score + wv * diversity_score + wm * micro_score)) END AS fitness FROM tm, wt)"""
EVAL = f"{TOTALS}, {PROFILE}, {FEATURES}, {SCORES}, {CONN}, {DIV}, {TERMS}"
_BITS = f"WITH {NODE}, {ROUTE}, {WALK}, {SEG}, sp AS (SELECT route_id, list(path ORDER BY seg) AS paths FROM sg GROUP BY route_id)"


def walks(spark: SparkSession, sf: str) -> DataFrame:
    return SG.walks(roads.routes(spark, sf))


def pieces(spark: SparkSession, sf: str) -> DataFrame:
    return SG.cut(walks(spark, sf))


def props(spark: SparkSession, sf: str) -> DataFrame:
    return SG.properties(pieces(spark, sf), roads.nodes(spark, sf), roads.edges(spark, sf))


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return FT.profile(pieces(spark, sf), roads.nodes(spark, sf))


def terms(spark: SparkSession, sf: str, own: DataFrame | None = None) -> DataFrame:
    own = keeper(spark)(props(spark, sf)) if own is None else own
    return FT.terms(SG.route_totals(own), own, profile(spark, sf), TARGET_KM)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many places, without negative zeros."""
    return df.select(*((F.round(f.name, digits) + 0.0).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema))


def r(columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in columns.split())


def digest(nodes: str) -> F.Column:
    return F.md5(F.array_join(F.col(nodes).cast("array<string>"), ",").cast("binary"))


MD5 = "md5(array_to_string({}, ','))"


@add("segment_properties", PROPS + f" SELECT route_id, seg, start_node, end_node, n_nodes, {r('km gain loss max_grade avg_grade')}, steep, {r('low high connectivity')}, is_valid, {r('net')}, direction FROM pr")
def segment_properties(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(props(spark, sf))


@add("segment_keys", PROPS + ", k AS (SELECT route_id, seg, concat_ws('_', array_to_string(path, '-'), direction, printf('%.6f', km)) AS t FROM pr JOIN sg USING (route_id, seg)) SELECT route_id, seg, CASE WHEN length(t) > 100 THEN md5(t) ELSE t END AS key FROM k")
def segment_keys(spark: SparkSession, sf: str) -> DataFrame:
    both = pieces(spark, sf).join(props(spark, sf).select("route_id", "seg", "direction", "km"), ["route_id", "seg"])
    return both.select("route_id", "seg", SG.key(F.col("path"), F.col("direction"), F.col("km")).alias("key"))


@add("route_totals", TOTALS + f" SELECT route_id, n_segments, {r('km gain loss net max_grade avg_grade connectivity high low')}, steep, is_circular, is_valid, {r('minutes')} FROM tt")
def route_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(SG.route_totals(props(spark, sf)))


@add("segment_edits", _BITS + ", e AS (SELECT route_id, paths || [paths[1]] AS a, paths[1:2] || [[7, 8]] || paths[3:] AS b, paths[1:2] || paths[4:] AS c FROM sp) SELECT route_id, len(a) AS appended, md5(array_to_string(flatten(b), ',')) AS inserted, md5(array_to_string(flatten(c), ',')) AS removed FROM e")
def segment_edits(spark: SparkSession, sf: str) -> DataFrame:
    own = listed(spark, sf)
    paths = F.col("paths")
    out = own.select("route_id", F.size(SG.append(paths, paths[0])).cast("long").alias("appended"), F.flatten(SG.insert(paths, 2, F.array(F.lit(7), F.lit(8)).cast("array<bigint>"))).alias("b"), F.flatten(SG.remove(paths, 2)).alias("c"))
    return out.select("route_id", "appended", digest("b").alias("inserted"), digest("c").alias("removed"))


def listed(spark: SparkSession, sf: str) -> DataFrame:
    """route_id and the paths of its segments in order."""
    rows = pieces(spark, sf).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seg", "path"))).alias("x"))
    return rows.select("route_id", F.col("x.path").alias("paths"))


@add("complete_nodes", _BITS + f" SELECT route_id, len(nodes) AS n, {MD5.format('nodes')} AS digest, {MD5.format('[paths[1][1]] || list_transform(paths, lambda p: p[-1])')} AS waypoints FROM sp JOIN wk USING (route_id)")
def complete_nodes(spark: SparkSession, sf: str) -> DataFrame:
    own = listed(spark, sf).select("route_id", SG.complete(F.col("paths")).alias("all"), SG.waypoints(F.col("paths")).alias("ends"))
    return own.select("route_id", F.size("all").cast("long").alias("n"), digest("all").alias("digest"), digest("ends").alias("waypoints"))


@add("route_results", EVAL + f" SELECT route_id, round(CASE WHEN fitness <> 0 THEN -fitness END, 6) + 0.0::DOUBLE AS cost, objective, round(km, 6) AS target_distance_km, {r('km gain loss minutes')}, is_circular, 'genetic_algorithm' AS solver FROM tt JOIN ev USING (route_id) WHERE objective = 'elevation'")
def route_results(spark: SparkSession, sf: str) -> DataFrame:
    own = keeper(spark)(props(spark, sf))
    scored = FT.evaluate(terms(spark, sf, own), TARGET_KM, FT.weights(spark).filter("objective = 'elevation'"))
    return rounded(SG.results(SG.route_totals(own), scored, "elevation"))


@add("fitness_weights", "SELECT event_id AS id, w.* FROM events JOIN (VALUES ('distance', 0.6::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.1::DOUBLE, 0.0::DOUBLE), ('elevation', 0.15, 0.4, 0.2, 0.1, 0.15), ('balanced', 0.25, 0.25, 0.2, 0.2, 0.1), ('scenic', 0.1, 0.3, 0.15, 0.25, 0.2), ('efficiency', 0.5, 0.2, 0.2, 0.1, 0.0)) w(objective, w_distance, w_elevation, w_connectivity, w_diversity, w_micro) ON objective = ['distance', 'elevation', 'balanced', 'scenic', 'efficiency'][1 + event_id % 5]")
def fitness_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The weights of every request; events stand for requests."""
    kind = F.element_at(F.array(*map(F.lit, ("distance", "elevation", "balanced", "scenic", "efficiency"))), (F.col("event_id") % 5 + 1).cast("int"))
    asked = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), kind.alias("objective"))
    return asked.join(F.broadcast(FT.weights(spark)), "objective")  # five rows


@add("connectivity_score", PROPS + f", {CONN} SELECT route_id, round(connectivity_score, 6) AS connectivity_score FROM cs")
def connectivity_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(FT.connectivity(props(spark, sf)))


@add("diversity_score", PROPS + f", {DIV} SELECT route_id, round(diversity_score, 6) AS diversity_score FROM dv")
def diversity_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(FT.diversity(props(spark, sf)))


_FINE = f"WITH {NODE}, {ROUTE}, {WALK}, {SEG}, {SN}, {PROFILE}"


@add("fine_profile", _FINE + " SELECT route_id, count(*) AS n, round(max(m), 3) AS total_m, round(avg(elevation), 4) AS mean_elevation, round(sum(m * elevation) / 1e6, 2) AS moment FROM mk GROUP BY route_id")
def fine_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = profile(spark, sf)
    return p.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("m"), 3).alias("total_m"), F.round(F.avg("elevation"), 4).alias("mean_elevation"), F.round(F.sum(F.col("m") * F.col("elevation")) / 1e6, 2).alias("moment"))


@add("terrain_features", f"{_FINE}, {FEATURES} SELECT route_id, count(peak) AS peaks, count(valley) AS valleys, count(*) FILTER (abs(grade) >= 0.03::DOUBLE) AS steep, count(*) FILTER (change >= 0.03::DOUBLE) AS changes, round(max(abs(grade)) * 100, 6) AS max_grade, round(avg(abs(grade)) * 100, 6) AS avg_grade, round(sum(CASE WHEN grade > 0 THEN grade ELSE 0 END) * avg(run), 6) + 0.0::DOUBLE AS gain, round(sum(CASE WHEN grade < 0 THEN -grade ELSE 0 END) * avg(run), 6) + 0.0::DOUBLE AS loss FROM mf GROUP BY route_id")
def terrain_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(FT.feature_stats(FT.features(profile(spark, sf))))


@add("micro_scores", f"{_FINE}, {FEATURES}, {SCORES} SELECT route_id, {r('peaks_score variety_score complexity_score micro_score')} FROM ms")
def micro_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(FT.micro_scores(profile(spark, sf)))


@add("fitness", EVAL + " SELECT route_id, objective, round(fitness, 6) + 0.0::DOUBLE AS fitness FROM ev")
def fitness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(FT.evaluate(terms(spark, sf), TARGET_KM, FT.weights(spark)))


_FAR = "(PARTITION BY route_id ORDER BY ord"


@add("fitness_history", PT + f", h AS (SELECT route_id, ord, CAST(round(greatest(0, least(1, (elevation - 500) / 1000)) * 100000) AS BIGINT) AS v FROM pt), s AS (SELECT *, count(*) OVER {_FAR}) AS n, sum(v) OVER {_FAR}) AS t, min(v) OVER {_FAR}) AS lo, sum(v * v) OVER {_FAR}) AS q, sum(v) OVER {_FAR} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l, sum(v) OVER {_FAR} ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS b FROM h), i AS (SELECT route_id, ord, n, t::DOUBLE / (n * 100000) AS mean, lo / 100000 AS least, sqrt((n * q - t * t)::DOUBLE) / (n * 100000) AS spread, CASE WHEN n < 10 THEN 0 WHEN n < 20 THEN l::DOUBLE / 1000000 ELSE (l - b)::DOUBLE / 1000000 END AS improvement FROM s) SELECT route_id, ord, mean, least, spread, improvement, n >= 10 AND abs(improvement) < 0.001 AS plateau FROM i")
def fitness_history(spark: SparkSession, sf: str) -> DataFrame:
    series = roads.points(spark, sf).select("route_id", "ord", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("elevation") - 500) / 1000)).alias("fitness"))
    # whole units divided once: the same in every digit on both sides
    return FT.history_stats(series)
