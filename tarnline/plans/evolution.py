"""Queries over likeness, selection, crossover and mutation of routes; importing this adds them to tarnline.plans.queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnline.operators import fitness as FT
from tarnline.operators import paths as P
from tarnline.operators import recombine as C
from tarnline.operators import segments as SG
from tarnline.operators import selection as S
from tarnline.plans.population import _BITS, EVAL, MD5, PROPS, SEG, WALK, digest, listed, pieces, props, r, rounded, terms, walks
from tarnline.plans.queries import _DEG, NET, NODE, PT, ROUTE, TARGET_KM, add, keeper
from tarnline.sources import roads

REACH = 600.0
HOP = "hop AS MATERIALIZED (SELECT u, v, min(length) AS length FROM edge GROUP BY u, v)"
NEAR = f"""{HOP}, np(src, node_id, dist, path) USING KEY (src, node_id) AS (SELECT node_id, node_id, 0.0::DOUBLE, [node_id] FROM node UNION (SELECT p.src, e.v, min(p.dist + e.length), arg_min(list_append(p.path, e.v), p.dist + e.length) FROM np p JOIN hop e ON e.u = p.node_id LEFT JOIN recurring.np k ON k.src = p.src AND k.node_id = e.v WHERE p.dist + e.length <= {REACH} AND p.dist + e.length < coalesce(k.dist, 1e18) GROUP BY p.src, e.v))"""
RNET = NET.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + NEAR
RPROPS = PROPS.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + NEAR
MATES = "mt AS (SELECT x.route_id AS a, y.route_id AS b, x.nodes AS an, y.nodes AS bn FROM wk x JOIN wk y ON y.route_id = x.route_id + 1 WHERE len(x.nodes) > 1 AND len(y.nodes) > 1)"
POP = EVAL + """, po AS (SELECT route_id // 50 AS gen, route_id, nodes, km, gain, fitness, list_distinct(list_transform(range(1, len(nodes)), lambda i: least(nodes[i], nodes[i + 1])::VARCHAR || '-' || greatest(nodes[i], nodes[i + 1])::VARCHAR)) AS steps FROM tt JOIN wk USING (route_id) JOIN ev USING (route_id) WHERE objective = 'elevation'),
pj0 AS (SELECT a.gen, a.route_id AS a, b.route_id AS b, 1 - len(list_distinct(list_intersect(a.nodes, b.nodes))) / len(list_distinct(a.nodes || b.nodes)) AS spatial, 1 - len(list_distinct(list_intersect(a.steps, b.steps))) / len(list_distinct(a.steps || b.steps)) AS segment, (abs(a.gain - b.gain) / greatest(a.gain, b.gain, 1) + abs(a.km - b.km) / greatest(a.km, b.km, 1)) / 2 AS elevation, greatest(len(a.nodes), len(b.nodes)) - len(list_filter(range(1, least(len(a.nodes), len(b.nodes)) + 1), lambda i: a.nodes[i] = b.nodes[i])) AS hamming FROM po a JOIN po b ON a.gen = b.gen AND a.route_id < b.route_id),
pj AS (SELECT *, 0.4::DOUBLE * spatial + 0.3::DOUBLE * elevation + 0.3::DOUBLE * segment AS combined FROM pj0)"""


def near(spark: SparkSession, sf: str, pairs: DataFrame | None = None) -> DataFrame:
    """Ways of at most the reach between all nodes, or for pairs (src, dst)."""
    return P.near_paths(roads.edges(spark, sf), REACH, keeper(spark), nodes=roads.nodes(spark, sf), pairs=pairs)


def population(spark: SparkSession, sf: str) -> DataFrame:
    """gen, route_id, nodes, km, gain and fitness; fifty routes are a generation."""
    own = keeper(spark)(props(spark, sf))
    scored = FT.evaluate(terms(spark, sf, own), TARGET_KM, FT.weights(spark).filter("objective = 'elevation'")).select("route_id", "fitness")
    totals = SG.route_totals(own).select("route_id", "km", "gain")
    return walks(spark, sf).join(totals, "route_id").join(scored, "route_id").withColumn("gen", F.expr("route_id div 50"))


def mates(spark: SparkSession, sf: str) -> DataFrame:
    """Every route and the next one: a, b and their nodes."""
    own = walks(spark, sf).filter(F.size("nodes") > 1)
    return own.select(F.col("route_id").alias("a"), F.col("nodes").alias("an")).join(own.select((F.col("route_id") - 1).alias("a"), F.col("route_id").alias("b"), F.col("nodes").alias("bn")), "a")


@add("pair_diversity", POP + f" SELECT gen, a, b, {r('spatial segment elevation combined')}, hamming FROM pj")
def pair_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.pairs(population(spark, sf)))


@add("novelty", POP + ", nd AS (SELECT gen, a AS route_id, combined FROM pj UNION ALL SELECT gen, b, combined FROM pj), nr AS (SELECT *, row_number() OVER (PARTITION BY gen, route_id ORDER BY combined DESC) AS i FROM nd) SELECT gen, route_id, round(coalesce(avg(combined), 1), 6) AS novelty FROM po LEFT JOIN (SELECT * FROM nr WHERE i <= 15) USING (gen, route_id) GROUP BY gen, route_id")
def novelty(spark: SparkSession, sf: str) -> DataFrame:
    pop = keeper(spark)(population(spark, sf))
    return rounded(S.novelty(S.pairs(pop), pop))


@add("novelty_archive", f"WITH nv AS ({POP}, nd AS (SELECT gen, a AS route_id, combined FROM pj UNION ALL SELECT gen, b, combined FROM pj), nr AS (SELECT *, row_number() OVER (PARTITION BY gen, route_id ORDER BY combined DESC) AS i FROM nd) SELECT gen, route_id, avg(combined) AS novelty FROM nr WHERE i <= 15 GROUP BY gen, route_id) SELECT gen, route_id, round(novelty, 6) AS novelty FROM nv WHERE novelty > 0.5 ORDER BY gen DESC, route_id DESC LIMIT 100")
def novelty_archive(spark: SparkSession, sf: str) -> DataFrame:
    pop = keeper(spark)(population(spark, sf))
    return rounded(S.archive(S.novelty(S.pairs(pop), pop)))


_LAST = "(ORDER BY gen ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@add("diversity_history", POP + f", dgn AS (SELECT gen, avg(combined) AS mean, min(combined) AS least, max(combined) AS most FROM pj GROUP BY gen), dh AS (SELECT *, row_number() OVER (ORDER BY gen) AS place FROM dgn), di AS (SELECT *, avg(mean) OVER {_LAST.format(9)} AS recent, CASE WHEN count(*) OVER {_LAST.format(4)} < 3 THEN 0 ELSE regr_slope(mean, place) OVER {_LAST.format(4)} END AS trend, CASE WHEN count(*) OVER {_LAST.format(9)} < 3 THEN 1 ELSE 1 / (1 + var_samp(mean) OVER {_LAST.format(9)}) END AS stability FROM dh) SELECT gen, {r('mean least most recent trend stability')} FROM di")
def diversity_history(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.diversity_history(S.pairs(population(spark, sf))))


@add("diversity_thresholds", PT + ", dt AS (SELECT route_id AS run, ord AS generation, abs(grade) / 100 AS base FROM pt) SELECT run, generation, round(base, 6) AS base, round(CASE WHEN generation < 10 THEN base * (1.5::DOUBLE - generation / 20) WHEN generation > 50 THEN base * greatest(0.5::DOUBLE, 1 - (generation - 50) / 100) ELSE base END, 6) AS threshold FROM dt")
def diversity_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold in force in every generation of every history, from its diversity."""
    base = F.abs("grade") / 100
    own = roads.points(spark, sf).select(F.col("route_id").alias("run"), F.col("ord").alias("generation"), base.alias("base"))
    return rounded(own.withColumn("threshold", S.threshold(F.col("base"), F.col("generation"))))


@add("elite", POP + ", el AS (SELECT gen, route_id, fitness, row_number() OVER (PARTITION BY gen ORDER BY fitness DESC, route_id) AS rank FROM po) SELECT gen, route_id, round(fitness, 6) AS fitness, rank FROM el WHERE rank <= 5")
def elite(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.elite(population(spark, sf), 5))


@add("tournaments", POP + ", dr AS (SELECT gen, route_id, fitness, t AS tournament, row_number() OVER (PARTITION BY gen, t ORDER BY (route_id * 7919 + t * 104729) % 10007, route_id) AS i FROM po, range(8) x(t)) SELECT gen, CAST(tournament AS INT) AS tournament, arg_max(route_id, (fitness, -route_id)) AS winner FROM dr WHERE i <= 3 GROUP BY gen, tournament")
def tournaments(spark: SparkSession, sf: str) -> DataFrame:
    return S.tournaments(population(spark, sf), 8, 3, lambda i, t: (i * 7919 + t * 104729) % 10007)


@add("weighted_choice", PROPS + ", wr AS (SELECT route_id, seg, sum(steep) OVER (PARTITION BY route_id) AS t0, CASE WHEN t0 > 0 THEN steep ELSE 1 END::DOUBLE AS w FROM pr), wc AS (SELECT *, sum(w) OVER (PARTITION BY route_id ORDER BY seg) AS run, sum(w) OVER (PARTITION BY route_id) AS t FROM wr) SELECT route_id, min(seg) AS seg FROM wc WHERE run >= (route_id % 10 / 10 + 0.05::DOUBLE) * t GROUP BY route_id")
def weighted_choice(spark: SparkSession, sf: str) -> DataFrame:
    own = props(spark, sf).select("route_id", "seg", "steep", (F.col("route_id") % 10 / 10 + 0.05).alias("u"))
    return S.weighted_choice(own, "route_id", "seg", "steep", "u")


@add("greedy_spread")
def greedy_spread(spark: SparkSession, sf: str) -> DataFrame:
    return S.greedy_spread(population(spark, sf), 10)


@add("preserved_diversity")
def preserved_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return S.preserve_diversity(population(spark, sf))


@add("spread_tournaments")
def spread_tournaments(spark: SparkSession, sf: str) -> DataFrame:
    return S.spread_tournaments(population(spark, sf), 20)


_PAIRED = _BITS + ", mp AS (SELECT x.route_id AS a, y.route_id AS b, x.paths AS ap, y.paths AS bp FROM sp x JOIN sp y ON y.route_id = x.route_id + 1)"


@add("segment_exchange", _PAIRED + f", en AS (SELECT *, list_sort(list_distinct(list_intersect(flatten(list_transform(ap, lambda p: [p[1], p[-1]])), flatten(list_transform(bp, lambda p: [p[1], p[-1]]))))) AS c FROM mp), xc AS (SELECT a, b, CASE WHEN len(c) >= 2 THEN ap || list_filter(bp, lambda p: p[1] IN (c[1], c[-1]) OR p[-1] IN (c[1], c[-1])) ELSE ap END AS child FROM en) SELECT a, b, len(child) AS n, {MD5.format('flatten(child)')} AS digest FROM xc")
def segment_exchange(spark: SparkSession, sf: str) -> DataFrame:
    own = listed(spark, sf)
    both = own.select(F.col("route_id").alias("a"), F.col("paths").alias("ap")).join(own.select((F.col("route_id") - 1).alias("a"), F.col("route_id").alias("b"), F.col("paths").alias("bp")), "a")
    shared = both.withColumn("c", C.common_ends(F.col("ap"), F.col("bp")))
    child = F.when(F.size("c") >= 2, C.exchange(F.col("ap"), F.col("bp"), F.col("c")[0], F.element_at("c", -1))).otherwise(F.col("ap"))
    out = shared.select("a", "b", child.alias("child")).withColumn("flat", F.flatten("child"))
    return out.select("a", "b", F.size("child").cast("long").alias("n"), digest("flat").alias("digest"))


_REACHED = f"WITH {NODE}, {NET.split(NODE + ', ')[1]}, {ROUTE}, {WALK}, {HOP}, dw AS (SELECT route_id, unnest(nodes) AS v, generate_subscripts(nodes, 1) AS i FROM wk), dl AS (SELECT *, lag(v) OVER (PARTITION BY route_id ORDER BY i) AS u FROM dw), dm AS (SELECT route_id, dl.v AS node_id, i, sum(coalesce(length, 0)) OVER (PARTITION BY route_id ORDER BY i) AS m FROM dl LEFT JOIN hop ON hop.u = dl.u AND hop.v = dl.v), dn AS (SELECT route_id, node_id, min(m) AS \"to\", any_value(t) - min(m) AS rest, min(i) AS place FROM (SELECT *, max(m) OVER (PARTITION BY route_id) AS t FROM dm) GROUP BY route_id, node_id)"


@add("distance_to_nodes", _REACHED + f' SELECT route_id, node_id, round("to", 6) AS "to", round(rest, 6) + 0.0::DOUBLE AS rest, place FROM dn')
def distance_to_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.distance_to_nodes(walks(spark, sf), roads.edges(spark, sf)).withColumn("place", F.col("place").cast("long")))


_POINTS = _REACHED + f""", {MATES}, cx AS (SELECT a, b, x.node_id, (1 / (1 + abs(x."to" + y.rest - 7000.0::DOUBLE) / 7000.0::DOUBLE) + 1 / (1 + abs(y."to" + x.rest - 7000.0::DOUBLE) / 7000.0::DOUBLE)) / 2 AS score FROM mt JOIN dn x ON x.route_id = a JOIN dn y ON y.route_id = b AND y.node_id = x.node_id WHERE x.node_id <> an[1]), cr AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, node_id) AS rank FROM cx)"""


@add("connection_points", _POINTS + " SELECT a, b, node_id, round(score, 6) AS score, rank FROM cr WHERE rank <= 3")
def connection_points(spark: SparkSession, sf: str) -> DataFrame:
    met = mates(spark, sf)
    reach = C.distance_to_nodes(walks(spark, sf), roads.edges(spark, sf))
    return rounded(C.crossover_points(met, reach, met.select(F.col("a").alias("route_id"), F.col("an")[0].alias("node_id")), 1000 * TARGET_KM))


@add("connection_crossover", _POINTS + f", cc AS (SELECT cr.a, cr.b, node_id, an[1:list_position(an, node_id)] || bn[list_position(bn, node_id) + 1:] AS x, bn[1:list_position(bn, node_id)] || an[list_position(an, node_id) + 1:] AS y FROM cr JOIN mt USING (a, b) WHERE rank = 1) SELECT a, b, node_id, {MD5.format('x')} AS child_a, {MD5.format('y')} AS child_b FROM cc")
def connection_crossover(spark: SparkSession, sf: str) -> DataFrame:
    met = mates(spark, sf)
    best = C.crossover_points(met, C.distance_to_nodes(walks(spark, sf), roads.edges(spark, sf)), met.select(F.col("a").alias("route_id"), F.col("an")[0].alias("node_id")), 1000 * TARGET_KM, 1)
    x, y = C.cross_at(F.col("an"), F.col("bn"), F.col("node_id"))
    return best.join(met, ["a", "b"]).select("a", "b", "node_id", x.alias("x"), y.alias("y")).select("a", "b", "node_id", digest("x").alias("child_a"), digest("y").alias("child_b"))


@add("segment_substitution", PROPS + ", sb AS (SELECT x.route_id AS a, y.route_id AS b, x.seg AS seg_a, y.seg AS seg_b FROM pr x JOIN pr y ON y.route_id = x.route_id + 1 AND x.start_node = y.start_node AND x.end_node = y.end_node WHERE abs(x.km * 1000 - y.km * 1000) < 500), sr AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY seg_a, seg_b) AS rank FROM sb) SELECT * FROM sr WHERE rank <= 2")
def segment_substitution(spark: SparkSession, sf: str) -> DataFrame:
    return C.substitutable(props(spark, sf), mates(spark, sf))


_PEAK = "pk AS (SELECT route_id, node_id, max(side) AS prominence FROM (SELECT route_id, node_id, least(elevation - be, elevation - lead(elevation) OVER (PARTITION BY route_id ORDER BY ord)) AS side, be, lead(elevation) OVER (PARTITION BY route_id ORDER BY ord) AS ne FROM pt) WHERE be IS NOT NULL AND ne IS NOT NULL AND side > 5 GROUP BY route_id, node_id)"


@add("route_high_points", PT + f", {_PEAK} SELECT route_id, node_id, round(prominence, 6) AS prominence FROM pk")
def route_high_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.peaks(roads.points(spark, sf)))


_INSERT = f"""{RNET}, {ROUTE}, {WALK}, {PT.split(ROUTE + ', ')[1]}, {_PEAK}, nw AS (SELECT route_id - 1 AS route_id, pk.node_id FROM pk WHERE route_id > 0 AND NOT EXISTS (FROM route r WHERE r.route_id = pk.route_id - 1 AND r.node_id = pk.node_id)),
iw AS (SELECT *, lag(at_node) OVER (PARTITION BY route_id ORDER BY place) AS before FROM (SELECT route_id, unnest(nodes) AS at_node, generate_subscripts(nodes, 1) - 1 AS place FROM wk)),
ii AS (SELECT nw.route_id, nw.node_id, place, CASE WHEN place = 0 THEN p.dist ELSE q.dist + p.dist - s.dist END AS added FROM nw JOIN iw USING (route_id) JOIN np p ON p.src = nw.node_id AND p.node_id = iw.at_node LEFT JOIN np q ON q.src = iw.before AND q.node_id = nw.node_id LEFT JOIN np s ON s.src = iw.before AND s.node_id = iw.at_node),
ib AS (SELECT route_id, node_id, arg_min(place, (added, place)) AS place, min(added) AS added FROM ii WHERE added IS NOT NULL GROUP BY route_id, node_id)"""


@add("insertion_points", _INSERT + " SELECT route_id, node_id, place, round(added, 4) + 0.0::DOUBLE AS added FROM ib")
def insertion_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_inserted(spark, sf), 4)


def _inserted(spark: SparkSession, sf: str) -> DataFrame:
    """The high points of the next route that a route doesn't pass, and where they go."""
    high = C.peaks(roads.points(spark, sf)).select((F.col("route_id") - 1).alias("route_id"), "node_id")
    new = high.join(roads.routes(spark, sf).select("route_id", "node_id"), ["route_id", "node_id"], "left_anti")
    own, keep = walks(spark, sf), keeper(spark)
    return C.insertion_points(own, new, keep(near(spark, sf, C.insertion_pairs(own, new))))


@add("terrain_crossover", _INSERT + f", tb AS (SELECT route_id, arg_min(node_id, (added, node_id)) AS node_id, arg_min(place, (added, node_id)) AS place FROM ib GROUP BY route_id), tc AS (SELECT route_id, tb.node_id, nodes[1:place] || [tb.node_id] || nodes[place + 1:] AS child FROM tb JOIN wk USING (route_id)) SELECT route_id, node_id, {MD5.format('child')} AS digest FROM tc")
def terrain_crossover(spark: SparkSession, sf: str) -> DataFrame:
    best = _inserted(spark, sf).groupBy("route_id").agg(F.min(F.struct("added", "node_id", "place")).alias("x")).select("route_id", "x.node_id", "x.place")
    child = best.join(walks(spark, sf), "route_id").withColumn("child", C.with_node(F.col("nodes"), F.col("node_id"), F.col("place")))
    return child.select("route_id", "node_id", digest("child").alias("digest"))


@add("simple_crossover", f"WITH {NODE}, {ROUTE}, {WALK}, {MATES}, sc AS (SELECT a, b, 1 + a % (len(an) - 1) AS i, 1 + b % (len(bn) - 1) AS j, an[1:i] || bn[j + 1:] AS x, bn[1:j] || an[i + 1:] AS y FROM mt) SELECT a, b, {MD5.format('x')} AS child_a, {MD5.format('y')} AS child_b FROM sc")
def simple_crossover(spark: SparkSession, sf: str) -> DataFrame:
    met = mates(spark, sf).withColumn("i", 1 + F.col("a") % (F.size("an") - 1)).withColumn("j", 1 + F.col("b") % (F.size("bn") - 1))
    x, y = C.cut_and_join(F.col("an"), F.col("bn"), F.col("i"), F.col("j"))
    return met.select("a", "b", x.alias("x"), y.alias("y")).select("a", "b", digest("x").alias("child_a"), digest("y").alias("child_b"))


def marked(spark: SparkSession, sf: str, every: int = 3) -> DataFrame:
    """Segments with every third one chosen for mutation."""
    return pieces(spark, sf).withColumn("chosen", (F.col("route_id") + F.col("seg")) % every == 0)


def _mutated(segments: DataFrame, other: DataFrame) -> DataFrame:
    return C.replaced(segments, other).select("route_id", "seg", F.size("path").cast("long").alias("n"), digest("path").alias("digest"))


_CHOSEN = ", sh AS (SELECT route_id, seg, path, path[1] AS src, path[-1] AS dst, (route_id + seg) % 3 = 0 AS chosen FROM sg)"
_PUT = f" SELECT route_id, seg, len(coalesce(o.path, sh.path)) AS n, {MD5.format('coalesce(o.path, sh.path)')} AS digest FROM sh LEFT JOIN o USING (route_id, seg)"


@add("segment_replacement", RPROPS + _CHOSEN + ", bp AS (SELECT src, dst, [src] AS path, src AS at_node FROM (SELECT DISTINCT src, dst FROM sh WHERE chosen AND src <> dst) UNION ALL SELECT bp.src, bp.dst, list_append(path, hop.v), hop.v FROM bp JOIN hop ON hop.u = bp.at_node WHERE len(path) <= 4 AND bp.at_node <> bp.dst AND NOT list_contains(path, hop.v)), bf AS (SELECT src, dst, arg_min(path, (len(path), path)) AS walk FROM bp WHERE at_node = dst GROUP BY src, dst), o AS (SELECT route_id, seg, CASE WHEN hop.u IS NOT NULL THEN [src, dst] ELSE walk END AS path FROM sh LEFT JOIN hop ON hop.u = src AND hop.v = dst LEFT JOIN bf USING (src, dst) WHERE chosen AND src <> dst)" + _PUT)
def segment_replacement(spark: SparkSession, sf: str) -> DataFrame:
    keep, own, edges = keeper(spark), marked(spark, sf), roads.edges(spark, sf)
    pairs = keep(own.filter("chosen").select(F.col("path")[0].alias("src"), F.element_at("path", -1).alias("dst")).distinct())
    return _mutated(own, C.direct_or_fewest(own, edges, P.bounded_paths(edges, pairs, 4, keep)))


@add("elevation_bias", PROPS + _CHOSEN + ", up AS (SELECT u, arg_max(v, (ve, -v)) AS nb, max(ve) - any_value(ue) AS rise FROM edge GROUP BY u), o AS (SELECT route_id, seg, [src, nb] AS path FROM sh JOIN up ON up.u = src WHERE chosen AND rise > 0)" + _PUT)
def elevation_bias(spark: SparkSession, sf: str) -> DataFrame:
    own = marked(spark, sf)
    return _mutated(own, C.toward_height(own, roads.nodes(spark, sf), roads.edges(spark, sf)))


@add("micro_mutation", f"{NET}, {ROUTE}, {WALK}, up AS (SELECT u, arg_max(v, (ve, -v)) AS nb, max(ve) - any_value(ue) AS rise FROM edge GROUP BY u), mm AS (SELECT route_id, nodes, 2 + route_id % (len(nodes) - 2) AS i FROM wk WHERE len(nodes) >= 3), mu AS (SELECT route_id, CASE WHEN rise > 2 THEN nodes[1:i - 1] || [nb] || nodes[i + 1:] ELSE nodes END AS child FROM mm LEFT JOIN up ON up.u = nodes[i]) SELECT route_id, {MD5.format('child')} AS digest FROM mu")
def micro_mutation(spark: SparkSession, sf: str) -> DataFrame:
    from tarnline.operators.search import highest_neighbours

    own = walks(spark, sf).filter(F.size("nodes") >= 3).withColumn("i", (2 + F.col("route_id") % (F.size("nodes") - 2)).cast("int")).withColumn("node_id", F.element_at("nodes", F.col("i")))
    up = highest_neighbours(roads.nodes(spark, sf), roads.edges(spark, sf), 2.0)
    put = F.concat(F.slice("nodes", F.lit(1), F.col("i") - 1), F.array("neighbour"), F.slice("nodes", F.col("i") + 1, F.size("nodes") - F.col("i")))
    out = own.join(up, "node_id", "left").select("route_id", F.when(F.col("neighbour").isNotNull(), put).otherwise(F.col("nodes")).alias("child"))
    return out.select("route_id", digest("child").alias("digest"))


@add("route_extension", f"{NET}, {ROUTE}, {WALK}, nb AS (SELECT u, list_sort(list(DISTINCT v)) AS vs FROM edge GROUP BY u) SELECT route_id, nodes[-1] AS last, vs[CAST(floor((route_id % 10 / 10) * len(vs)) AS INT) + 1] AS added FROM wk JOIN nb ON u = nodes[-1]")
def route_extension(spark: SparkSession, sf: str) -> DataFrame:
    around = roads.edges(spark, sf).groupBy(F.col("u").alias("last")).agg(F.collect_set("v").alias("vs"))
    own = walks(spark, sf).withColumn("last", F.element_at("nodes", -1)).join(around, "last")
    return own.select("route_id", "last", C.extension(F.col("last"), F.col("vs"), F.col("route_id") % 10 / 10)[1].alias("added"))


_AROUND = "ar AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY v) AS i FROM hop)"


@add("neutral_mutation", RPROPS + _CHOSEN + f", {_AROUND}, dt AS (SELECT sh.route_id, sh.seg, arg_min(x.path || y.path[2:], ar.v) AS path FROM sh JOIN pr USING (route_id, seg) JOIN ar ON ar.u = src AND ar.i <= 3 AND ar.v <> dst JOIN np x ON x.src = sh.src AND x.node_id = ar.v JOIN np y ON y.src = ar.v AND y.node_id = sh.dst WHERE chosen AND x.dist + y.dist > 0 AND (x.dist + y.dist) / (km * 1000) BETWEEN 0.8::DOUBLE AND 1.5::DOUBLE GROUP BY sh.route_id, sh.seg), we AS (SELECT sh.route_id, sh.seg, any_value(km * 1000) AS m, arg_min([sh.src] || y.path, h.length + y.dist) AS path, min(h.length + y.dist) AS alt FROM sh JOIN pr USING (route_id, seg) JOIN hop d ON d.u = sh.src AND d.v = sh.dst JOIN hop h ON h.u = sh.src AND h.v <> sh.dst JOIN np y ON y.src = h.v AND y.node_id = sh.dst WHERE chosen AND NOT list_contains(y.path, sh.src) GROUP BY sh.route_id, sh.seg), wf AS (SELECT * FROM we WHERE alt / m BETWEEN 0.7::DOUBLE AND 1.3::DOUBLE), o AS (SELECT route_id, seg, path FROM wf UNION ALL SELECT route_id, seg, path FROM dt WHERE NOT EXISTS (FROM wf WHERE wf.route_id = dt.route_id AND wf.seg = dt.seg))" + _PUT)
def neutral_mutation(spark: SparkSession, sf: str) -> DataFrame:
    own, edges, keep = marked(spark, sf), roads.edges(spark, sf), keeper(spark)
    lengths = keep(props(spark, sf).select("route_id", "seg", (F.col("km") * 1000).alias("m")))
    ways = keep(near(spark, sf, C.detour_pairs(own, lengths, edges)))
    first = keep(C.without_edge(own, lengths, edges, ways))
    other = C.detours(own, lengths, edges, ways, 0.8, 1.5, 3).join(first, ["route_id", "seg"], "left_anti")
    return _mutated(own, first.unionByName(other))


@add("local_optimization", RPROPS + _CHOSEN + f", {_AROUND}, lp AS (SELECT route_id, seg, chosen, start_node AS src, end_node AS mid, lead(end_node) OVER w AS dst, (km + lead(km) OVER w) * 1000 AS m, gain + lead(gain) OVER w AS climb FROM pr JOIN sh USING (route_id, seg) WINDOW w AS (PARTITION BY route_id ORDER BY seg)), lv AS (SELECT lp.route_id, lp.seg, climb, ar.v AS via, x.path AS p1, y.path AS p2 FROM lp JOIN ar ON ar.u = mid AND ar.i <= 3 AND ar.v <> src AND ar.v <> dst JOIN np x ON x.src = lp.src AND x.node_id = ar.v JOIN np y ON y.src = ar.v AND y.node_id = lp.dst WHERE chosen AND m > 0 AND (x.dist + y.dist) / m BETWEEN 0.8::DOUBLE AND 1.3::DOUBLE), lf AS (SELECT route_id, seg, any_value(climb) AS climb, min(via) AS via, arg_min(p1, via) AS p1, arg_min(p2, via) AS p2 FROM lv GROUP BY route_id, seg), ls AS (SELECT route_id, seg, sum(greatest(e - pe, 0)) AS up FROM (SELECT route_id, seg, i, elevation AS e, lag(elevation) OVER (PARTITION BY route_id, seg ORDER BY i) AS pe FROM (SELECT route_id, seg, unnest(p1 || p2[2:]) AS node_id, generate_subscripts(p1 || p2[2:], 1) AS i FROM lf) JOIN node USING (node_id)) GROUP BY route_id, seg), lb AS (SELECT lf.*, row_number() OVER (PARTITION BY route_id ORDER BY seg) AS k FROM lf JOIN ls USING (route_id, seg) WHERE up > climb) SELECT route_id, seg, via, {MD5.format('p1 || p2')} AS digest FROM lb WHERE k = 1")
def local_optimization(spark: SparkSession, sf: str) -> DataFrame:
    keep = keeper(spark)
    own, known, edges = marked(spark, sf), keep(props(spark, sf)), roads.edges(spark, sf)
    found = C.better_pairs(own, known, edges, keep(near(spark, sf, C.better_asked(own, known, edges))), roads.nodes(spark, sf))
    return found.withColumn("both", F.concat("path_1", "path_2")).select("route_id", "seg", "via", digest("both").alias("digest"))


@add("route_repair", RPROPS + f", {_AROUND}, rp AS (SELECT route_id, seg, start_node AS src, end_node AS dst, km, sum(km) OVER (PARTITION BY route_id) AS t, count(*) OVER (PARTITION BY route_id) AS n, row_number() OVER (PARTITION BY route_id ORDER BY km DESC, seg) AS k FROM pr), rl AS (SELECT route_id, seg, 'longer' AS kind, arg_min(x.path || y.path[2:], ar.v) AS path FROM rp JOIN ar ON ar.u = rp.src AND ar.i <= 5 AND ar.v <> rp.dst JOIN np x ON x.src = rp.src AND x.node_id = ar.v JOIN np y ON y.src = ar.v AND y.node_id = rp.dst WHERE t < 7.5 AND n >= 2 AND seg = n // 2 AND x.dist + y.dist > 0 AND (x.dist + y.dist) / (km * 1000) >= 1.5 GROUP BY route_id, seg), rs AS (SELECT route_id, seg, 'shorter' AS kind, [src, dst] AS path FROM rp JOIN hop ON hop.u = src AND hop.v = dst WHERE t > 8 AND k = 1) SELECT route_id, seg, kind, {MD5.format('path')} AS digest FROM (FROM rl UNION ALL FROM rs)")
def route_repair(spark: SparkSession, sf: str) -> DataFrame:
    keep = keeper(spark)
    known, own, edges = keep(props(spark, sf)), pieces(spark, sf), roads.edges(spark, sf)
    found = C.repairs(known, own, edges, keep(near(spark, sf, C.repair_pairs(known, own, edges, 7.5))), 7.5, 8.0)
    return found.select("route_id", "seg", "kind", digest("path").alias("digest"))


@add("shuffled_middle", _BITS + f", sm AS (SELECT route_id, CASE WHEN len(paths) >= 4 THEN [paths[1]] || list_transform(list_sort(list_transform(paths[2:-2], lambda p: {{'o': (p[1] * 31 + p[-1] * 17) % 101, 'p': p}})), lambda x: x.p) || [paths[-1]] ELSE paths END AS child FROM sp) SELECT route_id, {MD5.format('flatten(child)')} AS digest FROM sm")
def shuffled_middle(spark: SparkSession, sf: str) -> DataFrame:
    out = listed(spark, sf).select("route_id", F.flatten(C.shuffled_middle(F.col("paths"), lambda p: (p[0] * 31 + F.element_at(p, -1) * 17) % 101)).alias("child"))
    return out.select("route_id", digest("child").alias("digest"))
