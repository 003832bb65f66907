"""Route analytics over profiled points (route_id, ord, node_id, x, y, elevation, d, rise, cum_m, grade): many routes in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tarnline.functions.geo import bearing, compass, difficulty_score, distance_score, elevation_score, grade_percent, haversine, lerp, terrain



def along() -> WindowSpec:
    return Window.partitionBy("route_id").orderBy("ord")


def whole() -> WindowSpec:
    return Window.partitionBy("route_id")


def gain() -> Column:
    return F.sum(F.greatest("rise", F.lit(0.0)))


def loss() -> Column:
    return F.sum(F.greatest(-F.col("rise"), F.lit(0.0)))


def r(column: Column, digits: int = 3) -> Column:
    return F.round(column, digits)


def profile_stats(points: DataFrame) -> DataFrame:
    step = F.when(F.col("d") > 0, F.col("grade"))
    return points.groupBy("route_id").agg(F.count(F.lit(1)).alias("n_points"), r(F.max("cum_m")).alias("distance_m"), F.min("elevation").alias("min_elevation"), F.max("elevation").alias("max_elevation"), r(F.avg("elevation")).alias("avg_elevation"), r(gain()).alias("gain"), r(loss()).alias("loss"), r(F.max(step)).alias("max_grade"), r(F.min(step)).alias("min_grade"), r(F.avg(step)).alias("avg_grade"), F.count_if(F.abs(step) > 8).alias("n_steep"))


def spatial_stats(points: DataFrame) -> DataFrame:
    return points.groupBy("route_id").agg(r(F.stddev_samp("elevation")).alias("std_elevation"), r(F.median("elevation")).alias("median_elevation"), r(gain() - loss()).alias("net"), F.count_if(F.col("grade") > 2).alias("uphill"), F.count_if(F.col("grade") < -2).alias("downhill"), F.count_if(F.abs("grade") <= 2).alias("level"), F.count_if(F.col("grade") > 8).alias("steep_up"), F.count_if(F.col("grade") < -8).alias("steep_down"))


def zones(points: DataFrame, k: int = 5) -> DataFrame:
    """k zones of equally many points, the rest in the last; a zone ends where the next one begins."""
    n = F.count(F.lit(1)).over(whole())
    placed = points.withColumn("k", F.least(F.lit(k), n)).withColumn("zone", F.least(F.floor((F.col("ord") - F.min("ord").over(whole())) / F.floor(n / F.col("k"))), F.col("k") - 1) + 1).withColumn("next_m", F.coalesce(F.lead("cum_m").over(along()), F.col("cum_m")))
    return placed.groupBy("route_id", "zone").agg(F.count(F.lit(1)).alias("n_points"), r(F.min("cum_m")).alias("start_m"), r(F.max("next_m")).alias("end_m"), F.min("elevation").alias("min_elevation"), F.max("elevation").alias("max_elevation"), r(F.avg("elevation")).alias("avg_elevation"))


def extremes(points: DataFrame, prominence: float = 10.0) -> DataFrame:
    """Strict local peaks and valleys whose smaller side difference reaches the prominence."""
    a, b, e = F.lag("elevation").over(along()), F.lead("elevation").over(along()), F.col("elevation")
    side = points.withColumn("a", a).withColumn("b", b).filter("a is not null and b is not null")
    up, down = F.least(e - F.col("a"), e - F.col("b")), F.least(F.col("a") - e, F.col("b") - e)
    kind = F.when((up > 0) & (up >= prominence), "peak").when((down > 0) & (down >= prominence), "valley")
    return side.withColumn("kind", kind).filter("kind is not null").select("route_id", "ord", "node_id", "kind", r(F.greatest(up, down)).alias("prominence"))


def climbs(points: DataFrame, least_gain: float = 20.0) -> DataFrame:
    """Longest runs of rising steps that gain enough."""
    island = F.sum(F.when(F.col("rise") > 0, 0).otherwise(1)).over(along())
    runs = points.withColumn("island", island).filter("rise > 0").groupBy("route_id", "island").agg((F.min("ord") - 1).alias("start_ord"), F.max("ord").alias("end_ord"), F.sum("rise").alias("g"), F.sum("d").alias("m"))
    return runs.filter(F.col("g") >= least_gain).select("route_id", "start_ord", "end_ord", r(F.col("g")).alias("gain"), r(F.col("m")).alias("length_m"), r(grade_percent(F.col("g"), F.col("m"))).alias("avg_grade"))


def terrain_distribution(points: DataFrame) -> DataFrame:
    counted = points.groupBy("route_id", terrain(F.col("grade")).alias("terrain")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", r(F.col("n") / F.sum("n").over(whole()) * 100))


def rolling_elevation(points: DataFrame, window: int = 5) -> DataFrame:
    """Centred mean over a window, shorter at the ends."""
    return points.select("route_id", "ord", r(F.avg("elevation").over(along().rowsBetween(-(window // 2), (window - 1) // 2))).alias("smooth"))


def steep_sections(points: DataFrame, least: float = 8.0) -> DataFrame:
    """Consecutive points steeper than the least grade, uphill and downhill apart."""
    kind = F.when(F.col("grade") > least, "uphill").when(F.col("grade") < -least, "downhill")
    steep = points.withColumn("kind", kind).filter("kind is not null")
    island = F.col("ord") - F.row_number().over(Window.partitionBy("route_id", "kind").orderBy("ord"))
    return steep.withColumn("island", island).groupBy("route_id", "kind", "island").agg(F.min("ord").alias("start_ord"), F.max("ord").alias("end_ord"), r(F.max(F.abs("grade"))).alias("max_grade"), r(F.avg(F.abs("grade"))).alias("avg_grade"), r(F.sum("d")).alias("length_m")).drop("island")


def densify(points: DataFrame) -> DataFrame:
    """Points at a spacing by the route's length (1, 2, 5 or 10 m), interpolated between the old ones; frac tells where in the step."""
    total = F.max("cum_m").over(whole())
    spaced = points.withColumn("spacing", F.when(total <= 2000, 1.0).when(total <= 5000, 2.0).when(total <= 10000, 5.0).otherwise(10.0))
    for c in ("x", "y", "elevation", "cum_m"):
        spaced = spaced.withColumn(f"n_{c}", F.lead(c).over(along()))
    n = F.when(F.col("n_cum_m") - F.col("cum_m") > 2 * F.col("spacing"), F.floor((F.col("n_cum_m") - F.col("cum_m")) / F.col("spacing"))).otherwise(1)
    rows = spaced.withColumn("n", n).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    share = F.col("j") / F.col("n")
    at = lambda c: F.coalesce(lerp(F.col(c), F.col(f"n_{c}"), share), F.col(c)).alias(c)
    return rows.select("route_id", "ord", "j", at("x"), at("y"), at("elevation"), at("cum_m"))


def difficulty(points: DataFrame) -> DataFrame:
    own = points.groupBy("route_id").agg(gain().alias("g"), loss().alias("l"), F.max(F.abs("grade")).alias("m"), (F.max("cum_m") / 1000).alias("km"))
    score = difficulty_score(F.col("g"), F.col("l"), F.col("m"), F.col("km"))
    rating = F.when(F.col("km") <= 0, "flat").when(score < 20, "easy").when(score < 40, "moderate").when(score < 60, "hard").when(score < 80, "very_hard").otherwise("extreme")
    return own.select("route_id", r(score).alias("score"), rating.alias("rating"))


def _cycle(points: DataFrame) -> DataFrame:
    """Points with the metres (m) and rise (up) to the next one, from the last to the first."""
    first = lambda c: F.first_value(c).over(along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = lambda c: F.coalesce(F.lead(c).over(along()), first(c))
    return points.withColumn("m", haversine(F.col("y"), F.col("x"), after("y"), after("x"))).withColumn("up", after("elevation") - F.col("elevation"))


def _cyclic() -> list[Column]:
    g = F.when(F.col("m") > 0, F.col("up") / F.col("m") * 100)
    uphill = F.count_if(g > 2)
    return [F.count(F.lit(1)).alias("segments"), uphill.alias("uphill"), F.count_if(g < -2).alias("downhill"), F.count_if(F.abs(g) <= 2).alias("level"), r(F.greatest(F.max(g), F.lit(0.0))).alias("steepest_uphill"), r(F.least(F.min(g), F.lit(0.0))).alias("steepest_downhill"), r(uphill / F.count(F.lit(1)) * 100).alias("uphill_percent")]


def cyclic_stats(points: DataFrame) -> DataFrame:
    """Steps around the closed route: rise of more or less than 2 percent, steepest, shares."""
    return _cycle(points).groupBy("route_id").agg(*_cyclic())


def rating(points: DataFrame) -> DataFrame:
    """Difficulty points from length, gain per km, uphill share and steepest grade."""
    own = _cycle(points).groupBy("route_id").agg(*_cyclic(), (F.max("cum_m") / 1000).alias("km"), gain().alias("g"))
    tier = lambda x, *levels: F.coalesce(F.when(x > levels[0][0], levels[0][1]).when(x > levels[1][0], levels[1][1]).when(x > levels[2][0], levels[2][1]), F.lit(0))
    score = tier(F.col("km"), (10, 25), (5, 15), (2, 5)) + tier(F.try_divide("g", "km"), (100, 30), (50, 20), (20, 10)) + tier(F.col("uphill_percent"), (50, 25), (30, 15), (15, 5)) + tier(F.greatest("steepest_uphill", -F.col("steepest_downhill")), (15, 20), (10, 15), (5, 5))
    return own.select("route_id", score.cast("int").alias("score"), F.when(score >= 70, "very_hard").when(score >= 50, "hard").when(score >= 30, "moderate").when(score >= 15, "easy").otherwise("very_easy").alias("rating"))


def directions(points: DataFrame) -> DataFrame:
    last = F.max("ord").over(whole())
    kind = F.when(F.col("ord") == F.min("ord").over(whole()), "start").when(F.col("ord") == last, "finish").otherwise("continue")
    return points.select("route_id", F.col("ord").alias("step"), kind.alias("type"), F.when(F.col("rise") > 5, "uphill").when(F.col("rise") < -5, "downhill").otherwise("level").alias("terrain"), r(F.col("rise")).alias("elevation_change"), r(F.col("d") / 1000, 5).alias("distance_km"), r(F.col("cum_m") / 1000, 5).alias("cumulative_km"))


def terrain_kind(points: DataFrame) -> DataFrame:
    e, a, b = F.col("elevation"), F.lag("elevation").over(along()), F.lead("elevation").over(along())
    marked = points.withColumn("peak", (e > a) & (e > b) & (e - F.least(a, b) > 5)).withColumn("valley", (e < a) & (e < b) & (F.greatest(a, b) - e > 5))
    own = marked.groupBy("route_id").agg(F.stddev_pop("elevation").alias("s"), F.count_if("peak").alias("n_peaks"), F.count_if("valley").alias("n_valleys"))
    return own.select("route_id", F.when(F.col("s") < 5, "flat").when(F.col("s") < 15, "rolling").when(F.col("s") < 30, "hilly").otherwise("mountainous").alias("terrain_type"), r(F.col("s")).alias("std_elevation"), "n_peaks", "n_valleys")


def steps(points: DataFrame) -> DataFrame:
    """Segments of a route: from u to v, metres, rise and compass direction."""
    before = lambda c: F.lag(c).over(along())
    out = points.withColumn("u", before("node_id")).withColumn("deg", bearing(before("y"), before("x"), F.col("y"), F.col("x"))).filter("u is not null")
    return out.select("route_id", "ord", "u", F.col("node_id").alias("v"), "d", "rise", "grade", compass(F.col("deg")).alias("direction"))


def segment_metrics(route_steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Network length, gain, loss, grades of the edges walked; invalid if an edge is missing."""
    joined = route_steps.join(edges.select("u", "v", "length"), ["u", "v"], "left")
    g = F.when(F.col("length") > 0, F.abs("rise") / F.col("length") * 100)
    return joined.groupBy("route_id").agg(r(F.sum("length")).alias("length"), r(gain()).alias("gain"), r(loss()).alias("loss"), r(F.max(g)).alias("max_grade"), r(F.avg(g)).alias("avg_grade"), F.count_if(g > 8).alias("steep_sections"), F.bool_and(F.col("length").isNotNull()).alias("is_valid"))


def edge_usage(route_steps: DataFrame) -> DataFrame:
    """Distinct edges, edges walked both ways, efficiency, and whether every direction is walked once at most."""
    used = route_steps.groupBy("route_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count_if(F.col("u") < F.col("v")).alias("f"), F.count_if(F.col("u") >= F.col("v")).alias("w"))
    both = F.count_if((F.col("f") > 0) & (F.col("w") > 0))
    return used.groupBy("route_id").agg(F.count(F.lit(1)).alias("unique_edges"), both.alias("bidirectional_edges"), r((F.count(F.lit(1)) - both) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("efficiency"), (F.max(F.greatest("f", "w")) <= 1).alias("is_valid"))


def direction_diversity(route_steps: DataFrame) -> DataFrame:
    opposite = F.create_map(*(F.lit(x) for kv in (("N", "S"), ("NE", "SW"), ("E", "W"), ("SE", "NW"), ("S", "N"), ("SW", "NE"), ("W", "E"), ("NW", "SE")) for x in kv))
    turned = route_steps.withColumn("back", F.lead("direction").over(along()) == F.element_at(opposite, F.col("direction")))
    return turned.groupBy("route_id").agg(r(F.greatest(F.lit(0.0), F.count_distinct("direction") / 8 - 0.1 * F.count_if("back")), 6).alias("diversity"))


def fitness_terms(points: DataFrame, target_km: float) -> DataFrame:
    """Distance, elevation and diversity terms of routes whose every step is a segment: diversity is the mean of places visited (20 are full marks, one place none) and of the share of steps that don't repeat an edge, either way round."""
    own = points.groupBy("route_id").agg((F.max("cum_m") / 1000).alias("km"), gain().alias("g"), F.max(F.abs("grade")).alias("m"), F.count_distinct("node_id").alias("nodes"))
    used = steps(points).groupBy("route_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    loops = used.groupBy("route_id").agg(F.greatest(F.lit(0.0), 1 - F.sum(F.col("n") - 1) / F.sum("n")).alias("loops"))
    spread = F.when(F.col("nodes") <= 1, 0.0).otherwise(F.least(F.lit(1.0), F.col("nodes") / 20))
    both = own.join(loops, "route_id", "left")
    return both.select("route_id", r(distance_score(F.col("km"), target_km), 6).alias("distance_score"), r(elevation_score(F.col("g"), F.col("m")), 6).alias("elevation_score"), r((spread + F.coalesce("loops", F.lit(1.0))) / 2, 6).alias("diversity_score"))


def micro_terrain(points: DataFrame) -> DataFrame:
    e, a, b = F.col("elevation"), F.lag("elevation").over(along()), F.lead("elevation").over(along())
    g = F.col("grade") / 100
    marked = points.withColumn("peak", (e > a) & (e > b) & (e - F.least(a, b) >= 2)).withColumn("valley", (e < a) & (e < b) & (F.greatest(a, b) - e >= 2)).withColumn("change", F.when(F.col("ord") > F.min("ord").over(whole()) + 1, F.abs(g - F.lag(g).over(along()))))
    return marked.groupBy("route_id").agg(F.count_if("peak").alias("peaks"), F.count_if("valley").alias("valleys"), F.count_if(F.abs(g) >= 0.03).alias("steep_steps"), F.count_if(F.col("change") >= 0.03).alias("grade_changes"))


def jaccard_pairs(route: DataFrame, size: int = 50) -> DataFrame:
    """Jaccard distance of the node sets of all pairs of routes within a generation of so many ids, disjoint ones too; generations are of bounded size, so pairs are as many times more than routes."""
    own = route.groupBy("route_id").agg(F.collect_set("node_id").alias("s")).withColumn("gen", F.floor(F.col("route_id") / size))
    both = own.select("gen", F.col("route_id").alias("a"), F.col("s").alias("x")).join(own.select("gen", F.col("route_id").alias("b"), F.col("s").alias("y")), "gen").filter("a < b")
    met = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", r(1 - met / (F.size("x") + F.size("y") - met), 6).alias("distance"))


def hamming_to_next(route: DataFrame) -> DataFrame:
    """Positions at which a route and that with the next id differ; beyond the shorter one all do."""
    n = route.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    same = route.alias("p").join(route.alias("q"), (F.col("q.route_id") == F.col("p.route_id") + 1) & (F.col("p.ord") == F.col("q.ord")) & (F.col("p.node_id") == F.col("q.node_id"))).groupBy(F.col("p.route_id").alias("route_id")).agg(F.count(F.lit(1)).alias("same"))
    pairs = n.join(n.select((F.col("route_id") - 1).alias("route_id"), F.col("n").alias("m")), "route_id").join(same, "route_id", "left")
    return pairs.select("route_id", (F.greatest("n", "m") - F.coalesce("same", F.lit(0))).alias("hamming"))


def survivors(scored: DataFrame, score: str, rate: float = 0.8, least: float = 0.1) -> DataFrame:
    """Individuals over a threshold (the best one if none is), best first, a share of them. scored: gen, route_id, score."""
    w = Window.partitionBy("gen")
    fit = scored.withColumn("ok", F.col(score) >= least).withColumn("any", F.max("ok").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("ok"), F.desc(score), "route_id"))).withColumn("n", F.count_if("ok").over(w))
    return fit.filter(F.when(F.col("any"), F.col("ok") & (F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * rate)))).otherwise(F.col("rank") == 1)).select("gen", "route_id", "rank")


def fitness_trend(series: DataFrame, points_: int = 5) -> DataFrame:
    """Least-squares slope over the last points of a series (route_id, ord, value); 0 for fewer than three."""
    w = along().rowsBetween(-(points_ - 1), 0)
    slope = F.when(F.count(F.lit(1)).over(w) < 3, 0.0).otherwise(F.regr_slope(F.col("value"), F.col("ord").cast("double")).over(w))
    return series.select("route_id", "ord", (r(slope, 6) + 0.0).alias("slope"))  # no negative zero
