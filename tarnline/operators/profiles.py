"""More views of profiled routes: frames, smoothed extremes, zones, fine profiles, places near a route (points as in routes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnline.functions.geo import TERRAIN, grade_percent, haversine, lerp, terrain

from .routes import along, whole


def closed(points: DataFrame) -> DataFrame:
    """Points with the first one once more at the end, at the distance back to it; a route that ends where it starts gets a point at no distance."""
    ends = points.groupBy("route_id").agg(F.min_by(F.struct("node_id", "x", "y", "elevation"), "ord").alias("f"), F.max_by(F.struct("ord", "x", "y", "elevation", "cum_m"), "ord").alias("l"))
    d = haversine(F.col("l.y"), F.col("l.x"), F.col("f.y"), F.col("f.x"))
    rise = F.col("f.elevation") - F.col("l.elevation")
    back = ends.select("route_id", (F.col("l.ord") + 1).alias("ord"), "f.node_id", "f.x", "f.y", "f.elevation", d.alias("d"), rise.alias("rise"), (F.col("l.cum_m") + d).alias("cum_m"), grade_percent(rise, d).alias("grade"))
    return points.select(back.columns).unionByName(back)


def frame(points: DataFrame) -> DataFrame:
    """Points with the terrain class of their grade and the elevation smoothed over five points."""
    smooth = F.avg("elevation").over(along().rowsBetween(-2, 2))
    return points.select("route_id", "ord", "node_id", "x", "y", "elevation", "d", "cum_m", F.col("rise").alias("elevation_diff"), "grade", terrain(F.col("grade")).alias("terrain"), smooth.alias("smooth"))


def _round_trip(way: DataFrame, nodes: DataFrame) -> DataFrame:
    known = way.join(nodes.select("node_id", "x", "y", "elevation"), "node_id")
    first = known.groupBy("route_id").agg(F.min_by(F.struct("node_id", "x", "y", "elevation"), "ord").alias("f"), (F.max("ord") + 1).alias("ord"))
    rows = known.select("route_id", "ord", "node_id", "x", "y", "elevation").unionByName(first.select("route_id", "ord", "f.node_id", "f.x", "f.y", "f.elevation"))
    return rows.withColumn("src", F.lag("node_id").over(along()))


def over_network_pairs(way: DataFrame, nodes: DataFrame) -> DataFrame:
    """What over_network() asks of near: src, dst."""
    return _round_trip(way, nodes).filter("src is not null").select("src", F.col("node_id").alias("dst")).distinct()


def over_network(way: DataFrame, near: DataFrame, nodes: DataFrame) -> DataFrame:
    """Waypoints (route_id, ord, node_id) and the first once more, with network metres from the one before (the air line where near has no way), rise, cum_m and grade; unknown nodes are left out."""
    w = along()
    before = lambda c: F.lag(c).over(w)
    own = _round_trip(way, nodes).withColumn("air", haversine(before("y"), before("x"), F.col("y"), F.col("x"))).withColumn("rise", F.coalesce(F.col("elevation") - before("elevation"), F.lit(0.0)))
    met = own.join(near.select("src", "node_id", "dist"), ["src", "node_id"], "left")
    d = F.when(F.col("src").isNull(), 0.0).otherwise(F.coalesce("dist", "air"))
    out = met.withColumn("d", d).withColumn("cum_m", F.sum("d").over(w))
    return out.select("route_id", "ord", "node_id", "x", "y", "elevation", "d", "rise", "cum_m", grade_percent(F.col("rise"), F.col("d")).alias("grade"))


def between(points: DataFrame, k: int) -> DataFrame:
    """Points with k more at equal shares of every step; the new ones have no distance of their own, so their grade is 0: route_id, ord, j (0: as it was), elevation, cum_m, grade."""
    nxt = lambda c: F.lead(c).over(along())
    own = points.withColumn("ne", nxt("elevation")).withColumn("nm", nxt("cum_m"))
    rows = own.withColumn("j", F.explode(F.when(F.col("nm").isNotNull(), F.sequence(F.lit(0), F.lit(k))).otherwise(F.array(F.lit(0)))))
    share = F.col("j") / (k + 1)
    at = lambda c, n: F.when(F.col("j") == 0, F.col(c)).otherwise(lerp(F.col(c), F.col(n), share)).alias(c)
    return rows.select("route_id", "ord", "j", at("elevation", "ne"), at("cum_m", "nm"), F.when(F.col("j") == 0, F.col("grade")).otherwise(0.0).alias("grade"))


def smoothed_extremes(points: DataFrame, prominence: float = 10.0) -> DataFrame:
    """Strict local peaks and valleys of the smoothed elevation whose lesser side reaches the prominence; total_prominence sums both sides."""
    rows = frame(points)
    a, b, e = F.lag("smooth").over(along()), F.lead("smooth").over(along()), F.col("smooth")
    side = rows.withColumn("left", e - a).withColumn("right", e - b).filter("left is not null and right is not null")
    up = F.least("left", "right")
    down = F.least(-F.col("left"), -F.col("right"))
    kind = F.when((up > 0) & (up >= prominence), "peak").when((down > 0) & (down >= prominence), "valley")
    return side.withColumn("kind", kind).filter("kind is not null").select("route_id", "ord", "kind", F.greatest(up, down).alias("prominence"), (F.abs("left") + F.abs("right")).alias("total_prominence"))


def zones(points: DataFrame, k: int = 5) -> DataFrame:
    """k zones of equally many points, the rest in the last: bounds, heights, gain, loss, grades, and the most frequent terrain (ties by name)."""
    n = F.count(F.lit(1)).over(whole())
    placed = points.withColumn("k", F.least(F.lit(k), n)).withColumn("zone", F.least(F.floor((F.row_number().over(along()) - 1) / F.floor(n / F.col("k"))), F.col("k") - 1) + 1).withColumn("terrain", terrain(F.col("grade")))
    stats = placed.groupBy("route_id", "zone").agg(F.count(F.lit(1)).alias("n_points"), F.min("cum_m").alias("start_m"), F.max("cum_m").alias("end_m"), F.min("elevation").alias("low"), F.max("elevation").alias("high"), F.avg("elevation").alias("mean"), F.sum(F.greatest("rise", F.lit(0.0))).alias("gain"), F.sum(F.greatest(-F.col("rise"), F.lit(0.0))).alias("loss"), F.max("grade").alias("max_grade"), F.avg("grade").alias("mean_grade"))
    counted = placed.groupBy("route_id", "zone", "terrain").agg(F.count(F.lit(1)).alias("n"))
    usual = counted.groupBy("route_id", "zone").agg(F.min(F.struct((-F.col("n")).alias("m"), "terrain")).alias("x")).select("route_id", "zone", F.col("x.terrain").alias("terrain"))
    return stats.join(usual, ["route_id", "zone"])


def fine(points: DataFrame, spacing: float = 1.0) -> DataFrame:
    """Points every so many metres: a gap over the spacing gets int(gap / spacing) - 1 more: route_id, ord, j, elevation, cum_m."""
    nxt = lambda c: F.lead(c).over(along())
    gap = nxt("cum_m") - F.col("cum_m")
    own = points.withColumn("n", F.when(gap > spacing, F.greatest(F.floor(gap / spacing), F.lit(1))).otherwise(1)).withColumn("ne", nxt("elevation")).withColumn("nm", nxt("cum_m"))
    rows = own.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    share = F.col("j") / F.col("n")
    at = lambda c, n: F.coalesce(lerp(F.col(c), F.col(n), share), F.col(c)).alias(c)
    return rows.select("route_id", "ord", "j", at("elevation", "ne"), at("cum_m", "nm"))


def rounded_stats(points: DataFrame) -> DataFrame:
    """Statistics to one place: heights, range, mean, gain, loss, and the steepest step either way."""
    one = lambda c: F.round(c, 1)
    return points.groupBy("route_id").agg(one(F.min("elevation")).alias("low"), one(F.max("elevation")).alias("high"), one(F.max("elevation") - F.min("elevation")).alias("range"), one(F.avg("elevation")).alias("mean"), one(F.sum(F.greatest("rise", F.lit(0.0)))).alias("gain"), one(F.sum(F.greatest(-F.col("rise"), F.lit(0.0)))).alias("loss"), one(F.max(F.abs("grade"))).alias("max_grade"), F.count_if(F.abs("grade") > 8).alias("steep"), F.lit(90.0).alias("resolution_m"), F.lit(16.0).alias("accuracy_m"))


def resample_count(total_m: Column) -> Column:
    """Points of an even resampling by length: a spacing of 1, 2, 5 or 10 m with a cap, 100 at least."""
    by = lambda spacing, most: F.least(F.floor(total_m / spacing), F.lit(most))
    return F.greatest(F.lit(100), F.when(total_m <= 2000, by(1.0, 2000)).when(total_m <= 5000, by(2.0, 2500)).when(total_m <= 10000, by(5.0, 2000)).otherwise(by(10.0, 1000)))


def resampled(points: DataFrame) -> DataFrame:
    """Elevations at equal distances along every route, as many as resample_count says: route_id, i, m, elevation. Routes without length have none."""
    own = points.withColumn("nm", F.lead("cum_m").over(along())).withColumn("ne", F.lead("elevation").over(along())).withColumn("total", F.max("cum_m").over(whole()))
    own = own.filter("nm > cum_m").withColumn("gap", F.col("total") / (resample_count(F.col("total")) - 1))
    last = F.lead("cum_m").over(along()).isNull()
    own = own.withColumn("lo", F.ceil(F.col("cum_m") / F.col("gap"))).withColumn("hi", F.when(last, resample_count(F.col("total")) - 1).otherwise(F.ceil(F.col("nm") / F.col("gap")) - 1)).filter("hi >= lo")
    rows = own.withColumn("i", F.explode(F.sequence("lo", "hi"))).withColumn("m", F.least(F.col("i") * F.col("gap"), F.col("total")))
    return rows.select("route_id", F.col("i").cast("long").alias("i"), "m", lerp(F.col("elevation"), F.col("ne"), F.least(F.lit(1.0), (F.col("m") - F.col("cum_m")) / (F.col("nm") - F.col("cum_m")))).alias("elevation"))


def slopes(points: DataFrame, least: float = 5.0) -> DataFrame:
    """Numbers of steps that climb and fall by more than so many percent, and the mean grade."""
    return points.groupBy("route_id").agg(F.count_if(F.col("grade") > least).alias("climbing"), F.count_if(F.col("grade") < -least).alias("falling"), F.coalesce(F.avg(F.when(F.col("d") > 0, F.col("grade"))), F.lit(0.0)).alias("mean_grade"))


def info(points: DataFrame) -> DataFrame:
    """Number of points, first and last node, and whether they are one."""
    return points.groupBy("route_id").agg(F.count(F.lit(1)).alias("length"), F.min_by("node_id", "ord").alias("start"), F.max_by("node_id", "ord").alias("end")).withColumn("is_loop", F.col("start") == F.col("end"))


def by_last_visit(points: DataFrame) -> DataFrame:
    """Every node of a route once, at its last visit: route_id, node_id, ord, d, cum_m, elevation_diff, grade along what is left."""
    last = points.groupBy("route_id", "node_id").agg(F.max("ord").alias("ord"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("elevation").alias("elevation"))
    before = lambda c: F.lag(c).over(along())
    d = F.coalesce(haversine(before("y"), before("x"), F.col("y"), F.col("x")), F.lit(0.0))
    rows = last.withColumn("d", d).withColumn("elevation_diff", F.coalesce(F.col("elevation") - before("elevation"), F.lit(0.0)))
    return rows.select("route_id", "node_id", "ord", "d", F.sum("d").over(along()).alias("cum_m"), "elevation_diff", grade_percent(F.col("elevation_diff"), F.col("d")).alias("grade"))


def spatial_summary(points: DataFrame) -> DataFrame:
    """Sums, counts by slope with their shares of the steps, grades and heights; the first point has grade 0 and counts as level."""
    g, n = F.col("grade"), F.greatest(F.count(F.lit(1)) - 1, F.lit(1))
    up, down, level = F.count_if(g > 2), F.count_if(g < -2), F.count_if(F.abs(g) <= 2)
    return points.groupBy("route_id").agg(F.sum("d").alias("distance_m"), up.alias("uphill"), down.alias("downhill"), level.alias("level"), (up / n * 100).alias("uphill_percent"), (down / n * 100).alias("downhill_percent"), (level / n * 100).alias("level_percent"), F.max(g).alias("max_grade"), F.min(g).alias("min_grade"), F.avg(g).alias("mean_grade"), F.count_if(g > 8).alias("steep_up"), F.count_if(g < -8).alias("steep_down"), F.stddev_samp("elevation").alias("std_elevation"))


def terrain_shares(points: DataFrame) -> DataFrame:
    """Every terrain class of every route with its number of points, 0 too, percent, and the route's dominant class (ties by order) and number of classes."""
    kinds = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("terrain")) for i, (_, name) in enumerate(TERRAIN)))
    every = points.select("route_id").distinct().select("route_id", F.explode(kinds).alias("k")).select("route_id", "k.i", "k.terrain")
    counted = points.groupBy("route_id", terrain(F.col("grade")).alias("terrain")).agg(F.count(F.lit(1)).alias("n"))
    own = every.join(counted, ["route_id", "terrain"], "left").fillna(0, ["n"])
    top = F.max(F.struct("n", (-F.col("i")).alias("m"), "terrain")).over(whole())["terrain"]
    return own.select("route_id", "terrain", "n", (F.col("n") / F.sum("n").over(whole()) * 100).alias("percent"), top.alias("dominant"), F.count_if(F.col("n") > 0).over(whole()).alias("classes"))


def line(points: DataFrame) -> DataFrame:
    """route_id and the closed line of its places as text: 'x y, x y, ...', six places each; routes of one place have none."""
    at = F.format_string("%.6f %.6f", "x", "y")
    rows = points.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("ord", at.alias("t")))).alias("p")).filter(F.size("p") >= 2)
    texts = F.transform("p", lambda q: q["t"])
    return rows.select("route_id", F.array_join(F.concat(texts, F.array(texts[0])), ", ").alias("line"))


def near_line(points: DataFrame, nodes: DataFrame, degree: DataFrame, metres: float = 500.0) -> DataFrame:
    """Of every route: nodes within metres / 111000 degrees of its line, those of degree over 2, and their number for each node of the route.

    Steps and nodes meet in grid cells of that size, so only what is near is compared.
    """
    r = metres / 111_000
    nxt = lambda c: F.lead(c).over(along())
    steps = points.select("route_id", F.col("x").alias("ax"), F.col("y").alias("ay"), nxt("x").alias("bx"), nxt("y").alias("by")).filter("bx is not null")
    cell = lambda c: F.floor(c / r)
    reach = steps.withColumn("cx", F.explode(F.sequence(cell(F.least("ax", "bx")) - 1, cell(F.greatest("ax", "bx")) + 1))).withColumn("cy", F.explode(F.sequence(cell(F.least("ay", "by")) - 1, cell(F.greatest("ay", "by")) + 1)))
    own = nodes.select("node_id", "x", "y").withColumn("cx", cell(F.col("x"))).withColumn("cy", cell(F.col("y")))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    share = F.when(dx * dx + dy * dy > 0, ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    ex, ey = F.col("x") - F.col("ax") - t * dx, F.col("y") - F.col("ay") - t * dy
    found = reach.join(own, ["cx", "cy"]).filter(ex * ex + ey * ey <= r * r).select("route_id", "node_id").distinct().join(degree.select("node_id", "degree"), "node_id", "left")
    size = points.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("route_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("degree") > 2).alias("intersections")).join(size, "route_id").select("route_id", "nodes", "intersections", (F.col("nodes") / F.col("n")).alias("density"))
