"""Fitness of routes: distance, elevation, connectivity, diversity and micro-terrain, weighted by objective."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnline.functions.geo import distance_score, elevation_score, lerp

from .segments import placed

#: Weights of distance, elevation, connectivity, diversity and micro-terrain by objective (fixed values).
WEIGHTS = {"distance": (0.6, 0.1, 0.2, 0.1, 0.0), "elevation": (0.15, 0.4, 0.2, 0.1, 0.15), "balanced": (0.25, 0.25, 0.2, 0.2, 0.1), "scenic": (0.1, 0.3, 0.15, 0.25, 0.2), "efficiency": (0.5, 0.2, 0.2, 0.1, 0.0)}
TERMS = ("distance", "elevation", "connectivity", "diversity", "micro")
SPACING, RISE, STEEP = 10.0, 2.0, 0.03


def weights(spark: SparkSession) -> DataFrame:
    """One row for each objective with the weight of every term."""
    return spark.createDataFrame([(k, *map(float, v)) for k, v in WEIGHTS.items()], "objective string, " + ", ".join(f"w_{t} double" for t in TERMS))


def connectivity(props: DataFrame) -> DataFrame:
    """route_id and connectivity: 0 for routes that aren't valid, else from 0.5 to 1 by the share of segments that start where the one before ends."""
    w = Window.partitionBy("route_id").orderBy("seg")
    rows = props.withColumn("linked", (F.col("start_node") == F.lag("end_node").over(w)).cast("int"))
    smooth = F.coalesce(0.5 + 0.5 * F.avg("linked"), F.lit(1.0))
    return rows.groupBy("route_id").agg(F.when(F.bool_and("is_valid") & F.coalesce(F.bool_and(F.col("linked") == 1), F.lit(True)), smooth).otherwise(0.0).alias("connectivity_score"))


def diversity(props: DataFrame) -> DataFrame:
    """route_id and diversity: the mean of places visited (20 are full marks, one place none) and of the share of segments whose ends aren't those of another, either way round."""
    ends = props.select("route_id", F.explode(F.array("start_node", "end_node")).alias("node")).groupBy("route_id").agg(F.count_distinct("node").alias("places"))
    used = props.groupBy("route_id", F.least("start_node", "end_node").alias("a"), F.greatest("start_node", "end_node").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    loops = used.groupBy("route_id").agg(F.greatest(F.lit(0.0), 1 - F.sum(F.col("n") - 1) / F.sum("n")).alias("loops"))
    spread = F.when(F.col("places") <= 1, 0.0).otherwise(F.least(F.lit(1.0), F.col("places") / 20))
    return ends.join(loops, "route_id").select("route_id", ((spread + F.col("loops")) / 2).alias("diversity_score"))


def profile(segments: DataFrame, nodes: DataFrame, spacing: float = SPACING) -> DataFrame:
    """Points of the routes' paths every so many metres: route_id, k (from 1), m, elevation. Joints stand once for each of their segments."""
    along = Window.partitionBy("route_id").orderBy("seg", "i")
    rows = placed(segments, nodes).withColumn("m", F.sum("d").over(along))
    rows = rows.withColumn("before_m", F.lag("m").over(along)).withColumn("before_e", F.lag("elevation").over(along))
    gap = F.col("m") - F.col("before_m")
    extra = F.when(gap > spacing, F.floor(gap / spacing)).otherwise(0)
    shares = F.transform(F.sequence(F.lit(1).cast("long"), extra), lambda j: j * F.lit(spacing) / gap)
    inner = F.when(extra > 0, F.transform(shares, lambda s: F.struct(lerp(F.col("before_m"), F.col("m"), s).alias("m"), lerp(F.col("before_e"), F.col("elevation"), s).alias("elevation")))).otherwise(F.array().cast("array<struct<m:double,elevation:double>>"))
    # places of points are known before they are made, so that the many points aren't sorted for them
    made = rows.withColumn("made", F.concat(inner, F.array(F.struct("m", "elevation")))).withColumn("before", F.sum(F.size("made")).over(along) - F.size("made"))
    points = made.select("route_id", "before", F.posexplode("made").alias("j", "p"))
    return points.select("route_id", (F.col("before") + F.col("j") + 1).cast("int").alias("k"), "p.m", "p.elevation")


def _featured(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("route_id").orderBy("k")
    e, a, b = F.col("elevation"), F.lag("elevation").over(w), F.lead("elevation").over(w)
    run = F.col("m") - F.lag("m").over(w)
    grade = F.when(run > 0, (e - a) / run).when(run.isNotNull(), 0.0)
    peak, valley = e - F.least(a, b), F.greatest(a, b) - e
    own = points.withColumn("peak", F.when((e > a) & (e > b) & (peak >= RISE), peak)).withColumn("valley", F.when((e < a) & (e < b) & (valley >= RISE), valley)).withColumn("run", run).withColumn("rise", e - a).withColumn("grade", grade)
    return own.withColumn("change", F.abs(F.col("grade") - F.lag("grade").over(w)))


def features(points: DataFrame) -> DataFrame:
    """Steps of a profile: peak and valley (height over the lower, depth under the higher neighbour; null where there is none), grade and its change, as fractions."""
    return _featured(points).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("route_id"))).filter("n >= 3").drop("n")


def feature_stats(found: DataFrame) -> DataFrame:
    up, down = F.sum(F.when(F.col("grade") > 0, F.col("grade")).otherwise(0.0)), F.sum(F.when(F.col("grade") < 0, -F.col("grade")).otherwise(0.0))
    return found.groupBy("route_id").agg(F.count("peak").alias("peaks"), F.count("valley").alias("valleys"), F.count_if(F.abs("grade") >= STEEP).alias("steep"), F.count_if(F.col("change") >= STEEP).alias("changes"), (F.max(F.abs("grade")) * 100).alias("max_grade"), (F.avg(F.abs("grade")) * 100).alias("avg_grade"), (up * F.avg("run")).alias("gain"), (down * F.avg("run")).alias("loss"))


def micro_scores(points: DataFrame) -> DataFrame:
    """route_id, peaks_score, variety_score (may pass 1), complexity_score and micro_score, their mean between 0 and 1. Profiles of fewer than three points have no peaks and no variety."""
    percent, one, n = F.abs("grade") * 100, F.lit(1.0), F.count(F.lit(1))
    peaks = F.least(F.coalesce(F.sum(F.least(F.col("peak") / 10, one)), F.lit(0.0)) / 5, one)
    variety = (F.coalesce(F.sum(F.when((F.abs("grade") >= STEEP) & percent.between(3, 15), F.least(percent / 15, one))), F.lit(0.0)) + F.least(F.count_if((F.col("change") >= STEEP) & (F.col("change") * 100 >= 3)) / 10, one)) / 2
    shape = (F.least(F.stddev_pop("elevation") / 20, one) + F.least((F.max("elevation") - F.min("elevation")) / 100, one) + F.least(F.var_pop("rise") / 5, one)) / 3
    # one pass over the profile
    joined = _featured(points).groupBy("route_id").agg(F.when(n < 2, 0.0).otherwise(shape).alias("complexity_score"), F.when(n >= 3, peaks).otherwise(0.0).alias("peaks_score"), F.when(n >= 3, variety).otherwise(0.0).alias("variety_score")).fillna(0.0, ["peaks_score", "variety_score"])
    return joined.withColumn("micro_score", F.greatest(F.lit(0.0), F.least(one, (F.col("peaks_score") + F.col("variety_score") + F.col("complexity_score")) / 3)))


def terms(totals: DataFrame, props: DataFrame, points: DataFrame, target_km: float) -> DataFrame:
    """route_id, km, is_valid and the five terms of every route."""
    own = totals.select("route_id", "km", "is_valid", distance_score(F.col("km"), target_km).alias("distance_score"), elevation_score(F.col("gain"), F.col("max_grade")).alias("elevation_score"))
    return own.join(connectivity(props), "route_id").join(diversity(props), "route_id").join(micro_scores(points).select("route_id", "micro_score"), "route_id")


def combine(target_km: float, term: dict[str, Column], weight: dict[str, Column | float]) -> Column:
    """Weighted terms, 1 at most; outside 15 percent of the target a tenth of the terms other than distance, 0.05 at most. term has km too."""
    rest = sum((weight[t] * term[t] for t in TERMS[1:]), F.lit(0.0))
    inside = F.abs(term["km"] - target_km) <= 0.15 * target_km
    return F.when(inside, F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight["distance"] * term["distance"] + rest))).otherwise(F.least(F.lit(0.05), 0.1 * rest))


def evaluate(scored: DataFrame, target_km: float, by: DataFrame) -> DataFrame:
    """route_id, objective and fitness for every route (rows of terms()) and objective (rows of weights()); routes that aren't valid get 0."""
    term = {t: F.col(f"{t}_score") for t in TERMS} | {"km": F.col("km")}
    both = scored.crossJoin(F.broadcast(by))  # five rows
    value = combine(target_km, term, {t: F.col(f"w_{t}") for t in TERMS})
    return both.select("route_id", "objective", F.when(F.col("is_valid"), value).otherwise(0.0).alias("fitness"))


def history_stats(series: DataFrame, value: str = "fitness", units: int = 100_000) -> DataFrame:
    """For every point of a history (route_id, ord, value): mean, least and spread so far, the recent improvement (mean of the last 10 less that of the 10 before, those 0 where there are fewer than 20; 0 for fewer than 10) and whether it is a plateau (10 points at least, improvement under 0.001).

    Values count in whole units (hundred-thousandths), so that sums are exact in any order and each figure is divided once.
    """
    far = Window.partitionBy("route_id").orderBy("ord")
    so_far = far.rowsBetween(Window.unboundedPreceding, 0)
    own = series.withColumn("v", F.round(F.col(value) * units).cast("long"))
    n, total, squares = F.count("v").over(so_far), F.sum("v").over(so_far), F.sum(F.col("v") * F.col("v")).over(so_far)
    last, before = F.sum("v").over(far.rowsBetween(-9, 0)), F.sum("v").over(far.rowsBetween(-19, -10))
    tens = 10.0 * units
    out = own.select("route_id", "ord", (total / (n * units)).alias("mean"), (F.min("v").over(so_far) / units).alias("least"), (F.sqrt((n * squares - total * total).cast("double")) / (n * units)).alias("spread"), n.alias("n"), F.when(n < 10, 0.0).when(n < 20, last / tens).otherwise((last - before) / tens).alias("improvement"))
    return out.withColumn("plateau", (F.col("n") >= 10) & (F.abs("improvement") < 0.001)).drop("n")
