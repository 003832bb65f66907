"""Search control: adaptive mutation rates, population sizes, random search and sensitivity of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import draw

#: Base, least and largest mutation rate, generations without a gain and diversity from which it is raised (fixed values).
BASE, LEAST, MOST, STALE, DIVERSE = 0.15, 0.05, 0.5, 10, 0.3


def adaptive_rate(diversity: Column, stale: Column, decay: Column) -> Column:
    """Mutation rate: raised while nothing improves, while routes are alike, and twice when both; then decayed and clamped."""
    stuck, alike = stale >= STALE, diversity < DIVERSE
    rate = F.lit(BASE) * F.when(stuck, F.least(F.lit(1.5), 1 + (stale - STALE) * 0.1)).otherwise(1.0)
    rate = rate * F.when(alike, 1 + (DIVERSE - diversity) * 1.8).otherwise(1.0) * F.when(stuck & alike, 2.0).otherwise(1.0) * decay
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), rate))


def adaptive_rate_value(diversity: float, stale: int, generation: int) -> float:
    """The same for one generation on the driver."""
    rate = BASE * (min(1.5, 1 + (stale - STALE) * 0.1) if stale >= STALE else 1) * (1 + (DIVERSE - diversity) * 1.8 if diversity < DIVERSE else 1)
    return max(LEAST, min(MOST, rate * (2 if stale >= STALE and diversity < DIVERSE else 1) * 0.95**generation))


def adapted_sizes(km: float, population: int, generations: int) -> tuple[int, int, int, int]:
    """Population, generations, elite and tournament for a distance."""
    if km < 3:
        population, generations = max(50, population // 2), max(100, generations // 2)
    elif km > 20:
        population, generations = max(30, population // 3), max(50, generations // 2)
    elif km > 8:
        population, generations = min(200, int(population * 1.5)), min(500, int(generations * 1.5))
    return population, generations, max(5, population // 10), max(3, population // 20)


def sizes_for(km: Column, population: int = 100, generations: int = 200) -> list[Column]:
    """adapted_sizes as columns, of a column of distances: population, generations, elite, tournament."""
    kinds = [adapted_sizes(d, population, generations) for d in (1.0, 21.0, 9.0, 5.0)]
    pick = lambda i: F.when(km < 3, kinds[0][i]).when(km > 20, kinds[1][i]).when(km > 8, kinds[2][i]).otherwise(kinds[3][i])
    return [pick(i).alias(n) for i, n in enumerate(("population", "generations", "elite", "tournament"))]


def sampled(range_: Column, share: Column, kind: str) -> Column:
    """A value of a parameter for a share from 0 to 1 (exclusive): whole (low and high count), number, or list (an array of values)."""
    if kind == "list":
        return F.element_at(range_, (F.floor(share * F.size(range_)) + 1).cast("int"))
    low, high = range_["low"], range_["high"]
    return low + F.floor(share * (high - low + 1)) if kind == "whole" else low + share * (high - low)


def random_search(spark: SparkSession, ranges: dict[str, tuple[float, float]], n: int, seed: int = 42) -> DataFrame:
    """n points drawn evenly from the ranges."""
    return spark.range(n).select("id", *((F.lit(float(a)) + draw("id", F.lit(seed), F.lit(k)) * float(b - a)).alias(k) for k, (a, b) in ranges.items()))


def sensitivity(trials: DataFrame, by: str, parameter: str, value: str) -> DataFrame:
    """How much a parameter matters: absolute correlation with the value (0 where either doesn't vary), and the range of it in the best tenth of the trials."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), parameter))
    own = trials.withColumn("_rank", rank).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    top = F.when(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10)), F.col(parameter))
    c = F.abs(F.corr(parameter, value))
    return own.groupBy(by).agg(F.round(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), 6).alias("sensitivity"), F.min(top).alias("low"), F.max(top).alias("high"))
