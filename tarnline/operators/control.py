"""Control of a search over its history (run, generation, ...): stagnation, rates' moods, convergence, restarts, filters, constraints, requests, results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of mutation strategies in general, while nothing improves, and while routes are alike (fixed values).
STRATEGIES = {"usual": {"segment_replacement": 0.4, "route_extension": 0.3, "elevation_bias": 0.2, "long_range_exploration": 0.1}, "stuck": {"segment_replacement": 0.2, "route_extension": 0.2, "elevation_bias": 0.3, "long_range_exploration": 0.3}, "alike": {"segment_replacement": 0.2, "route_extension": 0.3, "elevation_bias": 0.1, "long_range_exploration": 0.4}}
#: Objectives of requests and those of the search (fixed values).
OBJECTIVES = {"maximize_elevation": "elevation", "minimize_distance": "distance", "balanced_route": "balanced", "minimize_difficulty": "efficiency"}
STALE, DIVERSE, MOST_RATE, BASE_RATE = 10, 0.3, 0.5, 0.15


def _in_order(history: DataFrame) -> DataFrame:
    """Runs one after another, each whole in one partition and in the order of its generations, for folds that go on from batch to batch."""
    return history.repartition("run").sortWithinPartitions("run", F.asc_nulls_last("generation"))


def _run(x: float | None) -> float | None:
    return None if x != x else x


def stagnation(history: DataFrame) -> DataFrame:
    """run, generation, best and stale: generations since the best last rose by more than 0.001, or a thousandth of it if that is more. history: run, generation, best. Whether a rise counts hangs on the last one that did, so a run is read once, in order."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, top, stale = "none yet", None, 0
        for own in batches:
            out = []
            for run, best in zip(map(_run, own["run"].tolist()), own["best"].tolist(), strict=True):
                if run != last:
                    last, top, stale = run, best, 0
                elif best - top > max(0.001, abs(top) * 0.001):
                    top, stale = best, 0
                else:
                    stale += 1
                out.append(stale)
            yield own.assign(stale=out)

    own = history.select(F.col("run").cast("long"), F.col("generation").cast("long"), "best")
    return _in_order(own).mapInPandas(fold, "run long, generation long, best double, stale int")


def strategies(grid: DataFrame) -> DataFrame:
    """grid (stale, diversity, rate) with the weight of every mutation strategy and the intensity of the rate."""
    mood = F.when(F.col("diversity") < DIVERSE, "alike").when(F.col("stale") >= STALE, "stuck").otherwise("usual")
    weight = lambda s: F.when(mood == "alike", STRATEGIES["alike"][s]).when(mood == "stuck", STRATEGIES["stuck"][s]).otherwise(STRATEGIES["usual"][s]).alias(s)
    r = F.col("rate") / BASE_RATE
    intensity = F.when(r <= 1, "low").when(r <= 1.5, "medium").when(r <= 2, "high").otherwise("extreme")
    return grid.select("*", mood.alias("mood"), *(weight(s) for s in STRATEGIES["usual"]), intensity.alias("intensity"))


def trends(history: DataFrame, rate: str = "rate") -> DataFrame:
    """Trends of fitness and diversity over the last five generations, and whether a restart is due: diversity under half its threshold over ten generations, twice the patience without a gain, and nearly the largest rate. history: run, generation, best, diversity, stale, rate."""
    w = Window.partitionBy("run").orderBy("generation")
    n, last = F.row_number().over(w), F.avg("diversity").over(w.rowsBetween(-9, 0))
    told = lambda c, up, down, same: F.when(n < 5, "insufficient_data").when(F.col(c) > F.lag(c, 4).over(w), up).when(F.col(c) < F.lag(c, 4).over(w), down).otherwise(same)
    due = (n >= 10) & (last < DIVERSE / 2) & (F.col("stale") > 2 * STALE) & (F.col(rate) >= 0.9 * MOST_RATE)
    return history.select("run", "generation", told("best", "improving", "declining", "stagnant").alias("fitness_trend"), told("diversity", "increasing", "decreasing", "stable").alias("diversity_trend"), due.alias("restart"))


def converged(history: DataFrame, patience: int = 20, least: float = 0.001) -> DataFrame:
    """Whether the best fitness moved by less than a threshold over the last generations, and whether it is stale and the routes alike (stale for ten generations, diversity under 0.2)."""
    w = Window.partitionBy("run").orderBy("generation")
    last = w.rowsBetween(1 - patience, 0)
    flat = (F.count(F.lit(1)).over(last) >= patience) & (F.max("best").over(last) - F.min("best").over(last) < least)
    return history.select("run", "generation", flat.alias("flat"), ((F.col("stale") >= STALE) & (F.col("diversity") < 0.2)).alias("stuck"))


def fit_enough(scored: DataFrame, rate: float = 0.8) -> DataFrame:
    """Individuals (gen, route_id, fitness) over the larger of 0.02 and a quarter of their generation's mean, best first, a share of them; the best one if none is. refill: how many are missing to half the generation."""
    w = Window.partitionBy("gen")
    limit = F.greatest(F.lit(0.02), F.avg("fitness").over(w) * 0.25)
    own = scored.withColumn("ok", F.col("fitness") >= limit).withColumn("n", F.count(F.lit(1)).over(w))
    own = own.withColumn("rank", F.row_number().over(w.orderBy(F.desc("ok"), F.desc("fitness"), "route_id"))).withColumn("m", F.count_if("ok").over(w))
    kept = F.greatest(F.lit(1), F.floor(F.col("m") * rate))
    left = own.filter(F.col("rank") <= kept)
    return left.select("gen", "route_id", "fitness", "rank", F.greatest(F.lit(0), F.floor(F.col("n") / 2) - kept).alias("refill"))


def run_stats(history: DataFrame) -> DataFrame:
    """Of every run: generations, evaluations, first and last best, the improvement in percent, means, and the generation of the best."""
    first, last = F.min_by("best", "generation"), F.max_by("best", "generation")
    return history.groupBy("run").agg(F.count(F.lit(1)).alias("generations"), first.alias("first_best"), last.alias("last_best"), F.max("best").alias("best"), F.coalesce(F.try_divide(last - first, first) * 100, F.lit(0.0)).alias("improvement_percent"), F.avg("mean").alias("mean"), F.min_by("generation", F.struct((-F.col("best")).alias("b"), "generation")).alias("best_generation"))


def within(totals: DataFrame, start: int | Column, least_km: float, most_km: float, both_ways: bool = True) -> DataFrame:
    """route_id and whether its length is in bounds (which count), it is connected, starts and ends at the start, and, unless both ways are allowed, uses no edge twice. totals: route_id, km, is_valid, first_node, last_node, repeated."""
    start = F.lit(start) if isinstance(start, int) else start
    rows = totals.select("route_id", F.col("km").between(least_km, most_km).alias("fits"), (F.col("is_valid") & (F.col("first_node") == start) & (F.col("last_node") == start)).alias("closed"), (F.lit(both_ways) | (F.col("repeated") == 0)).alias("single"))
    return rows.withColumn("allowed", F.col("fits") & F.col("closed") & F.col("single"))


def checked(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requests (id, start, km, objective, algorithm) with errors, warnings, valid, and the objective and algorithm that the search takes."""
    known = nodes.select(F.col("node_id").alias("start"), F.lit(True).alias("_known")).distinct()
    own = requests.join(known, "start", "left")
    errors = F.array_compact(F.array(F.when(F.col("_known").isNull(), F.concat(F.lit("unknown start node "), F.coalesce(F.col("start").cast("string"), F.lit("none")))), F.when(F.coalesce(F.col("km") <= 0, F.lit(True)), "the distance must be positive"), F.when(F.col("algorithm").isNotNull() & (F.col("algorithm") != "genetic"), F.concat(F.lit("unknown algorithm "), "algorithm"))))
    warnings = F.array_compact(F.array(F.when(F.col("km") > 20, "over 20 km takes long"), F.when(F.col("objective").isNotNull() & ~F.col("objective").isin(*OBJECTIVES), F.concat(F.lit("unknown objective "), "objective"))))
    return own.select("id", "start", "km", errors.alias("errors"), warnings.alias("warnings"), objective(F.col("objective")).alias("objective"), F.lit("genetic").alias("algorithm")).withColumn("valid", F.size("errors") == 0)


def objective(asked: Column) -> Column:
    """The search's objective for a requested one; elevation for others, distance where none is asked for."""
    table = F.create_map(*(F.lit(x) for kv in OBJECTIVES.items() for x in kv))
    return F.when(asked.isNull(), "distance").otherwise(F.coalesce(F.try_element_at(table, asked), F.lit("elevation")))


def standard_nodes(walk: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes (route_id, nodes) with the first node added at the end where an edge leads there."""
    hop = edges.select(F.col("u").alias("_last"), F.col("v").alias("_first"), F.lit(True).alias("_edge")).distinct()
    own = walk.withColumn("_last", F.element_at("nodes", -1)).withColumn("_first", F.col("nodes")[0]).join(hop, ["_last", "_first"], "left")
    return own.select("route_id", F.when(F.col("_edge") & (F.col("_last") != F.col("_first")), F.concat("nodes", F.array("_first"))).otherwise(F.col("nodes")).alias("nodes"))


def coordinates(walk: DataFrame, nodes: DataFrame) -> DataFrame:
    """route_id and its places in order, as 'lat,lon' texts of six places; unknown nodes are left out."""
    rows = walk.select("route_id", F.posexplode("nodes").alias("i", "node_id")).join(nodes.select("node_id", "x", "y"), "node_id")
    lists = rows.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("i", F.format_string("%.6f,%.6f", "y", "x").alias("t")))).alias("p"))
    return lists.select("route_id", F.transform("p", lambda q: q["t"]).alias("places"))


def restart_shares(pop: DataFrame, elite: float = 0.2, explore: float = 0.4) -> DataFrame:
    """What a restart does with every individual (gen, route_id, fitness): the fittest fifth stays, the next two fifths give way to exploration, the others are changed strongly. Ties by id."""
    w = Window.partitionBy("gen")
    rank = F.row_number().over(w.orderBy(F.desc("fitness"), "route_id"))
    n = F.count(F.lit(1)).over(w)
    stays = F.greatest(F.lit(1), F.floor(n * elite))
    kind = F.when(rank <= stays, "elite").when(rank <= stays + F.floor(n * explore), "explore").otherwise("mutate")
    return pop.select("gen", "route_id", rank.alias("rank"), kind.alias("kind"))


def exploration(slots: DataFrame, peaks: DataFrame) -> DataFrame:
    """Slots (id) with a peak each (node_id), in turn from the first. peaks: node_id, place (from 0); their number is one row."""
    n = peaks.agg(F.count(F.lit(1)).alias("_n"))
    return slots.crossJoin(F.broadcast(n)).filter("_n > 0").withColumn("place", F.col("id") % F.col("_n")).join(peaks.select("place", "node_id"), "place").select("id", "node_id")


# Tuning


def evaluated(grid: DataFrame, objective_: Callable[[dict], float], constraints: list[str] | None = None) -> DataFrame:
    """Parameter rows with a score from objective(row); constraints are SQL predicates that rows have to meet. A row whose objective raises is left out."""
    for c in constraints or []:
        grid = grid.filter(c)
    from pyspark.sql.types import DoubleType, StructField, StructType

    def score(batches):
        for own in batches:
            out = []
            for row in own.to_dict("records"):
                try:
                    out.append(float(objective_(row)))
                except Exception:  # noqa: BLE001  the objective is the caller's
                    out.append(None)
            own = own.assign(score=out)
            yield own[own.score.notna()]

    return grid.mapInPandas(score, StructType([*grid.schema.fields, StructField("score", DoubleType())]))


def swept(trials: DataFrame, parameter: str) -> DataFrame:
    """Mean, spread and number of trials for every value of a parameter, and whether it is the best value. Means that agree to nine places are ties, which go to the least."""
    own = trials.groupBy(parameter).agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("spread"), F.count(F.lit(1)).alias("trials"))
    best = own.agg(F.max(F.struct(F.round("mean", 9).alias("mean"), (-F.col(parameter)).alias("m"))).alias("b")).select((-F.col("b.m")).alias("_best"))
    return own.crossJoin(F.broadcast(best)).withColumn("best", F.col(parameter) == F.col("_best")).drop("_best")  # one row


def ranking(sensitivities: DataFrame) -> DataFrame:
    """Parameters by sensitivity with what to do: over 0.7 tune with care, over 0.3 tune, else leave."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("sensitivity"), "parameter"))  # one row a parameter
    advice = F.when(F.col("sensitivity") > 0.7, "high: tune with care").when(F.col("sensitivity") > 0.3, "medium: tune").otherwise("low: leave")
    return sensitivities.select("parameter", "sensitivity", rank.alias("rank"), advice.alias("advice"))


def simulated_score(population: Column, mutation: Column, crossover: Column) -> Column:
    """A score of parameters without a search: 0.3 for a population of 50 to 150, 0.3 for a mutation rate of 0.1 to 0.2, 0.4 for a crossover rate of 0.7 to 0.9."""
    part = lambda c, lo, hi, w: F.when(c.between(lo, hi), w).otherwise(0.0)
    return part(population, 50, 150, 0.3) + part(mutation, 0.1, 0.2, 0.3) + part(crossover, 0.7, 0.9, 0.4)


def category(population: Column, diversity: Column) -> Column:
    return F.when(population < 50, "small_population").when(population > 200, "large_population").when(diversity > 0.7, "high_diversity").otherwise("low_diversity")


#: Algorithms of every category, in the order of preference (fixed values).
PREFERRED = {"small_population": ("elitism", "tournament"), "large_population": ("roulette", "rank"), "high_diversity": ("tournament", "diversity"), "low_diversity": ("elitism", "uniform")}


def performance(scores: DataFrame, alpha: float = 0.1) -> DataFrame:
    """algorithm and its exponential moving average over the scores in their order (algorithm, ord, score)."""
    rows = scores.groupBy("algorithm").agg(F.array_sort(F.collect_list(F.struct("ord", "score"))).alias("x"))
    first = F.col("x")[0]["score"]
    mean = F.aggregate(F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), first, lambda acc, s: s["score"] * alpha + acc * (1 - alpha))
    return rows.select("algorithm", mean.alias("performance"))


def selected(problems: DataFrame, known: DataFrame) -> DataFrame:
    """problems (id, population, diversity) with their category and the best of its algorithms by performance; those without any have 0, ties go to the preferred one."""
    rows = [(c, i, a) for c, own in PREFERRED.items() for i, a in enumerate(own)]
    options = problems.sparkSession.createDataFrame(rows, "category string, i int, algorithm string").join(known, "algorithm", "left").fillna(0.0, ["performance"])
    own = problems.withColumn("category", category(F.col("population"), F.col("diversity"))).join(F.broadcast(options), "category")  # eight rows
    best = own.groupBy("id", "category").agg(F.max(F.struct("performance", (-F.col("i")).alias("m"), "algorithm")).alias("x"))
    return best.select("id", "category", F.col("x.algorithm").alias("algorithm"))


class Rule:
    """A change of one parameter by so much when a condition on a row of statistics holds, at most every so many generations, within bounds. when: an SQL predicate or a function of a dict."""

    def __init__(self, parameter: str, when: Callable[[dict], bool], change: float, least: float, most: float, cooldown: int = 5) -> None:
        self.parameter, self.when, self.change, self.least, self.most, self.cooldown = parameter, when, change, least, most, cooldown


def tuned(history: DataFrame, start: dict[str, float], rules: list[Rule]) -> DataFrame:
    """run, generation and the parameters in force after every generation of a history: the rules are tried in their order; a run is read once, in order."""
    names = list(start)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, now, last = "none yet", {}, []
        for own in batches:
            rows = []
            for row in own.to_dict("records"):
                if _run(row["run"]) != run:
                    run, now, last = _run(row["run"]), dict(start), [-(10**9)] * len(rules)
                for i, rule in enumerate(rules):
                    if row["generation"] - last[i] >= rule.cooldown and rule.when(row):
                        new = min(rule.most, max(rule.least, now[rule.parameter] + rule.change))
                        if new != now[rule.parameter]:
                            now[rule.parameter], last[i] = new, row["generation"]
                rows.append((row["run"], row["generation"], *(now[n] for n in names)))
            yield pd.DataFrame(rows, columns=["run", "generation", *names])

    return _in_order(history).mapInPandas(fold, "run long, generation long, " + ", ".join(f"{n} double" for n in names))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))
