"""Queries over the control of a search and its tuning; importing this adds them to tarnline.plans.queries.

The route profiles stand for histories: a route is a run, a point a generation, and what is measured there its statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnline.operators import control as C
from tarnline.operators import segments as SG
from tarnline.plans.evolution import POP, population
from tarnline.plans.population import MD5, TOTALS, WALK, digest, props, r, rounded, walks
from tarnline.plans.queries import _DEG, NET, NODE, PT, ROUTE, START, add, keeper
from tarnline.sources import roads
from tarnline.streaming import progress

HIST = "hs AS (SELECT route_id AS run, CAST(ord AS BIGINT) AS generation, least(1, ord / 60) * 0.7::DOUBLE + (elevation % 7) / 700 AS best, abs(grade) / 100 AS diversity, rise AS mean FROM pt)"
STALE = """st(run, generation, best, top, stale) AS (SELECT run, generation, best, best, 0 FROM hs WHERE generation = 1 UNION ALL SELECT hs.run, hs.generation, hs.best, CASE WHEN hs.best - st.top > greatest(0.001::DOUBLE, abs(st.top) * 0.001::DOUBLE) THEN hs.best ELSE st.top END, CASE WHEN hs.best - st.top > greatest(0.001::DOUBLE, abs(st.top) * 0.001::DOUBLE) THEN 0 ELSE st.stale + 1 END FROM st JOIN hs ON hs.run = st.run AND hs.generation = st.generation + 1)"""
_H = PT.replace("WITH ", "WITH RECURSIVE ", 1) + f", {HIST}, {STALE}, hh AS (SELECT hs.*, stale, CASE WHEN hs.generation % 3 = 0 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS rate FROM hs JOIN st USING (run, generation))"


def history(spark: SparkSession, sf: str) -> DataFrame:
    best = F.least(F.lit(1.0), F.col("ord") / 60) * 0.7 + (F.col("elevation") % 7) / 700
    return roads.points(spark, sf).select(F.col("route_id").alias("run"), F.col("ord").cast("long").alias("generation"), best.alias("best"), (F.abs("grade") / 100).alias("diversity"), F.col("rise").alias("mean"))


def full_history(spark: SparkSession, sf: str) -> DataFrame:
    own = keeper(spark)(history(spark, sf))
    return own.join(C.stagnation(own).select("run", "generation", "stale"), ["run", "generation"]).withColumn("rate", F.when(F.col("generation") % 3 == 0, 0.5).otherwise(0.2))


@add("stagnation", _H + " SELECT run, generation, round(best, 6) AS best, stale FROM st")
def stagnation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.stagnation(history(spark, sf)))


@add("search_progress", _H + ", pg AS (SELECT run, generation, best, top, stale, avg(best) OVER (PARTITION BY run ORDER BY generation ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean FROM st) SELECT run, generation, round(best, 6) AS best, round(top, 6) AS top, stale, round(mean, 6) AS mean, CASE WHEN stale = 0 THEN 'rising' WHEN stale >= 10 THEN 'stuck' ELSE 'waiting' END AS state FROM pg")
def search_progress(spark: SparkSession, sf: str) -> DataFrame:
    """The progress of every history; a stream of the same rows gives the same (see streaming.progress)."""
    return rounded(progress.progress(history(spark, sf)))


@add("mutation_strategies", _H + ", ms AS (SELECT run, generation, CASE WHEN diversity < 0.3 THEN 'alike' WHEN stale >= 10 THEN 'stuck' ELSE 'usual' END AS mood, rate / 0.15::DOUBLE AS over FROM hh) SELECT run, generation, mood, CASE mood WHEN 'alike' THEN 0.2::DOUBLE WHEN 'stuck' THEN 0.2 ELSE 0.4 END AS segment_replacement, CASE mood WHEN 'alike' THEN 0.3::DOUBLE WHEN 'stuck' THEN 0.2 ELSE 0.3 END AS route_extension, CASE mood WHEN 'alike' THEN 0.1::DOUBLE WHEN 'stuck' THEN 0.3 ELSE 0.2 END AS elevation_bias, CASE mood WHEN 'alike' THEN 0.4::DOUBLE WHEN 'stuck' THEN 0.3 ELSE 0.1 END AS long_range_exploration, CASE WHEN over <= 1 THEN 'low' WHEN over <= 1.5 THEN 'medium' WHEN over <= 2 THEN 'high' ELSE 'extreme' END AS intensity FROM ms")
def mutation_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """The mood of every generation of every history, with its weights."""
    return C.strategies(full_history(spark, sf)).drop("best", "diversity", "mean", "stale", "rate")


@add("search_trends", _H + ", tr AS (SELECT *, row_number() OVER w AS n, lag(best, 4) OVER w AS b4, lag(diversity, 4) OVER w AS d4, avg(diversity) OVER (PARTITION BY run ORDER BY generation ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM hh WINDOW w AS (PARTITION BY run ORDER BY generation)) SELECT run, generation, CASE WHEN n < 5 THEN 'insufficient_data' WHEN best > b4 THEN 'improving' WHEN best < b4 THEN 'declining' ELSE 'stagnant' END AS fitness_trend, CASE WHEN n < 5 THEN 'insufficient_data' WHEN diversity > d4 THEN 'increasing' WHEN diversity < d4 THEN 'decreasing' ELSE 'stable' END AS diversity_trend, n >= 10 AND l < 0.15::DOUBLE AND stale > 20 AND rate >= 0.45::DOUBLE AS restart FROM tr")
def search_trends(spark: SparkSession, sf: str) -> DataFrame:
    return C.trends(full_history(spark, sf))


_L20 = "(PARTITION BY run ORDER BY generation ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@add("convergence", _H + f" SELECT run, generation, count(*) OVER {_L20} >= 20 AND max(best) OVER {_L20} - min(best) OVER {_L20} < 0.001::DOUBLE AS flat, stale >= 10 AND diversity < 0.2::DOUBLE AS stuck FROM hh")
def convergence(spark: SparkSession, sf: str) -> DataFrame:
    return C.converged(full_history(spark, sf))


@add("population_filter", POP + ", pf AS (SELECT gen, route_id, fitness, fitness >= greatest(0.02::DOUBLE, avg(fitness) OVER (PARTITION BY gen) * 0.25::DOUBLE) AS ok, count(*) OVER (PARTITION BY gen) AS n FROM po), pg AS (SELECT *, row_number() OVER (PARTITION BY gen ORDER BY ok DESC, fitness DESC, route_id) AS rank, greatest(1, CAST(floor(count(*) FILTER (ok) OVER (PARTITION BY gen) * 0.8::DOUBLE) AS BIGINT)) AS kept FROM pf) SELECT gen, route_id, round(fitness, 6) AS fitness, rank, greatest(0, n // 2 - kept) AS refill FROM pg WHERE rank <= kept")
def population_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.fit_enough(population(spark, sf).select("gen", "route_id", "fitness")))


@add("run_stats", _H + ", rs AS (SELECT run, count(*) AS generations, arg_min(best, generation) AS first_best, arg_max(best, generation) AS last_best, max(best) AS best, avg(mean) AS mean, arg_max(generation, (best, -generation)) AS best_generation FROM hs GROUP BY run), ri AS (SELECT *, (last_best - first_best) / first_best * 100 AS improvement_percent FROM rs) SELECT run, generations, " + r("first_best last_best best improvement_percent mean") + ", best_generation FROM ri")
def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.run_stats(history(spark, sf)))


@add("route_constraints", TOTALS + ", rc AS (SELECT route_id, min_by(start_node, seg) AS f, max_by(end_node, seg) AS l FROM pr GROUP BY route_id), ru AS (SELECT route_id, sum(n - 1) AS rep FROM (SELECT route_id, count(*) AS n FROM pr GROUP BY route_id, least(start_node, end_node), greatest(start_node, end_node)) GROUP BY route_id), rv AS (SELECT route_id, km BETWEEN 5 AND 9 AS fits, is_valid AND f = l AS closed, rep = 0 AS single FROM tt JOIN rc USING (route_id) JOIN ru USING (route_id)) SELECT *, fits AND closed AND single AS allowed FROM rv")
def route_constraints(spark: SparkSession, sf: str) -> DataFrame:
    own = keeper(spark)(props(spark, sf))
    ends = own.groupBy("route_id").agg(F.min_by("start_node", "seg").alias("first_node"), F.max_by("end_node", "seg").alias("last_node"))
    used = own.groupBy("route_id", F.least("start_node", "end_node").alias("a"), F.greatest("start_node", "end_node").alias("b")).agg(F.count(F.lit(1)).alias("n")).groupBy("route_id").agg(F.sum(F.col("n") - 1).alias("repeated"))
    return C.within(SG.route_totals(own).join(ends, "route_id").join(used, "route_id"), F.col("first_node"), 5.0, 9.0, both_ways=False)


@add("checked_requests", f"WITH {NODE}, rq AS (SELECT event_id AS id, event_id % 3000 AS start, value - 5 AS km, CASE event_id % 5 WHEN 0 THEN 'maximize_elevation' WHEN 1 THEN 'balanced_route' WHEN 2 THEN 'fastest' WHEN 3 THEN 'minimize_difficulty' END AS objective, CASE event_id % 4 WHEN 0 THEN 'genetic' WHEN 1 THEN 'tsp' END AS algorithm FROM events), rn AS (SELECT rq.*, node_id IS NOT NULL AS known FROM rq LEFT JOIN node ON node_id = start) SELECT id, array_to_string(list_filter([CASE WHEN NOT known THEN 'unknown start node ' || start END, CASE WHEN km <= 0 THEN 'the distance must be positive' END, CASE WHEN algorithm <> 'genetic' THEN 'unknown algorithm ' || algorithm END], lambda e: e IS NOT NULL), '; ') AS errors, array_to_string(list_filter([CASE WHEN km > 20 THEN 'over 20 km takes long' END, CASE WHEN objective = 'fastest' THEN 'unknown objective fastest' END], lambda e: e IS NOT NULL), '; ') AS warnings, CASE objective WHEN 'maximize_elevation' THEN 'elevation' WHEN 'balanced_route' THEN 'balanced' WHEN 'minimize_difficulty' THEN 'efficiency' WHEN 'fastest' THEN 'elevation' ELSE 'distance' END AS objective, known AND km > 0 AND coalesce(algorithm, 'genetic') = 'genetic' AS valid FROM rn")
def checked_requests(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    rows = spark.read.parquet(f"{sf}/events.parquet").select(k.alias("id"), (k % 3000).alias("start"), (F.col("value") - 5).alias("km"), F.when(k % 5 == 0, "maximize_elevation").when(k % 5 == 1, "balanced_route").when(k % 5 == 2, "fastest").when(k % 5 == 3, "minimize_difficulty").alias("objective"), F.when(k % 4 == 0, "genetic").when(k % 4 == 1, "tsp").alias("algorithm"))
    return C.checked(rows, roads.nodes(spark, sf)).select("id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "objective", "valid")


@add("standard_routes", f"{NET}, {ROUTE}, {WALK}, sr AS (SELECT route_id, CASE WHEN EXISTS (FROM edge WHERE u = nodes[-1] AND v = nodes[1]) THEN nodes || [nodes[1]] ELSE nodes END AS child FROM wk) SELECT route_id, len(child) AS n, {MD5.format('child')} AS digest FROM sr")
def standard_routes(spark: SparkSession, sf: str) -> DataFrame:
    return C.standard_nodes(walks(spark, sf), roads.edges(spark, sf)).select("route_id", F.size("nodes").cast("long").alias("n"), digest("nodes").alias("digest"))


@add("route_coordinates", f"WITH {NODE}, {ROUTE} SELECT route_id, count(*) AS n, md5(string_agg(printf('%.6f,%.6f', y, x), ' ' ORDER BY ord)) AS digest FROM route JOIN node USING (node_id) GROUP BY route_id")
def route_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    found = C.coordinates(walks(spark, sf), roads.nodes(spark, sf))
    return found.select("route_id", F.size("places").cast("long").alias("n"), F.md5(F.array_join("places", " ").cast("binary")).alias("digest"))


@add("restart_shares", POP + ", rr AS (SELECT gen, route_id, row_number() OVER (PARTITION BY gen ORDER BY fitness DESC, route_id) AS rank, count(*) OVER (PARTITION BY gen) AS n FROM po) SELECT gen, route_id, rank, CASE WHEN rank <= greatest(1, floor(n * 0.2::DOUBLE)) THEN 'elite' WHEN rank <= greatest(1, floor(n * 0.2::DOUBLE)) + floor(n * 0.4::DOUBLE) THEN 'explore' ELSE 'mutate' END AS kind FROM rr")
def restart_shares(spark: SparkSession, sf: str) -> DataFrame:
    return C.restart_shares(population(spark, sf))


@add("exploration_targets", f"WITH {NODE}, {ROUTE}, pk AS (SELECT node_id, row_number() OVER (ORDER BY elevation DESC, node_id) - 1 AS place FROM (SELECT node_id, elevation FROM node WHERE elevation > (SELECT elevation FROM node WHERE node_id = {START}) + 40 AND node_id <> {START} AND node_id NOT IN (SELECT node_id FROM route) ORDER BY elevation DESC, node_id LIMIT 20)) SELECT s.id, node_id FROM range(50) s(id) JOIN pk ON pk.place = s.id % (SELECT count(*) FROM pk)")
def exploration_targets(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    from tarnline.operators.search import unexplored_peaks

    found = unexplored_peaks(roads.nodes(spark, sf), roads.routes(spark, sf), START)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("elevation"), "node_id")) - 1  # twenty rows at most
    return C.exploration(spark.range(50), found.withColumn("place", place.cast("long")))


_GRID = "SELECT DISTINCT CAST(l_quantity AS BIGINT) * 5 AS population, l_tax * 2.5::DOUBLE AS mutation, 0.6::DOUBLE + l_discount * 4.0::DOUBLE AS crossover FROM lineitem"


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    """The settings of parameters that occur, each once: line items stand for settings."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    return items.select((F.col("l_quantity").cast("long") * 5).alias("population"), (F.col("l_tax") * 2.5).alias("mutation"), (F.lit(0.6) + F.col("l_discount") * 4.0).alias("crossover")).distinct()


_SIM = "CASE WHEN population BETWEEN 50 AND 150 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN mutation BETWEEN 0.1::DOUBLE AND 0.2::DOUBLE THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN crossover BETWEEN 0.7::DOUBLE AND 0.9::DOUBLE THEN 0.4::DOUBLE ELSE 0 END"


@add("simulated_scores", f"SELECT *, round({_SIM}, 6) AS score FROM ({_GRID})")
def simulated_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_grid(spark, sf).withColumn("score", C.simulated_score(F.col("population"), F.col("mutation"), F.col("crossover"))))


@add("evaluated_parameters", f"SELECT *, round(population * mutation + crossover, 6) AS score FROM ({_GRID}) WHERE population * mutation >= 5 AND crossover <= 0.9::DOUBLE AND population <> 75")
def evaluated_parameters(spark: SparkSession, sf: str) -> DataFrame:
    def score(p: dict) -> float:
        if p["population"] == 75:
            raise ValueError("not evaluated")
        return p["population"] * p["mutation"] + p["crossover"]

    return rounded(C.evaluated(_grid(spark, sf), score, ["population * mutation >= 5", "crossover <= 0.9"]))


@add("parameter_sweep", f"WITH t AS (SELECT *, {_SIM} AS score FROM ({_GRID})), s AS (SELECT population, avg(score) AS mean, stddev_pop(score) AS spread, count(*) AS trials FROM t GROUP BY population) SELECT population, round(mean, 9) AS mean, round(spread, 9) AS spread, trials, population = (SELECT arg_max(population, (round(mean, 9), -population)) FROM s) AS best FROM s")
def parameter_sweep(spark: SparkSession, sf: str) -> DataFrame:
    trials = _grid(spark, sf).withColumn("score", C.simulated_score(F.col("population"), F.col("mutation"), F.col("crossover")))
    return rounded(C.swept(trials.withColumn("score", F.round("score", 9)), "population"), 9)


@add("sensitivity_ranking", "WITH s AS (SELECT event_type AS parameter, round(coalesce(abs(corr(value, user_id)), 0), 6) AS sensitivity FROM events GROUP BY event_type) SELECT parameter, sensitivity, row_number() OVER (ORDER BY sensitivity DESC, parameter) AS rank, CASE WHEN sensitivity > 0.7 THEN 'high: tune with care' WHEN sensitivity > 0.3 THEN 'medium: tune' ELSE 'low: leave' END AS advice FROM s")
def sensitivity_ranking(spark: SparkSession, sf: str) -> DataFrame:
    from tarnline.operators.tuning import sensitivity

    found = sensitivity(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "user_id", "value")
    return C.ranking(found.select(F.col("event_type").alias("parameter"), "sensitivity"))


@add("algorithm_choice", "WITH RECURSIVE a AS (SELECT ['elitism', 'tournament', 'roulette', 'rank', 'diversity'][1 + event_id % 5] AS algorithm, event_id AS ord, value / 100 AS score FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY ord) AS i FROM a), f AS (SELECT algorithm, i, score AS p FROM n WHERE i = 1 UNION ALL SELECT n.algorithm, n.i, n.score * 0.1::DOUBLE + f.p * (1 - 0.1::DOUBLE) FROM f JOIN n ON n.algorithm = f.algorithm AND n.i = f.i + 1), k AS (SELECT algorithm, arg_max(p, i) AS performance FROM f GROUP BY algorithm), o(category, i, algorithm) AS (VALUES ('small_population', 0, 'elitism'), ('small_population', 1, 'tournament'), ('large_population', 0, 'roulette'), ('large_population', 1, 'rank'), ('high_diversity', 0, 'tournament'), ('high_diversity', 1, 'diversity'), ('low_diversity', 0, 'elitism'), ('low_diversity', 1, 'uniform')), q AS (SELECT event_id AS id, CASE WHEN event_id % 300 < 50 THEN 'small_population' WHEN event_id % 300 > 200 THEN 'large_population' WHEN value / 100 > 0.7 THEN 'high_diversity' ELSE 'low_diversity' END AS category FROM events) SELECT id, category, arg_max(o.algorithm, (coalesce(performance, 0), -i)) AS algorithm FROM q JOIN o USING (category) LEFT JOIN k ON k.algorithm = o.algorithm GROUP BY id, category")
def algorithm_choice(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    events = spark.read.parquet(f"{sf}/events.parquet")
    names = F.array(*map(F.lit, ("elitism", "tournament", "roulette", "rank", "diversity")))
    scores = events.select(F.element_at(names, (k % 5 + 1).cast("int")).alias("algorithm"), k.alias("ord"), (F.col("value") / 100).alias("score"))
    problems = events.select(k.alias("id"), (k % 300).alias("population"), (F.col("value") / 100).alias("diversity"))
    return C.selected(problems, C.performance(scores))


@add("tuned_parameters")
def tuned_parameters(spark: SparkSession, sf: str) -> DataFrame:
    rules = [C.Rule("mutation", lambda s: s["stale"] >= 5, 0.05, 0.01, 0.5), C.Rule("population", lambda s: s["generation"] > 50 and s["diversity"] > 0.08, -10, 50, 300)]
    return C.tuned(full_history(spark, sf), {"mutation": 0.15, "population": 100.0}, rules)


@add("scalar_helpers", "SELECT event_id, round(greatest(0, least(1, (value - 50) / 40)), 6) AS clamped, round(CASE WHEN event_id % 10 = 0 THEN -1 ELSE value / (event_id % 10) END, 6) AS divided FROM events")
def scalar_helpers(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet")
    return rounded(rows.select("event_id", C.clamp((F.col("value") - 50) / 40).alias("clamped"), C.safe_divide(F.col("value"), F.col("event_id") % 10, -1.0).alias("divided")))
