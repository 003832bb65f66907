"""Likeness of routes, selection and archives, over populations (gen, route_id, ...).

A population is a generation of bounded size (a parameter of a search, never of the data), so pairs are made within
generations: their number is linear in the number of generations. Greedy choices, which depend on what is chosen
already, are made per generation in pandas.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the parts of combined diversity (fixed values).
SPATIAL, ELEVATION, SEGMENT = 0.4, 0.3, 0.3


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 less the share of common members of two arrays taken as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def _apart(what: str) -> Column:
    """jaccard_distance() of arrays without repeats from the number of members that they share: the union follows from the sizes."""
    shared = F.col(f"shared_{what}")
    union = F.size(f"a_{what}") + F.size(f"b_{what}") - shared
    return F.when(union == 0, 0.0).otherwise(1 - shared / union)


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(a, b, F.lit(1.0))


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two node lists differ; beyond the shorter one all do."""
    same = F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x).cast("long")


def edge_set(nodes: Column) -> Column:
    """Unordered steps of a node list, as an array of 'low-high'."""
    steps = F.transform(F.sequence(F.lit(1), F.size(nodes) - 1), lambda i: F.concat_ws("-", F.least(nodes[i - 1], nodes[i]).cast("string"), F.greatest(nodes[i - 1], nodes[i]).cast("string")))
    return F.when(F.size(nodes) > 1, F.array_distinct(steps)).otherwise(F.array().cast("array<string>"))


def pairs(pop: DataFrame) -> DataFrame:
    """gen, a < b and the distances of all pairs within a generation: spatial, segment, elevation, combined, hamming. pop: gen, route_id, nodes, km, gain."""
    own = pop.select("gen", "route_id", "nodes", F.array_distinct("nodes").alias("set"), edge_set(F.col("nodes")).alias("steps"), "km", "gain")
    side = lambda s: own.select("gen", *(F.col(c).alias(f"{s}_{c}") for c in own.columns[1:]))
    both = side("a").join(side("b"), "gen").filter("a_route_id < b_route_id").withColumns({f"shared_{c}": F.size(F.array_intersect(f"a_{c}", f"b_{c}")) for c in ("set", "steps")})
    parts = both.select(
        "gen", F.col("a_route_id").alias("a"), F.col("b_route_id").alias("b"), _apart("set").alias("spatial"), _apart("steps").alias("segment"),
        ((relative_difference(F.col("a_gain"), F.col("b_gain")) + relative_difference(F.col("a_km"), F.col("b_km"))) / 2).alias("elevation"), hamming(F.col("a_nodes"), F.col("b_nodes")).alias("hamming"),
    )
    return parts.withColumn("combined", SPATIAL * F.col("spatial") + ELEVATION * F.col("elevation") + SEGMENT * F.col("segment"))


def novelty(found: DataFrame, pop: DataFrame, k: int = 15, distance: str = "combined") -> DataFrame:
    """gen, route_id and novelty: the mean of the k largest distances to the others of the generation; 1 for one that is alone."""
    both = found.select("gen", F.explode(F.array("a", "b")).alias("route_id"), distance)
    ranked = both.withColumn("i", F.row_number().over(Window.partitionBy("gen", "route_id").orderBy(F.desc(distance)))).filter(F.col("i") <= k)
    mean = ranked.groupBy("gen", "route_id").agg(F.avg(distance).alias("novelty"))
    return pop.select("gen", "route_id").join(mean, ["gen", "route_id"], "left").fillna(1.0, ["novelty"])


def archive(scored: DataFrame, least: float = 0.5, size: int = 100) -> DataFrame:
    """The last routes, in the order of generations and ids, whose novelty is over a threshold; older ones have left."""
    return scored.filter(F.col("novelty") > least).orderBy(F.desc("gen"), F.desc("route_id")).limit(size)


def diversity_history(found: DataFrame, distance: str = "combined", window: int = 10) -> DataFrame:
    """gen, mean, least and most distance of its pairs, over the last generations the mean of the means, their trend (slope over the last five; 0 for fewer than three) and stability (1 / (1 + their variance); 1 for fewer than three)."""
    own = found.groupBy("gen").agg(F.avg(distance).alias("mean"), F.min(distance).alias("least"), F.max(distance).alias("most"))
    line = Window.partitionBy(F.lit(0)).orderBy("gen")  # one row for each generation of a search
    last, five = line.rowsBetween(1 - window, 0), line.rowsBetween(-4, 0)
    n = F.count(F.lit(1)).over(last)
    place = F.row_number().over(line).cast("double")
    own = own.withColumn("place", place)
    trend = F.when(F.count(F.lit(1)).over(five) < 3, 0.0).otherwise(F.regr_slope("mean", "place").over(five))
    return own.select("gen", "mean", "least", "most", F.avg("mean").over(last).alias("recent"), trend.alias("trend"), F.when(n < 3, 1.0).otherwise(1 / (1 + F.var_samp("mean").over(last))).alias("stability"))


def threshold(base: Column | float, generation: Column) -> Column:
    """The diversity asked for in a generation: higher in the first ten, lower after the fiftieth, half at the least."""
    base = F.lit(base) if isinstance(base, float) else base
    return F.when(generation < 10, base * (1.5 - generation / 20)).when(generation > 50, base * F.greatest(F.lit(0.5), 1 - (generation - 50) / 100)).otherwise(base)


def elite(pop: DataFrame, k: int) -> DataFrame:
    """The k fittest of every generation (gen, route_id, fitness, rank); ties by id."""
    rank = F.row_number().over(Window.partitionBy("gen").orderBy(F.desc("fitness"), "route_id"))
    return pop.select("gen", "route_id", "fitness", rank.alias("rank")).filter(F.col("rank") <= k)


def tournaments(pop: DataFrame, n: int, k: int, draw) -> DataFrame:
    """gen, tournament and winner: the fittest (ties by id) of the k individuals with the least draws. draw(id, tournament) makes a column of sortable draws."""
    rounds = pop.withColumn("tournament", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = rounds.withColumn("i", F.row_number().over(Window.partitionBy("gen", "tournament").orderBy(draw(F.col("route_id"), F.col("tournament")), "route_id"))).filter(F.col("i") <= k)
    return drawn.groupBy("gen", "tournament").agg(F.max_by("route_id", F.struct(F.coalesce("fitness", F.lit(0.0)), -F.col("route_id"))).alias("winner"))


def weighted_choice(options: DataFrame, by: str, choice: str, weight: str, u: str) -> DataFrame:
    """Of every group one option: the first, in the order of the options, at which the running weight reaches u times the whole. Without any weight all count alike."""
    w = Window.partitionBy(by)
    even = options.withColumn("_w", F.when(F.sum(weight).over(w) > 0, F.col(weight).cast("double")).otherwise(1.0))
    running = even.withColumn("_r", F.sum("_w").over(w.orderBy(choice))).withColumn("_t", F.sum("_w").over(w))
    return running.filter(F.col("_r") >= F.col(u) * F.col("_t")).groupBy(by).agg(F.min(choice).alias(choice))


def _distances(nodes: list, km: list, gain: list):
    """The combined distance and the Hamming distance of two members of a generation, by their places in it."""
    sets = [set(x) for x in nodes]
    steps = [{(min(p), max(p)) for p in zip(x, x[1:], strict=False)} for x in nodes]
    apart = lambda a, b: 1 - len(a & b) / len(a | b) if a | b else 0.0
    differ = lambda a, b: abs(a - b) / max(a, b, 1.0)

    def combined(i: int, j: int) -> float:
        return SPATIAL * apart(sets[i], sets[j]) + ELEVATION * (differ(gain[i], gain[j]) + differ(km[i], km[j])) / 2 + SEGMENT * apart(steps[i], steps[j])

    def positions(i: int, j: int) -> int:
        a, b = nodes[i], nodes[j]
        return sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))

    return apart, sets, combined, positions


def greedy_spread(pop: DataFrame, size: int) -> DataFrame:
    """gen, route_id and rank: the fittest, then in turn the one with the largest mean Jaccard distance of node sets to those chosen; ties by id. pop: gen, route_id, nodes, km, gain, fitness."""

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("route_id").reset_index(drop=True)
        apart, sets, _, _ = _distances(*([list(x) for x in own.nodes] if c == "nodes" else own[c].tolist() for c in ("nodes", "km", "gain")))
        fit = own.fitness.fillna(0.0).tolist()
        chosen = [max(range(len(own)), key=lambda i: (fit[i], -i))]
        while len(chosen) < min(size, len(own)):
            left = [i for i in range(len(own)) if i not in chosen]
            chosen.append(max(left, key=lambda i: (sum(apart(sets[i], sets[j]) for j in chosen) / len(chosen), -i)))
        return pd.DataFrame({"gen": own.gen.iloc[0], "route_id": own.route_id.iloc[chosen].tolist(), "rank": range(1, len(chosen) + 1)})

    return pop.select("gen", "route_id", "nodes", "km", "gain", "fitness").groupBy("gen").applyInPandas(choose, "gen long, route_id long, rank long")


def preserve_diversity(pop: DataFrame, base: float = 0.3, adaptive: bool = True, share: float = 0.1, least_hamming: int = 3, for_fitness: float = 0.7, for_diversity: float = 0.3) -> DataFrame:
    """gen, route_id and rank of the next generation: the elite (best last), then in as many rounds as places are left the best of those far enough from all chosen.

    Far enough: combined distance of the threshold at least, and least_hamming differing positions. A round without such
    candidates lowers the threshold by a fifth; under 0.1 the fittest is taken and the threshold set back. Such a round
    uses up its place, so fewer may be chosen.
    """

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("route_id").reset_index(drop=True)
        _, _, combined, positions = _distances([list(x) for x in own.nodes], own.km.tolist(), own.gain.tolist())
        fit, gen, n = own.fitness.fillna(0.0).tolist(), int(own.gen.iloc[0]), len(own)
        by_fitness = sorted(range(n), key=lambda i: (fit[i], i))
        chosen = by_fitness[-max(1, int(n * share)) :]
        left = [i for i in range(n) if i not in chosen]
        start = base * (1.5 - gen / 20) if gen < 10 else base * max(0.5, 1 - (gen - 50) / 100) if gen > 50 else base
        limit = start if adaptive else base
        far, alike = dict.fromkeys(left, float("inf")), set()

        def compare(j: int) -> None:
            # each pair is compared once, when one of it is chosen
            for i in left:
                far[i] = min(far[i], combined(i, j))
                if positions(i, j) < least_hamming:
                    alike.add(i)

        for j in chosen:
            compare(j)
        for _ in range(n - len(chosen)):
            good = [i for i in left if i not in alike and far[i] >= limit]
            if good:
                chosen.append(max(good, key=lambda i: (for_fitness * fit[i] + for_diversity * far[i], -i)))
                left.remove(chosen[-1])
                compare(chosen[-1])
                continue
            limit *= 0.8
            if limit < 0.1 and left:
                chosen.append(max(left, key=lambda i: (fit[i], -i)))
                left.remove(chosen[-1])
                compare(chosen[-1])
                limit = base
        return pd.DataFrame({"gen": gen, "route_id": own.route_id.iloc[chosen].tolist(), "rank": range(1, len(chosen) + 1)})

    return pop.select("gen", "route_id", "nodes", "km", "gain", "fitness").groupBy("gen").applyInPandas(choose, "gen long, route_id long, rank long")


def spread_tournaments(pop: DataFrame, n: int, k: int = 3, memory: int = 10, bonus: float = 0.3) -> DataFrame:
    """gen, tournament and winner: of k drawn individuals the one with the best fitness and mean combined distance to the last winners, weighted. A generation of k or fewer gives its fittest every time."""

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("route_id").reset_index(drop=True)
        _, _, combined, _ = _distances([list(x) for x in own.nodes], own.km.tolist(), own.gain.tolist())
        fit, ids = own.fitness.fillna(0.0).tolist(), own.route_id.tolist()
        won: list[int] = []
        for t in range(n):
            if len(own) <= k:
                won.append(max(range(len(own)), key=lambda i: (fit[i], -i)))
                continue
            drawn = sorted(range(len(own)), key=lambda i: ((ids[i] * 7919 + (t + 1) * 104729) % 10007, i))[:k]  # noqa: B023
            last = won[-memory:]
            far = lambda i: sum(combined(i, j) for j in last) / len(last) if last else 0.0  # noqa: E731, B023
            won.append(max(drawn, key=lambda i: ((1 - bonus) * fit[i] + bonus * far(i), -i)))  # noqa: B023
        return pd.DataFrame({"gen": own.gen.iloc[0], "tournament": range(n), "winner": [ids[i] for i in won]})

    return pop.select("gen", "route_id", "nodes", "km", "gain", "fitness").groupBy("gen").applyInPandas(choose, "gen long, tournament long, winner long")
