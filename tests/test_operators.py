"""Operators without SQL, and their edges, against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tarnline.operators import control as C
from tarnline.operators import elevation as E
from tarnline.operators import fitness as FT
from tarnline.operators import network as N
from tarnline.operators import selection as S
from tarnline.plans.queries import keeper
from tarnline.sources import catalog as K
from tarnline.sources import roads


def population(spark, n=24, seed=2):
    rng = random.Random(seed)
    rows = [(g, 100 * g + i, [rng.randrange(12) for _ in range(rng.randint(3, 9))], rng.uniform(1, 5), rng.uniform(0, 90), rng.choice([None, 0.1, 0.5, rng.random()])) for g in (0, 3, 60) for i in range(n)]
    rows.append((61, 7, [1, 2], 1.0, 0.0, 0.3))
    return rows, spark.createDataFrame(rows, "gen long, route_id long, nodes array<long>, km double, gain double, fitness double")


def apart(a, b):
    return 1 - len(a & b) / len(a | b) if a | b else 0.0


def combined(x, y):
    steps = lambda r: {frozenset(p) | {min(p), max(p)} for p in itertools.pairwise(r[2])}
    differ = lambda a, b: abs(a - b) / max(a, b, 1)
    return 0.4 * apart(set(x[2]), set(y[2])) + 0.3 * (differ(x[3], y[3]) + differ(x[4], y[4])) / 2 + 0.3 * apart(steps(x), steps(y))


def test_pairs_and_novelty(spark):
    rows, pop = population(spark)
    found = S.pairs(pop)
    by = {r[:2]: r for r in rows}
    assert {(r["a"], r["b"]): pytest.approx(r["combined"]) for r in found.collect()} == {(a[1], b[1]): combined(a, b) for a, b in itertools.combinations(rows, 2) if a[0] == b[0]}
    for r in S.novelty(found, pop).collect():
        far = sorted((combined(by[r["gen"], r["route_id"]], o) for o in rows if o[0] == r["gen"] and o[1] != r["route_id"]), reverse=True)[:15]
        assert r["novelty"] == pytest.approx(sum(far) / len(far) if far else 1.0)


def test_greedy_spread(spark):
    rows, pop = population(spark)
    got = {}
    for r in S.greedy_spread(pop, 6).collect():
        got.setdefault(r["gen"], {})[r["rank"]] = r["route_id"]
    for gen in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == gen}
        chosen = [max(own, key=lambda i: (own[i][5] or 0.0, -i))]
        while len(chosen) < min(6, len(own)):
            chosen.append(max((i for i in own if i not in chosen), key=lambda i: (sum(apart(set(own[i][2]), set(own[j][2])) for j in chosen) / len(chosen), -i)))
        assert [got[gen][k + 1] for k in range(len(chosen))] == chosen
    assert S.greedy_spread(pop.limit(0), 6).count() == 0


def test_preserved_diversity(spark):
    rows, pop = population(spark)
    got = {}
    for r in S.preserve_diversity(pop).collect():
        got.setdefault(r["gen"], {})[r["rank"]] = r["route_id"]
    places = lambda a, b: sum(x != y for x, y in itertools.zip_longest(a[2], b[2]))
    for gen in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == gen}
        order = sorted(own, key=lambda i: (own[i][5] or 0.0, i))
        chosen = order[-max(1, int(len(own) * 0.1)) :]
        limit = 0.3 * (1.5 - gen / 20) if gen < 10 else 0.3 * max(0.5, 1 - (gen - 50) / 100) if gen > 50 else 0.3
        for _ in range(len(own) - len(chosen)):
            left = [i for i in own if i not in chosen]
            far = {i: min(combined(own[i], own[j]) for j in chosen) for i in left}
            good = [i for i in left if far[i] >= limit and all(places(own[i], own[j]) >= 3 for j in chosen)]
            if good:
                chosen.append(max(good, key=lambda i: (0.7 * (own[i][5] or 0.0) + 0.3 * far[i], -i)))
            elif (limit := limit * 0.8) < 0.1 and left:
                chosen.append(max(left, key=lambda i: (own[i][5] or 0.0, -i)))
                limit = 0.3
        assert [got[gen][k + 1] for k in range(len(chosen))] == chosen


def test_spread_tournaments(spark):
    rows, pop = population(spark)
    for gen in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == gen}
        won = []
        for t in range(12):
            if len(own) <= 3:
                won.append(max(own, key=lambda i: (own[i][5] or 0.0, -i)))
                continue
            drawn = sorted(own, key=lambda i: ((i * 7919 + (t + 1) * 104729) % 10007, i))[:3]
            bonus = lambda i: sum(combined(own[i], own[j]) for j in won[-10:]) / len(won[-10:]) if won else 0.0  # noqa: E731, B023
            won.append(max(drawn, key=lambda i: (0.7 * (own[i][5] or 0.0) + 0.3 * bonus(i), -i)))
        got = S.spread_tournaments(pop.filter(F.col("gen") == gen), 12).orderBy("tournament").collect()
        assert [r["winner"] for r in got] == won


def metres(a, b):
    p, q = math.radians(a[2]), math.radians(b[2])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_thinned_and_consolidated(spark):
    rng = random.Random(6)
    points = [(i, 10 + rng.uniform(0, 0.002), 50 + rng.uniform(0, 0.002), rng.choice([None, None, None, "crossing"])) for i in range(80)]
    nodes = spark.createDataFrame(points, "node_id long, x double, y double, highway string")
    edges = spark.createDataFrame([(0, 1), (0, 2)], "u long, v long")
    kept = {p[0]: "real" for p in points if p[3] and p[0] != 0}
    for p in points:
        if p[0] not in kept and p[0] != 0 and not p[3]:
            if all(metres(p, points[k]) >= 20 for k in kept):
                kept[p[0]] = "other"
    got = {r["node_id"]: r["kind"] for r in N.thinned(nodes, edges, keeper(spark)).collect()}
    assert got == kept
    top = list(range(80))
    for _ in range(80):
        for a, b in itertools.combinations(range(80), 2):
            if metres(points[a], points[b]) < 15:
                top[a] = top[b] = min(top[a], top[b])
    found = {r["node_id"]: r for r in N.consolidated(nodes, keeper(spark), 15.0).collect()}
    assert {i: r["cluster"] for i, r in found.items()} == dict(enumerate(top))
    for i, r in found.items():
        own = [points[j] for j in range(80) if top[j] == top[i]]
        assert r["n"] == len(own) and r["x"] == pytest.approx(sum(p[1] for p in own) / len(own))


def test_simplified(spark):
    rng = random.Random(8)
    chain = lambda a, b, inner: list(itertools.pairwise([a, *inner, b]))
    pairs = chain(1, 2, range(100, 137)) + chain(1, 2, range(200, 203)) + chain(2, 3, [300]) + chain(3, 3, range(400, 405)) + [(1, 3), (3, 9)] + chain(500, 500, range(501, 506))
    edges = [(a, b, float(rng.randint(50, 99))) for a, b in pairs]
    got = {(r["u"], r["v"]): (r["length"], r["inner"]) for r in N.simplified(spark.createDataFrame(edges, "u long, v long, length double"), keeper(spark)).collect()}
    along = lambda lo, n: sum(m for _, _, m in edges[lo : lo + n])
    a, b = (along(0, 38), 37), (along(38, 4), 3)
    want = {(1, 2): min(a, b), (2, 3): (along(42, 2), 1), (3, 3): (along(44, 6), 5), (1, 3): (edges[50][2], 0), (3, 9): (edges[51][2], 0)}
    assert got == want | {(v, u): x for (u, v), x in want.items()}


def test_rasters_without_data(spark):
    tiles = spark.createDataFrame([("a", 0.0, 0.0, 0.01, 0.01, 0.005, -1.0), ("b", 0.0, 0.0, 0.02, 0.02, 0.01, -1.0)], "tile_id string, west double, south double, east double, north double, res double, nodata double")
    pixels = spark.createDataFrame([("a", 0, 0, 5.0), ("a", 0, 1, -1.0), ("a", 1, 0, float("nan")), ("b", 1, 0, 7.0), ("b", 0, 0, None)], "tile_id string, row long, col long, value double")
    points = spark.createDataFrame([(1, 0.001, 0.009), (2, 0.006, 0.009), (3, 0.001, 0.001), (4, 0.5, 0.5), (5, 0.001, 0.015), (6, None, None)], "node_id long, x double, y double")
    found = E.samples(points, tiles, pixels)
    first = {r["node_id"]: r["elevation"] for r in E.first_tile(found).collect()}
    last = {r["node_id"]: r["elevation"] for r in E.last_tile(found, points).collect()}
    assert first == {1: 5.0, 2: None, 3: None, 5: None} and last == {1: 7.0, 2: 7.0, 3: 7.0, 4: 0.0, 5: 0.0, 6: 0.0}
    assert {r["node_id"]: r["elevation"] for r in E.finest_tile(found).collect()} == {1: 5.0, 2: 7.0, 3: 7.0}
    assert E.bounds(tiles.limit(0)).first().west == 0.0 and E.has_elevation(points.limit(0).withColumn("elevation", F.lit(1.0))).first().complete is False


def test_networks_are_stored_and_read(spark, tmp_path):
    base = f"file://{tmp_path}"
    nodes = spark.createDataFrame([(1, 7.0, 46.0, 500.0), (2, 7.1, 46.1, 510.0)], roads.NODE)
    edges = spark.createDataFrame([(1, 2, 0, 99.0, "path")], roads.EDGE)
    built = []

    def build(*what):
        built.append(what)
        return nodes, edges

    assert len(K.prepare_common(spark, base, 46.0, 7.0, build)) == 4 and K.prepare_common(spark, base, 46.0, 7.0, build) == []
    assert len(built) == 4 and len(K.listed(spark, base)) == 4
    known = K.Networks(spark, base, build)
    own = known.load(46.0, 7.0, 1200)
    assert known.load(46.0, 7.0, 1200) is own and len(built) == 4 and own[0].count() == 2
    known.load(46.5, 7.0, 900)
    assert len(built) == 5 and K.exists(spark, roads.graph_path(base, 46.5, 7.0, 900)) and not K.exists(spark, f"{base}/none")


def test_configs_are_stored_and_read(spark, tmp_path):
    path = f"file://{tmp_path}/configs"
    K.write_configs(K.presets(spark), path)
    assert sorted(map(tuple, K.read_configs(spark, path).collect())) == sorted((k, *v) for k, v in K.PRESETS.items())
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x.json").write_text('{"name": "a", "population": 7, "unknown": 1}\nnot json\n{"population": 3}\n')
    rows = K.read_configs(spark, f"file://{tmp_path}/odd").collect()
    assert [tuple(r) for r in rows] == [("a", 7, 200, 0.8, 0.1, 2, "elevation")]


def test_tuned_parameters(spark):
    rows = [(run, g, (g * 7 + run) % 11) for run in (1, 2) for g in range(40)]
    rules = [C.Rule("mutation", lambda s: s["stale"] > 6, 0.1, 0.0, 0.45, 4)]
    got = C.tuned(spark.createDataFrame(rows, "run long, generation long, stale long"), {"mutation": 0.1}, rules).collect()
    for run in (1, 2):
        now, last, want = 0.1, -100, []
        for _, g, stale in sorted(r for r in rows if r[0] == run):
            if stale > 6 and g - last >= 4 and now < 0.45:
                now, last = min(0.45, now + 0.1), g
            want.append(pytest.approx(now))
        assert [r["mutation"] for r in sorted(got, key=lambda r: r["generation"]) if r["run"] == run] == want


def test_start_node_that_is_wanted(spark):
    nodes = spark.createDataFrame([(1, 7.0, 46.0), (2, 7.1, 46.1)], "node_id long, x double, y double")
    assert N.start_node(nodes, 0, 0, 2).first().node_id == 2 and N.start_node(nodes, 46.09, 7.09).first().node_id == 2
    with pytest.raises(ValueError):
        N.start_node(nodes, 0, 0, 9)


def test_swept_means_tie_whatever_the_order(spark):
    from tarnline.operators.control import swept

    # the same scores, summed in two orders, differ in the last place
    scores = [0.1, 0.2, 0.3]
    rows = [(50, s) for s in reversed(scores)] + [(70, s) for s in scores]
    found = {r.population: r for r in swept(spark.createDataFrame(rows, "population long, score double").coalesce(1), "population").collect()}
    assert found[50].mean != found[70].mean and found[50].best and not found[70].best


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_never_broadcast(spark):
    tiles = spark.range(1).selectExpr("concat('a', id) AS tile_id", "0D AS west", "0D AS south", "0.02D AS east", "0.02D AS north", "0.001D AS res", "-1D AS nodata")
    pixels = tiles.selectExpr("tile_id", "explode(sequence(0L, 19L)) AS row").selectExpr("tile_id", "row", "explode(sequence(0L, 19L)) AS col").selectExpr("*", "row * 20D + col AS value")
    points = spark.range(20).selectExpr("id AS node_id", "id * 0.001D + 0.0005D AS x", "0.0195D AS y")
    found = E.samples(points, tiles, pixels)
    assert "SortMergeJoin [tile_id" in planned(found) and "row" not in "".join(x for x in planned(found).splitlines() if "BroadcastHashJoin" in x)
    assert {r.node_id: r.value for r in found.collect()} == {i: float(i) for i in range(20)}


def test_micro_scores_make_a_profile_once(spark):
    points = spark.createDataFrame([(1, k, 40.0 * k, float(k % 5 * 3)) for k in range(30)] + [(2, 1, 0.0, 5.0), (3, 1, 0.0, 5.0), (3, 2, 9.0, 8.0)], "route_id long, k int, m double, elevation double")
    plan = planned(FT.micro_scores(points))
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Sort [") == 1 and "Join" not in plan
    got = {r.route_id: r for r in FT.micro_scores(points).collect()}
    assert (got[2].peaks_score, got[2].variety_score, got[2].complexity_score) == (0.0, 0.0, 0.0)
    assert got[3].peaks_score == 0.0 and got[3].complexity_score == pytest.approx((1.5 / 20 + 3 / 100) / 3) and got[1].peaks_score == 1.0


def test_folds_go_on_from_batch_to_batch(spark):
    from tarnline.operators import control as C

    rows = [(run, g, (g * 7 + (run or 5)) % 11, float((g * 5 + (run or 5)) % 7) / 10) for run in (1, 2, 3, None) for g in range(40)]
    history = spark.createDataFrame(rows[::-1], "run long, generation long, stale long, best double")
    rules = [C.Rule("mutation", lambda s: s["stale"] > 6, 0.1, 0.0, 0.45, 4)]
    assert not [x for df in (C.tuned(history, {"mutation": 0.1}, rules), C.stagnation(history)) if "FlatMapGroups" in planned(df)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.run, r.generation): r.mutation for r in C.tuned(history, {"mutation": 0.1}, rules).collect()}
        stale = {(r.run, r.generation): r.stale for r in C.stagnation(history).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for run in (1, 2, 3, None):
        now, last, top, n = 0.1, -100, None, 0
        for _, g, s, best in (r for r in rows if r[0] == run):
            if s > 6 and g - last >= 4 and now < 0.45:
                now, last = min(0.45, now + 0.1), g
            top, n = (best, 0) if top is None or best - top > max(0.001, top * 0.001) else (top, n + 1)
            assert got[run, g] == pytest.approx(now) and stale[run, g] == n


def test_novelty_makes_pairs_once(spark):
    pop = spark.createDataFrame([(0, i, [i % 3, i % 5, i % 2, i], float(i), 2.0 * i) for i in range(12)], "gen long, route_id long, nodes array<bigint>, km double, gain double")
    found = S.pairs(pop)
    assert planned(S.novelty(found, pop)).count("array_intersect(a_set") == 1
    want = {(r.a, r.b): r.x for r in found.join(pop.select(F.col("route_id").alias("a"), F.col("nodes").alias("an")), "a").join(pop.select(F.col("route_id").alias("b"), F.col("nodes").alias("bn")), "b").select("a", "b", S.jaccard_distance(F.col("an"), F.col("bn")).alias("x")).collect()}
    assert {(r.a, r.b): r.spatial for r in found.collect()} == want and len(want) == 66


def test_preserve_diversity_compares_each_pair_once(monkeypatch, spark):
    rows = [(0, i, [(i * k) % 9 for k in range(1, 8)], float(i % 4), float(i % 7), float(i % 10) / 10) for i in range(30)]
    pop = spark.createDataFrame(rows, "gen long, route_id long, nodes array<bigint>, km double, gain double, fitness double")
    compared, plain = [], S._distances

    def counting(*columns):
        apart, sets, combined, positions = plain(*columns)
        return apart, sets, lambda i, j: compared.append((i, j)) or combined(i, j), positions

    choose = {}
    monkeypatch.setattr(S, "_distances", counting)
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", lambda self, f, schema: choose.setdefault("f", f))
    S.preserve_diversity(pop)
    assert len(choose["f"](pop.toPandas())) >= 3 and 0 < len(compared) <= 30 * 29 // 2 == 435 and len({frozenset(p) for p in compared}) == len(compared)


def test_crossings_of_equal_length_go_by_node(spark):
    from tarnline.operators import recombine as R

    # children of 8248.212 and 6725.738 m by every node; the doubles of these sums differ
    near = [(3, 6351.457999999999, 4828.984, 1896.754, 309.108), (2, 6137.825, 4615.351000000001, 2110.387, 522.741), (1, 6218.024, 4695.549999999999, 2030.1879999999992, 442.54200000000037), (0, 1.0, 1.0, 1.0, 1.0)]
    reach = spark.createDataFrame([row for n, to_a, to_b, rest_b, rest_a in near for row in ((7, n, to_a, rest_a), (8, n, to_b, rest_b))], "route_id long, node_id long, to double, rest double")
    mates, start = spark.createDataFrame([(7, 8)], "a long, b long"), spark.createDataFrame([(7, 0)], "route_id long, node_id long")
    assert len({(to_a + rest_b, to_b + rest_a) for _, to_a, to_b, rest_b, rest_a in near[:3]}) > 1
    found = R.crossover_points(mates, reach, start, 7000.0).orderBy("rank").collect()
    assert [r.node_id for r in found] == [1, 2, 3] and len({r.score for r in found}) == 1
    # as far over the target as under it
    reach = spark.createDataFrame([(7, 2, 7000.3, 0.0), (8, 2, 7000.3, 0.0), (7, 1, 6999.7, 0.0), (8, 1, 6999.7, 0.0)], reach.schema)
    assert [r.node_id for r in R.crossover_points(mates, reach, start, 7000.0).orderBy("rank").collect()] == [1, 2]
