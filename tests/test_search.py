import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tarnline.operators import fitness as FT
from tarnline.operators import generate as G
from tarnline.operators import paths as P
from tarnline.operators import search as S
from tarnline.operators import segments as SG
from tarnline.operators import tuning as T
from tarnline.plans.queries import keeper
from tarnline.streaming import activity

# a ring of seven places with three chords and a tail
HEIGHTS = {1: 12.0, 2: 31.0, 3: 18.5, 4: 44.0, 5: 27.0, 6: 9.5, 7: 36.0, 8: 52.0}
NODES = [(n, 10.0 + 0.002 * math.cos(n), 50.0 + 0.0015 * math.sin(n), h) for n, h in HEIGHTS.items()]
EDGES = [(n, n % 7 + 1, 140 + 13 * n) for n in range(1, 8)] + [(1, 4, 390), (2, 6, 420), (3, 7, 333), (7, 8, 95)]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(NODES, "node_id long, x double, y double, elevation double")
    both = [(a, b, float(m)) for a, b, m in EDGES] + [(b, a, float(m)) for a, b, m in EDGES]
    return nodes, spark.createDataFrame(both, "u long, v long, length double")


LENGTH = {(a, b): float(m) for a, b, m in EDGES} | {(b, a): float(m) for a, b, m in EDGES}


def brute(source, target):
    inner = [n for n in HEIGHTS if n not in (source, target)]
    for k in range(len(inner) + 1):
        for middle in itertools.permutations(inner, k):
            path = [source, *middle, target]
            if all(p in LENGTH for p in itertools.pairwise(path)):
                yield sum(LENGTH[p] for p in itertools.pairwise(path)), path


def test_k_shortest_is_exact(spark, graph):
    for source, target in ((1, 6), (8, 4), (2, 5)):
        want = sorted(brute(source, target))
        got = S.k_shortest(graph[1], source, target, 200, keeper(spark)).collect()
        assert sorted((r["length"], r["path"]) for r in got) == want and [r["length"] for r in got] == [m for m, _ in want]
        assert [r["length"] for r in S.k_shortest(graph[1], source, target, 4, keeper(spark)).collect()] == [m for m, _ in want[:4]]
        near = [x for x in want if x[0] <= 900]
        assert [r["length"] for r in S.k_shortest(graph[1], source, target, 200, keeper(spark), 900.0).collect()] == [m for m, _ in near]
    assert S.k_shortest(graph[1], 1, 99, 5, keeper(spark)).count() == 0
    with pytest.raises(ValueError):
        P.k_shortest_pairs(graph[1], graph[1].select(F.col("u").alias("src"), F.col("v").alias("dst")), 2, keeper(spark), most_local=3)


@pytest.mark.parametrize("placed", [True, False])
def test_near_paths_are_least(spark, graph, placed):
    nodes = graph[0] if placed else None
    odd = graph[1].unionByName(spark.createDataFrame([(1, 2, 500.0), (1, 5, None), (5, 1, -1.0)], "u long, v long, length double"))
    got = {(r["src"], r["node_id"]): (r["dist"], r["path"]) for r in P.near_paths(odd, 600.0, keeper(spark), nodes=nodes).collect()}
    want = {(s, s): (0.0, [s]) for s in HEIGHTS}
    for s, t in itertools.permutations(HEIGHTS, 2):
        if (best := min(brute(s, t)))[0] <= 600:
            want[s, t] = best
    assert got == want
    assert P.near_paths(odd.limit(0), 600.0, keeper(spark), nodes=nodes).count() == 0
    one = spark.createDataFrame([(77,), (None,)], "node_id long")
    assert [r["path"] for r in P.near_paths(odd, 600.0, keeper(spark), one, nodes).collect()] == [[77]]


def test_bounded_paths_and_hops(spark, graph):
    pairs = [(s, t) for s, t in itertools.permutations(HEIGHTS, 2)]
    got = sorted((r["src"], r["dst"], r["path"]) for r in P.bounded_paths(graph[1], spark.createDataFrame(pairs, "src long, dst long"), 4, keeper(spark)).collect())
    assert got == sorted((s, t, p) for s, t in pairs for _, p in brute(s, t) if len(p) <= 5)
    hops = {(r["src"], r["node_id"]): r["hops"] for r in P.hop_counts(graph[1], graph[0].select("node_id"), 2, keeper(spark)).collect()}
    want = {(s, t): min(len(p) for _, p in brute(s, t)) - 1 for s, t in pairs}
    assert hops == {k: n for k, n in want.items() if n <= 2} | {(s, s): 0 for s in HEIGHTS}


def test_judge_is_the_fitness_of_the_plan(spark, graph):
    net = network()
    rng, walks = random.Random(3), []
    for _ in range(40):
        walk = [1]
        for _ in range(rng.randint(1, 25)):
            walk.append(rng.choice(net.around[walk[-1]])[0])
        walks.append(walk)
    walks.append([1, 5, 1])
    rows = spark.createDataFrame(list(enumerate(walks)), "route_id long, nodes array<long>")
    props = SG.properties(SG.cut(rows, 1), *graph)
    for km in (0.8, 2.5):
        terms = FT.terms(SG.route_totals(props), props, FT.profile(SG.cut(rows, 1), graph[0]), km)
        for r in FT.evaluate(terms, km, FT.weights(spark)).collect():
            assert G.Judge(net, km, r["objective"])(walks[r["route_id"]])[0] == pytest.approx(r["fitness"], abs=1e-9), (walks[r["route_id"]], r)


def network():
    around = {}
    for (a, b), m in sorted(LENGTH.items()):
        around.setdefault(a, []).append((b, m))
    return G.Network(around, {n: (x, y, h) for n, x, y, h in NODES})


def closed(nodes):
    return nodes[0] == nodes[-1] == 1 and all(p in LENGTH for p in itertools.pairwise(nodes))


def test_strategies_make_closed_walks(spark, graph):
    names = [*dict.fromkeys(n for mix in G.MIXES.values() for n, _ in mix), "fallback"]
    seeds = [(10 * i + k, 1, 1200.0, name, 5) for i, name in enumerate(names) for k in range(10)] + [(9999, 77, 1500.0, "random_walk", 5)]
    got = G.initial_routes(spark.createDataFrame(seeds, "id long, start long, target_m double, strategy string, seed long"), *graph, keeper(spark)).collect()
    assert all(closed(r["nodes"]) and r["length"] == pytest.approx(sum(LENGTH[p] for p in itertools.pairwise(r["nodes"]))) for r in got)
    assert {"out_and_back", "triangle", "figure_eight", "random_walk", "uphill", "directional", "fallback", "short_walk", "walker", "seeker"} <= {r["strategy"] for r in got}
    for r in got:
        if r["strategy"] in ("out_and_back", "triangle", "figure_eight", "spiral"):
            assert 0.85 * 1200 <= r["length"] <= 1.15 * 1200
    again = G.initial_routes(spark.createDataFrame(seeds[::-1], "id long, start long, target_m double, strategy string, seed long").repartition(7), *graph, keeper(spark)).collect()
    assert sorted((r["id"], r["nodes"]) for r in again) == sorted((r["id"], r["nodes"]) for r in got)


def test_search_finds_allowed_routes(spark, graph):
    asked = [(0, 1, 1.5, "elevation", 1), (1, 1, 1.5, "distance", 1), (2, 77, 1.5, "distance", 1), (3, 1, -1.0, "distance", 1)]
    schema = "id long, start long, target_km double, objective string, seed long"
    rows = {r["id"]: r for r in G.search(spark.createDataFrame(asked, schema), *graph, keeper(spark), size=20, generations=15).collect()}
    for i in (0, 1):
        assert closed(rows[i]["nodes"]) and abs(rows[i]["km"] - 1.5) <= 0.225 and rows[i]["fitness"] > 0.4
        assert rows[i]["history"] == sorted(rows[i]["history"]) and rows[i]["generations"] == len(rows[i]["history"])
        assert rows[i]["km"] * 1000 == pytest.approx(sum(LENGTH[p] for p in itertools.pairwise(rows[i]["nodes"])))
    assert rows[2]["nodes"] is None and rows[3]["nodes"] is None
    assert rows[0]["fitness"] >= G.Judge(network(), 1.5, "elevation")([1, 4, 3, 2, 1])[0] - 0.2
    again = G.search(spark.createDataFrame(asked[:1], schema), *graph, keeper(spark), size=20, generations=15).first()
    assert again["nodes"] == rows[0]["nodes"]
    with pytest.raises(ValueError):
        G.search(spark.createDataFrame(asked, schema), *graph, keeper(spark), most_local=3)


def test_rates_on_the_driver_and_in_a_plan_agree(spark):
    cases = [(d, s, g) for d in (0.0, 0.1, 0.5) for s in (0, 10, 14, 40) for g in (0, 5)]
    df = spark.createDataFrame(cases, "d double, s int, g int").withColumn("rate", T.adaptive_rate(F.col("d"), F.col("s"), F.pow(F.lit(0.95), F.col("g"))))
    assert all(r["rate"] == pytest.approx(T.adaptive_rate_value(r["d"], r["s"], r["g"])) for r in df.collect())
    assert T.adapted_sizes(2, 100, 200) == (50, 100, 5, 3) and T.adapted_sizes(5, 100, 200) == (100, 200, 10, 5)
    assert T.adapted_sizes(10, 100, 200) == (150, 300, 15, 7) and T.adapted_sizes(25, 100, 200) == (33, 100, 5, 3)
    drawn = T.random_search(spark, {"a": (1, 3), "b": (-1, 0)}, 500).toPandas()
    assert drawn.a.between(1, 3).all() and drawn.b.between(-1, 0).all() and 1.8 < drawn.a.mean() < 2.2


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = activity.windows(activity.read_events(spark, str(tmp_path / "in")), late="3650 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    key = lambda df: sorted((r["start"], r["event_type"], r["n"], round(r["mean"], 6)) for r in df.collect())
    assert key(spark.table("activity")) == key(activity.windows(events))
