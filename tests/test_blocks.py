"""Search by cells, by rounds and by the distance index, against Dijkstra in plain Python."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tarnline.operators import blocks as B
from tarnline.operators import distance_index as D
from tarnline.plans.queries import keeper


def dijkstra(around, source, cutoff=float("inf")):
    """Distance and least path of every node."""
    queue, done = [(0.0, [source])], {}
    while queue:
        d, path = heapq.heappop(queue)
        if path[-1] in done:
            continue
        done[path[-1]] = (d, path)
        for v, m in around.get(path[-1], ()):
            if v not in done and d + m <= cutoff:
                heapq.heappush(queue, (d + m, [*path, v]))
    return done


def made(spark, wide, high, seed=5, gap=0.0012):
    """A grid of streets with gaps, one-way streets, a few long links, and whole metres, so that equal lengths occur."""
    rng = random.Random(seed)
    place = {i * wide + j: (7.0 + gap * j + rng.uniform(0, gap / 3), 46.0 + gap * i + rng.uniform(0, gap / 3)) for i in range(high) for j in range(wide)}
    edges = []
    for n in place:
        for v in (n + 1 if n % wide < wide - 1 else None, n + wide):
            if v in place and rng.random() < 0.9:
                m = float(rng.choice([150, 160, 200, 260]))
                edges.append((n, v, m))
                if rng.random() < 0.85:
                    edges.append((v, n, m))
    edges += [(n, n + 2, 40.0) for n in rng.sample(sorted(place), 3)] + [(1, 0, None), (3, 2, -5.0), (4, 4, 1.0), (edges[0][0], edges[0][1], 999.0)]
    nodes = [(n, *xy) for n, xy in place.items()] + [(10_000, 8.0, 46.0), (10_001, None, None)]
    around = {}
    least = {}
    for u, v, m in edges:
        if m is not None and m >= 0:
            least[u, v] = min(m, least.get((u, v), m))
    for (u, v), m in least.items():
        around.setdefault(u, []).append((v, m))
    return spark.createDataFrame(nodes, "node_id long, x double, y double"), spark.createDataFrame(edges, "u long, v long, length double"), around


@pytest.mark.parametrize("group", [64, 3])
def test_cells_hold_every_near_way(spark, group):
    nodes, edges, around = made(spark, 14, 11)
    got = {(r.src, r.node_id): (r.dist, r.path) for r in B.near_paths(edges, 900.0, keeper(spark), nodes=nodes, group=group).collect()}
    ends = {u for u in around} | {v for x in around.values() for v, _ in x}
    want = {(s, n): x for s in ends for n, x in dijkstra(around, s, 900.0).items()}
    assert got == want
    plan = B.near_paths(edges, 900.0, keeper(spark), nodes=nodes)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("delta", [None, 130.0, 5000.0])
def test_rounds_give_the_same_rows(spark, delta):
    nodes, edges, around = made(spark, 6, 4)
    steps = keeper(spark)(B.hops(edges))
    seeds = spark.createDataFrame([(0,), (9,), (77_777,)], "src long")
    got = {(r.src, r.node_id): (r.dist, r.path) for r in B._rounds(steps, seeds, 1100.0, keeper(spark), delta).collect()}
    assert got == {(s, n): x for s in (0, 9, 77_777) for n, x in dijkstra(around, s, 1100.0).items()}


def test_networks_without_a_bound_go_by_rounds(spark):
    nodes, edges, around = made(spark, 5, 4)
    unplaced = nodes.withColumn("x", F.when(F.col("node_id") != 7, F.col("x")))
    zero = edges.unionByName(spark.createDataFrame([(0, 19, 0.0)], "u long, v long, length double"))
    for n, e in ((unplaced, edges), (nodes, zero)):
        assert B.margin(B.hops(e), n, 500.0) is None
    one = spark.createDataFrame([(0,)], "node_id long")
    assert {r.node_id: r.dist for r in B.reached(zero, 500.0, keeper(spark), nodes, one).collect()} == {n: d for n, (d, _) in dijkstra(around | {0: [*around.get(0, []), (19, 0.0)]}, 0, 500.0).items()}


def test_pointers_and_traces(spark):
    nodes, edges, around = made(spark, 12, 9)
    sources = spark.createDataFrame([(0,), (50,), (107,), (10_000,), (88_888,)], "node_id long")
    found = keeper(spark)(B.reached(edges, 3000.0, keeper(spark), nodes, sources))
    rows = {(r.src, r.node_id): (r.dist, r.parent) for r in found.collect()}
    want = {(s, n): d for s in (0, 50, 107, 10_000, 88_888) for n, (d, _) in dijkstra(around, s, 3000.0).items()}
    assert {k: d for k, (d, _) in rows.items()} == want
    length = {(u, v): m for u, x in around.items() for v, m in x}
    for (s, n), (d, p) in rows.items():
        if n != s:
            before = [u for u in around if (u, n) in length and (s, u) in rows and rows[s, u][0] + length[u, n] == d]
            assert p == min(before)
    pairs = spark.createDataFrame([(s, n) for s, n in want if (s + n) % 3 == 0] + [(0, 99_999), (0, None)], "src long, dst long")
    ways = {}
    for r in B.traced(found, pairs, keeper(spark)).collect():
        ways.setdefault((r.src, r.dst), {})[r.i] = r.node_id
    assert set(ways) == {k for k in want if sum(k) % 3 == 0}
    for (s, n), way in ways.items():
        path = [way[i] for i in range(len(way))]
        assert path[0] == s and path[-1] == n and all(rows[s, b][1] == a for a, b in zip(path, path[1:], strict=False))


@pytest.mark.parametrize(("leaf", "group"), [(12, 2_000), (40, 7), (1000, 2_000)])
def test_any_pair_is_exact(spark, monkeypatch, leaf, group):
    monkeypatch.setattr(D, "GROUP", group)
    nodes, edges, around = made(spark, 25, 20)
    rng = random.Random(1)
    ids = [*range(500), 10_000, 10_001, 55_555]
    pairs = {(rng.choice(ids), rng.choice(ids)) for _ in range(10_000)}
    index = D.build(nodes, edges, keeper(spark), leaf)
    got = {(r.src, r.dst): r.dist for r in D.distances(index, spark.createDataFrame(sorted(pairs), "src long, dst long"), keeper(spark)).collect()}
    assert set(got) == pairs
    known = set(ids) - {55_555}
    for s in {s for s, _ in pairs}:
        far = dijkstra(around, s)
        for p in (p for p in pairs if p[0] == s):
            want = far[p[1]][0] if p[1] in far and {*p} <= known else None
            assert got[p] == want if want is None else abs(got[p] - want) < 1e-6, p


def test_index_of_odd_networks(spark):
    keep = keeper(spark)
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (3, 1)], "src long, dst long")
    none = spark.createDataFrame([], "node_id long, x double, y double"), spark.createDataFrame([], "u long, v long, length double")
    assert {r.dist for r in D.distances(D.build(*none, keep), pairs, keep).collect()} == {None}
    # all at one place, more than a cell should hold
    nodes = spark.createDataFrame([(i, 7.0, 46.0) for i in range(20)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(19)], "u long, v long, length double")
    got = {(r.src, r.dst): r.dist for r in D.distances(D.build(nodes, edges, keep, 4), pairs, keep).collect()}
    assert got == {(1, 2): 1.0, (2, 1): None, (1, 1): 0.0, (3, 1): None}


def over_the_pole(spark):
    """A network over a pole, where degrees of x have hardly any length, with streets of length 0 along x."""
    nodes, edges, around = made(spark, 9, 14)
    moved = nodes.filter("x < 7.9").withColumn("y", F.col("y") + 43.99)
    flat = spark.createDataFrame([(63, 64, 0.0), (64, 63, 0.0), (65, 66, 0.0)], "u long, v long, length double")
    for u, v, m in flat.collect():
        around[u] = [(n, d) for n, d in around.get(u, ()) if n != v] + [(v, m)]
    level = moved.join(moved.filter("node_id between 63 and 66").agg(F.min("y").alias("low")), F.lit(True)).withColumn("y", F.when(F.col("node_id").between(63, 66), F.col("low")).otherwise(F.col("y"))).drop("low")
    return keeper(spark)(level), edges.unionByName(flat), around


def test_cells_reach_over_poles(spark):
    nodes, edges, around = over_the_pole(spark)
    assert B.margin(B.hops(edges), nodes, 500.0) is not None
    ends = {u for u in around} | {v for x in around.values() for v, _ in x}
    got = {(r.src, r.node_id): r.dist for r in B.near_paths(edges, 500.0, keeper(spark), nodes=nodes, group=5).collect()}
    want = {(s, n): d for s in ends for n, (d, _) in dijkstra(around, s, 500.0).items()}
    assert got == want
    one = spark.createDataFrame([(64,)], "node_id long")
    assert {r.node_id: r.dist for r in B.reached(edges, 900.0, keeper(spark), nodes, one).collect()} == {n: d for n, (d, _) in dijkstra(around, 64, 900.0).items()}


@pytest.mark.parametrize("placed", [True, False])
def test_only_what_is_asked(spark, placed):
    nodes, edges, around = made(spark, 7, 6)
    ask = {(0, 0), (0, 8), (0, 41), (9, 10), (9, 16), (10_000, 10_000), (5, 77_777), (20, 13)}
    pairs = spark.createDataFrame([*ask, (0, 8), (None, 3), (3, None)], "src long, dst long")
    found = B.near_paths(edges, 600.0, keeper(spark), nodes=nodes if placed else None, pairs=pairs).collect()
    ends = {u for u in around} | {v for x in around.values() for v, _ in x}
    want = {(s, n): x for s in {s for s, _ in ask} & ends for n, x in dijkstra(around, s, 600.0).items() if (s, n) in ask}
    assert {(r.src, r.node_id): (r.dist, r.path) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("cutoff", [float("inf"), 700.0])
def test_k_shortest_paths_in_surroundings(spark, cutoff):
    from tarnline.operators import paths as P

    nodes, edges, _ = made(spark, 4, 3)
    pairs = spark.createDataFrame([(0, 11), (2, 4), (5, 6), (0, 10_000), (3, 3)], "src long, dst long")
    key = lambda f: sorted((r.src, r.dst, r.rank, round(r.length, 6), tuple(r.path)) for r in f.collect())
    want = key(P.k_shortest_pairs(edges, pairs, 6, keeper(spark), cutoff))
    # a first look that is too small, and a network over the size of a broadcast
    assert key(P.k_shortest_pairs(edges, pairs, 6, keeper(spark), cutoff, 3, nodes, 150.0)) == want and len(want) > 6


def test_ways_are_those_of_pointers(spark, monkeypatch):
    nodes, edges, _ = made(spark, 9, 8)
    pairs = spark.createDataFrame([(0, 40), (0, 0), (0, 71), (13, 50), (13, 4), (88_888, 2), (5, 88_888), (60, 3), (None, 3)], "src long, dst long")
    found = keeper(spark)(B.reached(edges, 1500.0, keeper(spark), nodes, pairs.select(F.col("src").alias("node_id"))))
    want = {}
    for r in B.traced(found, pairs, keeper(spark)).collect():
        want.setdefault((r.src, r.dst), {})[r.i] = r.node_id
    searched = []
    one = B._led
    monkeypatch.setattr(B, "reached", lambda *_, **__: searched.append(one))
    got = {(r.src, r.node_id): r.path for r in B.ways(edges, pairs, 1500.0, keeper(spark), nodes, group=2).collect()}
    assert got == {k: [x[i] for i in range(len(x))] for k, x in want.items()} and (0, 40) in got and not searched


def test_traced_paths_writes_no_ways_that_are_not_asked(spark, monkeypatch):
    from tarnline.plans import terrain

    written, keep = [], keeper(spark)

    def counting(df):
        written.append(df.columns)
        return keep(df)

    monkeypatch.setattr(terrain, "keeper", lambda _: counting)
    assert terrain.traced_paths(spark, "/root/testdata/sf0.001").count() > 0
    assert not [c for c in written if "parent" in c or "up" in c]


def test_return_legs_try_every_neighbour(spark):
    from tarnline.operators import paths as P

    # twelve neighbours of node 50, of which only the last two are near enough to home; node 60 has parallel edges
    back = spark.createDataFrame([(n, 400.0 if n > 10 else 900.0, [n, 0]) for n in range(1, 13)], "node_id long, dist double, path array<long>")
    edges = spark.createDataFrame([(50, n, 100.0) for n in range(1, 13)] + [(60, 11, 100.0)] * 12 + [(60, 12, 50.0), (60, 11, 300.0)], "u long, v long, length double")
    found = P.return_legs(spark.createDataFrame([(50,), (60,)], "src long"), back, edges, 440.0, 460.0)
    assert [tuple(r) for r in found.collect()] == [(60, 12, 450.0, [60, 12, 0])]
    found = P.return_legs(spark.createDataFrame([(50,), (60,)], "src long"), back, edges, 490.0, 520.0)
    assert sorted(tuple(r) for r in found.collect()) == [(50, 11, 500.0, [50, 11, 0]), (60, 11, 500.0, [60, 11, 0])]
    # the shortest of parallel edges alone counts
    assert P.return_legs(spark.createDataFrame([(60,)], "src long"), back, edges, 650.0, 750.0).count() == 0
