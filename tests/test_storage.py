"""Nearest nodes, storage along a curve, versions, and progress of searches as a stream."""

import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnline.functions import zorder
from tarnline.operators import nearest as Q
from tarnline.plans.queries import keeper
from tarnline.sources import clustered, roads, versions
from tarnline.streaming import progress


def metres(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


def test_nearest_nodes_of_many_places(spark, k=10, leaf=8):
    """A crowd, a few far away, and some at one place; places among them, far off, and beyond the pole's side of the world."""
    rng = random.Random(k)
    nodes = [(i, 7 + rng.gauss(0, 0.001), 46 + rng.gauss(0, 0.001)) for i in range(300)] + [(1000 + i, rng.uniform(-20, 30), rng.uniform(30, 70)) for i in range(60)] + [(2000 + i, 8.0, 46.5) for i in range(40)]
    places = [(i, 7 + rng.gauss(0, 0.002), 46 + rng.gauss(0, 0.002)) for i in range(40)] + [(100 + i, rng.uniform(-170, 170), rng.uniform(-80, 80)) for i in range(40)] + [(200, 8.0, 46.5)]
    df = spark.createDataFrame([*places, (201, None, 1.0)], "id long, x double, y double")
    own = spark.createDataFrame([*nodes, (9999, None, None)], "node_id long, x double, y double")
    got = {}
    for r in Q.nearest_join(df, own, k, keeper(spark), leaf=leaf).collect():
        got.setdefault(r.id, {})[r.rank] = (r.node_id, r.dist_m)
    assert set(got) == {p[0] for p in places}
    for i, x, y in places:
        want = sorted((metres((x, y), n[1:]), n[0]) for n in nodes)[:k]
        assert [got[i][r][0] for r in sorted(got[i])] == [n for _, n in want]
        assert all(abs(got[i][r + 1][1] - d) < 1e-6 for r, (d, _) in enumerate(want))
    near = Q.nearest_join(df, own, k, keeper(spark), within=300.0, leaf=leaf).collect()
    assert {(r.id, r.node_id) for r in near} == {(i, n) for i, x, y in places for d, n in sorted((metres((x, y), n[1:]), n[0]) for n in nodes)[:k] if d <= 300}


def test_nearest_without_nodes(spark):
    none = spark.createDataFrame([], "node_id long, x double, y double")
    places = spark.createDataFrame([(1, 7.0, 46.0)], "id long, x double, y double")
    assert Q.nearest_join(places, none, 3, keeper(spark)).count() == 0
    two = none.unionByName(spark.createDataFrame([(1, 7.0, 46.0), (2, 7.0, 46.0)], none.schema))
    assert [(r.node_id, r.rank) for r in Q.nearest_join(places, two, 3, keeper(spark)).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert Q.nearest_join(places.limit(0), none.unionByName(spark.createDataFrame([(1, 7.0, 46.0)], none.schema)), 3, keeper(spark)).count() == 0


def test_candidates_stay_few(spark):
    """Ten thousand nodes, all far from the places: what is kept of a level isn't all of it."""
    rng = random.Random(1)
    nodes = spark.createDataFrame([(i, rng.uniform(7, 8), rng.uniform(46, 47)) for i in range(10_000)], "node_id long, x double, y double")
    places = spark.createDataFrame([(i, 60.0 + i, -30.0) for i in range(5)], "id long, x double, y double")
    sizes = []
    keep = keeper(spark)

    def counting(df):
        out = keep(df)
        if "up" in out.columns and "px" in out.columns:
            sizes.append(out.count())
        return out

    assert Q.nearest_join(places, nodes, 5, counting).count() == 25
    assert max(sizes) < 5 * 600


def test_curve():
    rng = random.Random(2)
    last = (1 << zorder.DEEPEST) - 1
    for most in (4, 64, 5000):
        w, s = rng.randrange(last - 60), rng.randrange(last - 60)
        e, n = w + rng.randrange(1, 60), s + rng.randrange(1, 60)
        runs = zorder.ranges((w, s, e, n), most)
        assert len(runs) <= most + 3 and all(a <= b for a, b in runs) and all(b[0] > a[1] + 1 for a, b in zip(runs, runs[1:], strict=False))
        inside = {zorder.spread(x) | zorder.spread(y) << 1 for x in range(w, e + 1) for y in range(s, n + 1)}
        assert all(any(a <= z <= b for a, b in runs) for z in inside)
        if most == 5000:
            assert sum(b - a + 1 for a, b in runs) == len(inside)


def test_codes_of_columns(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(50)] + [(0.0, 0.0), (10.0, 10.0), (None, 3.0), (-5.0, 99.0)]
    got = [r.z for r in spark.createDataFrame(rows, "x double, y double").select(zorder.code(F.col("x"), F.col("y"), 0.0, 0.0, 10.0).alias("z")).collect()]
    at = lambda v: max(0, min((1 << 24) - 1, int((v or 0.0) / 10.0 * (1 << 24) // 1)))
    assert got == [zorder.spread(at(x)) | zorder.spread(at(y)) << 1 for x, y in rows]


def test_boxes_read_few_files(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.uniform(7, 8), rng.uniform(46, 47), "t") for i in range(6000)] + [(10_000 + i, 7.25, 46.75, "same") for i in range(500)] + [(20_000, None, None, "nowhere")]
    df = spark.createDataFrame(rows, "node_id long, x double, y double, z_note string")
    path = f"file://{tmp_path}/c"
    clustered.write(df, path, files=40)
    files = spark.read.parquet(f"{path}/files").count()
    for box in ((7.2, 46.7, 7.3, 46.8), (7.0, 46.0, 8.0, 47.0), (7.91, 46.11, 7.912, 46.112), (9.0, 46.0, 9.5, 47.0), (7.25, 46.75, 7.25, 46.75)):
        got = {r.node_id for r in clustered.read_box(spark, path, *box).collect()}
        assert got == {i for i, x, y, _ in rows if x is not None and box[0] <= x <= box[2] and box[1] <= y <= box[3]}
        met = clustered.files_in(spark, path, *box).count()
        if box[2] - box[0] < 0.2:
            assert met < files / 3
    assert clustered.read_box(spark, path, 7.2, 46.7, 7.3, 46.8).columns == df.columns
    plan = clustered.read_box(spark, path, 7.2, 46.7, 7.3, 46.8)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "ThanOrEqual(z" in plan
    clustered.write(df.limit(0), f"{path}2")
    assert clustered.read_box(spark, f"{path}2", 0, 0, 9, 99).count() == 0


def net(spark, n):
    nodes = spark.createDataFrame([(i, 7.0, 46.0, 1.0) for i in range(n)], roads.NODE)
    return nodes, spark.createDataFrame([(i, i + 1, 0, 1.0, "path") for i in range(n - 1)], roads.EDGE)


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/net"
    assert roads.save_graph(*net(spark, 5), path) == 1
    reader = roads.load_graph(spark, path)
    bad = net(spark, 9)[1].withColumn("length", F.raise_error(F.lit("killed")).cast("double"))
    with pytest.raises(Exception, match="killed"):
        roads.save_graph(net(spark, 9)[0], bad, path)
    # the failed write left data, and no version
    assert [v["number"] for v in versions.versions(spark, path)] == [1] and roads.load_graph(spark, path)[0].count() == 5
    assert roads.save_graph(*net(spark, 7), path) == 2 and roads.save_graph(*net(spark, 8), path) == 3
    assert [x.count() for x in roads.load_graph(spark, path)] == [8, 7] and [x.count() for x in roads.load_graph(spark, path, 1)] == [5, 4]
    assert [x.count() for x in reader] == [5, 4]
    with pytest.raises(ValueError, match="no version"):
        roads.load_graph(spark, path, 9)
    (tmp_path / "net" / "commits" / "00000004.json").write_text('{"data": "dat')  # a commit that is being written
    assert roads.load_graph(spark, path)[0].count() == 8
    assert len(versions.expire(spark, path, keep=2)) == 1
    with pytest.raises(ValueError, match="no version"):
        roads.load_graph(spark, path, 1)
    assert roads.load_graph(spark, path, 2)[0].count() == 7
    assert len(versions.expire(spark, path, keep=2, unfinished_seconds=0)) == 1 and roads.load_graph(spark, path)[0].count() == 8


def test_writers_at_one_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/many"
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda n: versions.write(spark, path, {"t": spark.range(n)}, {"n": n}), range(1, 7)))
    assert sorted(numbers) == list(range(1, 7))
    for v in versions.versions(spark, path):
        assert spark.read.parquet(f"{versions.folder(spark, path, v['number'])}/t").count() == v["n"]


def test_progress_as_a_stream(spark, tmp_path):
    """Generations in shuffled files, some twice and some late; the stream is stopped in the middle and started again."""
    rng = random.Random(6)
    rows = [(run, g, rng.random() * 0.01 + 0.3 * (g // 9)) for run in range(12) for g in range(1, 41)]
    dealt = rows + rng.sample(rows, 30)
    rng.shuffle(dealt)
    source, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    table = spark.createDataFrame(rows, progress.HISTORY)

    def run():
        stream = progress.watch(spark.readStream.schema(progress.HISTORY).option("maxFilesPerTrigger", 1).parquet(source), wait=False)
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        assert query.awaitTermination(100)

    for i in range(0, len(dealt), 180):
        spark.createDataFrame(dealt[i : i + 180], progress.HISTORY).coalesce(1).write.mode("append").parquet(source)
        if i == 180:
            run()
    run()
    key = lambda df: sorted((r.run, r.generation, r.best, r.top, r.stale, round(r["mean"], 9), r.state) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(progress.progress(table)) and len(key(progress.progress(table))) == len(rows)


class Held:
    """A run's state, as a stream hands it over."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.wait = None, False, False, None

    def update(self, state):
        self.get, self.exists = state, True

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_a_missing_generation_is_waited_for():
    held = Held()
    batch = lambda *rows: iter([pd.DataFrame(rows, columns=["generation", "best"])])
    told = lambda out: [g for own in out for g in own.generation]
    assert told(progress._step((7,), batch((1, 0.1), (3, 0.3), (3, 0.2)), held)) == [1] and held.wait == progress.WAIT_MS
    assert told(progress._step((7,), batch((5, 0.5), (1, 9.0), (None, 1.0)), held)) == []
    held.hasTimedOut = True
    assert told(progress._step((7,), iter([]), held)) == [3, 5] and held.get[4] == []
    held.hasTimedOut = False
    # the missing one is too late now
    assert told(progress._step((7,), batch((2, 0.9), (6, 0.6)), held)) == [6]


def test_progress_by_hand():
    state, told = progress.State(), []
    for g, best in enumerate([0.5, 0.5009, 0.5018, 0.4] + [0.5] * 12, 1):
        state, row = progress.advance(state, g, best)
        told.append((row[2], row[3], row[5]))
    assert told[:4] == [(0.5, 0, "rising"), (0.5, 1, "waiting"), (0.5018, 0, "rising"), (0.5018, 1, "waiting")]
    assert told[11] == (0.5018, 9, "waiting") and told[12] == (0.5018, 10, "stuck") and len(state.last) == 10


def test_equal_places_are_searched_once(spark):
    nodes = spark.createDataFrame([(i, 7.0 + i % 20 / 100, 46.0 + i // 20 / 100) for i in range(400)], "node_id long, x double, y double")
    places = spark.createDataFrame([(i, 7.05 + i % 2 / 50, 46.03) for i in range(300)], "id long, x double, y double")
    sizes, keep = [], keeper(spark)

    def counting(df):
        out = keep(df)
        if "up" in out.columns and "px" in out.columns:
            sizes.append(out.count())
        return out

    got = {}
    for r in Q.nearest_join(places, nodes, 5, counting, leaf=8).collect():
        got.setdefault(r.id, []).append((r.rank, r.node_id, r.dist_m))
    assert len(got) == 300 and all(sorted(got[i]) == sorted(got[i % 2]) and len(got[i]) == 5 for i in got)
    assert max(sizes) < 300


def test_depth_of_a_level_by_itself(spark):
    codes = [0] * 3 + [1 << 2 * k for k in range(24)]
    coded = spark.createDataFrame([(c,) for c in codes], "z long")
    fullest = lambda k: max(Counter(c >> 2 * (zorder.DEEPEST - k) for c in codes).values())
    for most in (1, 3, 5, 9, 20, 100):
        assert zorder.depth(coded, most) == next(k for k in range(zorder.DEEPEST + 1) if fullest(k) <= max(most, 3))
    assert zorder.depth(coded.limit(0), 4) == 0
