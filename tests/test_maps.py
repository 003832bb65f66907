"""Projection, contracted networks, and rasters by blocks."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnline.functions import projection as PR
from tarnline.operators import contraction as T
from tarnline.operators import elevation as E
from tarnline.operators import network as N
from tarnline.plans.queries import keeper
from tarnline.plans.registry import ORACLES, QUERIES
from tarnline.sources import rasters
from tests.parity import rows


def test_projection_of_published_points(spark):
    # longitude, latitude, system, easting, northing
    known = [(12.0, 55.0, 32632, 691875.63214, 6098907.82501), (44.4, 33.3, 32638, 444140.54, 3684706.36)]
    rows = spark.createDataFrame(known, "lon double, lat double, epsg int, e double, n double")
    x, y = PR.forward(F.col("lon"), F.col("lat"), F.col("epsg"))
    got = rows.select(x.alias("x"), y.alias("y"), "e", "n").collect()
    assert abs(got[0].x - got[0].e) < 3e-4 and abs(got[0].y - got[0].n) < 3e-4
    assert abs(got[1].x - got[1].e) < 0.006 and abs(got[1].y - got[1].n) < 0.006


def test_meridian_arcs(spark):
    """On the central meridian the northing is the arc, which a fine sum gives as well."""
    lats = [0.0, 0.5, 23.0, 46.25, 71.5, 84.0]
    rows = spark.createDataFrame([(9.0, t, 32632) for t in lats] + [(9.0, -33.0, 32732)], "lon double, lat double, epsg int")
    x, y = PR.forward(F.col("lon"), F.col("lat"), F.col("epsg"))
    got = [(r.x, r.y) for r in rows.select(x.alias("x"), y.alias("y")).collect()]
    e2 = PR.FLAT * (2 - PR.FLAT)

    def arc(lat):
        t, w = np.polynomial.legendre.leggauss(60)
        half = math.radians(lat) / 2
        phi = half * (t + 1)
        return half * float((w * PR.A * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5).sum())

    for lat, (east, north) in zip(lats, got, strict=False):
        assert abs(east - 500_000) < 1e-6 and abs(north - 0.9996 * arc(lat)) < 1e-5
    assert abs(got[-1][1] - (10_000_000 - 0.9996 * arc(33.0))) < 1e-5


def test_projection_there_and_back(spark):
    rng = random.Random(2)
    rows = [(z * 6 - 183 + rng.uniform(-3.5, 3.5), rng.uniform(-80, 84), (32600 if i % 3 else 32700 if i % 2 else 26900) + z) for i, z in enumerate(rng.choices(range(1, 24), k=300))]
    df = spark.createDataFrame([*rows, (7.5, 46.0, 4326), (7.5, 46.0, 2056), (7.5, 46.0, None)], "lon double, lat double, epsg int")
    x, y = PR.forward(F.col("lon"), F.col("lat"), F.col("epsg"))
    there = df.withColumn("x", x).withColumn("y", y)
    lon, lat = PR.inverse(F.col("x"), F.col("y"), F.col("epsg"))
    got = there.withColumn("lon2", lon).withColumn("lat2", lat).collect()
    for r in got[:-2]:
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9
    assert got[-3].x == 7.5 and got[-2].x is None and got[-1].lon2 is None
    zones = spark.createDataFrame([(7.4, 46.2), (-179.9, -10.0), (180.0, 1.0)], "lon double, lat double").select(PR.zone(F.col("lon"), F.col("lat")).alias("z")).collect()
    assert [r.z for r in zones] == [32632, 32701, 32660]


def test_projected_tiles_are_found(spark):
    """Every point near a tile is found exactly if it lies in the tile's own box; tiles of several systems meet one set of points."""
    rng = random.Random(4)
    tiles = [("n", 380_000.0, 5_120_000.0, 384_000.0, 5_124_000.0, 32632), ("s", 600_000.0, 6_000_000.0, 700_000.0, 6_100_000.0, 32719), ("d", 7.0, 46.0, 7.5, 46.5, 4326), ("?", 0.0, 0.0, 9e9, 9e9, 2056)]
    own = spark.createDataFrame([(t, w, s, e, n, 100.0, 40, 40, -9.0, c) for t, w, s, e, n, c in tiles], "tile_id string, west double, south double, east double, north double, res double, width int, height int, nodata double, epsg int")
    points = [(i, rng.uniform(7.3, 7.6), rng.uniform(46.1, 46.4)) for i in range(800)] + [(1000 + i, rng.uniform(-68.2, -65.6), rng.uniform(-36.4, -35.0)) for i in range(800)]
    df = spark.createDataFrame(points, "node_id long, x double, y double")
    got = {(r.node_id, r.tile_id) for r in E.covering_projected(df, own).collect()}
    want = set()
    for t, w, s, e, n, c in tiles[:3]:
        x, y = PR.forward(F.col("x"), F.col("y"), F.lit(c))
        want |= {(r.node_id, t) for r in df.select("node_id", x.alias("px"), y.alias("py")).collect() if w <= r.px <= e and s <= r.py <= n}
    assert got == want and {t for _, t in got} == {"n", "s", "d"}
    x, y = PR.forward(F.lit(7.45), F.lit(46.25), F.lit(32632))
    pixel = spark.createDataFrame([("n", r, c, float(r * 40 + c)) for r, c in itertools.product(range(40), range(40))], "tile_id string, row long, col long, value double")
    for r in E.samples_projected(df, own.filter("tile_id = 'n'"), pixel).collect():
        assert r.value == math.floor((5_124_000 - r.py) / 100) * 40 + math.floor((r.px - 380_000) / 100)


# a square of streets with a bent street of three inner nodes, a loop and a dead end
PLACES = {1: (0.0, 0.0), 2: (0.01, 0.0), 3: (0.01, 0.01), 4: (0.0, 0.01), 5: (0.002, 0.013), 6: (0.005, 0.015), 7: (0.008, 0.013), 8: (0.02, 0.0), 9: (-0.004, -0.004), 10: (-0.006, 0.0), 20: (0.5, 0.5), 21: (0.5, 0.51), 22: (0.51, 0.5)}
STREETS = [(1, 2, 1200.0), (2, 3, 1150.0), (4, 1, 1130.0), (4, 5, 420.0), (5, 6, 410.0), (6, 7, 400.0), (7, 3, 430.0), (4, 3, 1700.0), (2, 8, 1180.0), (1, 9, 700.0), (9, 10, 600.0), (10, 1, 690.0), (1, 3, 1600.0), (20, 21, 5.0), (21, 22, 6.0), (22, 20, 7.0)]


def test_chains_keep_their_points(spark):
    nodes = spark.createDataFrame([(n, *xy) for n, xy in PLACES.items()], "node_id long, x double, y double")
    edges = spark.createDataFrame(STREETS, "u long, v long, length double")
    got = {(r.u, r.v): (r.length, r.inner, [(p.x, p.y) for p in r.geometry]) for r in T.simplified(nodes, edges, keeper(spark)).collect()}
    line = lambda *ids: [PLACES[i] for i in ids]
    # the bent street (1,660 m) is shorter than the direct one; the ring of 20 to 22 has no node to stay
    one_way = {(1, 2): (1200.0, 0, line(1, 2)), (2, 3): (1150.0, 0, line(2, 3)), (1, 4): (1130.0, 0, line(1, 4)), (4, 3): (1660.0, 3, line(4, 5, 6, 7, 3)), (2, 8): (1180.0, 0, line(2, 8)), (1, 3): (1600.0, 0, line(1, 3))}
    assert {k: v for k, v in got.items() if k[0] != k[1]} == one_way | {(b, a): (m, n, p[::-1]) for (a, b), (m, n, p) in one_way.items()}
    loop = got[1, 1]
    assert loop[:2] == (1990.0, 2) and loop[2] in (line(1, 9, 10, 1), line(1, 10, 9, 1))
    fixed = spark.createDataFrame([(6,)], "node_id long")
    assert (4, 6) in {(r.u, r.v) for r in T.simplified(nodes, edges, keeper(spark), fixed).collect()}
    given = edges.withColumn("geometry", F.when(F.col("u") == 5, F.expr("array(named_struct('x', 0.002D, 'y', 0.013D), named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', 0.005D, 'y', 0.015D))")))
    assert [(p.x, p.y) for p in T.simplified(nodes, given, keeper(spark)).filter("u = 4 and v = 3").first().geometry] == [*line(4, 5), (0.0, 0.0), *line(6, 7, 3)]


def test_rebuilt_networks(spark):
    near = 0.00004  # some four metres
    nodes = spark.createDataFrame([(1, 7.0, 46.0, 500.0), (2, 7.0 + near, 46.0, 502.0), (3, 7.0, 46.0 + near, 504.0), (4, 7.01, 46.0, 510.0), (5, 7.01, 46.01, None)], "node_id long, x double, y double, elevation double")
    edges = spark.createDataFrame([(1, 2, 4.0, "path", None), (2, 4, 800.0, "path", "30 mph"), (3, 4, 820.0, "primary", "50|60"), (4, 5, 1200.0, "path", "walk"), (1, 1, 90.0, "path", None), (5, 1, 1500.0, "track", None)], "u long, v long, length double, highway string, maxspeed string")
    merged, ways = T.for_routing(nodes, edges, keeper(spark))
    own = {r.node_id: r for r in merged.collect()}
    assert set(own) == {1, 4, 5} and own[1].members == [1, 2, 3] and own[1].n == 3 and own[1].elevation == 502.0 and own[5].elevation is None
    assert own[1].x == pytest.approx(7.0 + near / 3) and own[1].y == pytest.approx(46.0 + near / 3)
    got = {(r.u, r.v): r for r in ways.collect()}
    assert set(got) == {(1, 4), (4, 1), (4, 5), (5, 4), (1, 5), (5, 1), (1, 1)}
    short = got[1, 4]
    assert short.merged == 2 and short.highway == "path" and short.speed_kph == pytest.approx(48.28032) and 800 < short.length < 805
    assert [(p.x, p.y) for p in short.geometry] == [(own[1].x, own[1].y), (7.0 + near, 46.0), (7.01, 46.0)]
    assert [(p.x, p.y) for p in got[4, 1].geometry] == [(p.x, p.y) for p in short.geometry][::-1]
    # a path without a speed has that of paths, a track that of all
    assert got[4, 5].speed_kph == pytest.approx(48.28032) and got[5, 1].speed_kph == pytest.approx((48.28032 * 2 + 55 * 2) / 4)
    assert got[4, 5].travel_time == pytest.approx(1200 / 48.28032 * 3.6) and got[4, 5].bearing == pytest.approx(0.0, abs=1e-6) and got[5, 4].bearing == pytest.approx(180.0)
    assert got[1, 1].bearing is None and got[1, 1].length > 90
    none = T.for_routing(nodes.limit(0), edges.limit(0), keeper(spark))
    assert none[0].count() == 0 and none[1].count() == 0
    assert T.with_speeds(edges.drop("maxspeed"), 42.0).select("speed_kph").distinct().collect()[0][0] == 42.0


def test_lzw():
    # the example that the format's description gives
    codes = (256, 7, 258, 8, 8, 258, 6, 6, 257)
    bits = "".join(f"{c:09b}" for c in codes)
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert rasters.unlzw(body) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6)) and rasters.lzw(bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))) == body
    rng = random.Random(3)
    for n, kinds in ((0, 1), (1, 1), (5000, 2), (40_000, 7), (90_000, 256), (300_000, 3)):
        raw = bytes(rng.randrange(kinds) for _ in range(n))
        assert rasters.unlzw(rasters.lzw(raw)) == raw
    assert rasters.unpackbits(bytes((254, 170, 2, 128, 0, 42, 128, 253, 170))) == bytes((170, 170, 170, 128, 0, 42, 170, 170, 170, 170))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("blocks")
    rng = np.random.default_rng(1)
    made = {}
    for k, (packed, predictor, kind) in enumerate([(1, 1, "f8"), (5, 1, "i2"), (5, 2, "u2"), (8, 3, "f4"), (5, 3, "f8"), (32946, 2, "i4"), (1, 3, "f4"), (8, 2, "u1")]):
        values = rng.integers(0, 200, (21, 17)).astype(kind)
        values[3, 4] = 0
        made[f"t{k}"] = values.astype(float)
        (out / f"t{k}.tif").write_bytes(rasters.encoded(values, 100.0 * k, 50.0, 2.0, 0.0, 32632 if k % 2 else 4326, packed, predictor, 8))
    (out / "fax.tif").write_bytes(rasters.encoded(np.ones((2, 2)), 0, 0, 1.0, packed=3))
    (out / "cut.tif").write_bytes(rasters.encoded(np.ones((20, 20)), 0, 0, 1.0, packed=8)[:150])
    (out / "not.tif").write_bytes(b"II")
    return f"file://{out}", made


def test_rasters_of_each_kind(spark, folder):
    path, made = folder
    got = {}
    for r in rasters.pixels(spark, path).collect():
        got.setdefault(r.tile_id, {})[r.row, r.col] = r.value
    for name, values in made.items():
        assert got[name] == {(i, j): values[i, j] for i in range(21) for j in range(17) if values[i, j] != 0}, name
    assert {r.path.rsplit("/")[-1] for r in rasters.skipped(spark, path).collect()} == {"fax.tif", "cut.tif", "not.tif"}
    index = rasters.block_index(spark, path)
    assert index.count() == 3 * len(made) and {r.epsg for r in index.filter("tile_id = 't1'").collect()} == {32632}


def test_only_blocks_under_points_are_decoded(spark, folder, tmp_path):
    path, made = folder
    index = rasters.block_index(spark, path)
    rng = random.Random(9)
    places = [(i, f"t{rng.randrange(9)}", rng.randrange(-2, 24), rng.randrange(-2, 20)) for i in range(900)]
    got = {r.node_id: r.value for r in rasters.sample_blocks(spark.createDataFrame(places, "node_id long, tile_id string, row long, col long"), index).collect()}
    want = {i: (made[t][r, c] or None) for i, t, r, c in places if t in made and 0 <= r < 21 and 0 <= c < 17}
    assert got == want
    # a broken block that no point falls into does no harm
    broken = index.withColumn("start", F.when(F.col("block_row") == 2, 10**9).otherwise(F.col("start")))
    few = spark.createDataFrame([(1, "t3", 9, 9)], "node_id long, tile_id string, row long, col long")
    assert rasters.sample_blocks(few, broken).first().value == made["t3"][9, 9]


def test_boxes_are_pushed_to_the_source(spark, folder):
    path, made = folder
    rasters.register(spark)
    own = spark.read.format("raster_pixels").load(path)
    everything = {(r.tile_id, r.row, r.col): r.value for r in own.collect()}
    assert everything == {(t, i, j): v[i, j] for t, v in made.items() for i in range(21) for j in range(17) if v[i, j] != 0}
    box = own.filter("x between 305 and 318 and y > 20")
    assert {(r.tile_id, r.row, r.col) for r in box.collect()} == {(t, i, j) for t, i, j in everything if 305 <= 100 * int(t[1:]) + 2 * j + 1 <= 318 and 50 - 2 * i - 1 > 20}
    assert box.rdd.getNumPartitions() == 2 < own.rdd.getNumPartitions()
    assert own.filter("x > 1e7").count() == 0
    reader = rasters._PixelReader(path)
    list(reader.pushFilters([rasters.GreaterThanOrEqual(("x",), 305.0), rasters.LessThan(("y",), 30.0)]))
    assert {p.path.rsplit("/")[-1] for p in reader.partitions()} == {"t3.tif", "t4.tif", "t5.tif", "t6.tif", "t7.tif"} and {p.row for p in reader.partitions()} == {1, 2}


def test_close_pairs_at_a_pole(spark):
    rng = random.Random(4)
    # from where degrees of x are long to where they have hardly any length, on both sides of the pole
    places = [(i, rng.uniform(7.0, 7.02), lat + rng.uniform(-0.0002, 0.0002)) for i, lat in enumerate((46.0, 89.0, 89.9, 89.9999, 90.0, 90.001, 95.0) * 40)]
    points = spark.createDataFrame(places, "node_id long, x double, y double")

    def metres(a, b):
        (_, x, y), (_, v, w) = a, b
        h = math.sin(math.radians(w - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(w)) * math.sin(math.radians(v - x) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h)) if h >= 0 else math.nan

    want = {(a[0], b[0]) for a in places for b in places if a[0] < b[0] and metres(a, b) < 10}
    assert {tuple(r) for r in N.close_pairs(points, 10.0).collect()} == want and len(want) > 100


@pytest.mark.parametrize("name", ["consolidated_nodes", "rebuilt_nodes"])
def test_nodes_beyond_the_poles_merge_as_in_sql(spark, tmp_path, name):
    # rows of nodes at 46, 87, 90 and 95 degrees; near a pole neighbours in a row are less than 10 m apart on the globe
    keys = [k for row in (0, 41_000, 43_770, 43_771, 48_770) for k in range(20 * row, 20 * row + 20)]
    parts = spark.createDataFrame([(k, k % 50, 900.0 + k % 100) for k in keys], "p_partkey long, p_size int, p_retailprice double")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES[name](spark, str(tmp_path)).toArrow()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(ORACLES[name]).to_arrow_table()
    assert rows(got, want.column_names) == rows(want, want.column_names)


def test_close_pairs_in_a_plane(spark):
    rng = random.Random(5)
    places = [(i, rng.uniform(7.0, 7.001), lat + rng.uniform(-0.0002, 0.0002)) for i, lat in enumerate((46.0, 89.9999, 90.0, 95.0) * 50)]
    points = spark.createDataFrame(places, "node_id long, x double, y double")
    metres = lambda a, b: 6371000 * math.hypot(math.radians(a[2] - b[2]), math.radians(a[1] - b[1]) * math.cos(math.radians(46.0)))
    want = {(a[0], b[0]) for a in places for b in places if a[0] < b[0] and metres(a, b) < 10}
    assert {tuple(r) for r in N.close_pairs(points, 10.0, 46.0).collect()} == want and len(want) > 50


def test_merging_never_broadcasts_nodes(spark):
    nodes = spark.range(50).selectExpr("id AS node_id", "7 + id / 10000 AS x", "46.0D AS y")
    plan = N.consolidated(nodes, keeper(spark))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan
