"""Raster files, map extracts, sources to plug in, timing and the command line."""

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnline import __main__ as cli
from tarnline.functions.timing import Profiler
from tarnline.operators import heights as H
from tarnline.sources import catalog, osm, rasters, roads


def tiff(values, west, north, res, nodata, packed=False, tile=None, end="<"):
    """A one-band TIFF of doubles with the tags of its place."""
    height, width = values.shape
    dtype = np.dtype(f"{end}f8")
    if tile:
        whole = np.full((-(-height // tile) * tile, -(-width // tile) * tile), nodata)
        whole[:height, :width] = values
        parts = [whole[i : i + tile, j : j + tile].astype(dtype).tobytes() for i in range(0, whole.shape[0], tile) for j in range(0, whole.shape[1], tile)]
    else:
        parts = [values[i : i + 2].astype(dtype).tobytes() for i in range(0, height, 2)]
    parts = [zlib.compress(p) for p in parts] if packed else parts
    body, at = b"", 8
    offsets = []
    for p in parts:
        offsets.append(at + len(body))
        body += p
    tags = {256: ("I", [width]), 257: ("I", [height]), 258: ("H", [64]), 259: ("H", [8 if packed else 1]), 277: ("H", [1]), 339: ("H", [3]), 33550: ("d", [res, res, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, west, north, 0.0]), 42113: ("c", [c.encode() for c in f"{nodata:g}\0"])}
    tags |= {322: ("I", [tile]), 323: ("I", [tile]), 324: ("I", offsets), 325: ("I", list(map(len, parts)))} if tile else {273: ("I", offsets), 278: ("I", [2]), 279: ("I", list(map(len, parts)))}
    directory, extra = b"", b""
    start = 8 + len(body)
    beyond = start + 2 + 12 * len(tags) + 4
    for tag, (code, vals) in sorted(tags.items()):
        raw = struct.pack(f"{end}{len(vals)}{code}", *vals)
        if len(raw) <= 4:
            field = raw.ljust(4, b"\0")
        else:
            field = struct.pack(end + "I", beyond + len(extra))
            extra += raw
        directory += struct.pack(end + "HHI", tag, {"H": 3, "I": 4, "d": 12, "c": 2}[code], len(vals)) + field
    head = (b"II" if end == "<" else b"MM") + struct.pack(end + "HI", 42, start)
    return head + body + struct.pack(end + "H", len(tags)) + directory + struct.pack(end + "I", 0) + extra


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("rasters")
    values = np.arange(30, dtype=float).reshape(5, 6) + 100
    values[2, 3] = -9
    (out / "a.tif").write_bytes(tiff(values, 7.0, 46.05, 0.01, -9))
    (out / "b.tif").write_bytes(tiff(values * 2, 7.0, 46.05, 0.02, -18, packed=True, end=">"))
    (out / "deep").mkdir()
    (out / "deep" / "c.tif").write_bytes(tiff(values + 1, 8.0, 46.05, 0.01, -8, tile=4))
    (out / "d.asc").write_text("ncols 2\nnrows 2\nxllcorner 9\nyllcorner 46\ncellsize 0.5\nNODATA_value -1\n5 6\n-1 8\n")
    (out / "broken.tif").write_bytes(b"II*\0nothing")
    return f"file://{out}", values


def test_raster_files(spark, folder):
    path, values = folder
    index = {r.tile_id: r for r in rasters.tile_index(spark, path).collect()}
    assert set(index) == {"a", "b", "c", "d"}
    a, d = index["a"], index["d"]
    assert (a.west, a.north, a.res, a.width, a.height, a.nodata) == (7.0, 46.05, 0.01, 6, 5, -9.0) and a.east == pytest.approx(7.06) and a.south == pytest.approx(46.0)
    assert (d.west, d.south, d.east, d.north) == (9.0, 46.0, 10.0, 47.0)
    got = {}
    for r in rasters.pixels(spark, path).collect():
        got.setdefault(r.tile_id, {})[r.row, r.col] = r.value
    for name, own in (("a", values), ("b", values * 2), ("c", values + 1)):
        assert got[name] == {(i, j): own[i, j] for i in range(5) for j in range(6) if values[i, j] != -9}
    assert got["d"] == {(0, 0): 5.0, (0, 1): 6.0, (1, 1): 8.0}


def test_sources_of_heights(spark, folder):
    path, values = folder
    tiles, pixels = rasters.tile_index(spark, path), rasters.pixels(spark, path)
    fine = H.Rasters(tiles.filter("tile_id = 'a'"), pixels, "fine")
    coarse = H.Rasters(tiles.filter("tile_id in ('b', 'c')"), pixels, "coarse", 30.0)
    points = spark.createDataFrame([(1, 7.005, 46.045), (2, 7.035, 46.025), (3, 8.005, 46.045), (4, 20.0, 20.0)], "node_id long, x double, y double")
    both = H.chosen("hybrid", fine, coarse)
    got = {r.node_id: (r.elevation, r.source) for r in both.labelled(points).collect()}
    assert got == {1: (values[0, 0], "fine"), 2: (values[1, 1] * 2, "coarse"), 3: (values[0, 0] + 1, "coarse"), 4: (0.0, "none")}
    assert {r.node_id: r.elevation for r in both.profile(points).collect()}[4] == 0.0
    assert {r.node_id for r in both.available(points).collect()} == {1, 2, 3}
    box = both.bounds().first()
    assert box.west == 7.0 and box.tiles == 3 and box.east == pytest.approx(8.06)
    assert H.chosen("fine", fine, None) is fine and H.chosen("fine", None, coarse) is coarse and H.chosen("coarse", fine, coarse) is coarse and H.chosen("coarse", None, None) is None
    assert fine.info() == {"type": "Rasters", "name": "fine", "resolution_m": 1.0} and both.resolution_m == 1.0


@pytest.fixture(scope="module")
def extract(tmp_path_factory):
    grid = {10 * i + j: (46.001 + 0.001 * i, 7.001 + 0.001 * j) for i in range(8) for j in range(8)}
    ways = [{"type": "way", "id": i, "nodes": [10 * i + j for j in range(8)], "tags": {"highway": "residential"}} for i in range(8)]
    ways += [{"type": "way", "id": 100 + j, "nodes": [10 * i + j for i in range(8)], "tags": {"highway": "footway" if j == 3 else "path", "surface": "sand" if j == 5 else "gravel_road" if j == 6 else "asphalt"}} for j in range(8)]
    ways += [{"type": "way", "id": 200, "nodes": [0, 11, 999], "tags": {"highway": "tertiary", "oneway": "yes"}}, {"type": "way", "id": 201, "nodes": [22, 33], "tags": {"highway": "tertiary", "access": "private"}}]
    elements = [{"type": "node", "id": n, "lat": y, "lon": x, "tags": {"highway": "crossing"} if n == 11 else {}} for n, (y, x) in grid.items()] + ways
    out = tmp_path_factory.mktemp("extract")
    (out / "town.json").write_text(json.dumps({"version": 0.6, "elements": elements}))
    return f"file://{out}/town.json", grid


def test_extract_and_preparation(spark, extract, folder, tmp_path):
    path, grid = extract
    nodes, edges = osm.read_extract(spark, path)
    pairs = {(r.u, r.v) for r in edges.collect()}
    want = {(10 * i + j, 10 * i + j + 1) for i in range(8) for j in range(7)} | {(10 * i + j, 10 * i + 10 + j) for i in range(7) for j in range(8)} | {(22, 33)}
    assert pairs == want | {(b, a) for a, b in want} | {(0, 11)}
    assert nodes.count() == 64 and nodes.filter("highway = 'crossing'").count() == 1
    y = math.radians(0.001)
    assert edges.filter("u = 0 and v = 10").first().length == pytest.approx(6371000 * y, rel=1e-6)
    ready, weighted = osm.built(spark, path, folder[0])
    kept = {(r.u, r.v) for r in weighted.collect()}
    assert (3, 13) not in kept and (5, 15) not in kept and (6, 16) not in kept and (22, 33) not in kept and (0, 1) in kept and (0, 11) in kept
    assert ready.filter("elevation = 0").count() == 0 and {"degree", "elevation", "highway"} <= set(ready.columns)
    about = osm.metadata(ready, weighted).first()
    assert about.n_nodes == 64 and about.coverage == 100.0 and about.n_edges == len(kept)
    roads.save_graph(ready, weighted.withColumn("key", F.col("key").cast("int")), f"file://{tmp_path}/net")
    lines = cli.main([f"file://{tmp_path}/net", "starts", "--most", "5"], spark)
    assert len(lines) == 5 and lines[0].startswith("0  degree")
    out = cli.main([f"file://{tmp_path}/net", "route", "--lat", "46.004", "--lon", "7.004", "--km", "1.5", "--objective", "distance", "--out", f"file://{tmp_path}/out"], spark)
    assert out[0] == "Route statistics" and any(x.startswith("Difficulty") for x in out)
    assert json.loads(next((tmp_path / "out" / "geojson").glob("part*")).read_text())["features"][0]["geometry"]["type"] == "LineString"
    assert "<polyline" in next((tmp_path / "out" / "profile").glob("part*")).read_text() and "<trkpt" in next((tmp_path / "out" / "gpx").glob("part*")).read_text()
    with pytest.raises(ValueError):
        cli.main([f"file://{tmp_path}/net", "route", "--start", "12345"], spark)


def test_profiler(spark):
    log = Profiler()

    @log.watch("twice")
    def twice(x):
        return 2 * x

    assert [twice(i) for i in range(3)] == [0, 2, 4]
    with pytest.raises(KeyError), log.timed("fails", 5):
        raise KeyError
    rows = {r.operation: r for r in catalog.operations(log.frame(spark)).collect()}
    assert rows["twice"].n == 3 and rows["fails"].n == 1 and [r[3] for r in log.rows] == [True, True, True, False]
