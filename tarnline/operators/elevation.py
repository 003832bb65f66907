"""Elevation from raster tiles as tables, and enrichment of networks with it.

A tile is a row (tile_id, west, south, east, north, res, width, height, nodata), its pixels are rows (tile_id, row, col,
value); row 0 is the northern one. Points are rows (node_id, x, y). All coordinates are in one system, but for the
functions on projected tiles, whose column epsg names each tile's own system; points are in degrees there.

Points meet pixels by sorting, never by a broadcast: pixels made by exploding arrays look as few as the arrays to Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnline.functions import projection

#: Degrees of a grid cell in which points meet tiles; tiles should not be many cells wide.
CELL = 0.01


def covering(points: DataFrame, tiles: DataFrame, cell: float = CELL) -> DataFrame:
    """Every point with every tile whose box holds it (bounds count), by an equi-join on grid cells."""
    at = lambda c: F.floor(F.col(c) / cell)
    cells = tiles.withColumn("_cx", F.explode(F.sequence(at("west"), at("east")))).withColumn("_cy", F.explode(F.sequence(at("south"), at("north"))))
    met = points.withColumn("_cx", at("x")).withColumn("_cy", at("y")).join(cells, ["_cx", "_cy"])
    return met.filter(F.col("x").between(F.col("west"), F.col("east")) & F.col("y").between(F.col("south"), F.col("north"))).drop("_cx", "_cy")


def samples(points: DataFrame, tiles: DataFrame, pixels: DataFrame, cell: float = CELL) -> DataFrame:
    """node_id, tile_id, res and value of the pixel under every point in every covering tile; null for no data, beyond the array, and no pixel."""
    met = covering(points.select("node_id", "x", "y"), tiles, cell)
    col, row = F.floor((F.col("x") - F.col("west")) / F.col("res")), F.floor((F.col("north") - F.col("y")) / F.col("res"))
    placed = met.select("node_id", "tile_id", "res", "nodata", row.alias("row"), col.alias("col"))
    value = F.when(~F.isnan("value"), F.nullif("value", "nodata"))
    return placed.join(pixels.hint("merge"), ["tile_id", "row", "col"], "left").select("node_id", "tile_id", "res", value.alias("value"))


def degree_boxes(tiles: DataFrame) -> DataFrame:
    """Tiles in systems of their own (column epsg) with a box in degrees around each (west_deg, south_deg, east_deg, north_deg): from the corners and the middles of the sides, and a little more, as sides are bent. Unknown systems are left out."""
    known = tiles.filter(projection.is_known(F.col("epsg")))
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    xs, ys = (F.col("west"), middle("west", "east"), F.col("east")), (F.col("south"), middle("south", "north"), F.col("north"))
    corners = [projection.inverse(x, y, F.col("epsg")) for i, x in enumerate(xs) for j, y in enumerate(ys) if i != 1 or j != 1]
    (west, east), (south, north) = ((F.least(*c), F.greatest(*c)) for c in ([p[0] for p in corners], [p[1] for p in corners]))
    boxed = known.withColumns({"west_deg": west, "east_deg": east, "south_deg": south, "north_deg": north})
    more = lambda a, b: (F.col(b) - F.col(a)) * 0.02 + 1e-9
    wide, high = more("west_deg", "east_deg"), more("south_deg", "north_deg")
    return boxed.withColumns({"west_deg": F.col("west_deg") - wide, "east_deg": F.col("east_deg") + wide, "south_deg": F.col("south_deg") - high, "north_deg": F.col("north_deg") + high})


def covering_projected(points: DataFrame, tiles: DataFrame, cell: float = CELL) -> DataFrame:
    """Every point (degrees) with every tile whose box, in the tile's own system (column epsg), holds it, and its place there: px, py. Met through grid cells of the tiles' boxes in degrees."""
    at = lambda c: F.floor(F.col(c) / cell)
    cells = degree_boxes(tiles).withColumn("_cx", F.explode(F.sequence(at("west_deg"), at("east_deg")))).withColumn("_cy", F.explode(F.sequence(at("south_deg"), at("north_deg")))).drop("west_deg", "east_deg", "south_deg", "north_deg")
    met = points.withColumn("_cx", at("x")).withColumn("_cy", at("y")).join(cells, ["_cx", "_cy"]).drop("_cx", "_cy")
    px, py = projection.forward(F.col("x"), F.col("y"), F.col("epsg"))
    return met.withColumns({"px": px, "py": py}).filter(F.col("px").between(F.col("west"), F.col("east")) & F.col("py").between(F.col("south"), F.col("north")))


def samples_projected(points: DataFrame, tiles: DataFrame, pixels: DataFrame, cell: float = CELL) -> DataFrame:
    """samples() for tiles in systems of their own: node_id, tile_id, res, value, px and py."""
    met = covering_projected(points.select("node_id", "x", "y"), tiles, cell)
    col, row = F.floor((F.col("px") - F.col("west")) / F.col("res")), F.floor((F.col("north") - F.col("py")) / F.col("res"))
    placed = met.select("node_id", "tile_id", "res", "nodata", "px", "py", row.alias("row"), col.alias("col"))
    value = F.when(~F.isnan("value"), F.nullif("value", "nodata"))
    return placed.join(pixels.hint("merge"), ["tile_id", "row", "col"], "left").select("node_id", "tile_id", "res", value.alias("value"), "px", "py")


def first_tile(sampled: DataFrame) -> DataFrame:
    """The value in a point's first tile by id, even where that has no data and another tile would."""
    return sampled.groupBy("node_id").agg(F.min_by("value", "tile_id").alias("elevation"), F.min("tile_id").alias("tile_id"))


def last_tile(sampled: DataFrame, points: DataFrame) -> DataFrame:
    """The value in a point's last tile by id that has one; 0 without any."""
    best = sampled.groupBy("node_id").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("tile_id"))).alias("elevation"))
    return points.select("node_id").join(best, "node_id", "left").fillna(0.0, ["elevation"])


def finest_tile(sampled: DataFrame) -> DataFrame:
    """The value in a point's tile of the finest resolution (ties by id) that has one."""
    known = sampled.filter("value is not null")
    return known.groupBy("node_id").agg(F.min_by("value", F.struct("res", "tile_id")).alias("elevation"), F.min(F.struct("res", "tile_id"))["tile_id"].alias("tile_id"))


def available(points: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """node_id and, for each source (its tiles), whether a tile covers the point; anywhere: whether any does."""
    out = points.select("node_id")
    for name, tiles in sources:
        hit = covering(points, tiles).select("node_id").distinct().withColumn(name, F.lit(True))
        out = out.join(hit, "node_id", "left").fillna(False, [name])
    anywhere = F.lit(False)
    for name, _ in sources:
        anywhere = anywhere | F.col(name)
    return out.withColumn("anywhere", anywhere)


def bounds(tiles: DataFrame) -> DataFrame:
    """The envelope of tiles; zeros without any."""
    return tiles.agg(*(F.coalesce(f(c), F.lit(0.0)).alias(c) for c, f in (("west", F.min), ("south", F.min), ("east", F.max), ("north", F.max))), F.count(F.lit(1)).alias("tiles"))


def tiles_near(tiles: DataFrame, lat: float, lon: float, km: float = 2.0) -> DataFrame:
    """Tiles whose box meets the box of a radius round a point; a degree of latitude is 111 km."""
    from math import cos, radians

    dy, dx = km / 111.0, km / (111.0 * cos(radians(lat)))
    return tiles.filter((F.col("west") <= lon + dx) & (F.col("east") >= lon - dx) & (F.col("south") <= lat + dy) & (F.col("north") >= lat - dy))


def tiles_with_value(tiles: DataFrame, pixels: DataFrame, lat: float, lon: float) -> DataFrame:
    """Tiles that cover a point and have a value there."""
    point = tiles.sparkSession.range(1).select(F.col("id").alias("node_id"), F.lit(lon).alias("x"), F.lit(lat).alias("y"))
    return samples(point, tiles, pixels).filter("value is not null").select("tile_id", "res", "value")


def query_keys(queries: DataFrame) -> DataFrame:
    """Distinct lookups: points rounded to six places by source, with how many ask for each and the batch of 50 it is in."""
    keyed = queries.groupBy("source", F.round("y", 6).alias("lat"), F.round("x", 6).alias("lon")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("lat", "lon"))
    return keyed.withColumn("batch", F.floor((place - 1) / 50))


def has_elevation(nodes: DataFrame) -> DataFrame:
    """One row: whether there are nodes and all have an elevation, and the share of those above 0 in percent."""
    return nodes.agg((F.count(F.lit(1)) > 0).alias("some"), F.coalesce(F.bool_and(F.col("elevation").isNotNull()), F.lit(False)).alias("complete"), F.coalesce(F.try_divide(F.count_if(F.col("elevation") > 0), F.count(F.lit(1))) * 100, F.lit(0.0)).alias("coverage"))


def fill_gaps(nodes: DataFrame, fallback: DataFrame) -> DataFrame:
    """nodes with elevations of 0 or less, or none, taken from the fallback (node_id, elevation), if that has one."""
    other = fallback.select("node_id", F.col("elevation").alias("_other"))
    gap = F.col("elevation").isNull() | (F.col("elevation") <= 0)
    return nodes.join(other, "node_id", "left").withColumn("elevation", F.when(gap, F.coalesce("_other", "elevation")).otherwise(F.col("elevation"))).drop("_other")


def summary(nodes: DataFrame) -> DataFrame:
    """Counts, coverage in percent, range and mean of the elevations that aren't 0."""
    known = F.when(F.col("elevation") != 0, F.col("elevation"))
    return nodes.agg(F.count(F.lit(1)).alias("total"), F.count(known).alias("known"), (F.try_divide(F.count(known), F.count(F.lit(1))) * 100).alias("coverage"), F.min(known).alias("low"), F.max(known).alias("high"), (F.max(known) - F.min(known)).alias("range"), F.avg(known).alias("mean"))


def signed_grades(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with grade (rise over length, a signed fraction) and grade_abs; 0 without a length."""
    at = lambda end: nodes.select(F.col("node_id").alias(end), F.coalesce("elevation", F.lit(0.0)).alias(f"_{end}"))
    grade = F.when(F.col("length") > 0, (F.col("_v") - F.col("_u")) / F.col("length")).otherwise(0.0)
    return edges.join(at("u"), "u").join(at("v"), "v").withColumn("grade", grade).withColumn("grade_abs", F.abs("grade")).drop("_u", "_v")


def enriched(points: DataFrame, tiles: DataFrame, pixels: DataFrame, fallback: DataFrame, least_coverage: float = 90.0) -> DataFrame:
    """Points with elevation and source: the finest tile, and, if those cover less than so many percent, the fallback (node_id, elevation) for the others, else 0.

    The coverage is one row, joined to all.
    """
    own = points.join(finest_tile(samples(points, tiles, pixels)).select("node_id", F.col("elevation").alias("_tile")), "node_id", "left").join(fallback.select("node_id", F.col("elevation").alias("_other")), "node_id", "left")
    share = own.agg((F.coalesce(F.try_divide(F.count("_tile"), F.count(F.lit(1))), F.lit(0.0)) * 100).alias("_share"))
    filled = F.when(F.col("_share") < least_coverage, F.col("_other"))
    out = own.crossJoin(F.broadcast(share))  # one row
    return out.withColumn("elevation", F.coalesce("_tile", filled, F.lit(0.0))).withColumn("source", F.when(F.col("_tile").isNotNull(), "tile").when(filled.isNotNull(), "fallback").otherwise("none")).drop("_tile", "_other", "_share")


def decoded(value: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Stored pixel values as metres."""
    return value * scale + offset
