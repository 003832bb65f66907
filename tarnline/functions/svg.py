"""Drawings of routes as SVG texts, made by aggregation: no plotting library, one row a drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 800, 240


def _drawn(points: DataFrame, x: str, y: str, colour: Column | str) -> DataFrame:
    """route_id and a drawing of a line through (x, y) of its points in order, scaled to the frame; routes of fewer than three points have none."""
    w = Window.partitionBy("route_id")
    scaled = lambda c, size: F.when(F.max(c).over(w) > F.min(c).over(w), (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w)) * size).otherwise(size / 2.0)
    rows = points.withColumn("_x", scaled(x, WIDTH)).withColumn("_y", HEIGHT - scaled(y, HEIGHT))
    place = F.concat_ws(",", F.round("_x").cast("long").cast("string"), F.round("_y").cast("long").cast("string"))
    lines = rows.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("ord", place.alias("t")))).alias("p")).filter(F.size("p") >= 3)
    path = F.array_join(F.transform("p", lambda q: q["t"]), " ")
    hue = F.lit(colour) if isinstance(colour, str) else colour
    return lines.select("route_id", F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}"><polyline fill="none" stroke="'), hue, F.lit('" points="'), path, F.lit('"/></svg>')).alias("svg"))


def profiles(points: DataFrame, colour: Column | str = "black") -> DataFrame:
    """Elevation over distance."""
    return _drawn(points, "cum_m", "elevation", colour)


def maps(points: DataFrame, colour: Column | str = "black") -> DataFrame:
    """The way on the map."""
    return _drawn(points, "x", "y", colour)


def compared(drawings: DataFrame, by: Column) -> DataFrame:
    """Drawings of a group (by: its key) under each other in one, in the order of their ids: key, n, svg."""
    rows = drawings.withColumn("key", by).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("route_id", "svg"))).alias("p"))
    parts = F.transform("p", lambda q, i: F.concat(F.lit('<g transform="translate(0,'), (i * HEIGHT).cast("string"), F.lit(')">'), F.regexp_replace(q["svg"], "^<svg[^>]*>|</svg>$", ""), F.lit("</g>")))
    return rows.select("key", F.size("p").alias("n"), F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} '), (F.size("p") * HEIGHT).cast("string"), F.lit('">'), F.array_join(parts, ""), F.lit("</svg>")).alias("svg"))
