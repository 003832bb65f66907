"""Texts and colours for routes: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of ratings; others are grey (fixed values).
BADGES = {"very_easy": "#4CAF50", "easy": "#8BC34A", "moderate": "#FF9800", "hard": "#FF5722", "very_hard": "#F44336"}
#: Heights in metres over which a node is drawn in a colour (fixed values).
HEIGHTS = ((625.0, "red"), (615.0, "orange"), (605.0, "yellow"))


def fixed(value: Column, digits: int = 0) -> Column:
    """A number with so many places, halves away from 0; nulls count as 0. What the last bits of a sum add is rounded off first."""
    return F.format_string(f"%.{digits}f", F.round(F.coalesce(value, F.lit(0.0)).cast("double"), 9))


def signed(value: Column) -> Column:
    return F.format_string("%+.0f", F.round(F.coalesce(value, F.lit(0.0)).cast("double"), 9))


def statistics(km: Column, gain: Column, loss: Column, max_grade: Column, minutes: Column, n: Column, objective: Column) -> Column:
    """A block of lines on a route."""
    rule = "=" * 50
    rows = [F.lit("Route statistics"), F.lit(rule)]
    for label, value in (("Distance", F.concat(fixed(km, 2), F.lit(" km"))), ("Elevation gain", F.concat(fixed(gain), F.lit(" m"))), ("Elevation loss", F.concat(fixed(loss), F.lit(" m"))), ("Net elevation", F.concat(signed(gain - loss), F.lit(" m"))), ("Max grade", F.concat(fixed(max_grade, 1), F.lit("%"))), ("Time", F.concat(fixed(minutes), F.lit(" minutes"))), ("Points", F.concat(n.cast("string"), F.lit(" intersections"))), ("Objective", objective)):
        rows.append(F.concat(F.lit(f"{label + ':':<17}"), value))
    return F.array_join(F.array(*rows, F.lit(rule)), "\n")


def direction(step: Column, kind: Column, terrain: Column, elevation: Column, change: Column, km: Column) -> Column:
    """Three lines on a step of directions."""
    told = F.when(kind == "start", "Start here").when(kind == "finish", "Finish").otherwise(F.concat(F.lit("Continue "), terrain))
    return F.concat(step.cast("string"), F.lit(". "), told, F.lit("\n   Elevation: "), fixed(elevation), F.lit("m ("), signed(change), F.lit("m)\n   Distance: "), fixed(km, 2), F.lit(" km"))


def summary(km: Column, gain: Column, minutes: Column) -> Column:
    return F.concat(fixed(km, 1), F.lit("km, "), fixed(gain), F.lit("m gain, ~"), fixed(minutes), F.lit("min"))


def profile(low: Column, high: Column, max_grade: Column, steep: Column) -> Column:
    part = lambda label, value: F.concat(F.lit(f"   {label}: "), value)
    return F.array_join(F.array(F.lit("Elevation profile:"), part("Min", F.concat(fixed(low), F.lit("m"))), part("Max", F.concat(fixed(high), F.lit("m"))), part("Range", F.concat(fixed(high - low), F.lit("m"))), part("Max grade", F.concat(fixed(max_grade, 1), F.lit("%"))), part("Steep sections", steep.cast("string"))), "\n")


def badge(rating: Column, score: Column) -> Column:
    """text, score, color and description of a rating."""
    told = F.coalesce(rating, F.lit("unknown"))
    colour = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in BADGES.items() for x in kv)), rating), F.lit("#9E9E9E"))
    points = F.concat(fixed(score), F.lit("/100"))
    return F.struct(told.alias("text"), points.alias("score"), colour.alias("color"), F.concat(F.lit("Difficulty: "), told, F.lit(" ("), points, F.lit(")")).alias("description"))


def height_colour(elevation: Column) -> Column:
    chain = F.when(elevation > HEIGHTS[0][0], HEIGHTS[0][1])
    for least, name in HEIGHTS[1:]:
        chain = chain.when(elevation > least, name)
    return chain.otherwise("green")


def shade(value: Column, low: Column, high: Column) -> Column:
    """A grey from dark (low) to light (high); the middle one where both are equal."""
    part = F.lpad(F.lower(F.hex(F.round(F.when(high > low, (value - low) / (high - low)).otherwise(0.5) * 255).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), part, part, part)


def route_colour(index: Column, total: int) -> Column:
    """Hues spread evenly over so many routes."""
    return F.concat(F.lit("hsl("), F.format_string("%.0f", index / total * 360), F.lit(", 70%, 60%)"))


def file_name(base: Column, start: Column, km: Column, at: Column, extension: str) -> Column:
    return F.concat(base, F.lit("_"), start.cast("string"), F.lit("_"), fixed(km, 1), F.lit("km_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(f".{extension}"))
