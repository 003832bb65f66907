"""Elevation sources to plug in: what gives heights for points (node_id, x, y), where, and which to ask first."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import elevation as E
from .network import hybrid_elevation


class Source(ABC):
    """A source of heights."""

    name = "source"
    resolution_m = 0.0

    @abstractmethod
    def sample(self, points: DataFrame) -> DataFrame:
        """node_id and elevation, null where the source has none; points that it doesn't know may be left out."""

    @abstractmethod
    def available(self, points: DataFrame) -> DataFrame:
        """node_id of the points that the source covers."""

    @abstractmethod
    def bounds(self) -> DataFrame:
        """One row: west, south, east, north, tiles; zeros without any."""

    def info(self) -> dict:
        return {"type": type(self).__name__, "name": self.name, "resolution_m": self.resolution_m}

    def profile(self, points: DataFrame) -> DataFrame:
        """node_id and elevation of all points, 0 where the source has none."""
        return points.select("node_id").join(self.sample(points).select("node_id", "elevation"), "node_id", "left").fillna(0.0, ["elevation"])


class Rasters(Source):
    """Raster tiles as tables; the finest tile with a value counts."""

    def __init__(self, tiles: DataFrame, pixels: DataFrame, name: str = "rasters", resolution_m: float = 1.0) -> None:
        self.tiles, self.pixels, self.name, self.resolution_m = tiles, pixels, name, resolution_m

    def sample(self, points: DataFrame) -> DataFrame:
        return E.finest_tile(E.samples(points, self.tiles, self.pixels)).select("node_id", "elevation")

    def available(self, points: DataFrame) -> DataFrame:
        return E.covering(points, self.tiles).select("node_id").distinct()

    def bounds(self) -> DataFrame:
        return E.bounds(self.tiles)


class Hybrid(Source):
    """Several sources in the order they are asked in."""

    name = "hybrid"

    def __init__(self, sources: list[Source]) -> None:
        self.sources, self.resolution_m = sources, min(s.resolution_m for s in sources)

    def sample(self, points: DataFrame) -> DataFrame:
        found = self.labelled(points)
        return found.select("node_id", F.when(F.col("source") != "none", F.col("elevation")).alias("elevation"))

    def labelled(self, points: DataFrame) -> DataFrame:
        """node_id, elevation (0 where no source has one) and the name of the source."""
        return hybrid_elevation(points.select("node_id"), [(s.name, s.sample(points)) for s in self.sources], zero_is_missing=False)

    def available(self, points: DataFrame) -> DataFrame:
        out = self.sources[0].available(points)
        for s in self.sources[1:]:
            out = out.unionByName(s.available(points))
        return out.distinct()

    def bounds(self) -> DataFrame:
        out = self.sources[0].bounds()
        for s in self.sources[1:]:
            out = out.unionByName(s.bounds())
        some = out.filter("tiles > 0")
        return some.agg(*(F.coalesce(f(c), F.lit(0.0)).alias(c) for c, f in (("west", F.min), ("south", F.min), ("east", F.max), ("north", F.max))), F.coalesce(F.sum("tiles"), F.lit(0)).alias("tiles"))


def chosen(preferred: str, fine: Source | None, coarse: Source | None, fall_back: bool = True) -> Source | None:
    """The source to use: fine alone or before coarse, both as hybrid, coarse alone; what isn't there gives way to what is."""
    if preferred in ("fine", "hybrid") and fine and coarse and (fall_back or preferred == "hybrid"):
        return Hybrid([fine, coarse])
    if preferred in ("fine", "hybrid") and fine:
        return fine
    return coarse or (fine if fall_back else None)
