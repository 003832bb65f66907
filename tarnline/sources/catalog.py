"""Catalogs of stored networks and tiles: keys, upserts, listings, eviction, statistics, and configurations with defaults.

A catalog is a table (key, path, kind, created, last_accessed, size, ...); deleting files is the caller's, who gets the rows to delete.
"""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import versions

#: Named search configurations: population, generations, crossover, mutation, elite, objective (fixed values).
PRESETS = {"standard": (100, 200, 0.8, 0.1, 2, "elevation"), "fast": (50, 100, 0.9, 0.15, 1, "elevation"), "thorough": (200, 500, 0.7, 0.05, 5, "elevation"), "distance_focused": (100, 150, 0.85, 0.08, 3, "distance"), "balanced": (150, 300, 0.75, 0.12, 4, "balanced")}
CONFIG = "name string, population int, generations int, crossover double, mutation double, elite int, objective string"
#: Radius and kind of the networks that are prepared ahead (fixed values).
COMMON = ((800, "all"), (1200, "all"), (2000, "all"), (5000, "all"))


def legacy_name(lat: Column, lon: Column, radius: Column, kind: Column) -> Column:
    """File name of a stored network."""
    return F.format_string("cached_graph_%.4f_%.4f_%dm_%s.pkl", lat, lon, radius, kind)


def from_legacy_name(name: Column) -> Column:
    """What a file name says: lat, lon, radius, kind; nulls where it isn't one."""
    part = lambda i, t: F.when(name.rlike(_LEGACY), F.regexp_extract(name, _LEGACY, i)).cast(t)
    return F.struct(part(1, "double").alias("lat"), part(2, "double").alias("lon"), part(3, "int").alias("radius"), part(4, "string").alias("kind"))


_LEGACY = r"cached_graph_(-?[0-9]+\.[0-9]{4})_(-?[0-9]+\.[0-9]{4})_([0-9]+)m_([a-z_]+)\.pkl$"


def cache_key(lat: Column, lon: Column, radius: Column, kind: Column) -> Column:
    """md5 of the JSON of all parameters, in the order of their names."""
    body = F.format_string('{"center": [%.6f, %.6f], "consolidation_tolerance": 10, "elevation_source": "3dep", "network_type": "%s", "radius_m": %d, "running_filter": true, "version": "2.0"}', lat, lon, kind, radius)
    return F.md5(body.cast("binary"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every key (upsert: later rows replace earlier ones)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_i", rank).filter("_i = 1").drop("_i")


def valid(catalog: DataFrame, files: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Entries whose file exists and that are younger than so many days."""
    return catalog.filter(F.unix_timestamp(now) - F.unix_timestamp("created") < days * 86400).join(files.select("path").distinct(), "path", "left_semi")


def listing(catalog: DataFrame, now: Column) -> DataFrame:
    """Entries with their age in days, youngest first."""
    return catalog.withColumn("age_days", (F.unix_timestamp(now) - F.unix_timestamp("created")) / 86400).orderBy("age_days", "key")


def superseded(catalog: DataFrame, keep_latest: bool = True) -> DataFrame:
    """Entries that a clean-up deletes: all, or all but the newest (ties by key). The newest is one aggregate, so no task sees all rows."""
    if not keep_latest:
        return catalog
    newest = catalog.agg(F.max(F.struct("created", "key")).alias("n")).select(F.col("n.key").alias("key"))
    return catalog.join(F.broadcast(newest), "key", "left_anti")


def evicted(catalog: DataFrame, now: Column, days: int = 30, most_bytes: float = 10e9) -> DataFrame:
    """Entries that have to go, with the reason: age, or size: those last used longest ago, until the rest is within the bound.

    Sizes are summed in a few ranges of the time of use first, so the running total needs no sort of all rows in one task.
    """
    used = F.unix_timestamp(F.coalesce("last_accessed", "created"))
    aged = catalog.withColumn("_used", used).withColumn("_old", F.unix_timestamp(now) - F.unix_timestamp("created") > days * 86400)
    left = aged.filter("not _old").withColumn("_day", F.floor(F.col("_used") / 86400))
    by_day = left.groupBy("_day").agg(F.sum("size").alias("_sum"))
    later = by_day.withColumn("_newer", F.sum("_sum").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)))  # one row a day
    within = Window.partitionBy("_day").orderBy(F.desc("_used"), "key")
    running = left.join(later.select("_day", "_newer"), "_day").withColumn("_total", F.coalesce("_newer", F.lit(0)) + F.sum("size").over(within))
    old = aged.filter("_old").select(*catalog.columns, F.lit("age").alias("reason"))
    return old.unionByName(running.filter(F.col("_total") > most_bytes).select(*catalog.columns, F.lit("size").alias("reason")))


def stats(catalog: DataFrame) -> DataFrame:
    """Entries, megabytes (one place), first and last creation."""
    return catalog.agg(F.count(F.lit(1)).alias("entries"), F.round(F.coalesce(F.sum("size"), F.lit(0)) / 1048576, 1).alias("mb"), F.min("created").alias("oldest"), F.max("created").alias("newest"))


def operations(log: DataFrame) -> DataFrame:
    """Statistics of logged operations (operation, seconds, items) and advice: slow (over 60 s on average), heavy (over 10 ms an item), or fine."""
    mean, each = F.avg("seconds"), F.sum("seconds") / F.greatest(F.sum("items"), F.lit(1))
    own = log.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("total"), mean.alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("most"), each.alias("per_item"))
    return own.withColumn("advice", F.when(F.col("mean") > 60, "slow").when(F.col("per_item") > 0.01, "heavy").otherwise("fine"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """Percent of lookups that hit; 0 without lookups."""
    return F.coalesce(F.try_divide(hits, hits + misses) * 100, F.lit(0.0))


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PRESETS.items()], CONFIG)


def with_defaults(rows: DataFrame, default: str = "standard") -> DataFrame:
    """Configurations with missing values from a preset; unknown columns are left out. Rows without a name are passed over."""
    fields = [f.split()[0] for f in CONFIG.split(", ")]
    of = dict(zip(fields[1:], PRESETS[default], strict=True))
    types = dict(f.split() for f in CONFIG.split(", "))
    own = {c.lower() for c in rows.columns}
    return rows.filter("name is not null").select("name", *((F.coalesce(F.col(f).cast(types[f]), F.lit(of[f]).cast(types[f])) if f in own else F.lit(of[f]).cast(types[f])).alias(f) for f in fields[1:]))


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Stored configurations (JSON lines), with defaults; malformed lines are passed over."""
    return with_defaults(spark.read.schema(CONFIG).option("mode", "PERMISSIVE").json(path))


def write_configs(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def valid_config(c: DataFrame) -> DataFrame:
    """Configurations with whether they can run."""
    share = lambda x: F.col(x).between(0, 1)
    return c.withColumn("valid", (F.col("population") > 0) & (F.col("generations") > 0) & share("crossover") & share("mutation") & (F.col("elite") >= 0) & (F.col("elite") < F.col("population")))


def prepare_common(spark: SparkSession, base: str, lat: float, lon: float, build) -> list[str]:
    """Stores the common networks that aren't stored yet, made by build(radius, kind) -> (nodes, edges); the paths that are new."""
    from .roads import graph_path, save_graph

    made = []
    for radius, kind in COMMON:
        path = graph_path(base, lat, lon, radius, kind)
        if not stored(spark, path):
            save_graph(*build(radius, kind), path)
            made.append(path)
    return made


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a whole network: a version of one, or two finished tables."""
    return versions.folder(spark, path) is not None or all(exists(spark, f"{path}/{t}/_SUCCESS") for t in ("nodes", "edges"))


def listed(spark: SparkSession, base: str) -> list[str]:
    """Stored networks under a folder, sorted: whole ones only."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/network_type=*/radius_m=*/*")
    found = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(root) or []
    paths = [str(PurePosixPath(s.getPath().toUri().getPath())) for s in found]
    return sorted(p for p in paths if stored(spark, p))


class Networks:
    """Networks by place and radius: stored ones are read, others built and stored; each is loaded once a session."""

    def __init__(self, spark: SparkSession, base: str, build) -> None:
        self.spark, self.base, self.build, self.known = spark, base, build, {}

    def load(self, lat: float, lon: float, radius: int, kind: str = "all", anew: bool = False) -> tuple[DataFrame, DataFrame]:
        from .roads import graph_path, load_graph, save_graph

        key = (lat, lon, radius, kind)
        if anew or key not in self.known:
            path = graph_path(self.base, lat, lon, radius, kind)
            if anew or not stored(self.spark, path):
                save_graph(*self.build(lat, lon, radius, kind), path)
            self.known[key] = load_graph(self.spark, path)
        return self.known[key]


def metrics_json(log: DataFrame) -> DataFrame:
    """Logged operations as one JSON text each."""
    return log.select(F.to_json(F.struct(*log.columns)).alias("json"))


def to_json(config: dict) -> str:
    return json.dumps(config, indent=2, sort_keys=True)
