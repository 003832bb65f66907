"""Building blocks of route search: paths from one node, targets, neighbours, and edits of node lists as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import near_paths
from .paths import k_shortest_pairs

Keep = Callable[[DataFrame], DataFrame]


def draw(*salt: Column | str) -> Column:
    """A number from 0 to 1 (exclusive) by hash."""
    return F.pmod(F.xxhash64(*salt), F.lit(1 << 30)) / F.lit(float(1 << 30))


def shortest_paths(edges: DataFrame, start: int, cutoff: float, keep: Keep, nodes: DataFrame | None = None) -> DataFrame:
    """node_id, dist and path (nodes from the start) of all nodes within a cutoff; parallel edges count by the shortest."""
    one = edges.sparkSession.sql(f"SELECT {int(start)}L AS node_id")
    return near_paths(edges, cutoff, keep, one, nodes).drop("src")


def k_shortest(edges: DataFrame, source: int, target: int, k: int, keep: Keep, cutoff: float = float("inf")) -> DataFrame:
    """length and path of the k shortest loopless paths between two nodes, of at most cutoff metres; fewer if there aren't k."""
    one = edges.sparkSession.sql(f"SELECT {int(source)}L AS src, {int(target)}L AS dst")
    return k_shortest_pairs(edges, one, k, keep, cutoff).orderBy("rank").select("length", "path")


def out_and_back(paths: DataFrame, target_m: float, tolerance: float = 0.15, tries: int = 5) -> DataFrame:
    """The first of the nodes closest to 45 percent of the target (within 30 percent) whose way there and back is within the tolerance."""
    out = 0.45 * target_m
    off = F.abs(F.col("dist") - out)
    near = paths.filter(F.col("dist").between(0.7 * out, 1.3 * out)).orderBy(off, "node_id").limit(tries)
    fit = near.filter((F.col("dist") * 2).between(target_m * (1 - tolerance), target_m * (1 + tolerance)))
    return fit.orderBy(off, "node_id").limit(1).select("node_id", (F.col("dist") * 2).alias("total_m"), there_and_back(F.col("path")).alias("nodes"))


def there_and_back(path: Column) -> Column:
    return F.concat(path, F.slice(F.reverse(path), F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))))


def terrain_bins(nodes: DataFrame, start: int, very_high: float = 100.0, high: float = 30.0) -> DataFrame:
    """Nodes not below the start by their height above it: very_high, high or moderate."""
    base = nodes.filter(F.col("node_id") == start).select(F.col("elevation").alias("base"))
    up = F.col("elevation") - F.col("base")
    own = nodes.join(F.broadcast(base), F.lit(True)).withColumn("gain", up)  # one row
    return own.filter("gain >= 0").withColumn("category", F.when(up >= very_high, "very_high").when(up >= high, "high").otherwise("moderate"))


def unexplored_peaks(nodes: DataFrame, visited: DataFrame, start: int, least: float = 40.0, k: int = 20) -> DataFrame:
    """The k highest nodes more than so many metres above the start that no route visits."""
    higher = terrain_bins(nodes, start).filter((F.col("gain") > least) & (F.col("node_id") != start))
    return higher.join(visited.select("node_id").distinct(), "node_id", "left_anti").orderBy(F.desc("elevation"), "node_id").limit(k).select("node_id", "elevation")


def highest_neighbours(nodes: DataFrame, edges: DataFrame, least: float = 0.0) -> DataFrame:
    """For each node its highest neighbour, if that is more than so many metres higher; ties by id."""
    at = nodes.select("node_id", "elevation")
    near = edges.select("u", "v").join(at.select(F.col("node_id").alias("v"), F.col("elevation").alias("ve")), "v").join(at.select(F.col("node_id").alias("u"), F.col("elevation").alias("ue")), "u")
    best = near.groupBy("u").agg(F.max(F.struct(F.col("ve").alias("e"), (-F.col("v")).alias("m"))).alias("x"), F.first("ue").alias("ue"))
    return best.filter(F.col("x.e") - F.col("ue") > least).select(F.col("u").alias("node_id"), (-F.col("x.m")).alias("neighbour"), (F.col("x.e") - F.col("ue")).alias("rise"))


def splice(a: Column, b: Column, cut_a: Column, cut_b: Column) -> Column:
    """The first cut_a nodes of a, then b after its first cut_b nodes."""
    return F.concat(F.slice(a, F.lit(1), cut_a), F.slice(b, cut_b + 1, F.greatest(F.size(b) - cut_b, F.lit(0))))


def cross_at_connection(a: Column, b: Column, u: Column) -> Column:
    """a up to a node that both pass inside, then b from there; a if they share none. u chooses among the shared nodes."""
    inner = lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 2, F.lit(0)))
    shared = F.array_sort(F.array_except(F.array_intersect(inner(a), inner(b)), F.array(a[0])))
    node = F.try_element_at(shared, (F.floor(u * F.size(shared)) + 1).cast("int"))
    at = lambda x: F.array_position(x, node).cast("int")
    return F.when(F.size(shared) > 0, splice(a, b, at(a), at(b))).otherwise(a)


def without_loop(nodes: Column, i: Column) -> Column:
    """The walk without what lies between the first and the last visit of its i-th node (from 1); the start's visits stay."""
    node = F.element_at(nodes, i)
    last = F.size(nodes) + 1 - F.array_position(F.reverse(nodes), node).cast("int")
    return F.when(node == nodes[0], nodes).otherwise(splice(nodes, nodes, F.array_position(nodes, node).cast("int"), last))
