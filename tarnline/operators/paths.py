"""K shortest paths, paths of few edges, and what is built on shortest paths (see blocks).

K shortest paths go by the surroundings of their sources where the places of nodes are given; else they broadcast the
network, which then has to have at most LOCAL_EDGES edges (they are counted first).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnline.functions.geo import haversine

from .blocks import Keep, hops, near_paths, nearest_first, reached

__all__ = ["LOCAL_EDGES", "Keep", "bounded_paths", "detailed_path", "hop_counts", "k_shortest_pairs", "leg_pairs", "near_paths", "pair_distances", "return_legs"]

#: Edges of a network up to which it is broadcast (24 bytes each).
LOCAL_EDGES = 500_000


def _broadcast(steps: DataFrame, most: int):
    """The network as lists of neighbours in a broadcast variable; None if it has too many edges."""
    found = steps.limit(most + 1).toArrow()
    if found.num_rows > most:
        return None
    around: dict[int, list[tuple[int, float]]] = {}
    for u, v, m in zip(*(c.to_pylist() for c in found.columns), strict=True):
        around.setdefault(u, []).append((v, m))
    return steps.sparkSession.sparkContext.broadcast(around)


def _k_best(around: dict, source: int, target: int, k: int, cutoff: float) -> list[tuple[float, list[int]]]:
    first = next(((d, p) for n, d, p in nearest_first(around, source, cutoff, target) if n == target), None)
    if first is None:
        return []
    length = {(u, v): m for u, ways in around.items() for v, m in ways}
    out, waiting, seen = [first], [], {tuple(first[1])}
    while len(out) < k:
        path, done = out[-1][1], 0.0
        for i in range(len(path) - 1):
            begin = path[: i + 1]
            barred = frozenset((p[i], p[i + 1]) for _, p in out if p[: i + 1] == begin)
            rest = next(((d, p) for n, d, p in nearest_first(around, path[i], cutoff - done, target, frozenset(begin[:-1]), barred) if n == target), None)
            if rest and tuple(whole := begin[:-1] + rest[1]) not in seen:
                seen.add(tuple(whole))
                heapq.heappush(waiting, (sum(length[s] for s in zip(whole, whole[1:], strict=False)), whole))
            done += length[path[i], path[i + 1]]
        if not waiting:
            break
        out.append(heapq.heappop(waiting))
    return out


_K_PATHS = "src long, dst long, rank long, length double, path array<bigint>"


def _k_rows(found: list[tuple[int, int, int, float, list[int]]]) -> pa.Table:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
    columns = zip(*found, strict=True) if found else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["src", "dst", "rank", "length", "path"])


def k_shortest_pairs(edges: DataFrame, pairs: DataFrame, k: int, keep: Keep, cutoff: float = float("inf"), most_local: int = LOCAL_EDGES, nodes: DataFrame | None = None, first_m: float = 2000.0) -> DataFrame:
    """src, dst, rank (from 1), length and path: the k shortest loopless paths of every pair (src, dst), fewer if there aren't k.

    The shortest path is varied: of every path found, each beginning is kept, the steps that known paths take from it are
    barred, and the rest is searched anew. Ties go to the lesser path. Without nodes the network has to fit the broadcast; a
    larger one raises. With nodes it may have any size: a pair is searched in what lies within first_m of its source, and, as
    long as it has fewer than k paths of that length and edges lead further, within twice as much.
    """
    asked = pairs.select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct()
    if nodes is not None:
        return _k_around(edges, asked, k, keep, cutoff, nodes, first_m)
    if (known := _broadcast(keep(hops(edges)), most_local)) is None:
        raise ValueError(f"k shortest paths need a network of at most {most_local} edges; cut it to the surroundings first")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _k_rows([(s, t, i + 1, *x) for i, x in enumerate(_k_best(known.value, s, t, k, cutoff))]).to_batches()

    return asked.mapInArrow(search, _K_PATHS)


def _k_search(k: int, within: float, cutoff: float):
    def search(pair: pa.Table, ways: pa.Table) -> pa.Table:
        around: dict[int, list[tuple[int, float]]] = {}
        for u, v, m in zip(*(ways.column(c).to_pylist() for c in ("u", "v", "length")), strict=True):
            around.setdefault(u, []).append((v, m))
        s, t = pair["src"][0].as_py(), pair["dst"][0].as_py()
        return _k_rows([(s, t, i + 1, *x) for i, x in enumerate(_k_best(around, s, t, k, cutoff if pair["whole"][0].as_py() else within))])

    return search


def _k_around(edges: DataFrame, asked: DataFrame, k: int, keep: Keep, cutoff: float, nodes: DataFrame, metres: float) -> DataFrame:
    steps, left, done = keep(hops(edges)), keep(asked.filter("src is not null and dst is not null")), None
    while True:
        # all nodes of ways of so many metres are that near; of k ways found among these none is missing
        within = min(metres, cutoff)
        near = keep(reached(steps, within, keep, nodes, left.select(F.col("src").alias("node_id")).distinct()).select("src", F.col("node_id").alias("u"), "dist").join(steps, "u"))
        inside = left.join(near.filter(F.col("dist") + F.col("length") <= within).select("src", "u", "v", "length"), "src").select(F.col("src").alias("s"), F.col("dst").alias("t"), "u", "v", "length")

        further = near.filter(F.col("dist") + F.col("length") > within).select("src", F.lit(True).alias("more")).distinct()
        # where no edge leads further, all that the source reaches is at hand, for ways of any length
        own = keep(left.join(further, "src", "left").select("src", "dst", F.col("more").isNull().alias("whole")))
        found = keep(own.groupBy("src", "dst").cogroup(inside.groupBy("s", "t")).applyInArrow(_k_search(k, within, cutoff), _K_PATHS))
        counted = own.join(found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), ["src", "dst"], "left")
        more = counted.filter((F.coalesce("n", F.lit(0)) < k) & ~F.col("whole")).select("src", "dst")
        more = keep(more if within < cutoff else more.limit(0))
        whole = found.join(more, ["src", "dst"], "left_anti")
        done = whole if done is None else done.unionByName(whole)
        if more.isEmpty():
            return done
        left, metres = more, 2 * metres


def hop_counts(edges: DataFrame, sources: DataFrame, most: int, keep: Keep) -> DataFrame:
    """src, node_id and hops: the least number of edges, up to most."""
    steps = edges.select("u", "v").distinct()
    found = front = keep(sources.select(F.col("node_id").alias("src"), "node_id", F.lit(0).alias("hops")).distinct())
    for n in range(1, most + 1):
        reached = front.join(steps, F.col("node_id") == F.col("u")).select("src", F.col("v").alias("node_id")).distinct()
        front = keep(reached.join(found, ["src", "node_id"], "left_anti").withColumn("hops", F.lit(n)))
        found = found.unionByName(front)
    return found


def bounded_paths(edges: DataFrame, pairs: DataFrame, most: int, keep: Keep) -> DataFrame:
    """src, dst and path: all loopless paths of at most so many edges between the pairs. What can't reach its end in the edges left isn't followed."""
    steps = keep(edges.select("u", "v").distinct())
    ends = pairs.select(F.col("dst").alias("node_id")).distinct()
    left = keep(hop_counts(steps.select(F.col("v").alias("u"), F.col("u").alias("v")), ends, most, keep).select(F.col("src").alias("dst"), F.col("node_id").alias("v"), "hops"))
    walks, done = pairs.filter("src <> dst").select("src", "dst", F.array("src").alias("path")).distinct(), None
    for n in range(1, most + 1):
        near = walks.withColumn("u", F.element_at("path", -1)).join(steps, "u").filter(~F.array_contains("path", F.col("v"))).join(left, ["dst", "v"]).filter(F.col("hops") <= most - n)
        moved = keep(near.select("src", "dst", F.concat("path", F.array("v")).alias("path")))
        arrived = moved.filter(F.element_at("path", -1) == F.col("dst"))
        done = arrived if done is None else done.unionByName(arrived)
        walks = moved.filter(F.element_at("path", -1) != F.col("dst"))
    return done


def pair_distances(pairs: DataFrame, near: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst and dist with its kind for every pair (src, dst): same (0), edge, path (from near), air line, or unknown (0 where a node isn't known)."""
    hop = hops(edges).select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("length").alias("edge"))
    at = lambda end: nodes.select(F.col("node_id").alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y"))
    own = pairs.select("src", "dst").distinct().join(hop, ["src", "dst"], "left").join(near.select("src", F.col("node_id").alias("dst"), F.col("dist").alias("way")), ["src", "dst"], "left").join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    air = haversine(F.col("src_y"), F.col("src_x"), F.col("dst_y"), F.col("dst_x"))
    kind = F.when(F.col("src") == F.col("dst"), "same").when(F.col("edge").isNotNull(), "edge").when(F.col("way").isNotNull(), "path").when(air.isNotNull(), "air").otherwise("unknown")
    dist = F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.coalesce("edge", "way", air, F.lit(0.0)))
    return own.select("src", "dst", dist.alias("dist"), kind.alias("kind"))


def _legs(way: DataFrame, closed: bool) -> DataFrame:
    w = Window.partitionBy("route_id").orderBy("ord")
    legs = way.select("route_id", "ord", F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst"))
    if closed:
        first = F.first_value("src").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        legs = legs.withColumn("dst", F.coalesce("dst", first))
    return legs.filter("dst is not null and src <> dst")


def leg_pairs(way: DataFrame, closed: bool = True) -> DataFrame:
    """What detailed_path() asks of near: src, dst."""
    return _legs(way, closed).select("src", "dst").distinct()


def detailed_path(way: DataFrame, near: DataFrame, nodes: DataFrame, edges: DataFrame, closed: bool = True) -> DataFrame:
    """All nodes between the waypoints of routes (route_id, ord, node_id): route_id, k (from 1), node_id, kind, m (metres along the air lines).

    Legs are shortest paths from near; a leg without one goes straight to its end. closed adds the leg back to the first
    waypoint. A node is an intersection if its degree isn't 2, and so are the first one and the ends of straight legs; else geometry.
    """
    legs = _legs(way, closed).join(near.select("src", F.col("node_id").alias("dst"), "path"), ["src", "dst"], "left")
    walked = F.coalesce(F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))), F.array("dst"))
    inner = legs.select("route_id", "ord", F.col("path").isNull().alias("straight"), F.posexplode(walked).alias("i", "node_id"))
    start = way.groupBy("route_id").agg(F.min("ord").alias("o"), F.min_by("node_id", "ord").alias("node_id")).select("route_id", (F.col("o") - 1).alias("ord"), F.lit(True).alias("straight"), F.lit(0).alias("i"), "node_id")
    degree = edges.groupBy(F.col("u").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    rows = inner.unionByName(start).join(nodes.select("node_id", "x", "y", "elevation"), "node_id").join(degree, "node_id", "left")
    order = Window.partitionBy("route_id").orderBy("ord", "i")
    d = F.coalesce(haversine(F.lag("y").over(order), F.lag("x").over(order), F.col("y"), F.col("x")), F.lit(0.0))
    kind = F.when(F.col("straight") | (F.coalesce("degree", F.lit(0)) != 2), "intersection").otherwise("geometry")
    out = rows.withColumn("d", d).withColumn("kind", kind).withColumn("k", F.row_number().over(order))
    return out.select("route_id", "k", "node_id", "kind", "x", "y", "elevation", F.sum("d").over(order).alias("m"))


def return_legs(near: DataFrame, back: DataFrame, around: DataFrame, least: float, most: float) -> DataFrame:
    """For every source of near its way back to the start: straight if its length fits, else through the neighbour with the least id that makes it fit: src, via (null: straight), length, path.

    back: node_id, dist and path to the start. around: u, v, length; parallel edges count by the shortest. Sources that can't return within the bounds have no row.
    """
    home = back.select(F.col("node_id").alias("src"), F.col("dist").alias("length"), F.col("path"))
    sources = near.select("src").distinct()
    straight = sources.join(home, "src").filter(F.col("length").between(least, most)).select("src", F.lit(None).cast("long").alias("via"), "length", "path")
    over = sources.join(hops(around).select(F.col("u").alias("src"), F.col("v").alias("via"), F.col("length").alias("step")), "src").join(back.select(F.col("node_id").alias("via"), F.col("dist"), F.col("path")), "via")
    fits = over.select("src", "via", (F.col("step") + F.col("dist")).alias("length"), F.concat(F.array("src"), "path").alias("path")).filter(F.col("length").between(least, most))
    other = fits.groupBy("src").agg(F.min(F.struct("via", "length", "path")).alias("x")).select("src", "x.via", "x.length", "x.path")
    return straight.unionByName(other.join(straight, "src", "left_anti"))
