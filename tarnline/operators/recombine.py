"""Crossover and mutation of routes as column expressions and joins; every draw is an argument, so results repeat.

Routes are node lists (nodes) or lists of segment paths (paths). Alternatives come from a table of near shortest paths
(src, node_id, dist, path; see paths.near_paths). What an operator asks of that table it also gives as pairs (src, dst), so
that no other ways need be searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slice(x: Column, start: Column | int, n: Column) -> Column:
    """n elements from a place (from 1); none for a negative n."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.slice(x, start.cast("int"), F.greatest(n.cast("int"), F.lit(0)))


# Crossover


def exchange(paths_a: Column, paths_b: Column, first: Column, second: Column) -> Column:
    """The paths of a, then those of b that start or end at one of two nodes."""
    touches = lambda p: p[0].isin(first, second) | F.element_at(p, -1).isin(first, second)
    return F.concat(paths_a, F.filter(paths_b, touches))


def common_ends(paths_a: Column, paths_b: Column) -> Column:
    """Sorted nodes at which segments of both routes start or end."""
    ends = lambda ps: F.array_distinct(F.flatten(F.transform(ps, lambda p: F.array(p[0], F.element_at(p, -1)))))
    return F.array_sort(F.array_intersect(ends(paths_a), ends(paths_b)))


def distance_to_nodes(walk: DataFrame, edges: DataFrame) -> DataFrame:
    """Of every route (route_id, nodes) and node on it: to, the metres along the network to its first visit, and rest, those after it. Missing edges count nothing."""
    hop = edges.groupBy("u", "v").agg(F.min("length").alias("length"))
    rows = walk.select("route_id", F.posexplode("nodes").alias("i", "v"))
    w = Window.partitionBy("route_id").orderBy("i")
    known = rows.withColumn("u", F.lag("v").over(w)).join(hop, ["u", "v"], "left").withColumn("m", F.sum(F.coalesce("length", F.lit(0.0))).over(w))
    known = known.withColumn("whole", F.max("m").over(Window.partitionBy("route_id")))
    return known.groupBy("route_id", F.col("v").alias("node_id")).agg(F.min("m").alias("to"), F.max("whole").alias("whole"), F.min("i").alias("i")).select("route_id", "node_id", "to", (F.col("whole") - F.col("to")).alias("rest"), (F.col("i") + 1).alias("place"))


def crossover_points(mates: DataFrame, reach: DataFrame, start: DataFrame, target_m: float, most: int = 3) -> DataFrame:
    """The best places at which mates (a, b) can be crossed: a, b, node_id, score, rank. reach: rows of distance_to_nodes(). start: route_id and the node that doesn't count.

    The score is the mean over both children of 1 / (1 + their distance from the target over the target); ties by node.
    Children over the same edges are equally long, whatever the order in which their doubles were summed: distances count to
    six places, in which sums of lengths leave no trace of that order.
    """
    side = lambda s: reach.select(F.col("route_id").alias(s), "node_id", F.col("to").alias(f"to_{s}"), F.col("rest").alias(f"rest_{s}"))
    met = mates.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "node_id"]).join(start.select(F.col("route_id").alias("a"), F.col("node_id").alias("home")), "a").filter("node_id <> home")
    close = lambda m: 1 / (1 + F.round(F.abs(m - target_m), 6) / target_m)
    score = (close(F.col("to_a") + F.col("rest_b")) + close(F.col("to_b") + F.col("rest_a"))) / 2
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("score"), "node_id"))
    return met.withColumn("score", score).withColumn("rank", rank).filter(F.col("rank") <= most).select("a", "b", "node_id", "score", "rank")


def split_at(nodes: Column, node: Column) -> tuple[Column, Column]:
    """A route up to the first visit of a node, and from there on; both hold the node."""
    i = F.array_position(nodes, node)
    return _slice(nodes, 1, i), _slice(nodes, i, F.size(nodes) - i + 1)


def cross_at(a: Column, b: Column, node: Column) -> tuple[Column, Column]:
    """Both children of two routes that pass a node: each goes on as the other."""
    (a1, a2), (b1, b2) = split_at(a, node), split_at(b, node)
    tail = lambda x: _slice(x, 2, F.size(x) - 1)
    return F.concat(a1, tail(b2)), F.concat(b1, tail(a2))


def substitutable(props: DataFrame, mates: DataFrame, most_m: float = 500.0, first: int = 2) -> DataFrame:
    """Segments of mates (a, b) with the same ends and less than so many metres between their lengths: a, b, seg_a, seg_b, rank; the first few in the order of their places."""
    side = lambda s: props.select(F.col("route_id").alias(s), F.col("seg").alias(f"seg_{s}"), "start_node", "end_node", (F.col("km") * 1000).alias(f"m_{s}"))
    met = mates.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "start_node", "end_node"]).filter(F.abs(F.col("m_a") - F.col("m_b")) < most_m)
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("seg_a", "seg_b"))
    return met.select("a", "b", "seg_a", "seg_b", rank.alias("rank")).filter(F.col("rank") <= first)


def peaks(points: DataFrame, least: float = 5.0) -> DataFrame:
    """Strict local peaks of routes (route_id, ord, node_id, elevation) whose lesser side is higher than so many metres: route_id, node_id, prominence (the largest of its visits)."""
    w = Window.partitionBy("route_id").orderBy("ord")
    e = F.col("elevation")
    side = F.least(e - F.lag("elevation").over(w), e - F.lead("elevation").over(w))
    both = points.withColumn("before", F.lag("ord").over(w)).withColumn("after", F.lead("ord").over(w)).withColumn("prominence", side)
    return both.filter(F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("prominence") > least)).groupBy("route_id", "node_id").agg(F.max("prominence").alias("prominence"))


def _asked(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    return rows.select(F.explode(F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in pairs))).alias("p")).select("p.*").filter("src is not null and dst is not null").distinct()


def _places(walk: DataFrame, new: DataFrame) -> DataFrame:
    w = Window.partitionBy("route_id").orderBy("place")
    rows = walk.select("route_id", F.posexplode("nodes").alias("place", "at")).withColumn("before", F.lag("at").over(w))
    return new.select("route_id", "node_id").distinct().join(rows, "route_id")


def insertion_pairs(walk: DataFrame, new: DataFrame) -> DataFrame:
    """What insertion_points() asks of near."""
    return _asked(_places(walk, new), ("node_id", "at"), ("before", "node_id"), ("before", "at"))


def insertion_points(walk: DataFrame, new: DataFrame, near: DataFrame) -> DataFrame:
    """Where a node is put into a route with the least detour: route_id, node_id, place (from 0, before that node) and added metres; ties to the first place. new: route_id, node_id. Places that near doesn't reach don't count."""
    way = lambda a, b, n: near.select(F.col("src").alias(a), F.col("node_id").alias(b), F.col("dist").alias(n))
    own = _places(walk, new).join(way("node_id", "at", "onward"), ["node_id", "at"]).join(way("before", "node_id", "there"), ["before", "node_id"], "left").join(way("before", "at", "direct"), ["before", "at"], "left")
    added = F.when(F.col("place") == 0, F.col("onward")).otherwise(F.col("there") + F.col("onward") - F.col("direct"))
    best = own.withColumn("added", added).filter("added is not null").groupBy("route_id", "node_id").agg(F.min(F.struct("added", "place")).alias("x"))
    return best.select("route_id", "node_id", F.col("x.place").cast("long").alias("place"), "x.added")


def with_node(nodes: Column, node: Column, place: Column) -> Column:
    return F.concat(_slice(nodes, 1, place), F.array(node), _slice(nodes, place + 1, F.size(nodes) - place))


def cut_and_join(a: Column, b: Column, cut_a: Column, cut_b: Column) -> tuple[Column, Column]:
    """Both children of cuts after so many nodes."""
    rest = lambda x, n: _slice(x, n + 1, F.size(x) - n)
    return F.concat(_slice(a, 1, cut_a), rest(b, cut_b)), F.concat(_slice(b, 1, cut_b), rest(a, cut_a))


# Mutation. Segments are rows (route_id, seg, path, chosen); those that aren't chosen, or have no alternative, stay.


def replaced(segments: DataFrame, other: DataFrame) -> DataFrame:
    """segments with the paths of other (route_id, seg, path) in their place."""
    new = other.select("route_id", "seg", F.col("path").alias("_new"))
    return segments.join(new, ["route_id", "seg"], "left").withColumn("path", F.coalesce("_new", "path")).drop("_new")


def _ends(segments: DataFrame) -> DataFrame:
    return segments.filter("chosen").select("route_id", "seg", F.col("path")[0].alias("src"), F.element_at("path", -1).alias("dst"))


def direct_or_fewest(segments: DataFrame, edges: DataFrame, hops: DataFrame) -> DataFrame:
    """Alternatives of chosen segments: the edge between their ends, else the lesser of the paths with the fewest edges. hops: src, dst, path."""
    step = edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct().withColumn("edge", F.array("src", "dst"))
    short = hops.groupBy("src", "dst").agg(F.min(F.struct(F.size("path").alias("n"), F.col("path").alias("p"))).alias("x")).select("src", "dst", F.col("x.p").alias("walk"))
    own = _ends(segments).filter("src <> dst").join(step, ["src", "dst"], "left").join(short, ["src", "dst"], "left")
    return own.select("route_id", "seg", F.coalesce("edge", "walk").alias("path")).filter("path is not null")


def toward_height(segments: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Alternatives of chosen segments: the edge from their start to its highest neighbour, if that is higher."""
    from .search import highest_neighbours

    up = highest_neighbours(nodes, edges).select(F.col("node_id").alias("src"), "neighbour")
    return _ends(segments).join(up, "src").select("route_id", "seg", F.array("src", "neighbour").alias("path"))


def extension(last: Column, neighbours: Column, u: Column) -> Column:
    """The path from a last node to one of its neighbours, drawn by u; null without any."""
    return F.when(F.size(neighbours) > 0, F.array(last, F.try_element_at(F.array_sort(neighbours), (F.floor(u * F.size(neighbours)) + 1).cast("int"))))


def _via(segments: DataFrame, lengths: DataFrame, edges: DataFrame, first: int | None) -> DataFrame:
    around = edges.groupBy("u", "v").agg(F.min("length").alias("length"))
    if first is not None:
        around = around.withColumn("i", F.row_number().over(Window.partitionBy("u").orderBy("v"))).filter(F.col("i") <= first)
    own = _ends(segments).join(lengths.select("route_id", "seg", "m"), ["route_id", "seg"])
    return own.join(around.select(F.col("u").alias("src"), F.col("v").alias("via"), F.col("length").alias("step")), "src").filter("via <> dst")


def detour_pairs(segments: DataFrame, lengths: DataFrame, edges: DataFrame, first: int | None = None) -> DataFrame:
    """What detours() asks of near; without first, also what without_edge() asks."""
    return _asked(_via(segments, lengths, edges, first), ("src", "via"), ("via", "dst"))


def detours(segments: DataFrame, lengths: DataFrame, edges: DataFrame, near: DataFrame, least: float, most: float, first: int) -> DataFrame:
    """Alternatives of chosen segments through one of the first neighbours (by id) of their start, of least to most times their length: the lesser neighbour that fits. lengths: route_id, seg, m."""
    rest = _via(segments, lengths, edges, first).join(near.select(F.col("src").alias("via"), F.col("node_id").alias("dst"), F.col("dist"), F.col("path")), ["via", "dst"])
    there = rest.join(near.select("src", F.col("node_id").alias("via"), F.col("dist").alias("first_m"), F.col("path").alias("first_path")), ["src", "via"])
    m = F.col("first_m") + F.col("dist")
    fits = there.filter((F.col("m") > 0) & (m / F.col("m")).between(least, most)).select("route_id", "seg", "via", F.concat("first_path", _slice(F.col("path"), 2, F.size("path") - 1)).alias("path"))
    return fits.groupBy("route_id", "seg").agg(F.min(F.struct("via", "path")).alias("x")).select("route_id", "seg", "x.path")


def without_edge(segments: DataFrame, lengths: DataFrame, edges: DataFrame, near: DataFrame) -> DataFrame:
    """Alternatives of chosen segments whose ends are joined by an edge: the shortest way that doesn't begin with it, of 0.7 to 1.3 times their length."""
    hop = edges.groupBy("u", "v").agg(F.min("length").alias("length"))
    via = _via(segments, lengths, edges, None).join(hop.select(F.col("u").alias("src"), F.col("v").alias("dst")), ["src", "dst"], "left_semi")
    rest = via.join(near.select(F.col("src").alias("via"), F.col("node_id").alias("dst"), "dist", "path"), ["via", "dst"]).filter(~F.array_contains("path", F.col("src")))
    best = rest.groupBy("route_id", "seg", "m").agg(F.min(F.struct((F.col("step") + F.col("dist")).alias("m"), F.concat(F.array("src"), "path").alias("path"))).alias("x"))
    return best.filter((F.col("m") > 0) & (F.col("x.m") / F.col("m")).between(0.7, 1.3)).select("route_id", "seg", "x.path")


def _better_via(segments: DataFrame, props: DataFrame, edges: DataFrame, first: int) -> DataFrame:
    w = Window.partitionBy("route_id").orderBy("seg")
    own = segments.join(props.select("route_id", "seg", "start_node", "end_node", "km", "gain"), ["route_id", "seg"])
    after = lambda c: F.lead(c).over(w)
    pair = own.select("route_id", "seg", "chosen", F.col("start_node").alias("src"), F.col("end_node").alias("middle"), after("end_node").alias("dst"), ((F.col("km") + after("km")) * 1000).alias("m"), (F.col("gain") + after("gain")).alias("climb")).filter("chosen and dst is not null and m > 0")
    around = edges.select("u", "v").distinct().withColumn("i", F.row_number().over(Window.partitionBy("u").orderBy("v"))).filter(F.col("i") <= first)
    return pair.join(around.select(F.col("u").alias("middle"), F.col("v").alias("via")), "middle").filter("via <> src and via <> dst")


def better_asked(segments: DataFrame, props: DataFrame, edges: DataFrame, first: int = 3) -> DataFrame:
    """What better_pairs() asks of near."""
    return _asked(_better_via(segments, props, edges, first), ("src", "via"), ("via", "dst"))


def better_pairs(segments: DataFrame, props: DataFrame, edges: DataFrame, near: DataFrame, nodes: DataFrame, first: int = 3) -> DataFrame:
    """For every route the first pair of neighbouring segments (the first one chosen) that climbs more by way of a neighbour of its middle, at 0.8 to 1.3 times its length: route_id, seg, via, path_1, path_2.

    Neighbours go by id, the first few; the first that fits the length counts. props: metrics of the segments.
    """
    via = _better_via(segments, props, edges, first)
    way = lambda a, b, n: near.select(F.col("src").alias(a), F.col("node_id").alias(b), F.col("dist").alias(f"m_{n}"), F.col("path").alias(f"path_{n}"))
    legs = via.join(way("src", "via", 1), ["src", "via"]).join(way("via", "dst", 2), ["via", "dst"]).filter(((F.col("m_1") + F.col("m_2")) / F.col("m")).between(0.8, 1.3))
    chosen = legs.groupBy("route_id", "seg", "climb").agg(F.min(F.struct("via", "path_1", "path_2")).alias("x")).select("route_id", "seg", "climb", "x.*")
    at = nodes.select("node_id", F.coalesce("elevation", F.lit(0.0)).alias("e"))
    steps = chosen.select("route_id", "seg", F.posexplode(F.concat("path_1", _slice(F.col("path_2"), 2, F.size("path_2") - 1))).alias("i", "node_id")).join(at, "node_id")
    rise = F.col("e") - F.lag("e").over(Window.partitionBy("route_id", "seg").orderBy("i"))
    new = steps.withColumn("rise", rise).groupBy("route_id", "seg").agg(F.sum(F.greatest(F.coalesce("rise", F.lit(0.0)), F.lit(0.0))).alias("new_climb"))
    good = chosen.join(new, ["route_id", "seg"]).filter("new_climb > climb")
    return good.groupBy("route_id").agg(F.min(F.struct("seg", "via", "path_1", "path_2")).alias("x")).select("route_id", "x.*")


def _sized(props: DataFrame) -> DataFrame:
    w = Window.partitionBy("route_id")
    return props.select("route_id", "seg", "start_node", "end_node", "km").withColumn("total", F.sum("km").over(w)).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("longest", F.row_number().over(w.orderBy(F.desc("km"), "seg")))


def _middle(own: DataFrame, segments: DataFrame, least_km: float) -> tuple[DataFrame, DataFrame]:
    """The middle segment of every route that is too short, chosen, and its length."""
    short = own.filter((F.col("total") < least_km) & (F.col("n") >= 2) & (F.col("seg") == F.floor(F.col("n") / 2)))
    marked = segments.join(short.select("route_id", "seg"), ["route_id", "seg"], "left_semi").withColumn("chosen", F.lit(True))
    return marked, short.select("route_id", "seg", (F.col("km") * 1000).alias("m"))


def repair_pairs(props: DataFrame, segments: DataFrame, edges: DataFrame, least_km: float) -> DataFrame:
    """What repairs() asks of near."""
    return detour_pairs(*_middle(_sized(props), segments, least_km), edges, 5)


def repairs(props: DataFrame, segments: DataFrame, edges: DataFrame, near: DataFrame, least_km: float, most_km: float) -> DataFrame:
    """For routes out of bounds the segment that mends them: the middle one by a way 1.5 times as long at least, if they are too short; the longest one by the edge between its ends, if they are too long: route_id, seg, kind, path. Others have no row."""
    own = _sized(props)
    longer = detours(*_middle(own, segments, least_km), edges, near, 1.5, float("inf"), 5).withColumn("kind", F.lit("longer"))
    hop = edges.select(F.col("u").alias("start_node"), F.col("v").alias("end_node")).distinct()
    shorter = own.filter((F.col("total") > most_km) & (F.col("longest") == 1)).join(hop, ["start_node", "end_node"], "left_semi").select("route_id", "seg", F.array("start_node", "end_node").alias("path"), F.lit("shorter").alias("kind"))
    return longer.unionByName(shorter).select("route_id", "seg", "kind", "path")


def shuffled_middle(paths: Column, order) -> Column:
    """paths with all but the first and the last in the order of a key, order(path); as they are for fewer than four."""
    inner = F.transform(F.array_sort(F.transform(_slice(paths, 2, F.size(paths) - 2), lambda p: F.struct(order(p).alias("o"), p.alias("p")))), lambda x: x["p"])
    return F.when(F.size(paths) >= 4, F.concat(_slice(paths, 1, F.lit(1)), inner, _slice(paths, F.size(paths), F.lit(1)))).otherwise(paths)
