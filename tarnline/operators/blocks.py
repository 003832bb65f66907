"""Shortest ways in networks of any size, without a list of edges on the driver.

Near ways: the network is cut into square cells. Sources of a cell meet the edges of the cell and of a margin around it in
one shuffle, and are searched from where they meet. No edge leads further, in degrees, than the largest rate of degrees to
metres times its length, so a margin of the cutoff times that rate holds every way within the cutoff: for y one rate for
all, for x one for each band of y, as degrees of x shrink toward the poles. A cell's sources are dealt out to groups of
bounded size. Ways come as parent pointers or as lists of nodes; pointers become lists by doubling.

Networks without such a bound (unknown places, edges of length 0 that lead north or south) are searched by rounds over
buckets of distance; each round writes what it changed, and nothing else.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keep = Callable[[DataFrame], DataFrame]
#: Sources that one task searches from at a time.
GROUP = 64
#: The same where a source has few rows.
NEAR_GROUP = 256
#: Bands of a network up to which their margins are broadcast.
MOST_BANDS = 100_000
#: Margins wider than this are no cells any more, but rounds.
WIDEST_DEGREES = 20.0
#: Rounds after which the rows that rounds changed are put together.
COMPACT = 12
WAYS = "src long, node_id long, dist double, path array<bigint>"
POINTERS = "src long, node_id long, dist double, parent long"


def hops(edges: DataFrame) -> DataFrame:
    """u, v and the least length of parallel edges; edges without a length or with a negative one aren't walked."""
    return edges.filter("length >= 0").groupBy("u", "v").agg(F.min("length").alias("length"))


def nearest_first(around: dict, source: int, cutoff: float, target: int | None = None, closed: frozenset = frozenset(), barred: frozenset = frozenset()) -> Iterator[tuple[int, float, list[int]]]:
    """Nodes by distance with their paths; ends at the target. Closed nodes and barred steps aren't walked."""
    queue, done = [(0.0, [source])], set()
    while queue:
        dist, path = heapq.heappop(queue)
        node = path[-1]
        if node in done:
            continue
        done.add(node)
        yield node, dist, path
        if node == target:
            return
        for v, m in around.get(node, ()):
            if v not in done and v not in closed and (node, v) not in barred and dist + m <= cutoff:
                heapq.heappush(queue, (dist + m, [*path, v]))


def pointers_first(around: dict, source: int, cutoff: float) -> Iterator[tuple[int, float, int | None]]:
    """Nodes by distance with the node before them; of equally long ways that by the lesser one."""
    queue: list[tuple[float, int, int]] = [(0.0, source, -1)]
    best, done = {source: (0.0, -1)}, set()
    while queue:
        dist, node, before = heapq.heappop(queue)
        if node in done:
            continue
        done.add(node)
        yield node, dist, None if node == source else best[node][1]
        for v, m in around.get(node, ()):
            way = (dist + m, node)
            if v not in done and way[0] <= cutoff and (v not in best or way < best[v]):
                best[v] = way
                heapq.heappush(queue, (way[0], v, node))


class Margin(NamedTuple):
    """How far beyond a cell its sources' ways can lead, in degrees: dy for all, dx for each band of y (cy, dx); cells are twice as wide. wide: the extent in x, the most that dx is."""

    dy: float
    wide: float
    bands: DataFrame

    def band(self, y: Column) -> Column:
        return F.floor(y / (2 * self.dy))

    def reached_from(self, y: Column) -> Column:
        """The bands whose sources' ways can come to a place."""
        return F.explode(F.sequence(self.band(y - self.dy), self.band(y + self.dy)))


def _placed(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    at = lambda end: nodes.select(F.col("node_id").alias(end), F.col("x").cast("double").alias(f"{end}_x"), F.col("y").cast("double").alias(f"{end}_y"))
    return steps.join(at("u"), "u", "left").join(at("v"), "v", "left").select("u", "v", "length", "u_x", "u_y", "v_x", "v_y")


def margin(steps: DataFrame, nodes: DataFrame, cutoff: float) -> Margin | None:
    """The margin of a network (one row comes to the driver); None if there is no bound."""
    return _margin(_placed(steps, nodes), cutoff)


def _margin(placed: DataFrame, cutoff: float) -> Margin | None:
    # degrees for each metre of way; without length between two places there is no bound
    rate = lambda c: F.when(F.col("length") > 0, F.abs(F.col(f"u_{c}") - F.col(f"v_{c}")) / F.col("length")).when(F.col(f"u_{c}") != F.col(f"v_{c}"), float("inf")).otherwise(0.0)
    where = F.col("u_x") + F.col("u_y") + F.col("v_x") + F.col("v_y")
    found = placed.agg(F.count_if(where.isNull() | F.isnan(where)).alias("unknown"), F.max(rate("y")).alias("rate"), (F.max(F.greatest("u_x", "v_x")) - F.min(F.least("u_x", "v_x"))).alias("wide"), (F.max("u_y") - F.min("u_y")).alias("high")).first()
    dy = max(1.001 * cutoff * (found.rate or 0.0), 1e-6)
    if found.unknown or not cutoff < float("inf") or not dy <= WIDEST_DEGREES:
        return None
    wide = (found.wide or 0.0) + 1e-6
    here = Margin(dy, wide, placed)
    most = placed.select(here.reached_from(F.col("u_y")).alias("cy"), rate("x").alias("rate")).groupBy("cy").agg(F.max("rate").alias("rate"))
    bands = most.select("cy", F.least(F.greatest(1.001 * cutoff * F.col("rate"), F.lit(1e-6)), F.lit(wide)).alias("dx"))
    return here._replace(bands=F.broadcast(bands) if (found.high or 0.0) / (2 * dy) < MOST_BANDS else bands)


def _in_cells(placed: DataFrame, nodes: DataFrame, seeds: DataFrame, near: Margin, group: int) -> tuple[DataFrame, DataFrame]:
    """Sources and edges by the groups that they meet in: cx, cy, part."""
    known = nodes.select(F.col("node_id").alias("src"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null")
    column = lambda x: F.floor(x / (2 * F.col("dx")))
    # a source that is no known node has no edges
    own = seeds.join(known, "src", "left").withColumn("cy", F.coalesce(near.band(F.col("y")), F.lit(0))).join(near.bands, "cy", "left")
    sources = own.withColumn("cx", F.coalesce(column(F.col("x")), F.lit(0))).select(*seeds.columns, "cx", "cy", "dx")
    parts = sources.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / group).alias("parts"), F.first("dx").alias("dx"))
    dealt = sources.drop("dx").join(parts.drop("dx"), ["cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("src"), F.col("parts"))).drop("parts")
    # only bands with sources
    bands = parts.filter("dx is not null").select("cy", "dx").distinct()
    spread = placed.select("u", "v", "length", "u_x", near.reached_from(F.col("u_y")).alias("cy")).join(bands, "cy")
    spread = spread.withColumn("cx", F.explode(F.sequence(column(F.col("u_x") - F.col("dx")), column(F.col("u_x") + F.col("dx"))))).drop("dx", "u_x")
    return dealt, spread.join(parts.drop("dx"), ["cx", "cy"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")


def _searched(placed: DataFrame, nodes: DataFrame, seeds: DataFrame, wide: Margin, group: int, schema: str, one: Callable) -> DataFrame:
    """What one(edges, source, wants) gives for every source; wants: the nodes asked for, None for all."""
    sources, near = _in_cells(placed, nodes, seeds, wide, group)
    types = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()) if "path" in schema else pa.int64())
    names = [f.split()[0] for f in schema.split(", ")]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        around: dict[int, list[tuple[int, float]]] = {}
        for u, v, m in zip(*(right.column(c).to_pylist() for c in ("u", "v", "length")), strict=True):
            around.setdefault(u, []).append((v, m))
        asked = left.column("wants").to_pylist() if "wants" in left.column_names else [None] * left.num_rows
        rows = [(s, *x) for s, wants in zip(left.column("src").to_pylist(), asked, strict=True) for x in one(around, s, wants)]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    key = ["cx", "cy", "part"]
    return sources.groupBy(*key).cogroup(near.groupBy(*key)).applyInArrow(search, schema)


def _asked(around: dict, source: int, cutoff: float, wants: list[int] | None) -> Iterator[tuple[int, float, list[int]]]:
    """Nodes by distance with their paths, those asked for (None: all); ends with the last of them."""
    left = None if wants is None else set(wants)
    for found in nearest_first(around, source, cutoff):
        if left is None:
            yield found
        elif found[0] in left:
            yield found
            left.discard(found[0])
            if not left:
                return


def _seeds(steps: DataFrame, sources: DataFrame | None) -> DataFrame:
    own = sources.select(F.col("node_id").cast("long").alias("src")) if sources is not None else steps.select(F.explode(F.array("u", "v")).alias("src"))
    return own.filter("src is not null").distinct()


def _rounds(steps: DataFrame, seeds: DataFrame, cutoff: float, keep: Keep, delta: float | None = None) -> DataFrame:
    """Ways by rounds over buckets of distance, delta wide (the mean length of an edge, four times, if none is given).

    A round walks one edge from what the round before changed in the bucket, until nothing changes there; what lies beyond
    waits for its bucket. A round writes the rows it made shorter, and only these; now and then they are put together.
    """
    if delta is None:
        delta = max(1.0, 4 * (steps.agg(F.avg("length")).first()[0] or 1.0))
    way = F.struct("dist", "path")
    changed = keep(seeds.select("src", F.col("src").alias("node_id"), F.lit(0.0).alias("dist"), F.array("src").alias("path")))
    written, limit = [changed], delta

    def least() -> DataFrame:
        out = written[0]
        for f in written[1:]:
            out = out.unionByName(f)
        return out if len(written) == 1 else out.groupBy("src", "node_id").agg(F.min(way).alias("x")).select("src", "node_id", "x.dist", "x.path")

    while True:
        front = changed.filter(F.col("dist") < limit)
        if front.isEmpty():
            # the bucket is settled; what lies in the next one that holds any hasn't been walked from
            low = least().filter(F.col("dist") >= limit).agg(F.min("dist")).first()[0]
            if low is None:
                return least()
            before, limit = limit, (low // delta + 1) * delta
            front = least().filter((F.col("dist") >= before) & (F.col("dist") < limit))
        step = front.join(steps, F.col("node_id") == F.col("u")).filter(F.col("dist") + F.col("length") <= cutoff)
        best = step.groupBy("src", F.col("v").alias("node_id")).agg(F.min(F.struct((F.col("dist") + F.col("length")).alias("dist"), F.concat("path", F.array("v")).alias("path"))).alias("new"))
        old = least().select("src", "node_id", way.alias("old"))
        changed = keep(best.join(old, ["src", "node_id"], "left").filter("old is null or new < old").select("src", "node_id", "new.dist", "new.path"))
        written.append(changed)
        if len(written) > COMPACT:
            written = [keep(least())]


def near_paths(edges: DataFrame, cutoff: float, keep: Keep, sources: DataFrame | None = None, nodes: DataFrame | None = None, group: int = NEAR_GROUP, pairs: DataFrame | None = None) -> DataFrame:
    """src, node_id, dist and path of every node within a cutoff of each source (column node_id; all ends of edges by default), the source itself at 0.

    Ties go to the lesser path. Parallel edges count by the shortest; edges without a length or with a negative one aren't
    walked. Without nodes, or a bound from their places, the search goes by rounds, with the same rows. With pairs (src, dst)
    only their sources are searched from, and only their rows are given.
    """
    steps = hops(edges)
    placed = keep(_placed(steps, nodes)) if nodes is not None else None
    steps = placed.select("u", "v", "length") if nodes is not None else keep(steps)
    seeds = _seeds(steps, sources)
    if pairs is not None:
        own = pairs.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src is not null and dst is not null").distinct()
        seeds = keep(own.join(seeds, "src", "left_semi").groupBy("src").agg(F.collect_list("dst").alias("wants")))
    if nodes is None or (wide := _margin(placed, cutoff)) is None:
        found = _rounds(steps, seeds.select("src"), cutoff, keep)
        return found if pairs is None else found.join(seeds.select("src", F.explode("wants").alias("node_id")), ["src", "node_id"], "left_semi")
    return _searched(placed, nodes, seeds, wide, group, WAYS, lambda around, s, wants: _asked(around, s, cutoff, wants))


def reached(edges: DataFrame, cutoff: float, keep: Keep, nodes: DataFrame, sources: DataFrame, group: int = GROUP) -> DataFrame:
    """src, node_id, dist and parent (the node before; null for the source) of every node within a cutoff of each source. Of equally long ways the parent is the least; a network without a bound goes by rounds."""
    placed = keep(_placed(hops(edges), nodes))
    steps = placed.select("u", "v", "length")
    seeds = _seeds(steps, sources)
    if (wide := _margin(placed, cutoff)) is None:
        return _rounds(steps, seeds, cutoff, keep).select("src", "node_id", "dist", F.when(F.size("path") > 1, F.element_at("path", -2)).alias("parent"))
    return _searched(placed, nodes, seeds, wide, group, POINTERS, lambda around, s, _: pointers_first(around, s, cutoff))


def _led(around: dict, source: int, cutoff: float, wants: list[int]) -> Iterator[tuple[int, float, list[int]]]:
    """The nodes asked for by distance with their paths along the pointers; ends with the last of them."""
    left, before = set(wants), {}
    for node, dist, parent in pointers_first(around, source, cutoff):
        before[node] = parent
        if node in left:
            path, at = [node], parent
            while at is not None:
                path.append(at)
                at = before[at]
            yield node, dist, path[::-1]
            left.discard(node)
            if not left:
                return


def ways(edges: DataFrame, pairs: DataFrame, cutoff: float, keep: Keep, nodes: DataFrame, group: int = NEAR_GROUP) -> DataFrame:
    """src, node_id, dist and path of the pairs (src, dst) that are within a cutoff. What traced() gives of reached(), but a source is searched only until its last pair is found, and no other ways are written."""
    placed = keep(_placed(hops(edges), nodes))
    own = pairs.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src is not null and dst is not null")
    seeds = keep(own.groupBy("src").agg(F.collect_set("dst").alias("wants")))
    if (wide := _margin(placed, cutoff)) is None:
        found = _rounds(placed.select("u", "v", "length"), seeds.select("src"), cutoff, keep)
        return found.join(seeds.select("src", F.explode("wants").alias("node_id")), ["src", "node_id"], "left_semi")
    return _searched(placed, nodes, seeds, wide, group, WAYS, lambda around, s, wants: _led(around, s, cutoff, wants))


def traced(found: DataFrame, pairs: DataFrame, keep: Keep) -> DataFrame:
    """src, dst, i (0 at the source) and node_id of the ways to the pairs (src, dst) that are reached, a row a node.

    Pointers are doubled, which takes as many rounds as the logarithm of the longest way; then the ways unfold from their
    ends, each row making one more by the next lower power.
    """
    jumps = [keep(found.filter("parent is not null").join(pairs.select("src").distinct(), "src", "left_semi").select("src", "node_id", F.col("parent").alias("up")))]
    while True:
        far = jumps[-1]
        twice = keep(far.join(far.select("src", F.col("node_id").alias("up"), F.col("up").alias("further")), ["src", "up"]).select("src", "node_id", F.col("further").alias("up")))
        if twice.isEmpty():
            break
        jumps.append(twice)
    rows = pairs.select("src", "dst").distinct().join(found.select("src", F.col("node_id").alias("dst")), ["src", "dst"]).select("src", "dst", F.col("dst").alias("node_id"), F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(jumps))):
        more = rows.join(jumps[k], ["src", "node_id"]).select("src", "dst", F.col("up").alias("node_id"), (F.col("back") + (1 << k)).alias("back"))
        rows = keep(rows.unionByName(more))
    longest = rows.groupBy("src", "dst").agg(F.max("back").alias("n"))
    return rows.join(longest, ["src", "dst"]).select("src", "dst", (F.col("n") - F.col("back")).alias("i"), "node_id")
