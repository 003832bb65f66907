"""A distance index of a network: exact network distances between any two nodes, as joins.

The plane is cut into cells within cells. A way between two nodes either stays in the smallest cell that holds both, and
there passes a border of one of its parts, or it leaves that cell over a border of a part of a larger one. So for each cell
the index keeps the distances, inside the cell, between the border nodes of its parts (for the smallest cells: between all
nodes). They are made from the parts' own tables, level by level, one task a cell; a level's tables are of the size of
borders, not of areas.

A question takes, for each end, its distances to the borders in every cell around it, level by level from the smallest
(labels), and adds the labels of both ends in each cell that they share. Nothing is searched at that time.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnline.functions import zorder

from .blocks import Keep, hops

#: Nodes up to which a cell isn't cut further (all pairs of them are kept).
LEAF = 128
#: Ends of questions that a task makes labels of at a time, for each cell.
GROUP = 2_000

_TABLE = "cell long, part long, node_id long, top int, hubs array<bigint>, away array<double>, back array<double>"


class Index(NamedTuple):
    """nodes: node_id, cell (at the lowest level). tables: for each level from the top, the distances within its cells."""

    nodes: DataFrame
    tables: list[DataFrame]


def _closed(d: np.ndarray) -> np.ndarray:
    """Shortest distances from those of single steps (in place)."""
    for k in range(len(d)):
        np.minimum(d, d[:, k, None] + d[k], out=d)
    return d


def _rows(cell: int, ids: np.ndarray, part: np.ndarray, top: np.ndarray, d: np.ndarray) -> pa.Table:
    n = len(ids)
    offsets = pa.array(np.arange(n + 1) * n, pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (np.tile(ids, n), d.ravel(), d.T.ravel())]
    return pa.table([pa.array(np.full(n, cell, np.int64)), pa.array(part), pa.array(ids), pa.array(top), *lists], names=[f.split()[0] for f in _TABLE.split(", ")])


def build(nodes: DataFrame, edges: DataFrame, keep: Keep, leaf: int = LEAF) -> Index:
    """The index of a network. Edges without a length or with a negative one aren't walked, nor are those to unknown nodes; of parallel edges the shortest counts. Nodes without a place stand at the least one."""
    known = nodes.filter("node_id is not null").groupBy(F.col("node_id").cast("long").alias("node_id")).agg(F.min("x").alias("x"), F.min("y").alias("y"))
    box = known.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side")).first()
    side = (box.side or 0.0) * (1 + 1e-9) or 1.0
    finest = keep(known.select("node_id", zorder.code(F.col("x"), F.col("y"), box.x or 0.0, box.y or 0.0, side).alias("z")))
    deep = zorder.depth(finest, leaf)
    placed = keep(finest.select("node_id", zorder.cell("z", deep).alias("cell")))
    end = lambda c: placed.select(F.col("node_id").alias(c), F.col("cell").alias(f"{c}_cell"))
    # the lowest level at which both ends lie in one cell
    differ = F.col("u_cell").bitwiseXOR(F.col("v_cell"))
    shared = F.when(differ == 0, F.lit(deep)).otherwise(F.lit(deep) - F.ceil(F.length(F.bin(differ)) / 2)).cast("int")
    steps = keep(hops(edges).filter("u <> v").join(end("u"), "u").join(end("v"), "v").withColumn("shared", shared))
    ends = steps.select(F.explode(F.array("u", "v")).alias("node_id"), "shared")
    # a node is on the border of its cells at levels below the highest edge it has
    tops = ends.groupBy("node_id").agg((F.min("shared") + 1).alias("top"))
    own = placed.join(tops, "node_id", "left").select("node_id", "cell", F.coalesce("top", F.lit(deep + 1)).cast("int").alias("top"))
    tables = [keep(own.groupBy("cell").cogroup(steps.filter(F.col("shared") == deep).select(F.col("u_cell").alias("cell"), "u", "v", "length").groupBy("cell")).applyInArrow(_leaf, _TABLE))]
    for level in range(deep - 1, -1, -1):
        border = tables[0].filter(F.col("top") <= level + 1).select(F.shiftright("cell", 2).alias("cell"), F.col("cell").alias("part"), "node_id", "top", "hubs", "away")
        across = steps.filter(F.col("shared") == level).select(F.shiftright("u_cell", 2 * (deep - level)).alias("cell"), "u", "v", "length")
        tables.insert(0, keep(border.groupBy("cell").cogroup(across.groupBy("cell")).applyInArrow(_overlay, _TABLE)))
    return Index(placed, tables)


def _leaf(own: pa.Table, inside: pa.Table) -> pa.Table:
    order = np.argsort(own["node_id"].to_numpy())
    ids, top = own["node_id"].to_numpy()[order], own["top"].to_numpy()[order]
    d = np.full((len(ids), len(ids)), np.inf)
    np.fill_diagonal(d, 0.0)
    d[np.searchsorted(ids, inside["u"].to_numpy()), np.searchsorted(ids, inside["v"].to_numpy())] = inside["length"].to_numpy()
    cell = own["cell"][0].as_py()
    return _rows(cell, ids, np.full(len(ids), cell, np.int64), top, _closed(d))


def _overlay(border: pa.Table, across: pa.Table) -> pa.Table:
    order = np.argsort(border["node_id"].to_numpy())
    ids, top, part = (border[c].to_numpy()[order] for c in ("node_id", "top", "part"))
    d = np.full((len(ids), len(ids)), np.inf)
    np.fill_diagonal(d, 0.0)
    away, hubs = border["away"].combine_chunks(), border["hubs"].combine_chunks()
    for i, k in enumerate(order.tolist()):
        to = hubs[k].values.to_numpy()
        j = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        held = ids[j] == to
        d[i, j[held]] = away[k].values.to_numpy()[held]
    if across.num_rows:
        u, v = (np.searchsorted(ids, across[c].to_numpy()) for c in ("u", "v"))
        np.minimum.at(d, (u, v), across["length"].to_numpy())
    return _rows(border["cell"][0].as_py(), ids, part, top, _closed(d))


def labels(index: Index, ends: DataFrame, keep: Keep) -> DataFrame:
    """node_id, level, cell, away and back of every end (node_id): its distances to and from what the tables of the cells around it list, in their order."""
    deep = len(index.tables) - 1
    now = keep(index.tables[deep].join(ends.select("node_id").distinct(), "node_id", "left_semi").select("node_id", "cell", "hubs", "away", "back"))
    out = now.select("node_id", F.lit(deep).alias("level"), "cell", "away", "back")
    for level in range(deep - 1, -1, -1):
        size = now.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
        mine = now.join(size, "cell").withColumn("group", F.pmod(F.xxhash64("node_id"), F.col("groups"))).select(F.col("cell").alias("part"), "group", "node_id", "hubs", "away", "back")
        theirs = index.tables[level].join(size.withColumnRenamed("cell", "part"), "part").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select("part", "group", "cell", "node_id", "hubs", "away", "back")
        now = keep(mine.groupBy("part", "group").cogroup(theirs.groupBy("part", "group")).applyInArrow(_lifted, "node_id long, cell long, hubs array<bigint>, away array<double>, back array<double>"))
        out = out.unionByName(now.select("node_id", F.lit(level).alias("level"), "cell", "away", "back"))
    return out


def _lifted(mine: pa.Table, theirs: pa.Table) -> pa.Table:
    """Labels of one cell's ends in the cell around it. A cell without a border there isn't left: no rows."""
    schema = pa.schema([("node_id", pa.int64()), ("cell", pa.int64()), ("hubs", pa.list_(pa.int64())), ("away", pa.list_(pa.float64())), ("back", pa.list_(pa.float64()))])
    if not mine.num_rows or not theirs.num_rows:
        return schema.empty_table()
    k, m = mine.num_rows, theirs.num_rows
    matrix = lambda t, c, n: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    border, around = theirs["node_id"].to_numpy(), theirs["hubs"][0].values.to_numpy()
    # ends of one cell have the same list of hubs, and every border node is in it
    at = np.searchsorted(mine["hubs"][0].values.to_numpy(), border)
    out = []
    for c in ("away", "back"):
        first, then = matrix(mine, c, k)[:, at], matrix(theirs, c, m)
        d = np.full((k, len(around)), np.inf)
        for j in range(m):
            np.minimum(d, first[:, j, None] + then[j], out=d)
        out.append(d)
    offsets = pa.array(np.arange(k + 1) * len(around), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (np.tile(around, k), out[0].ravel(), out[1].ravel())]
    return pa.table([mine["node_id"].combine_chunks(), pa.array(np.full(k, theirs["cell"][0].as_py(), np.int64)), *lists], schema=schema)


def distances(index: Index, pairs: DataFrame, keep: Keep) -> DataFrame:
    """src, dst and dist of every distinct pair: the exact network distance, however long; null where no way leads, or an end is no node."""
    own = pairs.select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct()
    both = keep(labels(index, own.select(F.explode(F.array("src", "dst")).alias("node_id")), keep))
    first = both.select(F.col("node_id").alias("src"), "level", "cell", "away")
    then = both.select(F.col("node_id").alias("dst"), "level", "cell", "back")
    met = own.join(first, "src").join(then, ["dst", "level", "cell"])
    way = met.groupBy("src", "dst").agg(F.min(F.array_min(F.zip_with("away", "back", lambda a, b: a + b))).alias("dist"))
    return own.join(way, ["src", "dst"], "left").select("src", "dst", F.when(F.col("dist") < float("inf"), F.col("dist")).alias("dist"))
