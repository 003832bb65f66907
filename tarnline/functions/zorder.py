"""Places on a space-filling curve: codes whose longer common beginnings mean smaller common cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Halvings of each side of the box.
DEEPEST = 24
_SIZE = 1 << DEEPEST


def _spread(c: Column) -> Column:
    """The bits of a number of 24 bits, with a zero before each."""
    out = c
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def spread(n: int) -> int:
    """The same for a number."""
    return sum((n >> k & 1) << 2 * k for k in range(DEEPEST))


def step(c: Column, low: float, side: float) -> Column:
    """Which of the finest columns (or rows) of a box a coordinate is in; what lies outside counts to the first or last, what is missing to the first."""
    at = F.floor((F.coalesce(c, F.lit(low)) - low) / side * _SIZE)
    return F.greatest(F.least(at, F.lit(_SIZE - 1)), F.lit(0)).cast("long")


def code(x: Column, y: Column, west: float, south: float, side: float) -> Column:
    return _spread(step(x, west, side)).bitwiseOR(F.shiftleft(_spread(step(y, south, side)), 1))


def cell(z: Column | str, level: int) -> Column:
    """The cell of a level that a code lies in; level 0 is the whole box."""
    return F.shiftright(z, 2 * (DEEPEST - level))


def depth(coded: DataFrame, most: int) -> int:
    """The first level at which the fullest cell of a column z holds at most so many rows, or can't be cut further. Finer levels have no fuller cells, so it is found by halving; each level asked is counted by itself, and one row of it comes to the driver."""
    fullest = lambda k: coded.groupBy(cell("z", k).alias("c")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    low, high = 0, DEEPEST
    least = max(most, fullest(high))
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fullest(middle) <= least else (middle + 1, high)
    return low


def ranges(box: tuple[int, int, int, int], most: int = 64) -> list[tuple[int, int]]:
    """Runs of codes that cover a box of finest columns and rows (west, south, east, north, all counted), in order: exact cells as far as so many runs allow, else what holds them."""
    west, south, east, north = box
    todo, done = [(0, 0, 0)], []
    while todo:
        level, i, j = todo.pop(0)
        size = 1 << DEEPEST - level
        w, s, e, n = i * size, j * size, (i + 1) * size - 1, (j + 1) * size - 1
        if w > east or e < west or s > north or n < south:
            continue
        inside = west <= w and e <= east and south <= s and n <= north
        if inside or level == DEEPEST or len(todo) + len(done) >= most:
            first = spread(w) | spread(s) << 1
            done.append((first, first + size * size - 1))
        else:
            todo += [(level + 1, 2 * i + a, 2 * j + b) for b in (0, 1) for a in (0, 1)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
