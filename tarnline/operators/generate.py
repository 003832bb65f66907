"""Initial routes and whole route searches, one task for each search.

A single search is small (a population of bounded size on the surroundings of a start) and sequential; what grows is the
number of searches. So the network, cut to the surroundings and of at most LOCAL_EDGES edges, is broadcast, and every
search (a row: start, distance, objective, seed) runs where its row is. Draws come from the row's own seed: a search
repeats on any partitioning and after lost executors.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitness import RISE, SPACING, STEEP, TERMS, WEIGHTS
from .blocks import Keep, hops, nearest_first
from .paths import LOCAL_EDGES
from .tuning import adapted_sizes, adaptive_rate_value

#: Shares of strategies in populations of each kind, in the order of their turns (fixed values).
MIXES = {
    "basic": (("random_walk", 0.4), ("directional", 0.3), ("uphill", 0.2), ("random_walk", 0.05), ("directional", 0.05)),
    "distance": (("out_and_back", 0.4), ("triangle", 0.3), ("figure_eight", 0.2), ("spiral", 0.1)),
    "far": (("out_and_back", 0.6), ("triangle", 0.3), ("figure_eight", 0.1)),
    "terrain": (("very_high", 0.2), ("high", 0.4), ("moderate", 0.3), ("short_walk", 0.1)),
    "improved": (("outbound_return", 0.3), ("loop_builder", 0.25), ("walker", 0.2), ("seeker", 0.15), ("explorer", 0.1)),
}
EARTH_M = 6_371_000.0


class Network:
    """A network in memory: neighbours with lengths, places and heights, and shortest ways, which are remembered for the last sources."""

    def __init__(self, around: dict[int, list[tuple[int, float]]], place: dict[int, tuple[float, float, float]], remembered: int = 400) -> None:
        self.around, self.place, self.remembered = around, place, remembered
        self.length = {(u, v): m for u, own in around.items() for v, m in own}
        self._ways: dict[tuple[int, float], dict[int, tuple[float, list[int]]]] = {}

    def ways(self, source: int, cutoff: float) -> dict[int, tuple[float, list[int]]]:
        """Nodes within a cutoff with their distance and path, nearest first."""
        key = (source, cutoff)
        if key not in self._ways:
            if len(self._ways) >= self.remembered:
                del self._ways[next(iter(self._ways))]
            self._ways[key] = {n: (d, p) for n, d, p in nearest_first(self.around, source, cutoff)}
        return self._ways[key]

    def air(self, a: int, b: int) -> float:
        (x, y, _), (u, v, _) = self.place[a], self.place[b]
        p, q = math.radians(y), math.radians(v)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(u - x) / 2) ** 2
        return 2 * EARTH_M * math.asin(math.sqrt(h))

    def bearing(self, a: int, b: int) -> float:
        (x, y, _), (u, v, _) = self.place[a], self.place[b]
        p, q, d = math.radians(y), math.radians(v), math.radians(u - x)
        return math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) % 360

    def metres(self, nodes: list[int]) -> float:
        """Length of a walk; infinite where there is no edge."""
        return sum(self.length.get(s, math.inf) for s in zip(nodes, nodes[1:], strict=False))

    def band(self, source: int, goal: float, tolerance: float, first: int, cutoff: float) -> list[int]:
        """The nodes whose distance is closest to a goal, within a tolerance; ties by id."""
        found = [(abs(d - goal), n) for n, (d, _) in self.ways(source, cutoff).items() if n != source and abs(d - goal) <= tolerance * goal]
        return [n for _, n in sorted(found)[:first]]


def _free(used: set[tuple[int, int]], a: int, b: int, both_ways: bool) -> bool:
    return (a, b) not in used and (both_ways or (b, a) not in used)


class Maker:
    """Closed walks from a start of about a length, by strategy; None where a strategy finds none."""

    def __init__(self, net: Network, start: int, target_m: float, rng: random.Random, both_ways: bool = True) -> None:
        self.net, self.start, self.target, self.rng, self.both_ways = net, start, target_m, rng, both_ways
        self.reach = max(8000.0, 0.5 * target_m)
        self.home = net.ways(start, self.reach)
        self.taken: set[int] = set()

    def make(self, strategy: str) -> list[int] | None:
        walk = getattr(self, f"_{strategy}")()
        return walk if walk and len(walk) > 2 and walk[0] == walk[-1] == self.start else None

    def _fits(self, walk: list[int]) -> bool:
        return 0.85 * self.target <= self.net.metres(walk) <= 1.15 * self.target

    def _close(self, walk: list[int]) -> list[int] | None:
        """The walk and the shortest way home."""
        if walk[-1] == self.start:
            return walk
        back = self.home.get(walk[-1])
        return walk + back[1][::-1][1:] if back and all((b, a) in self.net.length for a, b in zip(back[1], back[1][1:], strict=False)) else None

    def _leg(self, a: int, b: int) -> list[int] | None:
        found = self.net.ways(a, self.reach).get(b)
        return found[1] if found else None

    def _there_and_back(self, node: int) -> list[int] | None:
        out = self._leg(self.start, node)
        return self._close(list(out)) if out else None

    def _out_and_back(self) -> list[int] | None:
        near = self.net.band(self.start, 0.45 * self.target, 0.3, 5, self.reach)
        fit = [w for n in near if (w := self._there_and_back(n)) and self._fits(w)]
        return self.rng.choice(fit) if fit else None

    def _triangle(self) -> list[int] | None:
        leg = self.target / 3
        first = self.net.band(self.start, leg, 0.4, 12, self.reach)
        for a in self.rng.sample(first, min(3, len(first))):
            second = self.net.band(a, leg, 0.4, 12, self.reach)
            for b in self.rng.sample(second, min(3, len(second))):
                walk = self._close(self._leg(self.start, a) + self._leg(a, b)[1:])
                if walk and self._fits(walk):
                    return walk
        return None

    def _figure_eight(self) -> list[int] | None:
        near = self.net.band(self.start, self.target / 4, 0.4, 12, self.reach)
        pairs = [(a, b) for a in near for b in near if a != b]
        for a, b in self.rng.sample(pairs, min(4, len(pairs))):
            one, two = self._there_and_back(a), self._there_and_back(b)
            if one and two and self._fits(one + two[1:]):
                return one + two[1:]
        return None

    def _spiral(self) -> list[int] | None:
        if 0.35 * self.target > 0.9 * max((d for d, _ in self.home.values()), default=0):
            return None
        walk = [self.start]
        for share in (0.15, 0.25, 0.35, 0.2):
            near = self.net.band(walk[-1], share * self.target, 0.4, 5, self.reach)
            if not near:
                return None
            walk += self._leg(walk[-1], self.rng.choice(near))[1:]
        walk = self._close(walk)
        return walk if walk and self._fits(walk) else None

    def _steps(self, longest: float, most: int, pick: Callable[[int, list[int], list[int]], int]) -> list[int] | None:
        """A walk of single steps, each direction of an edge once at most; the way home is left for the end."""
        walk, used, m = [self.start], set(), 0.0
        for _ in range(most):
            here = walk[-1]
            home = self.home.get(here)
            if home is None or m + home[0] >= 0.95 * self.target:
                break
            ahead = [v for v, d in self.net.around.get(here, ()) if d <= longest and v in self.home and _free(used, here, v, self.both_ways)]
            if not ahead:
                break
            v = pick(here, ahead, walk)
            used.add((here, v))
            m += self.net.length[here, v]
            walk.append(v)
        return self._close(walk)

    def _random_walk(self) -> list[int] | None:
        def pick(here: int, ahead: list[int], walk: list[int]) -> int:
            new = [v for v in ahead if v not in seen] or ahead
            v = self.rng.choice(ahead if self.rng.random() < 0.3 else new)
            seen.add(v)
            return v

        seen = {self.start}
        return self._steps(800, max(20, int(self.target / 250)) * 4, pick)

    def _directional(self) -> list[int] | None:
        way = self.rng.randrange(8) * 45.0

        def pick(here: int, ahead: list[int], walk: list[int]) -> int:
            nonlocal way
            if len(walk) > 3 and self.rng.random() < 0.4 / 3:
                way = (way + self.rng.choice((-90.0, 90.0))) % 360
            off = lambda v: abs((self.net.bearing(here, v) - way + 180) % 360 - 180) + self.rng.uniform(0, 30)
            return min(ahead, key=off)

        return self._steps(600, max(20, int(self.target / 250)) * 4, pick)

    def _uphill(self) -> list[int] | None:
        def pick(here: int, ahead: list[int], walk: list[int]) -> int:
            top = sorted(ahead, key=lambda v: -self.net.place[v][2])
            down = [v for v in ahead if self.net.place[v][2] < self.net.place[here][2]]
            return self.rng.choice(down) if down and len(walk) > 2 and self.rng.random() < 0.3 else self.rng.choice(top[:3])

        return self._steps(700, max(20, int(self.target / 250)) * 4, pick)

    def _fallback(self) -> list[int] | None:
        near = sorted((abs(d - self.target / 4), v) for v, d in self.net.around.get(self.start, ()))
        return self._close([self.start, near[0][1]]) if near else None

    def _short_walk(self) -> list[int] | None:
        walk = [self.start]
        for _ in range(self.rng.randint(3, 6)):
            ahead = [v for v, _ in self.net.around.get(walk[-1], ()) if v in self.home]
            if not ahead:
                break
            walk.append(self.rng.choice(ahead))
        return self._close(walk)

    def _to_height(self, low: float, high: float) -> list[int] | None:
        """There and back to a node so much higher than the start, drawn by its height and nearness; none is drawn twice."""
        base = self.net.place[self.start][2]
        options = [(n, self.net.place[n][2] - base, d) for n, (d, _) in self.home.items() if d <= 0.75 * self.target and low <= self.net.place[n][2] - base < high and n not in self.taken and n != self.start]
        if not options:
            return None
        weight = [max(1.0, g + 50) * self.rng.uniform(0.7, 1.3) * max(0.5, 1 - d / 10000) for _, g, d in options]
        node = self.rng.choices(options, weight)[0][0]
        self.taken.add(node)
        return self._there_and_back(node)

    def _very_high(self) -> list[int] | None:
        return self._to_height(100, math.inf)

    def _high(self) -> list[int] | None:
        return self._to_height(30, 100)

    def _moderate(self) -> list[int] | None:
        return self._to_height(0, 30)

    def _outbound_return(self) -> list[int] | None:
        near = self.net.band(self.start, self.target / 2, 0.2, 20, self.reach)
        if not near:
            return None
        out = self._leg(self.start, self.rng.choice(near))
        barred = frozenset(s for a, b in zip(out, out[1:], strict=False) for s in ((a, b), (b, a))) if self.rng.random() < 0.7 else frozenset()
        back = next((p for n, _, p in nearest_first(self.net.around, out[-1], self.target, self.start, barred=barred) if n == self.start), None)
        return out + back[1:] if back else self._close(list(out))

    def _loop_builder(self) -> list[int] | None:
        walk, goal = [self.start], self.target / 4
        for _ in range(3):
            near = self.net.band(walk[-1], goal, 0.4, 8, self.reach)
            if not near:
                break
            walk += self._leg(walk[-1], self.rng.choice(near))[1:]
        return self._close(walk)

    def _walker(self) -> list[int] | None:
        goal = self.target / 12

        def pick(here: int, ahead: list[int], walk: list[int]) -> int:
            score = lambda v: self.rng.uniform(0.5, 1.5) / (1 + abs(self.net.length[here, v] - goal) / goal)
            top = sorted(((score(v), v) for v in ahead), reverse=True)[:3]
            return self.rng.choices([v for _, v in top], [s for s, _ in top])[0]

        return self._steps(1000, max(20, int(self.target / 100)), pick)

    def _seeker(self) -> list[int] | None:
        goal = self.target / 12

        def pick(here: int, ahead: list[int], walk: list[int]) -> int:
            rise = lambda v: max(0.0, self.net.place[v][2] - self.net.place[here][2]) / 20
            return max(ahead, key=lambda v: 0.6 / (1 + abs(self.net.length[here, v] - goal) / goal) + 0.4 * min(1.0, rise(v)) + self.rng.uniform(0, 0.1))

        return self._steps(1000, max(20, int(self.target / 100)), pick)

    def _explorer(self) -> list[int] | None:
        return getattr(self, self.rng.choice(("_outbound_return", "_loop_builder", "_walker")))()

    def population(self, size: int, kind: str) -> list[list[int]]:
        """Routes by the shares of a mix; a strategy that finds nothing is tried twice as often at most, then fallbacks and short walks fill up."""
        out: list[list[int]] = []
        shares = MIXES["far" if kind == "distance" and self.target > 15000 else kind]
        for strategy, share in shares:
            want, tries = round(share * size), 0
            while want and tries < 2 * round(share * size) + 2 and len(out) < size:
                tries += 1
                if walk := self.make(strategy):
                    out.append(walk)
                    want -= 1
        for i in range(3 * size):
            if len(out) >= size:
                break
            if walk := self.make(("out_and_back", "random_walk", "short_walk", "fallback")[i % 4]):
                out.append(walk)
        return out


class Judge:
    """Fitness of walks on a network, as in fitness.py with every step a segment; remembered by walk."""

    def __init__(self, net: Network, target_km: float, objective: str) -> None:
        self.net, self.target, self.weight = net, target_km, dict(zip(TERMS, WEIGHTS.get(objective, WEIGHTS["elevation"]), strict=True))
        self.known: dict[tuple[int, ...], tuple[float, float, float, bool]] = {}
        self.counted = 0

    def __call__(self, walk: list[int]) -> tuple[float, float, float, bool]:
        """fitness, km, gain, valid."""
        key = tuple(walk)
        if key not in self.known:
            self.known[key] = self._judge(walk)
            self.counted += 1
        return self.known[key]

    def _judge(self, walk: list[int]) -> tuple[float, float, float, bool]:
        if len(walk) < 2 or any(n not in self.net.place for n in walk):
            return 0.0, 0.0, 0.0, False
        pairs = list(zip(walk, walk[1:], strict=False))
        if any(s not in self.net.length for s in pairs):
            return 0.0, 0.0, 0.0, False
        m = np.array([self.net.length[s] for s in pairs])
        e = np.array([self.net.place[n][2] for n in walk])
        rise, km = np.diff(e), m.sum() / 1000
        gain = float(rise[rise > 0].sum())
        steepest = float((np.abs(rise[m > 0]) / m[m > 0] * 100).max()) if (m > 0).any() else 0.0
        error, tolerance = abs(km - self.target), 0.1 * self.target
        inside = error <= 0.15 * self.target
        near = 0.0 if km <= 0 else 0.01 if not inside else 1 - error / tolerance * 0.1 if error <= tolerance else max(0.0, 0.9 - min(0.8, (error - tolerance) / self.target * 3))
        climb = 0.0 if gain <= 0 else max(0.0, math.log(1 + gain / 10) / math.log(501) - (min(0.3, (steepest - 15) / 100) if steepest > 15 else 0.0))
        places, used = len(set(walk)), {}
        for a, b in pairs:
            used[min(a, b), max(a, b)] = used.get((min(a, b), max(a, b)), 0) + 1
        spread = 0.0 if places <= 1 else min(1.0, places / 20)
        diverse = (spread + max(0.0, 1 - sum(n - 1 for n in used.values()) / len(pairs))) / 2
        micro = self._micro(walk, e) if self.weight["micro"] else 0.0
        w = self.weight
        rest = w["elevation"] * climb + w["connectivity"] + w["diversity"] * diverse + w["micro"] * micro
        score = max(0.0, min(1.0, w["distance"] * near + rest)) if inside else min(0.05, 0.1 * rest)
        return score, float(km), gain, True

    def _micro(self, walk: list[int], e: np.ndarray) -> float:
        """The micro-terrain score of the profile at every ten metres of the air lines; joints stand once for each of their steps."""
        gap = np.array([self.net.air(a, b) for a, b in zip(walk, walk[1:], strict=False)])
        ends = np.cumsum(gap)
        where, height = [0.0], [e[0]]
        for i, g in enumerate(gap):
            if i:
                where.append(ends[i - 1])
                height.append(e[i])
            if g > SPACING:
                share = np.arange(1, int(g // SPACING) + 1) * SPACING / g
                where += (ends[i] - g + g * share).tolist()
                height += (e[i] + (e[i + 1] - e[i]) * share).tolist()
            where.append(ends[i])
            height.append(e[i + 1])
        x, h = np.array(where), np.array(height)
        run, step = np.diff(x), np.diff(h)
        complexity = (min(h.std() / 20, 1) + min((h.max() - h.min()) / 100, 1) + min(step.var() / 5, 1)) / 3
        if len(h) < 3:
            return max(0.0, min(1.0, complexity / 3))
        grade = np.abs(np.divide(step, run, out=np.zeros_like(step), where=run > 0))
        signed = np.divide(step, run, out=np.zeros_like(step), where=run > 0)
        a, b, c = h[:-2], h[1:-1], h[2:]
        over = b - np.minimum(a, c)
        peaks = np.minimum(over[(b > a) & (b > c) & (over >= RISE)] / 10, 1).sum()
        percent = grade * 100
        steep = percent[(grade >= STEEP) & (percent >= 3) & (percent <= 15)]
        change = np.abs(np.diff(signed))
        variety = (np.minimum(steep / 15, 1).sum() + min(((change >= STEEP) & (change * 100 >= 3)).sum() / 10, 1)) / 2
        return float(max(0.0, min(1.0, (min(peaks / 5, 1) + variety + complexity) / 3)))


def _jaccard(a: frozenset, b: frozenset) -> float:
    return 1 - len(a & b) / len(a | b) if a | b else 0.0


class Search:
    """A genetic search for one closed route."""

    def __init__(self, net: Network, start: int, target_km: float, objective: str, seed: int, size: int | None = None, generations: int | None = None, patience: int = 20, kind: str = "terrain") -> None:
        grown = adapted_sizes(target_km, 100, 200)
        self.size, self.generations, self.elite, self.tournament = size or grown[0], generations or grown[1], grown[2], grown[3]
        self.net, self.start, self.target, self.patience, self.kind = net, start, target_km, patience, kind
        self.rng = random.Random(f"{seed}-{start}-{objective}")
        self.judge = Judge(net, target_km, objective)
        self.maker = Maker(net, start, target_km * 1000, self.rng)
        self.history: list[tuple[int, float, float, float]] = []

    def allowed(self, walk: list[int]) -> bool:
        _, km, _, valid = self.judge(walk)
        return valid and walk[0] == walk[-1] == self.start and 0.85 * self.target <= km <= 1.15 * self.target

    def cross(self, a: list[int], b: list[int]) -> list[int]:
        """The better child of the best of three common places at which both children are allowed; a if there is none."""
        at_a, at_b = {}, {}
        for walk, at in ((a, at_a), (b, at_b)):
            m = 0.0
            for i, n in enumerate(walk):
                m += self.net.length[walk[i - 1], n] if i else 0.0
                at.setdefault(n, (i, m))
        whole_a, whole_b, goal = self.net.metres(a), self.net.metres(b), self.target * 1000
        close = lambda m: 1 / (1 + abs(m - goal) / goal)
        score = {n: close(at_a[n][1] + whole_b - at_b[n][1]) + close(at_b[n][1] + whole_a - at_a[n][1]) for n in at_a.keys() & at_b.keys() if n != self.start}
        for n in sorted(score, key=lambda n: (-score[n], n))[:3]:
            one, two = a[: at_a[n][0]] + b[at_b[n][0] :], b[: at_b[n][0]] + a[at_a[n][0] :]
            if self.allowed(one) and self.allowed(two):
                return max(one, two, key=lambda w: self.judge(w)[0])
        return a

    def mutate(self, walk: list[int], rate: float) -> list[int]:
        if self.rng.random() >= rate or len(walk) < 4:
            return walk
        new = self.rng.choice((self.detour, self.spur, self.shortcut, self.unloop, self.far))(walk)
        return new if self.allowed(new) else walk

    def _part(self, walk: list[int], most: int = 8) -> tuple[int, int]:
        i = self.rng.randrange(len(walk) - 1)
        return i, min(len(walk) - 1, i + self.rng.randint(1, most))

    def detour(self, walk: list[int]) -> list[int]:
        """A stretch by way of a neighbour of its start."""
        i, j = self._part(walk)
        via = self.rng.choice(self.net.around[walk[i]])[0]
        rest = self.net.ways(via, 1500.0).get(walk[j])
        return walk[: i + 1] + rest[1] + walk[j + 1 :] if rest else walk

    def spur(self, walk: list[int]) -> list[int]:
        """A step to the highest neighbour and back."""
        i = self.rng.randrange(1, len(walk))
        top = max((v for v, _ in self.net.around[walk[i]]), key=lambda v: (self.net.place[v][2], -v))
        return walk[: i + 1] + [top] + walk[i:] if (top, walk[i]) in self.net.length else walk

    def shortcut(self, walk: list[int]) -> list[int]:
        """A stretch by its shortest way."""
        i, j = self._part(walk, 15)
        rest = self.net.ways(walk[i], 1500.0).get(walk[j])
        return walk[:i] + rest[1] + walk[j + 1 :] if rest else walk

    def unloop(self, walk: list[int]) -> list[int]:
        """Without what lies between two visits of a node."""
        i = self.rng.randrange(1, len(walk) - 1)
        j = len(walk) - 1 - walk[::-1].index(walk[i])
        return walk[:i] + walk[j:] if walk[i] != self.start else walk

    def far(self, walk: list[int]) -> list[int]:
        """A stretch by way of a high node near its start."""
        i, j = self._part(walk, 20)
        near = sorted(self.net.ways(walk[i], 1000.0), key=lambda n: (-self.net.place[n][2], n))[:10]
        via = self.rng.choice(near)
        out, rest = self.net.ways(walk[i], 1000.0)[via][1], self.net.ways(via, 1500.0).get(walk[j])
        return walk[:i] + out + rest[1][1:] + walk[j + 1 :] if rest else walk

    def repaired(self, walk: list[int]) -> list[int]:
        """A walk brought nearer to the bounds: detours while it is too short, shortcuts while it is too long."""
        for _ in range(30):
            _, km, _, valid = self.judge(walk)
            if not valid or 0.85 * self.target <= km <= 1.15 * self.target:
                return walk
            new = (self.detour if km < self.target else self.shortcut)(walk)
            got = self.judge(new)
            if got[3] and abs(got[1] - self.target) < abs(km - self.target):
                walk = new
        return walk

    def spread(self, pop: list[list[int]]) -> list[list[int]]:
        """The next population: the elite, then the best by fitness and distance to those taken before, in one pass; copies come last."""
        sets = {id(w): frozenset(w) for w in pop}
        order = sorted(pop, key=lambda w: -self.judge(w)[0])
        taken, late = order[: self.elite], []
        seen = {tuple(w) for w in taken}
        for w in order[self.elite :]:
            if len(taken) >= self.size:
                break
            alike = min(_jaccard(sets[id(w)], sets[id(t)]) for t in taken[-20:])
            if tuple(w) in seen or alike < 0.1:
                late.append(w)
                continue
            seen.add(tuple(w))
            taken.append(w)
        return (taken + late)[: self.size]

    def diversity(self, pop: list[list[int]]) -> float:
        sets = [frozenset(w) for w in pop]
        pairs = [(self.rng.randrange(len(sets)), self.rng.randrange(len(sets))) for _ in range(200)]
        far = [_jaccard(sets[i], sets[j]) for i, j in pairs if i != j]
        return sum(far) / len(far) if far else 0.0

    def run(self) -> tuple[list[int], list[tuple[int, float, float, float]]]:
        """The best walk and the history: generation, best, mean, diversity. Ends when the best has moved by less than 0.001 over the patience; once before, a restart replaces most of the population."""
        pop = [self.repaired(w) for w in self.maker.population(self.size, self.kind)]
        if not pop:
            return [], []
        stale, restarted = 0, False
        for g in range(self.generations + 1):
            scores = [self.judge(w)[0] for w in pop]
            best, diverse = max(scores), self.diversity(pop)
            stale = stale + 1 if self.history and best - max(h[1] for h in self.history) <= max(0.001, 0.001 * best) else 0
            self.history.append((g, best, sum(scores) / len(scores), diverse))
            last = [h[1] for h in self.history[-self.patience :]]
            if g == self.generations or (len(last) == self.patience and max(last) - min(last) < 0.001 and restarted):
                break
            rate = adaptive_rate_value(diverse, stale, g)
            children = sorted(pop, key=lambda w: -self.judge(w)[0])[: self.elite]
            if stale >= 10 and not restarted:
                restarted = True
                children = children + [self.repaired(w) for w in self.maker.population(int(0.4 * self.size), "distance")]
            while len(children) < 2 * self.size:
                a, b = (max(self.rng.sample(pop, min(len(pop), self.tournament)), key=lambda w: self.judge(w)[0]) for _ in range(2))
                child = self.cross(a, b) if self.rng.random() < 0.8 else a
                children.append(self.mutate(child, max(rate, 0.3)))
            pop = self.spread(children)
        return max(pop, key=lambda w: (self.judge(w)[0], [-n for n in w])), self.history


def _shared(nodes: DataFrame, edges: DataFrame, keep: Keep, most_local: int):
    """The network in a broadcast variable; raises if it has too many edges."""
    steps = keep(hops(edges))
    found = steps.limit(most_local + 1).toArrow()
    if found.num_rows > most_local:
        raise ValueError(f"a search needs a network of at most {most_local} edges; cut it to the surroundings first")
    around: dict[int, list[tuple[int, float]]] = {}
    for u, v, m in sorted(zip(*(c.to_pylist() for c in found.columns), strict=True)):
        around.setdefault(u, []).append((v, m))
    ends = steps.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    own = nodes.join(ends, "node_id", "left_semi").select("node_id", "x", "y", F.coalesce("elevation", F.lit(0.0))).toArrow()
    place = {n: (x, y, e) for n, x, y, e in zip(*(c.to_pylist() for c in own.columns), strict=True)}
    return nodes.sparkSession.sparkContext.broadcast((around, place))


def surroundings(nodes: DataFrame, edges: DataFrame, lat: float, lon: float, target_km: float) -> tuple[DataFrame, DataFrame]:
    """What a route of a length from a place can reach: nodes within three quarters of it, and the edges between them."""
    from .network import nearby, subgraph

    own = nearby(nodes, lat, lon, 0.75 * target_km)
    return own.select("node_id", "x", "y", "elevation"), subgraph(own, edges)


def initial_routes(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, keep: Keep, most_local: int = LOCAL_EDGES) -> DataFrame:
    """Closed walks by strategy: id, strategy, nodes, length, for every seed (id, start, target_m, strategy, seed); seeds whose strategy finds none, or whose start isn't on the network, have no row."""
    shared = _shared(nodes, edges, keep, most_local)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(*shared.value)
        for own in batches:
            rows = []
            for s in own.itertuples():
                if s.start in net.around and s.start in net.place:
                    walk = Maker(net, s.start, float(s.target_m), random.Random(f"{s.seed}-{s.id}")).make(s.strategy)
                    if walk:
                        rows.append((s.id, s.strategy, walk, net.metres(walk)))
            yield pd.DataFrame(rows, columns=["id", "strategy", "nodes", "length"])

    return seeds.select("id", "start", "target_m", "strategy", "seed").mapInPandas(make, "id long, strategy string, nodes array<long>, length double")


def search(requests: DataFrame, nodes: DataFrame, edges: DataFrame, keep: Keep, size: int | None = None, generations: int | None = None, most_local: int = LOCAL_EDGES, on_generation: Callable | None = None) -> DataFrame:
    """The best route of every request (id, start, target_km, objective, seed): id, nodes, km, gain, fitness, generations, evaluations, history (best of every generation).

    Sizes follow the distance where none are given. A request whose distance isn't positive, whose start isn't on the
    network, or that finds no route has null nodes. on_generation(id, history) is called after every search, on the executor.
    """
    shared = _shared(nodes, edges, keep, most_local)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(*shared.value)
        for own in batches:
            rows = []
            for q in own.itertuples():
                best, judged, history = [], None, []
                if q.target_km > 0 and q.start in net.around and q.start in net.place:
                    one = Search(net, q.start, float(q.target_km), q.objective, int(q.seed), size, generations)
                    best, history = one.run()
                    judged = one.judge
                if on_generation:
                    on_generation(q.id, history)
                fitness, km, gain, _ = judged(best) if best else (None, None, None, False)
                rows.append((q.id, best or None, km, gain, fitness, len(history), judged.counted if judged else 0, [h[1] for h in history]))
            yield pd.DataFrame(rows, columns=["id", "nodes", "km", "gain", "fitness", "generations", "evaluations", "history"])

    n = requests.count()
    dealt = requests.select("id", "start", "target_km", "objective", "seed").repartition(max(1, min(n, 10_000)), "id")
    return dealt.mapInPandas(run, "id long, nodes array<long>, km double, gain double, fitness double, generations long, evaluations long, history array<double>")
