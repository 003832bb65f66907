"""Progress of searches, as their generations come in: the best so far, how long it hasn't risen, the mean of the last ten, and what that says.

One rule makes the rows, for tables and for streams. A stream keeps for each run its state and the generations that came
before the ones they follow; these wait until the gap is closed, or for a time, after which the run goes on without the missing ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY = "run LONG, generation LONG, best DOUBLE"
PROGRESS = "run LONG, generation LONG, best DOUBLE, top DOUBLE, stale LONG, mean DOUBLE, state STRING"
#: Least rise, of the value or as its share, that counts; generations without one after which a search is stuck; last values that are averaged (fixed values).
LEAST_RISE, STUCK, LAST = 0.001, 10, 10
#: Milliseconds that generations wait for one before them.
WAIT_MS = 600_000


class State(NamedTuple):
    generation: int = 0
    top: float | None = None
    stale: int = 0
    last: tuple[float, ...] = ()


def advance(state: State, generation: int, best: float) -> tuple[State, tuple]:
    """The state after a generation, and its row without the run."""
    better = state.top is None or best - state.top > max(LEAST_RISE, abs(state.top) * LEAST_RISE)
    top, stale = (best, 0) if better else (state.top, state.stale + 1)
    last = (*state.last, best)[-LAST:]
    mood = "rising" if better else "stuck" if stale >= STUCK else "waiting"
    return State(generation, top, stale, last), (generation, best, top, stale, sum(last) / len(last), mood)


def progress(history: DataFrame) -> DataFrame:
    """The rows of a table of histories (run, generation, best); of rows of one generation the greatest counts, rows without a value or number don't. A run is one group, read once."""

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        state, rows = State(), []
        run = own["run"].iloc[0]
        for g, b in own.dropna().groupby("generation")["best"].max().sort_index().items():
            state, row = advance(state, int(g), float(b))
            rows.append((run, *row))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in PROGRESS.split(", ")])

    return history.filter("run is not null").select("run", "generation", "best").groupBy("run").applyInPandas(fold, PROGRESS)


STATE = "generation LONG, top DOUBLE, stale LONG, last ARRAY<DOUBLE>, early ARRAY<LONG>, values ARRAY<DOUBLE>"


def _step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState, wait: bool = True) -> Iterator[pd.DataFrame]:
    """What a batch, or the end of a wait, adds to a run."""
    state, early = State(), {}
    if held.exists:
        generation, top, stale, last, numbers, values = held.get
        state, early = State(generation, top, stale, tuple(last)), dict(zip(numbers, values, strict=True))
    ended = held.hasTimedOut
    for own in () if ended else batches:
        for g, b in own[["generation", "best"]].dropna().itertuples(index=False):
            # what comes after its place has been passed is too late
            if g > state.generation:
                early[int(g)] = max(float(b), early.get(int(g), float(b)))
    rows = []
    for g in sorted(early):
        if g != state.generation + 1 and not ended:
            break
        state, row = advance(state, g, early.pop(g))
        rows.append((key[0], *row))
    held.update((state.generation, state.top, state.stale, list(state.last), list(early), list(early.values())))
    if early and wait:
        held.setTimeoutDuration(WAIT_MS)
    yield pd.DataFrame(rows, columns=[f.split()[0] for f in PROGRESS.split(", ")])


def watch(history: DataFrame, wait: bool = True) -> DataFrame:
    """The same rows of a stream of histories, whose generations may come in any order; a generation is told once all before it have been. Numbers start at 1. Use it with the output mode append and a checkpoint, from which it goes on.

    wait: whether a run goes on without a generation that hasn't come for WAIT_MS. A stream that is to end with what is
    there (the trigger availableNow) can't wait for a time: it leaves such runs for the next start.
    """
    own = history.filter("run is not null").select("run", "generation", "best")
    kind = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return own.groupBy("run").applyInPandasWithState(lambda key, rows, held: _step(key, rows, held, wait), PROGRESS, STATE, "append", kind)
