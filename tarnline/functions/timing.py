"""Timing of operations on the driver, as rows for catalog.operations()."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Profiler:
    """A log of operations: name, seconds, items and whether they ended well."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float, int, bool]] = []

    @contextmanager
    def timed(self, operation: str, items: int = 0) -> Iterator[None]:
        began, well = time.perf_counter(), False
        try:
            yield
            well = True
        finally:
            self.rows.append((operation, time.perf_counter() - began, items, well))

    def watch(self, operation: str) -> Callable:
        """A decorator: every call is an operation."""

        def wrap(f: Callable) -> Callable:
            @functools.wraps(f)
            def inner(*args, **kwargs):
                with self.timed(operation):
                    return f(*args, **kwargs)

            return inner

        return wrap

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "operation string, seconds double, items long, well boolean")
