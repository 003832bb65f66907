"""Whitening of embeddings with an exact covariance.

Entries become whole numbers (256ths, rounded down). The scatter matrix of the distinct vectors, with a column of ones
that brings the count and the sums along, is made modulo several primes: each partition multiplies residues small enough
that a matrix product in double precision is exact, the residues of the partitions are added, and Chinese remaindering
gives the whole numbers. As many primes are taken as the count and the largest entry need, so nothing is rounded before the
covariance is, once, turned into doubles. A symmetric eigensolver then works on a matrix of the vectors' length, on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import Staged

SCALE = 256
COMPONENTS = 4
#: Primes are below this, so that a product of residues has 40 bits at most and BLOCK of them add up exactly in a double.
PRIME_BELOW = 1 << 20
BLOCK = 1 << 12
#: Largest power of two of which all whole numbers are longs.
_LONG = 1 << 63


def primes(least_product: int, below: int = PRIME_BELOW) -> list[int]:
    """The largest primes under a bound, as many as their product needs to pass least_product."""
    out, product, n = [], 1, below - 1
    while product <= least_product:
        if all(n % d for d in range(2, math.isqrt(n) + 1)):
            out.append(n)
            product *= n
        n -= 1
    return out


def remainders_to_whole(residues: list[int], moduli: list[int]) -> int:
    """The whole number nearest to 0 with these residues."""
    value, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def quantised(df: DataFrame, vector: str, name: str, scale: int = SCALE) -> DataFrame:
    """The rows whose vector holds numbers only (null vectors, null and non-finite entries go), with a column name of whole scaled entries, instead of the vector. An entry whose scaled value is no long raises."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    def whole_of(c: Column) -> Column:
        scaled = F.floor(c.cast("double") * float(scale))
        return F.when(F.abs(c.cast("double") * float(scale)) < float(_LONG), scaled).otherwise(F.raise_error(F.lit("an entry is too large for a whole number of 64 bits")).cast("long"))

    whole = F.transform(F.col(vector), whole_of)
    return df.filter(F.col(vector).isNotNull()).filter(F.forall(vector, finite)).withColumn(name, whole).drop(*([vector] if vector != name else []))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, as rows; all have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scatter(xs: DataFrame, length: int, moduli: list[int]) -> list[list[int]]:
    """Sums of products of every two entries over all rows (one array column of one length), entry 0 being 1 in each row, as exact whole numbers; the products of primes have to exceed twice the largest of them."""
    schema = StructType([StructField(n, LongType()) for n in ("prime", "cell", "value")])
    size = length + 1
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(moduli), size, size), np.int64)
        for batch in batches:
            own = _matrix(batch.column(0))
            for at in range(0, len(own), BLOCK):
                block = np.insert(own[at : at + BLOCK], 0, 1, axis=1)
                for k, p in enumerate(moduli):
                    rest = (block % p).astype(np.float64)
                    sums[k] = (sums[k] + (rest.T @ rest).astype(np.int64)) % p
        for k in range(len(moduli)):
            cells = sums[k][upper]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), k)), pa.array(np.arange(len(cells))), pa.array(cells)], names=schema.names)

    added = xs.mapInArrow(run, schema).groupBy("cell", "prime").agg(F.sum("value").alias("value"))
    rows = added.toArrow()  # one row for each prime and cell, whatever the number of vectors
    table = np.zeros((len(moduli), len(upper[0])), object)
    table[rows["prime"].to_numpy(), rows["cell"].to_numpy()] = rows["value"].to_pylist()
    out = [[0] * size for _ in range(size)]
    for c, (i, j) in enumerate(zip(*upper, strict=True)):
        out[i][j] = out[j][i] = remainders_to_whole([int(v) % p for v, p in zip(table[:, c], moduli, strict=True)], moduli)
    return out


class Whitening(NamedTuple):
    """A fit: n vectors with sums per dimension, and components as columns of a matrix, by falling eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    @classmethod
    def fit(cls, products: list[list[int]], components: int = COMPONENTS) -> Whitening:
        """From a scatter matrix with its column of ones. A component without variance has the eigenvalue 0, and whitened values 0."""
        n, sums = products[0][0], products[0][1:]
        d = len(sums)
        cover = np.array([[(n * products[i + 1][j + 1] - sums[i] * sums[j]) / (n * n) if n else 0.0 for j in range(d)] for i in range(d)], np.float64).reshape(d, d)
        values, vectors = np.linalg.eigh(cover)
        k = min(components, d)
        values, vectors = values[::-1][:k].copy(), vectors[:, ::-1][:, :k]
        trace = float(np.trace(cover))
        values[values <= trace * d * np.finfo(float).eps] = 0.0
        return cls(n, sums, vectors, values, values / trace if trace > 0 else np.zeros(k))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs where they fit, else as Python's whole numbers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < _LONG else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def deviation(self, centred: np.ndarray) -> np.ndarray:
        """Sums of squares of each row, exact; one that is no long raises."""
        most = int(np.abs(centred).max(initial=0))
        if most * most * centred.shape[1] < _LONG:
            return (centred * centred).sum(axis=1)
        exact = [sum(int(v) * int(v) for v in row) for row in centred]
        if max(exact) >= _LONG:
            raise OverflowError("a deviation is no long")
        return np.array(exact, np.int64)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        over = np.divide(1.0, np.sqrt(self.values), out=np.zeros(len(self.values)), where=self.values > 0)
        return centred.astype(np.float64) / max(self.n, 1) @ self.vectors * over

    def identity_error(self, xs: DataFrame) -> float:
        """Largest absolute entry of the covariance of the fit list's whitened vectors, less the identity, over the components that have variance; 0 without any."""
        k = int((self.values > 0).sum())
        fit = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k))
            for batch in batches:
                if batch.num_rows:
                    w = fit.whitened(fit.centred(_matrix(batch.column(0))))[:, :k]
                    total += w.T @ w
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["cell", "value"])

        if not k:
            return 0.0
        rows = xs.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # k * k rows
        cover = np.zeros(k * k)
        for r in rows:
            cover[r.cell] = r.value / self.n
        return float(np.abs(cover.reshape(k, k) - np.eye(k)).max())


def _lengths(df: DataFrame, column: str) -> int | None:
    """The commonest length of an array column (of several, the greatest); None without rows."""
    found = df.groupBy(F.size(column).alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return found.length if found else None


def whiten(df: DataFrame, staged: Staged, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row for each remaining row and component: the id, component (from 1), n, deviation, whitened, explained and identity_error.

    Vectors that are null or hold null or non-finite entries are left out, and so are those whose length isn't the commonest
    one (of several, the greatest), which can't stand in one covariance. Equal vectors count once in the fit, however many
    rows have them; repeated rows each give rows. Without a remaining row, or with empty vectors only, there are no rows. A
    single distinct vector has eigenvalues, whitened values, shares and an error of 0. Other columns are left out.
    """
    spark = df.sparkSession
    own = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    rows = quantised(own, "v", "x", scale)
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), *(StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    length = _lengths(rows, "x")
    if not length:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == length)
    distinct = staged.keep(rows.select("x").distinct())
    most = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("m")).first()
    fit = Whitening.fit(scatter(distinct, length, primes(2 * most.n * max(most.m, 1) ** 2 + 1)), components)
    error = fit.identity_error(distinct)
    k = len(fit.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = fit.centred(_matrix(batch.column(1)))
            n = batch.num_rows
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(n), k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, fit.n)), pa.array(np.repeat(fit.deviation(centred), k)), pa.array(fit.whitened(centred).ravel()), pa.array(np.tile(fit.explained, n)), pa.array(np.full(n * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(project, schema)
