"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of hashed words is trained in numpy from confirmed toxic documents and
unlabelled ones. Its risk is corrected for the class prior: prior * R_p+ + max(0, R_u- - prior * R_p-), and where the
second part falls below zero the step climbs back. Training sees bounded, documented samples, chosen by a hash of the
id; scoring sees every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import add_struct, free_name, release

#: Hashed word space.
SPACE = 1 << 20
#: Documents in training at most: confirmed toxic, unlabelled, and labelled ones for the scale of the score.
MAX_POSITIVE, MAX_UNLABELLED, MAX_SCALE = 4000, 12000, 8000
_WORD = re.compile(r"[^\W\d_]+")
FIELDS = StructType([StructField("score", DoubleType())])


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    centre: float = 0.0
    slope: float = 1.0

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * (logits - self.centre))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def hashed(text: str | None) -> list[int]:
    """Distinct words of a text, hashed."""
    return sorted({zlib.crc32(w.encode()) % SPACE for w in set(_WORD.findall(text.lower()))}) if text else []


def held_out(doc_id: F.Column) -> F.Column:
    """Documents whose labels are never learned from: crc32 of the id as text is divisible by 5. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class _Rows:
    """Sparse 0/1 rows over kept features."""

    def __init__(self, rows: list, features: np.ndarray) -> None:
        self.n = len(rows)
        flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(self.n, dtype=np.int32), [len(r) for r in rows])
        place = np.full(SPACE, -1, np.int32)
        place[features] = np.arange(len(features), dtype=np.int32)
        at = place[flat]
        self.at, self.owner, self.width = at[at >= 0], owner[at >= 0], len(features)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.at], self.n) if self.n else np.zeros(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.owner], self.width) if self.n else np.zeros(self.width)


def choose_features(positive: list, unlabelled: list, least: int = 4, z_least: float = 2.0, most: int = 20000) -> np.ndarray:
    """Words seen often enough whose rates differ between the toxic and the unlabelled texts."""
    counts = lambda rows: np.bincount(np.concatenate([np.asarray(r, np.int32) for r in rows] or [np.zeros(0, np.int32)]), minlength=SPACE)
    p, u = counts(positive), counts(unlabelled)
    rate = (p + u) / max(1, len(positive) + len(unlabelled))
    spread = np.sqrt(np.maximum(1e-12, rate * (1 - rate)) * (1 / max(1, len(positive)) + 1 / max(1, len(unlabelled))))
    z = np.abs(p / max(1, len(positive)) - u / max(1, len(unlabelled))) / spread
    z[(p + u < least) | (z < z_least)] = 0
    return np.sort(np.argsort(-z, kind="stable")[: min(most, int((z > 0).sum()))])


def risk(w: np.ndarray, p: _Rows, u: _Rows, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of weights (the last is the bias) and its gradient; where the corrected part is negative, the gradient that climbs out of it."""
    zp, zu = p.dot(w[:-1]) + w[-1], u.dot(w[:-1]) + w[-1]
    correction = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if correction >= 0:
        gp, gu = -prior / p.n * (_sigmoid(-zp) + _sigmoid(zp)), _sigmoid(zu) / u.n
    else:
        gp, gu = prior / p.n * _sigmoid(zp), -_sigmoid(zu) / u.n
    return prior * np.logaddexp(0, -zp).mean() + max(0.0, correction), np.append(p.back(gp) + u.back(gu), gp.sum() + gu.sum())


def fit(positive: list, unlabelled: list, prior: float, epochs: int = 300, rate: float = 0.05, ridge: float = 1e-4) -> Model:
    """The classifier of least non-negative risk, by Adam over whole samples. Without positives every logit is that of the prior."""
    prior = min(max(prior, 1e-4), 0.9)
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), start)
    features = choose_features(positive, unlabelled)
    p, u = _Rows(positive, features), _Rows(unlabelled, features)
    w = np.zeros(len(features) + 1)
    w[-1] = start
    m, v = np.zeros_like(w), np.zeros_like(w)
    for e in range(1, epochs + 1):
        _, g = risk(w, p, u, prior)
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**e)) / (np.sqrt(v / (1 - 0.99**e)) + 1e-8)
    return Model(features, w[:-1], float(w[-1]))


def rescale(model: Model, rows: list, labels: np.ndarray) -> Model:
    """Centres the score between the labels of training rows: the cut with fewest errors gets 0.5, and a slope fitted to the labels."""
    if not len(rows) or labels.min() == labels.max():
        return model
    z = _Rows(rows, model.features).dot(model.weights) + model.bias
    order = np.argsort(z, kind="stable")
    z, y = z[order], labels[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edge = np.concatenate([[True], z[1:] != z[:-1], [True]])
    wrong = np.where(edge, wrong, len(y) + 1)
    k = int(np.argmin(wrong))
    model.centre = float((z[max(0, k - 1)] + z[min(len(z) - 1, k)]) / 2) if 0 < k < len(z) else float(z[0] - 1 if k == 0 else z[-1] + 1)
    slopes = np.geomspace(0.1, 10, 41)
    losses = [np.logaddexp(0, -s * (z - model.centre) * (2 * y - 1)).mean() for s in slopes]
    model.slope = float(slopes[int(np.argmin(losses))])
    return model


def least_hashes(rows: DataFrame, salt: int, n: int) -> DataFrame:
    """The n rows (id, part) with the least hashes of their ids. Hashes far over those that n rows need are left out before the sort, so no task sees n rows of every partition; where one id fills most rows, fewer may be left."""
    share = min(1.0, (2 * n + 1000) / max(1, rows.count()))
    hashed_ = rows.withColumn("h", F.xxhash64(F.col("id"), F.lit(salt)))
    low = hashed_.filter(F.col("h") < int(-(2**63) + share * 2**64)) if share < 1 else hashed_
    return low.orderBy("h", "id").limit(n).select("id", "part")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_scale: int = MAX_SCALE) -> Model:
    """Samples ids by hash, hashes the words of their texts and fits in one task on the sample, whose size the parameters bound.

    Labels are taken only from rows that held_out() leaves; rows with a null id or label are passed over. The class prior is the share of toxic rows among all those.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).filter(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("y").isin(0, 1)).distinct()
    prior = known.agg(F.avg("y")).first()[0] or 0.0
    toxic, others = known.filter("y = 1").withColumn("part", F.lit(1)), docs.select(F.col(id_col).alias("id"), F.lit(0).alias("part")).filter("id is not null")
    chosen = least_hashes(toxic, 1, max_positive).unionByName(least_hashes(others, 1, max_unlabelled))
    scale = least_hashes(known.select("id", (F.col("y") + 2).alias("part")), 2, max_scale)
    picked = F.broadcast(chosen.unionByName(scale).groupBy("id").agg(F.collect_set("part").alias("parts")))  # bounded by the three parameters
    name = free_name(docs, "words")
    sample = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(picked, "id")
    rows = add_struct(sample, "text", name, StructType([StructField("w", ArrayType(IntegerType()))]), lambda: lambda texts: {"w": [hashed(t) for t in texts]}).select("parts", F.col(name)["w"].alias("w"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, w = [], []
        for batch in batches:
            parts += batch.column(0).to_pylist()
            w += [x.values.to_numpy() for x in batch.column(1)]
        m = _learned(parts, w, prior)
        yield pa.RecordBatch.from_arrays([pa.array([m.features.astype(np.int32)]), pa.array([m.weights]), *(pa.array([float(x)]) for x in (m.bias, m.centre, m.slope))], names=["features", "weights", "bias", "centre", "slope"])
        del parts, w
        release()

    # one task sees the sample, which the parameters bound; the driver gets the weights alone
    found = rows.repartition(1).mapInArrow(learn, "features array<int>, weights array<double>, bias double, centre double, slope double").first()
    if found is None:
        return _learned([], [], prior)
    return Model(np.array(found["features"], np.int64), np.array(found["weights"], float), found["bias"], found["centre"], found["slope"])


def _learned(parts: list, w: list, prior: float) -> Model:
    """The model of a sample: parts of each row (0 unlabelled, 1 toxic, 2 and 3 for the scale of the score) and its words."""
    of = lambda k: [x for p, x in zip(parts, w, strict=True) if k in p]
    bad, good = of(3), of(2)
    return rescale(fit(of(1), of(0), prior), bad + good, np.array([1] * len(bad) + [0] * len(good)))


class _Weights(dict):
    """Word to weight, remembered; at most 250,000 words."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.table = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > 250_000:
            self.clear()
        h = zlib.crc32(word.encode()) % SPACE
        self[word] = out = (h, self.table.get(h, 0.0))
        return out


def score_documents(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """docs with a struct column: score, 0 to 1. Null and empty texts score what the bias alone gives; other columns pass through."""

    def make():
        weights = _Weights(model)

        def logit(body: str | None) -> float:
            if not body:
                return model.bias
            return model.bias + sum({h: w for h, w in map(weights.__getitem__, set(_WORD.findall(body.lower()))) if w}.values())

        return lambda texts: {"score": model.scores(np.array([logit(t) for t in texts])).tolist()}

    return add_struct(docs, text, name, FIELDS, make)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **columns: str) -> DataFrame:
    """docs without those that score the threshold or more; the columns stay."""
    name = free_name(docs, "toxicity")
    scored = score_documents(docs, train(docs, labels, **columns), name, columns.get("text", "text"))
    return scored.filter(F.col(name)["score"] < threshold).drop(name)
