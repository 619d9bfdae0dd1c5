"""Toxicity grades by cumulative-link ordinal regression (operator 2).

Features are the words of a text and their first 4, 5 and 6 bytes, A-Z lowered, each present or not. One weight vector w is
shared by all thresholds: P(grade <= k) = sigmoid(t_k - w.x) with t_0 < t_1 < ... The expected severity is the mean grade
under the model. It is fitted in numpy on a bounded sample of labelled texts, with a ridge on w. The executors count the
features of the sampled texts; the driver gets the FEATURES that it fits and which of them each sampled text has, no text.

Null and empty texts have no features, and the severity of a text without any. Very long texts are read whole. Without labels
of two grades, as with empty tables, every severity is 0. Of grades that are equally probable the lowest is given. Repeated
rows are graded each; of several labels of a key the highest counts. A carried column named like a new one gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import Scratch, ship
from .common import carried, chunks, words

#: Labelled texts of each label that the model is fitted on, and its features at most.
TEXTS, FEATURES = 2000, 4096
PREFIXES = (4, 5, 6)
#: A feature has to occur in so many sampled texts, with a label above 0, and so much more often there than elsewhere.
LEAST, LIFT = 6, 8.0
RIDGE, STEPS = 2e-5, 500


class Model(NamedTuple):
    """features: sorted hashes; weights: theirs; thresholds: t_0 < t_1 < ..."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(expected severity, most probable grade, probability of any grade above 0) for each w.x."""
        above = _sigmoid(x[:, None] - self.thresholds[None])  # P(grade > k)
        p = -np.diff(np.concatenate([np.ones((len(x), 1)), above, np.zeros((len(x), 1))], axis=1), axis=1)
        return above.sum(axis=1), p.argmax(axis=1), above[:, 0] if len(self.thresholds) else np.zeros(len(x))

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """w.x of each row."""
        row, at = self.found(buf, offsets)
        return np.bincount(row, weights=self.weights[at], minlength=len(offsets) - 1)

    def found(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature), each pair once."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w = words(buf, offsets)
        pairs = []
        for h in w.prefixes(*PREFIXES):
            at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
            hit = self.features[at] == h
            pairs.append(w.row[hit] * len(self.features) + at[hit])
        pairs = np.unique(np.concatenate(pairs))
        return pairs // len(self.features), pairs % len(self.features)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


NONE = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))


def _once(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (key, row) once."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return keys[new], rows[new]


def _counted(df: DataFrame) -> DataFrame:
    """(feature, up, down): sampled texts with a label above 0 that have each feature, and others. df: (t, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False) > 0
            for first, buf, offsets in chunks(b.column(0)):
                w = words(buf, offsets)
                keys, rows = _once(np.concatenate(w.prefixes(*PREFIXES)), np.tile(w.row, 1 + len(PREFIXES)))
                keys, at = np.unique(keys, return_inverse=True)
                up = np.bincount(at, weights=label[first + rows], minlength=len(keys)).astype(np.int64)
                all_of = np.bincount(at, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(up), pa.array(all_of - up)], ["feature", "up", "down"])

    counts = df.select("t", "y").mapInArrow(run, "feature long, up long, down long")
    return counts.groupBy("feature").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))


def select(df: DataFrame) -> np.ndarray:
    """Hashes of the features that speak most for labels above 0, by occurrences times the log of the lift. df: (t, y)."""
    totals = {r["up"]: r["count"] for r in df.groupBy((F.col("y") > 0).alias("up")).count().collect()}
    n_up, n_down = (max(1, totals.get(x, 0)) for x in (True, False))
    lift = F.log((F.col("up") + 0.5) / (n_up + 1)) - F.log((F.col("down") + 0.5) / (n_down + 1))
    best = _counted(df).filter(F.col("up") >= LEAST).withColumn("lift", lift).filter(F.col("lift") >= float(np.log(LIFT)))
    best = best.orderBy((F.col("up") * F.col("lift")).desc(), "feature").limit(FEATURES).select("feature").toArrow().column(0).to_numpy()
    return np.sort(best.view(np.uint64))


def _rows(df: DataFrame, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(label and weight of each sampled text; (row, feature), each pair once). df: (t, y, weight)."""
    model = Model(features, np.zeros(0), np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, buf, offsets in chunks(b.column(0)):
                row, at = model.found(buf, offsets)
                cut = np.append(0, np.cumsum(np.bincount(row, minlength=len(offsets) - 1)))
                have = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(first, len(have)), b.column(2).slice(first, len(have)), have], ["y", "weight", "have"])

    t = df.select("t", F.col("y").cast("long").alias("y"), "weight").mapInArrow(run, "y long, weight double, have array<int>").toArrow()
    have = t.column("have").combine_chunks()
    size = have.value_lengths().to_numpy(zero_copy_only=False)
    y, weight = t.column("y").to_numpy(), t.column("weight").to_numpy()
    # the order in which tasks ended does not count
    order = np.lexsort((np.bincount(np.repeat(np.arange(len(size)), size), weights=have.flatten().to_numpy() + 1.0, minlength=len(size)), size, weight, y))
    place = np.argsort(order)
    return y[order], weight[order], place[np.repeat(np.arange(len(size)), size)], have.flatten().to_numpy().astype(np.int64)


def loss(p: np.ndarray, row: np.ndarray, at: np.ndarray, grades: np.ndarray, weight: np.ndarray, m: int) -> tuple[float, np.ndarray]:
    """(weighted mean negative log-likelihood with the ridge, its gradient). p: weights of m features, the first threshold, logs of the gaps."""
    levels, n = len(p) - m + 1, len(grades)
    t = np.append(p[m], p[m] + np.cumsum(np.exp(p[m + 1 :])))
    x = np.bincount(row, weights=p[at], minlength=n)
    a, b = _sigmoid(np.append(t, np.inf)[grades] - x), _sigmoid(np.append(-np.inf, t)[grades] - x)
    da, db = a * (1 - a), b * (1 - b)
    like = np.maximum(a - b, 1e-12)
    dx = weight * (da - db) / like
    dt = np.bincount(grades, weights=-weight * da / like, minlength=levels)[: levels - 1] + np.bincount(grades, weights=weight * db / like, minlength=levels)[1:]
    tail = np.cumsum(dt[::-1])[::-1]
    g = np.concatenate([np.bincount(at, weights=dx[row], minlength=m) + 2 * RIDGE * p[:m], [tail[0]], tail[1:] * np.exp(p[m + 1 :])])
    return float(-(weight * np.log(like)).sum() + RIDGE * (p[:m] ** 2).sum()), g


def fit(features: np.ndarray, row: np.ndarray, at: np.ndarray, grades: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """Of grades 0, 1, ... of texts that have these features; gradient descent with Adam. weight: rows that each text stands for."""
    kinds, grades = np.unique(np.asarray(grades, np.int64), return_inverse=True)
    if len(kinds) < 2:
        return NONE
    m = len(features)
    weight = np.ones(len(grades)) if weight is None else np.asarray(weight, float)
    weight = weight / weight.sum()
    # thresholds as the first and the logs of the gaps, so that they stay in order
    p = np.zeros(m + len(kinds) - 1)
    moment, square = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        g = loss(p, row, at, grades, weight, m)[1]
        moment += 0.1 * (g - moment)
        square += 0.001 * (g * g - square)
        p -= 0.05 * (1 - step / (STEPS + 1)) * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return Model(features, p[:m], np.append(p[m], p[m] + np.cumsum(np.exp(p[m + 1 :]))))


def graded(model: Model, row: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades for labels of two kinds: 0 where not toxic, else 1, or 2 where the features that speak for toxicity are more than
    in the median toxic text."""
    hits = np.bincount(row, weights=model.weights[at] > 0, minlength=len(toxic))
    return np.where(toxic, 1 + (hits > np.median(hits[toxic])), 0)


def learn(sampled: DataFrame) -> Model:
    """The model of sample(). Labels of two kinds become three grades by graded()."""
    features = select(sampled)
    y, weight, row, at = _rows(sampled, features)
    if len(np.unique(y)) < 2:
        return NONE
    if len(np.unique(y)) == 2 and y.min() <= 0 < y.max():
        y = graded(fit(features, row, at, y > 0, weight), row, at, y > 0)
    return fit(features, row, at, y, weight)


def sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, text: str = "text", label: str = "toxic", key: str = "doc_id", texts: int = TEXTS) -> DataFrame:
    """(t, y, weight): about `texts` labelled texts of each label, chosen by a hash of the key, and the rows that each stands for."""
    labels = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    counts = labels.groupBy("y").count().collect()
    share = F.coalesce(*(F.when(F.col("y") == r["y"], F.lit(1_000_000.0 * texts / r["count"])) for r in counts), F.lit(0.0))
    h = F.pmod(F.xxhash64(key), F.lit(1_000_000))
    # at most 2 * texts ids of each label: small enough to be sent to all
    some = labels.filter(h < share).withColumn("h", h).orderBy("h", key).limit(2 * texts * max(1, len(counts)))
    rows = docs.select(key, F.col(text).alias("t")).filter(F.col("t").isNotNull()).join(F.broadcast(some), key).select("t", "y")
    rows = scratch.keep(rows.repartition(8), "sample")
    have = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    weight = F.coalesce(*(F.when(F.col("y") == r["y"], F.lit(r["count"] / max(1, have.get(r["y"], 0)))) for r in counts), F.lit(1.0))
    return rows.withColumn("weight", weight)


def score(df: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """The columns in carry, expected_severity, grade and toxic of each row; toxic: any grade above 0 is at least as probable as 0."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    carry = carried(carry, ["expected_severity", "grade", "toxic"])
    at = carry.index(text) if text in carry else len(carry)
    df = df.select(*carry, *([] if text in carry else [text]))
    new = [T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    schema = T.StructType([*df.schema.fields[: len(carry)], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            parts = [np.zeros(0)]
            parts += [model.score(buf, offsets) for _, buf, offsets in chunks(b.column(at))]
            severity, grade, toxic = model.severity(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(carry))] + [pa.array(severity), pa.array(grade, pa.int32()), pa.array(toxic >= 0.5)], schema.names)

    return df.mapInArrow(run, schema)


def clean(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df that are not toxic."""
    ship(df.sparkSession)
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            x = np.concatenate([np.zeros(0), *(model.score(buf, offsets) for _, buf, offsets in chunks(b.column(at)))])
            yield b.filter(pa.array(model.severity(x)[2] < 0.5))

    return df.mapInArrow(run, df.schema)
