"""Language identification with a byte convolutional network (operator 3).

A text's bytes are cut into windows of WINDOW bytes that overlap by the widest filter less one, so that each place of the
text meets each filter once. Filters of several widths slide over a window; the largest response of each filter, after a
ReLU, feeds a softmax. The network is trained in numpy with Adam on windows of labelled texts. A text's class probabilities
are the means over its windows, weighted by their letters.

Training takes a bounded sample of windows, which the executors cut; the driver gets no text. Prediction holds TOGETHER windows
at a time, however long a text is.

The score is the probability of lang_pred. Null and empty texts and texts without letters are `und` with score 0; so is every
text where no labelled text was given, as with an empty table. Of classes that are equally probable the first in order is
given. Repeated rows are predicted each. A carried column named like a new one gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import ship
from .common import LOWER, carried, chunks, mix

WINDOW, WIDTHS, FILTERS, EMBED = 192, (2, 3, 4, 5), 12, 12
#: Texts per class, windows per class (both about) and passes that training takes.
TEXTS, WINDOWS, EPOCHS = 300, 3000, 8
OVERLAP = max(WIDTHS) - 1
#: Windows that are predicted at once.
TOGETHER = 256
#: Bytes that can be part of a letter: ASCII letters and everything beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x41:0x5B] = LETTER[0x80:] = True
_ANY_LETTER = regex.compile(r"\p{L}")


class Net(NamedTuple):
    classes: list[str]
    #: by width: (width, 256, FILTERS), the response of each filter place to each byte
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, w: np.ndarray) -> np.ndarray:
        """(windows, features) of bytes (WINDOW, windows)."""
        found = []
        for t in self.tables:
            n = len(w) - len(t) + 1
            act = t[0][w[:n]]
            for j in range(1, len(t)):
                act += t[j][w[j : j + n]]
            found.append(act.max(axis=0))
        return np.maximum(np.concatenate(found, axis=1) + self.bias, 0)

    def predict(self, w: np.ndarray) -> np.ndarray:
        """(windows, classes): probabilities."""
        z = self.pooled(w) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each window begins, its row), for windows over every place of every text."""
    size = np.diff(offsets)
    step = WINDOW - OVERLAP
    n = np.where(size > 0, np.maximum(1, -(-(size - OVERLAP) // step)), 0)
    row = np.repeat(np.arange(len(size)), n)
    return offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step, row


def cut(buf: np.ndarray, offsets: np.ndarray, start: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Bytes (windows, WINDOW) with A-Z lowered, and zeros after a text's end."""
    if not len(start):
        return np.zeros((0, WINDOW), np.uint8)
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][row][:, None]
    return np.where(inside, LOWER[buf[np.minimum(at, len(buf) - 1)]], 0).astype(np.uint8)


def windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all windows, row of each)."""
    start, row = places(offsets)
    return cut(buf, offsets, start, row), row


def fit(x: np.ndarray, labels: list[str], seed: int = 7) -> Net | None:
    """Of windows (windows, WINDOW) and the class of each."""
    classes = sorted(set(labels))
    if not classes:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([classes.index(c) for c in labels])
    weight = (len(y) / (len(classes) * np.bincount(y, minlength=len(classes)).clip(1)))[y].astype(np.float32)
    features = len(WIDTHS) * FILTERS

    def start(*shape, fan):
        return (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)

    p = [start(256, EMBED, fan=1), *(start(k, EMBED, FILTERS, fan=k * EMBED) for k in WIDTHS), np.zeros(features, np.float32), start(features, len(classes), fan=features), np.zeros(len(classes), np.float32)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), 64):
            some = order[k : k + 64]
            g = _gradient(p, x[some].T, y[some], weight[some])
            t += 1
            rate = 4e-3 * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for a, b, mm, vv in zip(p, g, m, v, strict=True):
                mm += 0.1 * (b - mm)
                vv += 0.001 * (b * b - vv)
                a -= rate * mm / (np.sqrt(vv) + 1e-7)
    embed, bias, out, out_bias = p[0], p[-3], p[-2], p[-1]
    return Net(classes, [np.stack([embed @ f[j] for j in range(len(f))]) for f in p[1:-3]], bias, out, out_bias)


def _gradient(p: list[np.ndarray], w: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy, for each parameter; w: bytes (WINDOW, windows)."""
    embed, filters, bias, out, out_bias = p[0], p[1:-3], p[-3], p[-2], p[-1]
    e = embed[w]
    best, pooled = [], []
    for f in filters:
        n = len(w) - len(f) + 1
        act = e[:n] @ f[0]
        for j in range(1, len(f)):
            act += e[j : j + n] @ f[j]
        best.append(act.argmax(axis=0))
        pooled.append(act.max(axis=0))
    h = np.concatenate(pooled, axis=1) + bias
    r = np.maximum(h, 0)
    z = r @ out + out_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(len(y)), y] -= 1
    z *= (weight / len(y))[:, None]
    dh = (z @ out.T) * (h > 0)
    de = np.zeros_like(embed)
    df = []
    column = np.arange(len(y))[:, None]
    for i, f in enumerate(filters):
        d = dh[:, i * FILTERS : (i + 1) * FILTERS]
        g = np.zeros_like(f)
        for j in range(len(f)):
            byte = w[best[i] + j, column]  # (windows, FILTERS): what the best place of each filter saw
            g[j] = np.einsum("wfe,wf->ef", embed[byte], d)
            np.add.at(de, byte, d[:, :, None] * f[j].T[None])
        df.append(g)
    return [de, *df, dh.sum(axis=0), r.T @ z, z.sum(axis=0)]


def sample(df: DataFrame, learn: Column, text: str, label: str, key: str, texts: int = TEXTS, most: int = WINDOWS) -> tuple[np.ndarray, list[str]]:
    """(windows, classes): about `most` windows with letters of about `texts` labelled rows of each class, all by hashes of the key
    and the window's number: the bounded sample that the network is fitted on."""
    ship(df.sparkSession)
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000))
    df = df.filter(learn & F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(text).alias("t"), F.col(label).alias("y"), h.alias("h"))
    counts = df.groupBy("y").count().collect()
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), []
    some = df.filter(F.col("h") < F.coalesce(*(F.when(F.col("y") == r["y"], F.lit(1_000_000.0 * texts / r["count"])) for r in counts), F.lit(0.0)))
    # windows of a text at most: what its share of `most` would be were half of the texts shorter
    each = max(1, 2 * most // texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, buf, offsets in chunks(b.column(0)):
                start, row = places(offsets)
                seed = b.column(2).slice(first, len(offsets) - 1).to_numpy().astype(np.uint64)[row]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                order = mix(mix(seed + np.uint64(1)) ^ nth.astype(np.uint64)) >> np.uint64(1)
                place = np.lexsort((order, row))
                rank = np.empty(len(row), np.int64)
                rank[place] = np.arange(len(row)) - np.searchsorted(row, row[place])
                at = np.flatnonzero(rank < each)
                w = cut(buf, offsets, start[at], row[at])
                lettered = LETTER[w].mean(axis=1) > 0.3
                if not lettered.any():
                    continue
                at, w = at[lettered], w[lettered]
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(first + row[at])), pa.array(order[at].astype(np.int64)), pa.array([x.tobytes() for x in w], pa.binary())], ["y", "o", "w"])

    found = some.select("t", "y", "h").mapInArrow(run, "y string, o long, w binary")
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("y").orderBy("o", "w"))).filter(F.col("nth") <= most).orderBy("y", "nth").select("y", "w").toArrow()
    if not len(best):
        return np.zeros((0, WINDOW), np.uint8), []
    return np.stack([np.frombuffer(w, np.uint8) for w in best.column("w").to_pylist()]), best.column("y").to_pylist()


def predict(df: DataFrame, net: Net | None, carry: list[str], text: str = "text") -> DataFrame:
    """The columns in carry, lang_pred and score of each row."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(net)
    carry = carried(carry, ["lang_pred", "score"])
    df = df.select(*carry, F.col(text).alias("__text"))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            column = b.column(len(carry))
            for first, buf, offsets in chunks(column):
                rows = len(offsets) - 1
                lang, score = np.full(rows, "und", object), np.zeros(rows)
                if net is not None and len(buf):
                    start, of = places(offsets)
                    total, ascii_letters, prob = np.zeros(rows), np.zeros(rows), np.zeros((rows, len(net.classes)))
                    for k in range(0, len(start), TOGETHER):
                        row = of[k : k + TOGETHER]
                        w = cut(buf, offsets, start[k : k + TOGETHER], row)
                        letters = LETTER[w].sum(axis=1).astype(float)
                        low, span = row[0], row[-1] - row[0] + 1
                        total[low : low + span] += np.bincount(row - low, weights=letters, minlength=span)
                        ascii_letters[low : low + span] += np.bincount(row - low, weights=(LETTER[w] & (w < 0x80)).sum(axis=1), minlength=span)
                        p = net.predict(w.T) * letters[:, None]
                        for c in range(len(net.classes)):
                            prob[low : low + span, c] += np.bincount(row - low, weights=p[:, c], minlength=span)
                    mean = prob / np.maximum(total, 1)[:, None]
                    best = mean.argmax(axis=1)
                    for k in np.flatnonzero(total > 0).tolist():
                        if ascii_letters[k] or _ANY_LETTER.search(column[first + k].as_py()):
                            lang[k], score[k] = net.classes[best[k]], min(1.0, float(mean[k, best[k]]))
                yield pa.RecordBatch.from_arrays([b.column(i).slice(first, rows) for i in range(len(carry))] + [pa.array(lang.tolist(), pa.string()), pa.array(score)], schema.names)

    return df.mapInArrow(run, schema)
