"""LM scoring with a probabilistic suffix tree (operator 10).

The symbols of a text are the bytes of its words, A-Z lowered, a space after each word and one newline as its end; before it
lie newlines. A context is a run of up to DEPTH preceding symbols. Counts of all runs of DEPTH + 1 symbols in the training
texts are summed over the whole corpus. A context is a candidate if it occurs LEAST times, so that the model grows with the
corpus. A candidate stays if its next-symbol distribution diverges from that of its suffix (count times Kullback-Leibler
divergence of at least GAIN nats), if a longer one that stays needs it, or if it has fewer than ROOT symbols.
Distributions are smoothed toward that of the suffix by the number of different next symbols, at the root toward the uniform
one. A symbol's probability is that in the longest suffix state of what precedes it.

The contexts that end in the same ROOT symbols are built together, in parts of about PART candidates, by the executors. Each part
is sent on its own; a task holds HOLD bytes of text against one part after the other, so that it has one part in memory.

The base score is that of words with add-one smoothing. Counts of words that make up COMMON of the tokens (at most 1 / COMMON
words) are sent to the executors; the other words meet their counts in a join.

Null and empty texts are one end. Very long texts are whole; their symbols lie in memory at once. Repeated rows are scored each
and all count in training. Ties do not arise: a state stays or not by its own counts. Without training rows every symbol has
probability 1 / 256, and N is 0. An empty table gives no rows. A carried column named like a new one gives way to it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import Scratch, ship
from .common import SPACE, Words, carried, chunks, mix, words

DEPTH, LEAST, GAIN, COMMON = 6, 16, 8.0, 5e-7
ROOT, PART, HOLD = 3, 50_000, 8 << 20
PAD, GAP = 0x0A, 0x20
#: The end of a text among the word hashes.
END = int(mix(np.array([0x5EED], np.uint64)).astype(np.int64)[0])
#: Different keys that a task sums before it emits them.
HELD = 2_000_000


def symbols(w: Words, rows: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of the rows, each after depth newlines; row of each)."""
    size = w.end - w.start
    at = (depth + 1) * w.row + depth + np.cumsum(size + 1) - size - 1
    out = np.full((depth + 1) * rows + int((size + 1).sum()), PAD, np.uint8)
    inner = w.low[~SPACE[w.low]]
    out[np.repeat(at - np.cumsum(size) + size, size) + np.arange(len(inner))] = inner
    out[at + size] = GAP
    lengths = np.full(rows, depth + 1) + np.bincount(w.row, weights=size + 1, minlength=rows).astype(np.int64)
    return out, np.repeat(np.arange(rows), lengths)


def events(row: np.ndarray, depth: int) -> np.ndarray:
    """Positions of symbols that are not padding."""
    return np.flatnonzero(row[depth:] == row[: len(row) - depth]) + depth if depth else np.arange(len(row))


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def _summed(df: DataFrame, text: str, make) -> DataFrame:
    """(key, n): what make(chunk) gives as (keys, counts), summed in each task and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(held[0][0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000].astype(np.int64)) for x in held[0]], ["key", "n"])

        for b in batches:
            for _, buf, offsets in chunks(b.column(0)):
                held.append(make(buf, offsets))
                size += len(held[-1][0])
                if size > HELD:
                    held, size = [_sum(held)], 0
                    if len(held[0][0]) > HELD // 2:
                        yield from out()
                        held = []
        if held:
            held = [_sum(held)]
            yield from out()

    return df.select(text).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(key, n) of each token: a word's hash, or END."""

    def make(buf, offsets):
        w = words(buf, offsets)
        keys, n = np.unique(w.hashes().astype(np.int64), return_counts=True)
        return np.append(keys, END), np.append(n, len(offsets) - 1)

    return _summed(df, text, make)


def gram_counts(df: DataFrame, depth: int, text: str = "text") -> DataFrame:
    """(key, n) of each run of depth + 1 symbols, the last symbol in the lowest byte."""

    def make(buf, offsets):
        s, row = symbols(words(buf, offsets), len(offsets) - 1, depth)
        code = np.zeros(max(0, len(s) - depth), np.int64)
        for k in range(depth + 1):
            code = (code << 8) | s[k : len(s) - depth + k]
        return np.unique(code[events(row, depth) - depth], return_counts=True)

    return _summed(df, text, make)


class Tree(NamedTuple):
    """classes: class of each byte; child: state of (state, class of the symbol before), or 0; logp: of (state, class of the next symbol), as log10."""

    depth: int
    classes: np.ndarray
    child: np.ndarray
    logp: np.ndarray
    contexts: list[bytes]

    def score(self, s: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """log10 probability of each row of symbols()."""
        at = events(row, self.depth)
        return np.bincount(row[at], weights=self.logs(s, at), minlength=rows)

    def logs(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of the symbols at these places."""
        c = self.classes[s]
        k = self.logp.shape[1]
        state, alive = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        child, logp = self.child.ravel(), self.logp.ravel()
        for d in range(1, self.depth + 1):
            below = child[state * k + c[at - d]]
            alive &= below > 0
            state = np.where(alive, below, state)
        return logp[state * k + c[at]]

    def packed(self) -> tuple:
        """What unpacked() needs: of each state but the first its parent, class, factor of what it has not seen, and what it has seen."""
        up, by = np.nonzero(self.child)
        order = np.argsort(self.child[up, by])
        up, by = up[order].astype(np.int32), by[order].astype(np.int16)
        depth = np.array([len(c) for c in self.contexts])
        back = self.logp[1:, -1] - self.logp[up, -1]
        seen = []
        for k in range(0, len(up), 10_000):
            # one occurrence raises a probability by at least 1 / 256 of it, in log10 by 0.0017
            i, j = np.nonzero(self.logp[1 + k : 10_001 + k] - self.logp[up[k : k + 10_000]] - back[k : k + 10_000, None] > 5e-4)
            seen.append(((i + k + 1).astype(np.int32), j.astype(np.int16)))
        i, j = (np.concatenate(x) for x in zip(*seen, strict=True)) if seen else (np.zeros(0, np.int32), np.zeros(0, np.int16))
        return self.depth, self.classes, np.searchsorted(depth, np.arange(1, self.depth + 2)), self.logp[0], up, by, back, i, j, self.logp[i, j]


def unpacked(packed: tuple) -> Tree:
    """The tree without the names of its contexts."""
    depth, classes, cut, first, up, by, back, i, j, value = packed
    child = np.zeros((len(up) + 1, len(first)), np.int32)
    child[up, by] = np.arange(1, len(up) + 1)
    logp = np.empty((len(up) + 1, len(first)), np.float32)
    logp[0] = first
    at = np.searchsorted(i, cut)
    for d in range(depth):
        a, b, x, y = cut[d], cut[d + 1], at[d], at[d + 1]
        logp[a:b] = logp[up[a - 1 : b - 1]] + back[a - 1 : b - 1, None]
        logp[i[x:y], j[x:y]] = value[x:y]
    return Tree(depth, classes, child, logp, [])


def tree(candidates: list[tuple[int, int, list[int], list[int]]], depth: int, gain: float) -> Tree:
    """From (length, context, next symbols, counts) of each candidate; a candidate's suffixes are candidates too."""
    candidates = sorted(candidates, key=lambda x: (x[0], x[1]))
    seen = sorted({s for d, _, nexts, _ in candidates if d == 0 for s in nexts} | {PAD})
    classes = np.full(256, len(seen), np.int64)
    classes[seen] = np.arange(len(seen))
    k = len(seen) + 1
    uniform = np.full(k, 1 / 256)
    uniform[-1] = max(1, 256 - len(seen)) / 256
    dense: dict[tuple[int, int], np.ndarray] = {}
    keep = {(0, 0)}
    for d, ctx, nexts, counts in candidates:
        up = uniform if d == 0 else dense[d - 1, ctx & ((1 << 8 * (d - 1)) - 1)]
        at, n = classes[nexts], np.array(counts, float)
        total, kinds = n.sum(), len(n)
        p = up * (kinds / (total + kinds))
        p[at] += n / (total + kinds)
        dense[d, ctx] = p
        if d and (d < ROOT or float((n * np.log(n / total / up[at])).sum()) >= gain):
            keep.update((e, ctx & ((1 << 8 * e) - 1)) for e in range(1, d + 1))
    states = {x: i for i, x in enumerate(sorted(keep))}
    child = np.zeros((len(states), k), np.int32)
    for (d, ctx), i in states.items():
        if d:
            child[states[d - 1, ctx & ((1 << 8 * (d - 1)) - 1)], classes[ctx >> 8 * (d - 1)]] = i
    unseen = np.ones(k)
    unseen[-1] = max(1, 256 - len(seen))  # the last class shares its probability among its bytes
    logp = np.log10(np.array([dense.get(x, uniform) for x in states], np.float32) / unseen.astype(np.float32))
    return Tree(depth, classes, child, logp, [ctx.to_bytes(d, "big") for d, ctx in states])


def candidates(df: DataFrame, scratch: Scratch, depth: int = DEPTH, least: int = LEAST, share: float = 0.0, text: str = "text") -> DataFrame:
    """(d, ctx, nexts, ns) of the contexts that occur `least` times and make up `share` of the events; that of length 0 always."""
    grams = scratch.keep(gram_counts(df, depth, text), "grams")
    total = (grams.agg(F.sum("n")).first()[0] or 0) if share else 0
    # length d: the context is the d bytes before the last; at 0 there is none
    level = grams.select(F.explode(F.array([F.struct(F.lit(d).alias("d"), F.expr(f"shiftright(key, 8) & {(1 << 8 * d) - 1}L").alias("ctx"), F.expr("int(key & 255L)").alias("next"), "n") for d in range(depth + 1)])).alias("x")).select("x.*")
    level = level.groupBy("d", "ctx", "next").agg(F.sum("n").alias("n"))
    # a context has at most 256 next symbols
    found = level.groupBy("d", "ctx").agg(F.sum("n").alias("total"), F.collect_list("next").alias("nexts"), F.collect_list("n").alias("ns"))
    found = scratch.keep(found.filter((F.col("d") == 0) | (F.col("total") >= max(least, share * total))).select("d", "ctx", "nexts", "ns"), "candidates")
    scratch.drop("grams")
    return found


def _rows(t: pa.Table) -> list[tuple[int, int, list[int], list[int]]]:
    return list(zip(*(t.column(x).to_pylist() for x in ("d", "ctx", "nexts", "ns")), strict=True))


def learn(df: DataFrame, scratch: Scratch, depth: int = DEPTH, share: float = 0.0, gain: float = GAIN, text: str = "text", least: int = LEAST) -> Tree:
    """The whole tree, for small corpora."""
    out = tree(_rows(candidates(df, scratch, depth, least, share, text).toArrow()), depth, gain)
    scratch.drop("candidates")
    return out


def ends(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ROOT symbols before each of these places as a number, the nearest highest."""
    code = np.zeros(len(at), np.int64)
    for k in range(1, ROOT + 1):
        code = (code << 8) | s[at - k]
    return code


def learn_parts(df: DataFrame, scratch: Scratch, depth: int = DEPTH, gain: float = GAIN, text: str = "text", part: int = PART, least: int = LEAST, share: float = 0.0) -> tuple[np.ndarray, list]:
    """(the least ends() of each part; its packed tree, broadcast)."""
    spark = df.sparkSession
    found = candidates(df, scratch, depth, least, share, text)
    short = spark.sparkContext.broadcast(_rows(found.filter(F.col("d") < ROOT).toArrow()))
    long = found.filter(F.col("d") >= ROOT).withColumn("code", F.expr(" | ".join(f"shiftleft(shiftright(ctx, {8 * k}) & 255L, {8 * (ROOT - 1 - k)})" for k in range(ROOT))))
    count = long.groupBy("code").count().toArrow().sort_by("code")
    code, count = count.column(0).to_numpy(), count.column(1).to_numpy()
    if not len(code):
        scratch.drop("candidates")
        return np.zeros(1, np.int64), [spark.sparkContext.broadcast(tree(short.value, depth, gain).packed())]
    _, at = np.unique((np.cumsum(count) - count) // part, return_index=True)
    bounds = code[at]
    bounds[0] = 0
    of = spark.createDataFrame(pa.table({"code": code, "part": np.searchsorted(bounds, code, "right") - 1}))

    def build(t: pa.Table) -> pa.Table:
        model = tree(short.value + _rows(t), depth, gain)
        return pa.table({"part": t.column("part").slice(0, 1), "model": pa.array([pickle.dumps(model.packed())], pa.binary())})

    models = scratch.keep(long.join(F.broadcast(of), "code").groupBy("part").applyInArrow(build, "part long, model binary"), "model")
    sent = [spark.sparkContext.broadcast(pickle.loads(models.filter(F.col("part") == p).first()["model"])) for p in range(len(bounds))]
    scratch.drop("candidates", "model")
    return bounds, sent


class _Held:
    """Texts that wait to be held against the parts of the model, with the columns that go out with their scores."""

    def __init__(self, bounds: np.ndarray, parts: list, depth: int = DEPTH):
        self.bounds, self.parts, self.depth, self.size = bounds, parts, depth, 0
        self.texts: list[tuple] = []

    def add(self, w: Words, rows: int, out) -> None:
        s, row = symbols(w, rows, self.depth)
        at = events(row, self.depth)
        part = (np.searchsorted(self.bounds, ends(s, at), "right") - 1).astype(np.int16 if len(self.parts) < 1 << 15 else np.int32)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(len(self.parts) + 1))
        at = at[order].astype(np.int32)
        self.texts.append((s, row[at].astype(np.int32), at, cut, rows, out))
        self.size += len(s)

    def scores(self) -> Iterator[tuple[np.ndarray, object]]:
        total = [np.zeros(x[4]) for x in self.texts]
        for p, b in enumerate(self.parts):
            if not any(x[3][p] < x[3][p + 1] for x in self.texts):
                continue
            model = unpacked(b.value)
            if len(self.parts) > 1:
                vars(b).pop("_value", None)  # read again where it is needed again
            for (s, row, at, cut, rows, _), to in zip(self.texts, total, strict=True):
                here = slice(cut[p], cut[p + 1])
                to += np.bincount(row[here], weights=model.logs(s, at[here].astype(np.int64)), minlength=rows)
            del model
        yield from zip(total, [x[5] for x in self.texts], strict=True)
        self.texts, self.size = [], 0


def score(df: DataFrame, train: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, common: float = COMMON, depth: int = DEPTH, least: int = LEAST, share: float = 0.0, gain: float = GAIN) -> DataFrame:
    """key, the columns in carry, n_tokens, n_known, train_tokens, base_score and score of each row of df.

    depth, least, share and gain say which contexts are states; least = 1, share = 0 and gain = 0 keep all up to depth (at most 7).
    """
    spark = df.sparkSession
    ship(spark)
    carry = carried(carry, [key, "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    counts = scratch.keep(word_counts(train, text), "words")
    kinds, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = counts.filter(F.col("n") >= max(1.0, common * total)).toArrow()
    at = np.argsort(top.column(0).to_numpy(), kind="stable")
    sent = spark.sparkContext.broadcast((top.column(0).to_numpy()[at], top.column(1).to_numpy()[at]))
    bounds, parts = learn_parts(train, scratch, depth, gain, text, PART, least, share)
    below = total + kinds + 1
    base = df.select(key, *carry, F.col(text).alias("__text"))
    new = [T.StructField("__n_tokens", T.LongType()), T.StructField("__known", T.LongType()), T.StructField("__base", T.DoubleType()), T.StructField("__score", T.DoubleType()), T.StructField("__rare", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ns = sent.value
        held = _Held(bounds, parts, depth)

        def scored() -> Iterator[pa.RecordBatch]:
            for total, columns in held.scores():
                yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(total), columns[-1]], [key, *carry, *(f.name for f in new)])

        for b in batches:
            for first, buf, offsets in chunks(b.column(len(carry) + 1)):
                rows = len(offsets) - 1
                w = words(buf, offsets)
                different, at = np.unique(np.append(w.hashes().astype(np.int64), END), return_inverse=True)
                place = np.minimum(np.searchsorted(hashes, different), max(0, len(hashes) - 1))
                hit = hashes[place] == different if len(hashes) else np.zeros(len(different), bool)
                c = np.where(hit, ns[place] if len(ns) else 0, 0)
                row, at = np.append(w.row, np.arange(rows)), np.append(at[:-1], np.full(rows, at[-1]))
                here = hit[at]
                one = np.where(here, np.log10(c[at] + 1.0), 0.0) - np.log10(below)
                rare = np.flatnonzero(~here)
                rare = rare[np.argsort(row[rare], kind="stable")]
                cut = np.append(0, np.cumsum(np.bincount(row[rare], minlength=rows)))
                held.add(
                    w,
                    rows,
                    [b.column(i).slice(first, rows) for i in range(len(carry) + 1)]
                    + [
                        pa.array(np.bincount(row, minlength=rows).astype(np.int64)),
                        pa.array(np.bincount(row, weights=here, minlength=rows).astype(np.int64)),
                        pa.array(np.bincount(row, weights=one, minlength=rows)),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(different[at[rare]])),
                    ],
                )
                if held.size > HOLD:
                    yield from scored()
        yield from scored()

    scored = base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], *new]))
    scored = scratch.keep(scored.withColumn("__at", F.monotonically_increasing_id()), "scored")
    rare = scored.filter(F.size("__rare") > 0).select("__at", F.explode("__rare").alias("key")).join(counts.filter(F.col("n") < max(1.0, common * total)), "key")
    rest = rare.groupBy("__at").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("__more"), F.count("*").alias("__found"))
    return scored.join(rest, "__at", "left").select(
        key,
        *carry,
        F.col("__n_tokens").alias("n_tokens"),
        (F.col("__known") + F.coalesce("__found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("__base") + F.coalesce("__more", F.lit(0.0))).alias("base_score"),
        F.col("__score").alias("score"),
    )
