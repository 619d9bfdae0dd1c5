"""Reading tables and cutting Arrow batches of text into words with numpy, without a Python step per word.

Words are runs of bytes outside space and \\x09-\\x0D; all of these are ASCII, so UTF-8 can be cut bytewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that are cut at once: bounds what the working arrays need (about 60 bytes for each), but for longer single texts.
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: The same as a Java regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"

_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_remainder(m: int, column: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod m; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def sampled(df: DataFrame, n: int, *key: str) -> DataFrame:
    """n rows by a hash of key, or all where they are fewer. About 2n rows leave the tasks, whatever the number of tasks."""
    total = df.select(*key).count()
    h = F.pmod(F.xxhash64(*key), F.lit(1 << 30))
    return df.withColumn("__h", h).filter(F.col("__h") < F.lit(min(1.0, 2 * n / max(1, total)) * (1 << 30))).orderBy("__h", *key).limit(n).drop("__h")


def within(df: DataFrame, text: str, budget: int) -> list[str]:
    """Whole texts of a few rows, the shortest first, as many as have `budget` bytes together."""
    size = F.octet_length(text)
    sums = df.filter(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.sum(size).over(Window.orderBy(size, F.xxhash64(text)).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    return [r["t"] for r in sums.filter(F.col("upto") <= budget).collect()]


def carried(carry: list[str] | None, new: list[str]) -> list[str]:
    """The columns to carry; one that is named like a new column gives way to it."""
    return [c for c in dict.fromkeys(carry or []) if c not in new]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps)
        if n > 8 * CHUNK:
            _POWERS.pop(base)
    return have[:n]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with CHUNK bytes or one text; null counts as empty. The bytes are views."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, buf[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words(NamedTuple):
    """The words of a chunk: row, first byte, byte after the last. low: the bytes, A-Z lowered if asked."""

    low: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        return self.prefixes()[0]

    def prefixes(self, *sizes: int) -> list[np.ndarray]:
        """hashes(), then those of each word's first bytes, of as many as each size says, or fewer where a word is shorter."""
        if not len(self.start):
            return [np.zeros(0, np.uint64)] * (1 + len(sizes))
        with np.errstate(over="ignore"):
            sums = np.empty(len(self.low) + 1, np.uint64)
            sums[0] = 0
            np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * _powers(_R, len(self.low)), out=sums[1:])
            scale, before = _powers(_RINV, len(self.low) + 1)[self.start], sums[self.start]
            ends = [self.end, *(np.minimum(self.end, self.start + k) for k in sizes)]
            return [mix((sums[e] - before) * scale + (e - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) for e in ends]


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    low = LOWER[buf] if lower else buf
    if not len(low):
        none = np.zeros(0, np.int64)
        return Words(low, none, none, none)
    inside = ~SPACE[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(low))]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(first)
    return Words(low, np.searchsorted(offsets, start, "right") - 1, start, np.flatnonzero(last) + 1)


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of n words within a row, in order."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        m = len(h) - n + 1
        g = np.zeros(m, np.uint64)
        for j in range(n):
            g = mix(g * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : j + m])
    same = row[:m] == row[n - 1 :]
    return g[same], row[:m][same]


def word_key(word: bytes) -> int:
    """Words.hashes() of one word, for tests and small tables."""
    b = np.frombuffer(word, np.uint8)
    return int(words(b, np.array([0, len(b)]), False).hashes()[0])
