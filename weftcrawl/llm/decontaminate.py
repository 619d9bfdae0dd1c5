"""Benchmark decontamination by pigeonhole edit matching (operator 6).

Test items and texts are lowered and runs of white space become one space. An item of m characters may differ from a place in
a text by k = m * RATE edits, rounded down. Cut into k + 1 pieces, one piece must be there unchanged; an Aho-Corasick
automaton over the pieces finds all such hits in one pass. Around the hits Myers' bit-parallel algorithm gives the least edit
distance of the item to any part of the text. Items under SHORT characters have to be there unchanged, between word ends.

A part of an item is asked for by segments of about SEGMENT characters, each within its own k, wherever an item makes two of
them: a leaked passage of 2 * SEGMENT characters holds a whole segment. What is shorter counts only as a whole item.

The items are the stated query set: they go to the executors in blocks of BLOCK characters, each block with its own pass over
the texts. Null and empty texts and items match nothing. Very long texts are searched whole. Repeated texts are matched each;
repeated items are one row each. Of several matches of an item the longest counts, then the nearest, then the first. An empty
table of either kind gives no match. Other columns are not read, whatever their names; clean() passes them through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import ship

RATE = 1 / 16
SHORT, SEGMENT = 24, 80
BLOCK = 4_000_000
#: The automaton that this process made last, by what it was made of: tasks of a worker share it.
_LAST: dict[str, Matcher] = {}


def _inside(text: str, i: int) -> bool:
    """Place i lies within a word. Scripts that are written without spaces have a word end anywhere."""
    return 0 < i < len(text) and all(c.isalnum() and not (0x0E00 <= ord(c) < 0x1100 or 0x1780 <= ord(c) < 0x1800 or 0x2E80 <= ord(c) < 0xAC00 or ord(c) >= 0xF900) for c in text[i - 1 : i + 1])


def needles(item: str, rate: float = RATE) -> list[tuple[str, int]]:
    """(what to find, edits that it may have): a normal item and its segments."""
    n = len(item) // SEGMENT
    segments = [item[len(item) * j // n : len(item) * (j + 1) // n].strip() for j in range(n)] if n > 1 else []
    return [(s, int(len(s) * rate) if len(s) >= SHORT else 0) for s in [item, *segments] if s]


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(place, piece): k + 1 parts of nearly equal length that make up the item."""
    n = k + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(i, item[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str) -> tuple[int, int]:
    """(least edit distance of item to any part of text, where the first such part ends), by bit vectors as long as the item."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << m - 1
    pv, mv, distance = mask, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            distance += 1
        elif mh & high:
            distance -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if distance < best:
            best, end = distance, j + 1
            if not best:
                break
    return best, end


class Matcher:
    """items: (id, normal text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.needles: list[tuple[int, str, int]] = []
        for i, item in items:
            self.needles += [(i, s, k) for s, k in needles(item, rate)]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, s, k) in enumerate(self.needles):
            for at, piece in pieces(s, k):
                where.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, x in where.items():
            self.automaton.add_word(piece, (len(piece), x))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, length of what was matched, end in the normal text), the best for each item."""
        if self.empty or not text:
            return []
        text = normal(text)
        places: dict[int, list[int]] = {}
        for last, (size, hits) in self.automaton.iter(text):
            for n, at in hits:
                places.setdefault(n, []).append(last + 1 - size - at)
        best: dict[int, tuple[int, int, int]] = {}
        for n, starts in places.items():
            item, s, k = self.needles[n]
            if len(s) < SHORT:
                starts = [x for x in starts if not _inside(text, x) and not _inside(text, x + len(s))]
            for lo, hi in _merged(starts, k):
                lo, hi = max(0, lo - k), min(len(text), hi + len(s) + k)
                at = text.find(s, lo, hi)
                distance, end = (0, at + len(s)) if at >= 0 else myers(s, text[lo:hi])
                end += 0 if at >= 0 else lo
                # a whole item is better evidence than a segment, then the smaller distance
                if distance <= k:
                    best[item] = min(best.get(item, (0, 0, 0)), (-len(s), distance, end))
        return [(item, d, -s, end) for item, (s, d, end) in best.items()]


def _merged(starts: list[int], k: int) -> list[list[int]]:
    """Runs of starts, each at most 2k after the one before, as [first, last]."""
    out: list[list[int]] = []
    for x in sorted(starts):
        if out and x - out[-1][1] <= 2 * k + 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return out


def matches(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item_id, distance, matched_chars and match_end of each text and item that it holds."""
    spark = df.sparkSession
    ship(spark)
    schema = T.StructType([df.schema[key], T.StructField("item_id", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in ("distance", "matched_chars", "match_end"))])
    out = spark.createDataFrame([], schema)
    for block in _blocks(items.select(F.col(item_key).cast("long"), item_text).filter(F.col(item_text).isNotNull())):
        sent = spark.sparkContext.broadcast(block)
        out = out.unionByName(df.select(key, text).mapInArrow(_search(sent, _name(block), schema.names), schema))
    return out


def clean(df: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df that hold none of the items."""
    spark = df.sparkSession
    ship(spark)
    at = df.columns.index(text)

    def keep(sent, name):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, sent)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(t.as_py()) for t in b.column(at)], pa.bool_()))

        return run

    for block in _blocks(items.select(F.col(item_key).cast("long"), item_text).filter(F.col(item_text).isNotNull())):
        df = df.mapInArrow(keep(spark.sparkContext.broadcast(block), _name(block)), df.schema)
    return df


def _name(block: list[tuple[int, str]]) -> str:
    return hashlib.sha256(repr(block).encode()).hexdigest()


def _matcher(name: str, sent) -> Matcher:
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Matcher(sent.value)
    return _LAST[name]


def _search(sent, name: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, sent)
        for b in batches:
            rows: list[int] = []
            found: list[tuple[int, int, int, int]] = []
            for k, t in enumerate(b.column(1)):
                for x in matcher.find(t.as_py()):
                    rows.append(k)
                    found.append(x)
            if rows:
                item, distance, size, end = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(item, pa.int64()), *(pa.array(x, pa.int32()) for x in (distance, size, end))], names)

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    for i, t in items.toLocalIterator():
        t = normal(t)
        if block and size + len(t) > BLOCK:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    if block:
        yield block
