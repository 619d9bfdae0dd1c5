"""Byte-level BPE encoding and decoding by a rank file (operator 4).

Each pre-token is a linked list of symbols. Adjacent pairs that can merge sit in buckets, one for each merge rank, which
hold list positions. A two-level bitmap marks the buckets in use, so that find-first-set gives the next rank; an entry whose
pair has changed since is stale and skipped. The different pre-tokens of a batch lie in one array and share the queue, so a
rank is taken for many of them at once; a pre-token of any length takes n log n.

Nulls and empty texts have no ids and decode to no bytes. Very long texts are encoded whole, in memory at once. Of equal ranks the
leftmost pair merges first. Repeated rows stay; an empty table gives no rows. Other columns pass through, but for one named like
the new one, which gives way.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..plans.runtime import ship
from .common import chunks
from .parts import PartCoder, ragged, spell

_BITS = 256


class RankQueue:
    """List positions by rank: a bucket of arrays for each rank, and a two-level bitmap of the ranks in use."""

    def __init__(self, ranks: int):
        self.words = [0] * (ranks // _BITS + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        buckets, words = self.buckets, self.words
        for rank, i, j in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
            bucket = buckets.get(rank)
            if bucket is None:
                buckets[rank] = [positions[i:j]]
                words[rank // _BITS] |= 1 << rank % _BITS
                self.top |= 1 << rank // _BITS
            else:
                bucket.append(positions[i:j])

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank, found by two find-first-set steps, and its positions in ascending order."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        rank = word * _BITS + low.bit_length() - 1
        self.words[word] = bits ^ low
        if bits == low:
            self.top ^= 1 << word
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))


class Codec:
    """Ids of texts by ranks and a pattern for pre-tokens, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.size = size = max(ranks.values(), default=0) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.bytes, self.decimal = ragged(tokens), ragged([b" %d" % i for i in range(size)])
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * size + b] = rank
        self.keys = np.array(sorted(pairs) or [-9], np.int64)
        self.merged = np.array([pairs.get(k, -1) for k in self.keys.tolist()], np.int64)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.parts = PartCoder(self.whole)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair merges to, or -1; the id of a symbol that is gone is -1."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], -1)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token. All of them share one queue: a rank is taken once for the positions of all."""
        out: list[list[int]] = [[r] if (r := self.ranks.get(p)) is not None else [] for p in pieces]
        todo = [k for k, p in enumerate(pieces) if p and not out[k]]
        if not todo:
            return out
        data = np.frombuffer(b"".join([pieces[k] for k in todo]), np.uint8)
        n, ends = len(data), np.cumsum([len(pieces[k]) for k in todo])
        ids = np.append(self.single[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[np.append(ends - 1, n)] = n
        before[np.append(0, ends[:-1])] = n
        taken = np.zeros(n + 1, bool)
        queue = RankQueue(self.size)
        first = self._rank(*(x.ravel() for x in np.meshgrid(self.single, self.single, indexing="ij")))[data[:-1].astype(np.int64) * 256 + data[1:]]
        first[ends[:-1] - 1] = -1
        at = np.flatnonzero(first >= 0)
        queue.push(first[at], at)
        while queue.top:
            rank, at = queue.pop()
            at = at[self._rank(ids[at], ids[after[at]]) == rank]  # the others are stale
            right = after[at]
            taken[at] = True
            if taken[right].any():  # pairs that share a symbol: from the left, each symbol once
                keep, gone = [], -1
                for k, (i, j) in enumerate(zip(at.tolist(), right.tolist(), strict=True)):
                    if i != gone:
                        keep.append(k)
                        gone = j
                taken[at] = False
                at, right = at[keep], right[keep]
            else:
                taken[at] = False
            if not len(at):
                continue
            ids[at], ids[right] = rank, -1
            after[at] = beyond = after[right]
            before[beyond] = at
            at = np.concatenate([at, before[at]])
            new = self._rank(ids[at], ids[after[at]])
            queue.push(new[new >= 0], at[new >= 0])
        left = ids[:n] >= 0
        flat, counts = ids[:n][left].tolist(), np.append(0, np.cumsum(left))[ends].tolist()
        for k, i, j in zip(todo, [0, *counts], counts, strict=False):
            out[k] = flat[i:j]
        return out

    def whole(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, which is cut into pre-tokens by the pattern."""
        pieces = [self.pattern.findall(t) for t in texts]
        order = list(dict.fromkeys(chain.from_iterable(pieces)))
        ids = dict(zip(order, self.merge([p.encode() for p in order]), strict=True))
        return [ids[x[0]] if len(x) == 1 else [i for p in x for i in ids[p]] for x in pieces]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of the rows one after another, where each row's begin and the last ends) of runs of texts."""
        for first, buf, offsets in chunks(texts):
            yield first, *self.parts.chunk(buf, offsets)

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> tuple[bytes, list[int]]:
        """The bytes of ids, and where those of each row begin and the last ends."""
        return spell(self.bytes, ids, cut)


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """Of a rank file with lines of base64 bytes and rank; the file lies at the same path on every machine."""
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


def _added(df: DataFrame, name: str, kind: T.DataType, make) -> DataFrame:
    """df with one more column, which takes the place of one of that name."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [i for i, n in enumerate(b.schema.names) if n != name]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [make(b)], [b.schema.names[i] for i in keep] + [name])

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of each text."""

    def make(b: pa.RecordBatch) -> pa.Array:
        found = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x.astype(np.int32))) for _, x, cut in codec(path, pattern).encode(b.column(text))]
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))

    return _added(df, ids, T.ArrayType(T.IntegerType()), make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes of each list of ids; null is null."""

    def make(b: pa.RecordBatch) -> pa.Array:
        x = b.column(ids)
        cut = np.append(0, np.cumsum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        data, ends = codec(path, pattern).decode(x.flatten().to_numpy(zero_copy_only=False), cut)
        return pa.array([None if null else data[i:j] for null, i, j in zip(x.is_null().to_pylist(), ends, ends[1:], strict=False)], pa.binary())

    return _added(df, decoded, T.BinaryType(), make)


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each text, decodes its ids and returns key, n_tokens, ids_sha256 and decoded_sha256 in one pass."""
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def digest(data: bytes, ends: list[int], skip: int) -> pa.Array:
        view = memoryview(data)  # a decimal begins with a space; the first of a row is left out
        return pa.array([hashlib.sha256(view[min(i + skip, j) : j]).hexdigest() for i, j in zip(ends, ends[1:], strict=False)], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for first, ids, cut in c.encode(b.column(1)):
                n = pa.array(np.diff(cut))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), n, digest(*spell(c.decimal, ids, cut), 1), digest(*c.decode(ids, cut), 0)], schema.names)

    ship(df.sparkSession)
    return df.select(key, text).mapInArrow(run, schema)
