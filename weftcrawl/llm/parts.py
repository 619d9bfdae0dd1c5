"""Encoding texts part by part, where byte-level BPE patterns always cut.

In a text without two white-space characters in a row, a newline is a pre-token of its own and a single space starts one.
Such a text is the sequence of its parts: newlines, and words with the space before them. Parts are found and told apart by a
64-bit hash in numpy; each different part is encoded once and its ids are remembered, a few dozen bytes for each. Other
texts, and parts over LONG bytes, are encoded whole and anew. Two of the at most PARTS parts that a worker remembers have
the same hash with a probability under 1e-6.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from .common import SPACE, Words, mix

#: Arrow rows that are taken at once, parts and ids that a worker remembers, bytes of a part that is remembered.
SLICE, PARTS, IDS, LONG = 1500, 1_000_000, 6_000_000, 64


def _plain(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has no two white-space characters in a row; those beyond ASCII count as such at once."""
    space = SPACE[buf]
    bad = np.zeros(len(buf), bool)
    bad[1:] = space[1:] & space[:-1]
    a, b, c = buf[:-2], buf[1:-1], buf[2:]
    # U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000
    high = np.flatnonzero(a >= 0xC2)
    a, b, c = a[high], b[high], c[high]
    odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    odd |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    bad[high[odd]] = True
    if len(buf) >= 2 and buf[-2] == 0xC2 and buf[-1] in (0x85, 0xA0):
        bad[-2] = True
    first = offsets[:-1][offsets[:-1] < len(buf)]
    bad[first] &= ~space[first]  # white space there follows what another row ends with
    sums = np.append(0, np.cumsum(bad))
    return sums[offsets[1:]] == sums[offsets[:-1]]


class PartCoder:
    """encode: the ids of each of some texts."""

    def __init__(self, encode: Callable[[list[str]], list]):
        self.encode = encode
        self.forget()
        self.count = 0

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids = self.encode(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        start = len(self.flat) + np.cumsum(size) - size
        # keys are sorted and new: one merge of two sorted runs
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.size = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.size, at, size)
        self.flat = np.concatenate([self.flat, flat])

    def chunk(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the rows one after another, where each row's begin and the last ends)."""
        rows = len(offsets) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        if len(self.keys) > PARTS or len(self.flat) > IDS:
            self.forget()
        line = buf == 0x0A
        first = line | (buf == 0x20)
        first[1:] |= line[:-1]
        plain = _plain(buf, offsets)
        if not plain.all():
            first &= np.repeat(plain, np.diff(offsets))
        first[offsets[:-1][offsets[:-1] < len(buf)]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(buf))
        row = np.searchsorted(offsets, start, "right") - 1
        key = Words(buf, row, start, end).hashes()
        long = np.flatnonzero((end - start > LONG) | ~plain[row])
        key[long] = mix(np.arange(self.count, self.count + len(long)).astype(np.uint64) + np.uint64(1 << 63))
        self.count += len(long)
        different, place, inverse = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, different), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != different) if len(self.keys) else np.arange(len(different))
        if len(new):
            data = buf.tobytes()
            p = place[new]
            self._learn(different[new], [data[i:j].decode() for i, j in zip(start[p].tolist(), end[p].tolist(), strict=True)])
            at = np.searchsorted(self.keys, different)
        at = at[inverse]
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1])]
        cut = np.append(0, np.cumsum(np.bincount(row, weights=size, minlength=rows).astype(np.int64)))
        return ids, cut


def ragged(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, start and size of each value), for spell()."""
    size = np.array([len(x) for x in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(size) - size, size


def spell(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, cut: np.ndarray) -> tuple[bytes, list[int]]:
    """The values of ids one after another, and where those of each row of ids begin and the last ends."""
    flat, start, size = table
    n = size[ids]
    ends = np.append(0, np.cumsum(n))
    return flat[np.repeat(start[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes(), ends[cut].tolist()
