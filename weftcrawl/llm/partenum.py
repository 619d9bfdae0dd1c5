"""N-gram Jaccard join with PartEnum signatures (operator 5).

A document's set are the hashes of its different word n-grams (64 bits; of the whole sequence where words are fewer). Sets of
near sizes form bands: the sizes from l to l / similarity. Two similar sets, the larger one in a band, differ in at most k
elements, k following from the band. The domain is cut into n1 first-level partitions, so that in one of them the sets differ in
at most k2 elements, and each of these into n2 second-level partitions; for each subset of n2 - k2 of those, the elements in it
make one signature. Similar sets share a signature. n1, n2 and k2 >= 1 are the cheapest of which a signature covers LEAST
elements on average.

A signature without elements would be shared by all sets that have none in its cells, however unlike they are, so it is not
made. That loses nothing: n1 is larger than the pigeonhole needs, and if a set's partitions with such a signature are no more
than what is to spare, one of the others is good for each similar set. A set that has more of them (one in a hundred) is also
cut by the next of SEEDS hashes; two similar sets that both have are found there. Only by the last hash are all made.

Equal sets are one node, and nodes that share a signature are a bucket. In a bucket each node is paired with the least one and
compared, which brings groups of near copies together. Then, within buckets that hold several
components, all pairs across components are looked at where they lie, by the parities of their sets over BITS cells: each
element that only one set has flips one parity, so sets that differ in more parities than similar ones differ in elements are
not similar. Near copies share many buckets, so a task counts each pair once, whatever the number of its buckets that have it.
Where these are no more than its nodes, all are compared, and its buckets are done; else, in those with many, each node's nearest, and the nodes that have one are looked at again, the last time for all pairs. In buckets of more than BLOCK nodes those outside the largest component are cut
into blocks, and each two blocks, and each block and piece of that component, are looked at by a task of their own. So a pair becomes a row only if its parities allow,
and in dense groups only while it joins components. Each pair that is left is compared exactly.

Null and empty texts and those without words have no set and are linked with nothing. Very long texts are whole; they need about
60 bytes of memory for each of theirs. Equal texts and texts with equal sets are linked at every similarity. A key that occurs
more than once names several documents, and links none of them; each has the least key of its component. A row without a key
links nothing; its component_id is that of a row with an equal set, or null. An empty table gives no rows. Of other columns none
is read, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, exp
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import Scratch, ship
from .common import chunks, mix, ngrams, words
from .components import contracted

LEAST, SEEDS, BITS = 5, 4, 512
#: Columns of the parities.
ODD = [f"o{i}" for i in range(BITS // 64)]
#: Sets over MANY elements have their parities over WIDE cells too, for pairs that are left.
MANY, WIDE = 1000, 4096
#: Signatures that a task holds before it deals them out; those that occur more than HOT times among them go to several tasks.
HELD, HOT = 1 << 19, 1000
#: Signatures and bucket rows of a task; nodes of a bucket that are looked at together, and those of its largest component beside them.
SIGNED, ROWS, BLOCK, PIECE = 1 << 20, 1 << 17, 4096, 1 << 16
#: Pairs for each row of a cell that are compared at once where a task has more different pairs than nodes.
PAIRS = 4
#: Candidates up to this number are sent to the executors to pick their texts; more are joined. Equal sets that a task remembers.
SENT, SEEN = 500_000, 200_000
#: Rounds of nearest pairs, at most.
ROUNDS = 4


class Similarity(NamedTuple):
    """At least num / den, on n-grams of n words."""

    num: int
    den: int
    n: int


def sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of each row's set, sorted by both."""
    w = words(buf, offsets)
    h = w.hashes()
    g, row = ngrams(h, w.row, n)
    parts = [(g, row)]
    size = np.bincount(w.row, minlength=len(offsets) - 1)
    for k in range(1, n):
        if (size == k).any():
            few = size[w.row] == k
            parts.append(ngrams(h[few], w.row[few], k))
    if len(parts) > 1:
        g, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return row[new], g[new]


def fingerprints(row: np.ndarray, g: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, fingerprint) of each row's set."""
    n = np.bincount(row, minlength=rows)
    acc = np.zeros(rows, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(acc, row, mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        return n, mix(acc + n.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)).astype(np.int64)


class Band(NamedTuple):
    most: int
    k: int
    n1: int
    n2: int
    k2: int


def _beyond(mean: float, most: int) -> float:
    """The probability that a Poisson variable is more than `most`."""
    p = total = exp(-mean)
    for i in range(1, most + 1):
        p *= mean / i
        total += p
    return max(0.0, 1 - total)


@lru_cache(8)
def bands(s: Similarity, upto: int) -> tuple[np.ndarray, tuple[Band, ...]]:
    """(the least size of each band, and one beyond the last; the bands) for sets of up to `upto` elements, and one band beyond theirs."""
    least, found = [1], []
    while len(found) < 2 or least[-2] <= upto:
        most = least[-1] * s.den // s.num
        k = 2 * most * (s.den - s.num) // (s.den + s.num)
        choices = []
        for k2 in (1, 2):
            for n2 in range(k2 + 2, k2 + 5):
                for spare in range(200):
                    n1 = k // (k2 + 1) + 1 + spare
                    covers = most * (n2 - k2) / (n1 * n2)
                    again = min(0.9, _beyond(n1 * min(1.0, comb(n2, k2) * exp(-covers)), spare))
                    choices.append((covers < LEAST, n1 * comb(n2, k2) / (1 - again) if covers >= LEAST else -covers, Band(most, k, n1, n2, k2)))
                    if again < 1e-3:
                        break
        found.append(min(choices)[2])
        least.append(most + 1)
    return np.array(least), tuple(found)


def signatures(row: np.ndarray, g: np.ndarray, n: np.ndarray, s: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature): of each set for its own band, where it may be the larger one, and for the next."""
    least, params = bands(s, 1 << int(n.max(initial=1)).bit_length())
    own = np.searchsorted(least, n, "right") - 1
    rows_out, sigs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    value = mix(g)
    for up in (0, 1):
        band = own + up
        most, k, n1, n2, k2 = np.array(params)[band].T
        partner = np.minimum(most, n * s.den // s.num)
        bad = (n + partner) * (s.den - s.num) // (s.den + s.num) // (k2 + 1)
        todo = (n > 0) & (k > 0) & (partner >= least[band])
        for seed in range(SEEDS):
            cells = np.where(todo, n1 * n2, 0)
            if not cells.any():
                break
            base = np.cumsum(cells) - cells
            used = todo[row]
            r = row[used]
            spread = mix(g[used] ^ mix(np.array([0x1F83D9AB + seed], np.uint64))) >> np.uint64(32)
            cell = base[r] + ((spread * cells[r].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            acc = np.zeros(int(cells.sum()), np.uint64)
            count = np.bincount(cell, minlength=len(acc))
            thin = np.zeros(len(n), np.int64)
            with np.errstate(over="ignore"):
                np.add.at(acc, cell, value[used])
                for a, b in sorted(set(zip(n2[todo].tolist(), k2[todo].tolist(), strict=True))):
                    mine = np.flatnonzero(todo & (n2 == a) & (k2 == b))
                    firsts = n1[mine]
                    place = np.arange(int(firsts.sum())) - np.repeat(np.cumsum(firsts) - firsts, firsts)
                    owner = np.repeat(mine, firsts)
                    at = base[owner] + a * place
                    part = mix(band[owner].astype(np.uint64) * np.uint64(SEEDS) + np.uint64(seed)) + place.astype(np.uint64) * np.uint64(64)
                    lacks = np.zeros(len(at), bool)
                    for c, subset in enumerate(combinations(range(a), a - b)):
                        total, size = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
                        for j in subset:
                            total += acc[at + j]
                            size += count[at + j]
                        lacks |= size == 0
                        made = (size > 0) | (seed == SEEDS - 1)
                        sigs.append(mix(total ^ mix(part + np.uint64(c)))[made])
                        rows_out.append(owner[made])
                    thin += np.bincount(owner[lacks], minlength=len(n))
            todo &= thin >= n1 - bad
    return np.concatenate(rows_out), np.concatenate(sigs).astype(np.int64)


def _expected(n: np.ndarray, s: Similarity) -> np.ndarray:
    """The number of signatures of sets of these sizes, about."""
    least, params = bands(s, 1 << int(n.max(initial=1)).bit_length())
    each = np.array([b.n1 * comb(b.n2, b.k2) if b.k else 0 for b in params])
    own = np.searchsorted(least, n, "right") - 1
    return np.where(n > 0, each[own] + each[own + 1], 0)


def parities(row: np.ndarray, g: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """(rows, bits // 64) of int64: the parity of the number of elements in each cell."""
    cell = (mix(g ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(row * bits + cell, minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)
    return np.packbits(odd, axis=1).view(np.int64)


def _lists(x: np.ndarray, at: np.ndarray, rows: int) -> pa.ListArray:
    """The rows of x as the lists at these places of `rows`; the others are null."""
    have = np.zeros(rows, bool)
    have[at] = True
    cut = np.append(0, np.cumsum(have)).astype(np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(x.ravel()), mask=pa.array(~have))


def _documents(df: DataFrame, key: str, text: str, s: Similarity) -> DataFrame:
    """(key, n, sid, signs, o0 to o7, wide): size, fingerprint, signatures and parities of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, buf, offsets in chunks(b.column(1)):
                rows = len(offsets) - 1
                row, g = sets(buf, offsets, s.n)
                n, sid = fingerprints(row, g, rows)
                large = np.flatnonzero(n > MANY)
                of = np.isin(row, large)
                wide = _lists(parities(np.searchsorted(large, row[of]), g[of], len(large), WIDE), large, rows)
                odd = parities(row, g, rows, BITS).T.copy()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, rows), pa.array(n), pa.array(sid, mask=n == 0), pa.array(_expected(n, s)), *map(pa.array, odd), wide], ["key", "n", "sid", "signs", *ODD, "wide"])

    shape = f"key {df.schema[key].dataType.simpleString()}, n long, sid long, signs long, {', '.join(o + ' long' for o in ODD)}, wide array<long>"
    return df.select(F.col(key), F.col(text)).mapInArrow(run, shape)


def _dealt(df: DataFrame, text: str, s: Similarity, parts: int) -> DataFrame:
    """(part, sigs, sids): runs of signatures and of their sets' fingerprints, for `parts` tasks. A set comes again only after SEEN others."""

    often, most = HOT, HELD

    def deal(sig: np.ndarray, sid: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
        order = np.argsort(sig, kind="stable")
        sig, sid = sig[order], sid[order]
        at = np.append(np.flatnonzero(np.append(True, sig[1:] != sig[:-1])), len(sig))
        size = np.diff(at)
        part = ((sig >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        if (size > often).any():
            hot = np.repeat(size > often, size)
            one = at[:-1][size > often]
            home = part[one]
            part[hot] = mix(sig[hot] ^ mix(np.full(1, turn, np.uint64))) % np.uint64(parts)
            sig, sid, part = np.append(sig, sig[one]), np.append(sid, np.minimum.reduceat(sid, at[:-1])[size > often]), np.append(part, home)
            order = np.argsort(part, kind="stable")
            sig, sid, part = sig[order], sid[order], part[order]
        cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        places = pa.array(cut * 8, pa.int64())
        columns = [pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, places.buffers()[1], pa.py_buffer(x.tobytes())]) for x in (sig, sid)]
        for first in range(0, len(cut) - 1, 32):
            yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]][first : first + 32].astype(np.int32)), *(c.slice(first, 32).cast(pa.binary()) for c in columns)], ["part", "sigs", "sids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        turn = (task.partitionId() if task else 0) << 32
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for b in batches:
            for _, buf, offsets in chunks(b.column(0)):
                rows = len(offsets) - 1
                row, g = sets(buf, offsets, s.n)
                n, sid = fingerprints(row, g, rows)
                if len(seen) > SEEN:
                    seen.clear()
                fresh = np.zeros(rows, bool)
                for i in np.flatnonzero(n).tolist():
                    x = int(sid[i])
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                keep = fresh[row]
                owner, sig = signatures(row[keep], g[keep], np.where(fresh, n, 0), s)
                held.append((sig.view(np.uint64), sid[owner]))
                count += len(sig)
                if count >= most:
                    yield from deal(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), turn)
                    held, count, turn = [], 0, turn + 1
        if count:
            yield from deal(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), turn)
        pa.default_memory_pool().release_unused()

    return df.select(F.col(text)).mapInArrow(run, "part int, sigs binary, sids binary")


def _buckets(dealt: DataFrame, parts: int) -> DataFrame:
    """(sig, sid, least): the sets that share a signature, and the least of those that the task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, sids = [], []
        for b in batches:
            for x, y in zip(b.column(1), b.column(2), strict=True):
                sigs.append(np.frombuffer(x.as_buffer(), np.int64))
                sids.append(np.frombuffer(y.as_buffer(), np.int64))
        if not sigs:
            return
        sig, sid = np.concatenate(sigs), np.concatenate(sids)
        sigs.clear()
        sids.clear()
        order = np.argsort(sig, kind="stable")
        sig, sid = sig[order], sid[order]
        same = sig[1:] == sig[:-1]
        keep = np.append(False, same) | np.append(same, False)
        sig, sid = sig[keep], sid[keep]
        order = np.lexsort((sid, sig))
        sig, sid = sig[order], sid[order]
        keep = np.append(True, (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1]))[: len(sig)]
        sig, sid = sig[keep], sid[keep]
        at = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
        size = np.diff(np.append(at, len(sig)))
        least = np.repeat(sid[at], size)
        keep = np.repeat(size > 1, size)
        sig, sid, least = sig[keep], sid[keep], least[keep]
        for first in range(0, len(sig), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[first : first + 100_000]) for x in (sig, sid, least)], ["sig", "sid", "least"])

    return dealt.repartitionById(parts, "part").mapInArrow(run, "sig long, sid long, least long")


def _elements(df: DataFrame, text: str, s: Similarity) -> DataFrame:
    """(sid, want, g): the sets of texts, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, buf, offsets in chunks(b.column(1)):
                rows = len(offsets) - 1
                row, g = sets(buf, offsets, s.n)
                n, sid = fingerprints(row, g, rows)
                cut = np.append(0, np.cumsum(n))
                yield pa.RecordBatch.from_arrays([pa.array(sid), b.column(0).slice(first, rows), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(g.astype(np.int64)))], ["sid", "want", "g"])

    return df.select("want", text).mapInArrow(run, "sid long, want long, g array<long>")


def _flips(a: str, b: str) -> str:
    return " + ".join(f"bit_count({a}{o} ^ {b}{o})" for o in ODD)


def _near(m: str, n: str, flips: str, s: Similarity) -> str:
    """SQL: sets of m and n elements with so many different parities can be similar."""
    flips = f"({flips})"
    return f"({s.den} * least({m}, {n}) >= {s.num} * greatest({m}, {n}) AND {s.den + s.num} * {flips} <= {s.den - s.num} * ({m} + {n}))"


def _cells(bucket: DataFrame, most: int) -> DataFrame:
    """(sig, cell, block, within, sid, c): the rows of buckets (sig, sid, c, size), dealt to cells. most: the largest size.

    Two rows of a bucket and of different components share a cell; where their block is the same, they are to be compared where
    within. A bucket of up to BLOCK rows is one cell. Of a larger one only the rows outside its largest component are cut into
    blocks of BLOCK, which meet one another and each piece of that component, of up to PIECE rows, whose rows never meet.
    """
    small = bucket.filter(F.col("size") <= BLOCK).select("sig", F.col("sig").alias("cell"), F.lit(0).alias("block"), F.lit(True).alias("within"), "sid", "c")
    if most <= BLOCK:
        return small
    large = bucket.filter(F.col("size") > BLOCK).select("sig", "sid", "c")
    tops = large.groupBy("sig", "c").agg(F.count("*").alias("rows")).groupBy("sig").agg(F.max(F.struct("rows", "c")).alias("top"), F.sum("rows").alias("rows"))
    tops = tops.select("sig", F.col("top.c").alias("top"), F.ceil((F.col("rows") - F.col("top.rows")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("top.rows") / PIECE).cast("int").alias("pieces"))
    h, inside = F.xxhash64("sid", "sig"), F.col("c") == F.col("top")
    rows = large.join(tops, "sig").withColumn("block", F.when(inside, -1 - F.pmod(h, "pieces")).otherwise(F.pmod(h, "blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(inside, F.lit(0)).otherwise(-F.col("pieces")), F.col("blocks") - 1))).filter("block <> other")
    cell = F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other"))
    return small.unionByName(rows.select("sig", cell.alias("cell"), "block", (F.col("other") == -1).alias("within"), "sid", "c"))


def _lookup(df: DataFrame, s: Similarity, whole: bool) -> DataFrame:
    """(u, v, flips, sig): pairs of nodes of a cell, in different components, that their parities allow.

    Cells give all of their pairs if whole, or if the task's different pairs are no more than its nodes. Else those with more than
    PAIRS for each of their own rows give only some or none, and each row's nearest, with flips and the bucket's
    sig. These rows, as u, are all that have pairs in such a cell, and are to be looked at again.
    df: (sig, cell, block, within, sid, c, n, o0 to o7), all rows of a cell in one task.
    """
    each = PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, None) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        sig, cell, block, within, sid, c, n = (table[x].to_numpy() for x in ("sig", "cell", "block", "within", "sid", "c", "n"))
        odd = np.stack([table[o].to_numpy() for o in ODD], 1).view(np.uint64)
        ids, node, back = np.unique(sid, return_index=True, return_inverse=True)
        odd, size = odd[node], n[node]
        order = np.lexsort((c, cell))
        sig, cell, block, within, sid, c, node = (x[order] for x in (sig, cell, block, within, sid, c, back))
        new = np.append(True, cell[1:] != cell[:-1])
        at, run_of = np.cumsum(new) - 1, np.cumsum(new | np.append(True, c[1:] != c[:-1])) - 1
        rows_of, sig = np.bincount(at), sig[new]
        # the rows of a cell's largest component come last: no pair begins with one
        most, top = np.zeros(len(sig), np.int64), np.full(len(sig), len(c))
        alike = np.bincount(run_of)[run_of]
        np.maximum.at(most, at, alike)
        np.minimum.at(top, at, np.where(alike == most[at], run_of, len(c)))
        last = run_of == top[at]
        order = np.lexsort((mix((sid ^ cell).view(np.uint64)), last, at))
        at, block, within, c, node, last = (x[order] for x in (at, block, within, c, node, last))
        pairs_of, far = np.zeros(len(sig), np.int64), 1 << 40
        nearest, partner = np.full(len(c), far), np.zeros(len(c), np.int64)
        found, held = [], 0
        # once the task has too many pairs, those of cells over the limit are left to the next look; not those in sure, which other cells may rely on
        sure, tight, over = np.zeros(0, np.int64), False, np.zeros(len(sig), bool)
        alive, d = np.flatnonzero(~last), 0

        def different() -> np.ndarray:
            return np.unique(np.concatenate([sure, *(x for x, _ in found)]))

        def pairs(x: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(x), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(ids[x // len(ids)]), pa.array(ids[x % len(ids)]), none, none], names)

        names = ["u", "v", "flips", "sig"]
        while True:
            d += 1
            alive = alive[alive < len(c) - d]
            alive = alive[at[alive] == at[alive + d]]
            if not len(alive):
                break
            for first in range(0, len(alive), 1 << 17):
                x = alive[first : first + (1 << 17)]
                x = x[(c[x] != c[x + d]) & (within[x] | (block[x] != block[x + d]))]
                m, k = size[node[x]], size[node[x + d]]
                x = x[s.den * np.minimum(m, k) >= s.num * np.maximum(m, k)]
                i, j = node[x], node[x + d]
                flips = np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64)
                ok = (s.den + s.num) * flips <= (s.den - s.num) * (size[i] + size[j])
                x, i, j, flips = x[ok], i[ok], j[ok], flips[ok]
                if not len(x):
                    continue
                pair = np.minimum(i, j) * len(ids) + np.maximum(i, j)
                found.append((pair, at[x]))
                held += len(pair)
                if whole:
                    if held > 1 << 20:
                        yield pairs(different())
                        found, held = [], 0
                    continue
                np.add.at(pairs_of, at[x], 1)
                for one, other in ((x, j), (x + d, i)):
                    closer = flips < nearest[one]
                    nearest[one[closer]], partner[one[closer]] = flips[closer], other[closer]
                if held > 2 * each * len(c) + (1 << 16):
                    if not tight and len(now := different()) <= len(ids):
                        sure, found, held = now, [], 0
                        continue
                    tight, over = True, pairs_of > each * rows_of
                    found = [(x[~over[y]], y[~over[y]]) for x, y in found]
                    held = sum(len(x) for x, _ in found)
        if not whole and (tight or len(different()) > len(ids)):
            over = pairs_of > each * rows_of
            found = [(x[~over[y]], y[~over[y]]) for x, y in found]
        yield pairs(different())
        have = np.flatnonzero(over[at] & (nearest < far))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[node[have]], ids[partner[have]], nearest[have], sig[at[have]])], names)

    return df.mapInArrow(run, "u long, v long, flips long, sig long")


class _Join:
    """The links between nodes that are found so far, as known: (u, v), each node but the least of its component, and that."""

    def __init__(self, docs: DataFrame, texts: DataFrame, s: Similarity, scratch: Scratch):
        self.docs, self.texts, self.s, self.scratch = docs, texts, s, scratch
        self.known: DataFrame | None = None
        self.step, self.last = 0, ""

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.keep(df, f"{name}-{self.step}", self.files)

    def run(self, bucket: DataFrame, first: DataFrame) -> DataFrame | None:
        """known, of all links between the nodes of buckets (sig, sid, least)."""
        self.files = self.scratch.files(bucket.count())
        nodes = self.docs.join(bucket.select("sid").distinct(), "sid", "left_semi").join(first, ["sid", "key"], "left_semi")
        self.nodes = self.scratch.keep(nodes.dropDuplicates(["sid"]).select("sid", "key", "n", *ODD, "wide"), "nodes", self.files)
        # at most a pair for each row of a bucket: the least node of a group of near copies brings most of them together
        self.compare(bucket.filter("sid <> least").select(F.least("sid", "least").alias("u"), F.greatest("sid", "least").alias("v")).distinct())
        last, whole = ["buckets"], False
        while True:
            self.step += 1
            bucket = self.keep(self._open(bucket), "open")
            self.scratch.drop(*last)
            found = self.keep(self._pairs(bucket, whole), "found")
            last = [f"open-{self.step}", f"found-{self.step}"]
            nearest = found.filter("sig IS NOT NULL").groupBy("u").agg(F.min(F.struct("flips", "v")).alias("best")).select("u", F.col("best.v").alias("v"))
            pairs = found.filter("sig IS NULL").select("u", "v").unionByName(nearest)
            new = self.compare(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
            more = found.filter("sig IS NOT NULL")
            if more.isEmpty():
                self.scratch.drop(*last, "nodes")
                return self.known
            whole = not new or self.step >= ROUNDS
            # the other rows have had all of their pairs compared
            bucket = more.select("sig", F.col("u").alias("sid")).distinct().withColumn("least", F.lit(None).cast("long"))

    def _open(self, bucket: DataFrame) -> DataFrame:
        """(sig, sid, c, size): the rows of buckets that hold several components c, and the bucket's size.

        Without the least node, which all others were compared with, but where several tasks had parts of a bucket."""
        now = bucket.withColumn("c", F.col("sid"))
        if self.known is not None:
            now = bucket.join(self.known.select(F.col("u").alias("sid"), F.col("v").alias("root")), "sid", "left").select("sig", "sid", "least", F.coalesce("root", "sid").alias("c"))
        rest = F.when(F.col("sid") != F.col("least"), F.col("c"))
        ends = now.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), F.min(rest).alias("lo_rest"), F.max(rest).alias("hi_rest"), (F.min("least") == F.max("least")).alias("one"))
        ends = ends.withColumn("one", F.coalesce("one", F.lit(False))).filter("CASE WHEN one THEN lo_rest < hi_rest ELSE lo < hi END")
        return now.join(ends.select("sig", "size", "one"), "sig").filter("NOT one OR sid <> least").select("sig", "sid", "c", "size")

    def _pairs(self, bucket: DataFrame, whole: bool) -> DataFrame:
        rows, most = bucket.agg(F.count("*"), F.max("size")).first()
        tasks = max(1, -(-rows // ROWS))
        return _lookup(_cells(bucket, most or 0).join(self.nodes.select("sid", "n", *ODD), "sid").repartition(tasks, "cell"), self.s, whole)

    def compare(self, pairs: DataFrame) -> int:
        """Adds the links among the pairs (u, v) to what is known; their number."""
        side = self.nodes.select("sid", "n", *ODD, "wide")
        a = side.select(F.col("sid").alias("u"), F.struct("n", *ODD, "wide").alias("a"))
        b = side.select(F.col("sid").alias("v"), F.struct("n", *ODD, "wide").alias("b"))
        wide = "aggregate(zip_with(a.wide, b.wide, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
        pairs = pairs.join(a, "u").join(b, "v").filter(_near("a.n", "b.n", _flips("a.", "b."), self.s))
        pairs = self.keep(pairs.filter(f"a.wide IS NULL OR b.wide IS NULL OR {_near('a.n', 'b.n', wide, self.s)}").select("u", "v"), "pairs")
        ends = self.keep(pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct().join(self.nodes.select("sid", "key"), "sid"), "ends")
        count = ends.count()
        links = 0
        if count:
            want = ends.select("key", F.col("sid").alias("want"))
            some = self.texts.join(F.broadcast(want) if count <= SENT else want, "key")
            elements = self.keep(_elements(some, "text", self.s).filter("sid = want").dropDuplicates(["sid"]).drop("want"), "elements")
            u, v = elements.select(F.col("sid").alias("u"), F.col("g").alias("gu")), elements.select(F.col("sid").alias("v"), F.col("g").alias("gv"))
            both = pairs.join(u, "u").join(v, "v").select("u", "v", (F.size("gu") + F.size("gv")).alias("sum"), F.size(F.array_intersect("gu", "gv")).alias("both"))
            found = self.keep(both.filter(f"{self.s.den} * both >= {self.s.num} * (sum - both)").select("u", "v"), "links")
            links = found.count()
            if links:
                self.known = contracted(found, self.known, self.scratch, f"known-{self.step}", links)
                if self.last:
                    self.scratch.drop(self.last)
                self.last = f"known-{self.step}"
            self.scratch.drop(f"elements-{self.step}", f"links-{self.step}")
        self.scratch.drop(f"pairs-{self.step}", f"ends-{self.step}")
        return links


def linked(df: DataFrame, s: Similarity, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of each row."""
    ship(df.sparkSession)
    docs = scratch.keep(_documents(df, key, text, s), "documents")
    parts = max(1, -(-(docs.agg(F.sum("signs")).first()[0] or 0) // SIGNED))
    bucket = scratch.keep(_buckets(_dealt(df, text, s, parts), parts), "buckets")
    scratch.spent()
    first = docs.filter("n > 0").groupBy("sid").agg(F.min("key").alias("key"))
    known = None if bucket.isEmpty() else _Join(docs, df.select(F.col(key).alias("key"), F.col(text).alias("text")), s, scratch).run(bucket, first)
    if known is None:
        named = first.withColumnRenamed("key", "component_id")
    else:
        rooted = first.join(known.withColumnRenamed("u", "sid"), "sid", "left").select("sid", F.coalesce("v", "sid").alias("root"), "key")
        rooted = scratch.keep(rooted, "rooted", scratch.files(docs.count()))
        named = rooted.join(rooted.groupBy("root").agg(F.min("key").alias("component_id")), "root").select("sid", "component_id")
    out = docs.select("key", "n", "sid").join(named, "sid", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def one_of_each(df: DataFrame, s: Similarity, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one document of each component, that with the smallest key. Rows without a key stay."""
    groups = linked(df, s, scratch, key, text)
    gone = scratch.keep(groups.filter(F.col(key) != F.col("component_id")).select(key).distinct(), "gone", scratch.files(scratch.spark.read.parquet(scratch.path("documents")).count()))
    scratch.drop("documents", "rooted")
    return df.join(F.broadcast(gone) if gone.count() <= SENT else gone, key, "left_anti").select(*df.columns)
