"""PartEnum's rounds: what is looked at again, and how large buckets are dealt."""

import random

import pytest
from weftcrawl.llm import partenum
from weftcrawl.plans.runtime import Scratch

from .test_operators import components, prose


def dense(seed):
    """Groups of near copies on both sides of the threshold, and texts that share a passage."""
    rng = random.Random(seed)
    rows, passage = [], prose(rng, 60, 5000)
    for _ in range(3):
        base = prose(rng, 90, 5000).split()
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 16)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    rows += [f"{prose(rng, 25, 5000)} {passage}" for _ in range(25)]
    return [(500 - i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("small", [{"BLOCK": 3, "PIECE": 4, "PAIRS": 1}, {"PAIRS": 0}, {"PAIRS": 0, "BLOCK": 5, "PIECE": 3, "HOT": 2, "HELD": 50, "SIGNED": 300, "ROUNDS": 2}])
def test_rounds(spark, monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(partenum, name, value)
    rows, s = dense(11), partenum.Similarity(70, 100, 2)
    got = partenum.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), s, Scratch(spark, "t5")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows, s)


def test_each_pair_of_a_bucket_is_looked_at_once(spark, monkeypatch):
    """A bucket whose pairs were all compared is not dealt again, nor is a pair with the bucket's least node."""
    seen, lookup = [], partenum._lookup
    monkeypatch.setattr(partenum, "_lookup", lambda df, *a: seen.append(df.select("cell", "sid").collect()) or lookup(df, *a))
    rows, s = dense(11), partenum.Similarity(70, 100, 2)
    scratch = Scratch(spark, "t5")
    dealt = []
    drop = scratch.drop
    scratch.drop = lambda *tables: dealt.extend(spark.read.parquet(scratch.path("buckets")).collect() if "buckets" in tables else []) or drop(*tables)
    partenum.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), s, scratch).count()
    size, least = {}, {}
    for r in dealt:
        size[r["sig"]], least[r["sig"]] = size.get(r["sig"], 0) + 1, r["least"]
    first = {}
    for cell, sid in seen[0]:
        first.setdefault(cell, set()).add(sid)
    assert all(size[cell] > 2 and least[cell] not in sids for cell, sids in first.items())
    assert sum(map(len, seen)) < 1.5 * len(seen[0])


def test_rows_of_a_large_bucket_follow_its_size(spark, monkeypatch):
    """One large component and a few nodes beside it: no row for each block of the bucket; all pairs across components meet once."""
    monkeypatch.setattr(partenum, "BLOCK", 10)
    monkeypatch.setattr(partenum, "PIECE", 150)
    rows = [(1, i, 0 if i < 400 else i, 403) for i in range(403)] + [(2, i, i // 3, 60) for i in range(60)] + [(3, i, i, 5) for i in range(5)]
    cells = partenum._cells(spark.createDataFrame(rows, "sig long, sid long, c long, size long"), 403).collect()
    assert sum(r["sig"] == 1 for r in cells) <= 400 + 3 * 4
    met, of = {}, {}
    for r in cells:
        of.setdefault((r["sig"], r["cell"]), []).append(r)
    for (sig, _), own in of.items():
        for i, a in enumerate(own):
            for b in own[:i]:
                if a["c"] != b["c"] and (a["within"] or a["block"] != b["block"]):
                    pair = sig, min(a["sid"], b["sid"]), max(a["sid"], b["sid"])
                    met[pair] = met.get(pair, 0) + 1
    want = {(sig, i, j) for sig, i, c, _ in rows for other, j, k, _ in rows if sig == other and i < j and c != k}
    assert met == dict.fromkeys(want, 1)


def looked(spark, monkeypatch, buckets, odd, pairs):
    """(pairs, nearest) of buckets of nodes that are components of their own; odd: the parities of each node's set."""
    monkeypatch.setattr(partenum, "PAIRS", pairs)
    rows = [(sig, sig, 0, True, sid, sid, 100, *odd[sid]) for sig, sids in buckets.items() for sid in sids]
    df = spark.createDataFrame(rows, f"sig long, cell long, block int, within boolean, sid long, c long, n long, {', '.join(o + ' long' for o in partenum.ODD)}")
    out = partenum._lookup(df.coalesce(1), partenum.Similarity(80, 100, 5), False).collect()
    return [(r["u"], r["v"]) for r in out if r["sig"] is None], {(r["sig"], r["u"]) for r in out if r["sig"] is not None}


def test_a_pair_of_many_buckets_counts_once(spark, monkeypatch):
    """Twelve near copies that no bucket joined, 5.5 pairs for each row of a bucket, and 80 other nodes: nothing is looked at again."""
    odd = {i: [0] * 8 if i < 12 else [-1 if k == i % 8 else 0 for k in range(8)] for i in range(92)}
    buckets = {sig: range(12) for sig in range(40)} | {100 + i: [i, i + 1] for i in range(12, 91)}
    found, again = looked(spark, monkeypatch, buckets, odd, 4)
    assert not again and sorted(found) == [(i, j) for i in range(12) for j in range(i + 1, 12)]


def test_pairs_of_a_large_group_follow_its_rows(spark, monkeypatch):
    """Near copies in large numbers give each row's nearest, not all pairs."""
    found, again = looked(spark, monkeypatch, {1: range(100), 2: range(100)}, {i: [0] * 8 for i in range(100)}, 4)
    assert not found and len(again) == 200


@pytest.mark.parametrize("pairs", [0, 1, 2])
def test_only_rows_with_pairs_are_looked_at_again(spark, monkeypatch, pairs):
    """What is not found at once has both of its rows in the bucket that is looked at again; rows without pairs are not."""
    far = {i: [0] * 8 if i < 20 else [-1 if k == i - 20 else 0 for k in range(8)] for i in range(28)}
    buckets = {1: range(28), 2: range(10, 28), 3: [0, 1], 4: range(5, 25)}
    found, again = looked(spark, monkeypatch, buckets, far, pairs)
    assert again and not any(sid >= 20 for _, sid in again)
    for sig, sids in buckets.items():
        for i in sids:
            for j in sids:
                if i < j < 20:
                    assert (i, j) in found or {(sig, i), (sig, j)} <= again
