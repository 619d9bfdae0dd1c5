"""The other operators against brute-force versions, on odd rows: nulls, empty and very long texts, ties, repeats, clashes."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from weftcrawl.llm import byte_cnn, decontaminate, partenum, quality, secrets, suffix_tree, toxicity, warc
from weftcrawl.llm import components as component_steps
from weftcrawl.llm.common import word_key
from weftcrawl.plans.runtime import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def prose(rng, n, kinds=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % kinds}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Columns named like those the operators make."""
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "one", "One", "two words", "Über straße 漢字", "x" * 3000, prose(rng, 4000)]
    base = [prose(rng, rng.randint(20, 120)) for _ in range(40)]
    texts += base + base[:5] + [b.upper() for b in base[:3]]
    for b in base[:20]:
        for _ in range(3):
            w = b.split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = "edit"
            texts.append("  ".join(w))
    rows = [(i if i != 1 else None, t, "en" if i % 2 else None, "src", 7, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, grade string, sid int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def components(rows, s):
    sets = {}
    for k, t in rows:
        w = words((t or "").translate(LOWER))
        sets[k] = frozenset(tuple(w[i : i + s.n]) for i in range(max(1, len(w) - s.n + 1))) if w else frozenset()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and s.den * both >= s.num * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("s", [partenum.Similarity(85, 100, 4), partenum.Similarity(80, 100, 5), partenum.Similarity(50, 100, 2)])
def test_partenum(spark, docs, s):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    got = partenum.linked(docs, s, Scratch(spark, "t5")).collect()
    want = components(rows, s)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(0, None)]
    kept = partenum.one_of_each(docs, s, Scratch(spark, "t5"))
    assert kept.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted([-1, *{c for _, c in want.values()}])


@pytest.mark.parametrize("small", [{}, {"HOT": 2, "HELD": 50, "SIGNED": 300}, {"BLOCK": 3, "ROWS": 40}, {"ROUNDS": 1, "FEW": 0}])
def test_partenum_of_dense_groups(spark, monkeypatch, small):
    """Groups of near copies on both sides of the threshold, with hot signatures, buckets in blocks, and steps cut short."""
    for name, value in small.items():
        monkeypatch.setattr(component_steps if name == "FEW" else partenum, name, value)
    rng, s = random.Random(7), partenum.Similarity(70, 100, 2)
    rows, passage = [], prose(rng, 60, 5000)
    for _ in range(3):
        base = prose(rng, 90, 5000).split()
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 16)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    rows += [f"{prose(rng, 25, 5000)} {passage}" for _ in range(25)]
    rows = [(500 - i, t) for i, t in enumerate(rows)]
    got = partenum.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), s, Scratch(spark, "t5")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows, s)


def test_rows_with_equal_keys_are_documents_of_their_own(spark):
    a, b = prose(random.Random(1), 50), prose(random.Random(2), 50)
    rows = [(5, a), (5, b), (3, a), (9, b), (None, a), (None, "all alone here")]
    got = partenum.linked(spark.createDataFrame(rows, "n long, sid string"), partenum.Similarity(85, 100, 4), Scratch(spark, "t5"), "n", "sid").collect()
    assert sorted((r["n"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 3), (3, 3), (5, 3), (5, 5), (9, 5)]


def test_components_of_long_paths(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (103, 101)], "u long, v long")
    more = spark.createDataFrame([(40, 103), (200, 201)], "u long, v long")
    want = {i: 0 for i in [*range(1, 41), *range(100, 104)]} | {201: 200}
    for few in (0, 1000):
        monkeypatch.setattr(component_steps, "FEW", few)
        scratch = Scratch(spark, "cc")
        known = component_steps.contracted(edges, None, scratch, "a")
        assert {r["u"]: r["v"] for r in component_steps.contracted(more, known, scratch, "b").collect()} == want


def test_bands_enumerate_subsets():
    for s in (partenum.Similarity(85, 100, 4), partenum.Similarity(80, 100, 5)):
        assert all(b.n2 - b.k2 >= 2 and b.n1 * (b.k2 + 1) > b.k for b in partenum.bands(s, 20000)[1])


def test_unlike_sets_share_no_signature():
    """Sets with empty cells in common do not meet there."""
    rng, s = np.random.default_rng(5), partenum.Similarity(80, 100, 5)
    row = np.repeat(np.arange(2000), 320)
    g = rng.integers(0, 2**63, len(row)).astype(np.uint64)
    owner, sig = partenum.signatures(row, g, np.full(2000, 320), s)
    assert len(np.unique(sig)) == len(sig)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    s = partenum.Similarity(85, 100, 4)
    for _ in range(200):
        n = int(rng.integers(7, 300))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a[: n - int(rng.integers(0, max(1, n * 15 // 100) + 1))]
        if 100 * len(b) < 85 * n or len(b) == n:
            continue
        g = np.concatenate([np.sort(a), np.sort(b)])
        row = np.repeat([0, 1], [n, len(b)])
        owner, sig = partenum.signatures(row, g, np.array([n, len(b)]), s)
        assert set(sig[owner == 0]) & set(sig[owner == 1])


def signed_alone(a, s):
    """The signatures of a set that is alone in its chunk."""
    return set(partenum.signatures(np.zeros(len(a), np.int64), np.sort(a), np.array([len(a)]), s)[1].tolist())


@pytest.mark.parametrize("s", [partenum.Similarity(85, 100, 4), partenum.Similarity(80, 100, 5)])
def test_signatures_do_not_depend_on_the_chunk(s):
    """At each band's edge and each power of two, the smaller set of the band before meets the larger one, each signed in its own call."""
    rng = np.random.default_rng(3)
    edges = partenum.bands(s, 2000)[0].tolist()
    for small in sorted({x - 1 for x in edges if x > 7} | {(1 << k) - 1 for k in range(3, 12)} | {1 << k for k in range(3, 12)}):
        most = small * s.den // s.num
        for large in sorted({min(most, small + 1), *(x for x in edges if small < x <= most), most} - {small}):
            a = rng.integers(0, 2**63, large).astype(np.uint64)
            assert signed_alone(a, s) & signed_alone(a[:small], s), (small, large)


def test_signatures_alone_are_those_beside_a_larger_set():
    s, rng = partenum.Similarity(85, 100, 4), np.random.default_rng(4)
    other = rng.integers(0, 2**63, 5000).astype(np.uint64)
    for n in (1, 2, 6, 7, 8, 15, 31, 60, 63, 64, 127, 255, 500, 511, 1023):
        a = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        owner, sig = partenum.signatures(np.repeat([0, 1], [n, len(other)]), np.concatenate([a, np.sort(other)]), np.array([n, len(other)]), s)
        assert set(sig[owner == 0].tolist()) == signed_alone(a, s)


def test_partenum_empty(spark, empty):
    assert partenum.linked(empty, partenum.Similarity(85, 100, 4), Scratch(spark, "t5")).count() == 0


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(2)
    for _ in range(300):
        item = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 90)))
        assert decontaminate.myers(item, text)[0] == distance(item, text)


def leaks(item, text):
    """The least number of edits with which a needle is found, by each needle that its own limit lets through."""
    for needle, k in decontaminate.needles(item):
        if len(needle) < decontaminate.SHORT:
            if re.search(rf"(?<![^\W_]){re.escape(needle)}(?![^\W_])", text):
                yield len(needle), 0
        elif (d := distance(needle, text)) <= k:
            yield len(needle), d


def test_decontaminate(spark, docs, empty):
    rng = random.Random(4)
    items = [prose(rng, 30, 10**6) for _ in range(6)] + ["short", "", None, "the capital of france", prose(rng, 33, 10**6)[:200], prose(rng, 130, 10**6)[:700], prose(rng, 130, 10**6)[:700], "a b c d"]
    table = spark.createDataFrame([(i, t, i) for i, t in enumerate(items)], "item_id long, text string, n int")
    edited = items[1].replace("w", "v", 3)
    rows = [(1, f"before {items[0].upper()}\n after"), (2, f"x {edited} y"), (3, items[2][: len(items[2]) // 2]), (4, None), (5, ""), (6, prose(rng, 500)), (7, f"{items[3]} {items[4]}"), (7, items[3])]
    rows += [(8, "It is The  Capital of France."), (9, "the capital of franceville"), (10, f"half {items[10][:110]} of it"), (11, f"middle {items[11][250:450]} of it"), (12, items[12][:70]), (13, items[12].replace("w1", "x2", 12)), (14, "shorts and a short."), (15, "short " * 20_000)]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["matched_chars"], r["distance"]) for r in decontaminate.matches(found, table).collect())
    want = []
    for k, t in rows[:-1]:
        for i, item in enumerate(items):
            best = max(leaks(decontaminate.normal(item), decontaminate.normal(t)), key=lambda x: (x[0], -x[1]), default=None)
            if best:
                want.append((k, i, *best))
    assert {x[0] for x in want} >= {8, 10, 11, 13, 14} and not {x[0] for x in want} & {3, 4, 5, 6, 9, 12}
    assert got == sorted([*want, (15, 6, 5, 0)])
    assert {r["doc_id"] for r in decontaminate.clean(found, table).collect()} == {3, 4, 5, 6, 9, 12}
    assert decontaminate.matches(empty, table).count() == 0
    assert decontaminate.matches(docs, table.limit(0)).count() == 0
    assert decontaminate.clean(docs, table).columns == docs.columns
    assert decontaminate.clean(docs, table).count() == docs.count()


def test_short_items_of_scripts_without_spaces(spark):
    table = spark.createDataFrame([(1, "法国的首都")], "item_id long, text string")
    df = spark.createDataFrame([(1, "请问法国的首都是哪里"), (2, "法国")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.matches(df, table).collect()] == [1]


def test_warc(spark):
    pages = [(1, "http://a/", "<p>é</p>"), (2, "http://b/\n", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "v", "x" * 100_000), (5, "v", "x" * 100_000), (None, "w", "<p>é</p>"), (8, "z", "alone\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, sha1 string")
    scratch = Scratch(spark, "t7")
    manifest = warc.write(df, scratch.path("a"), scratch)
    got = sorted(map(tuple, warc.read_back(manifest).collect()), key=str)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        top = max((p[0] for p in pages if (p[2] or "") == (html or "") and p[0] is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "response" if top == i else "revisit", None if top == i else top))
    assert got == sorted(want, key=str)
    scratch = Scratch(spark, "t7")
    large = warc.read_back(warc.write(df, scratch.path("a"), scratch, least=50)).filter("record_type = 'revisit'").count()
    assert large == 0
    scratch = Scratch(spark, "t7")
    assert warc.read_back(warc.write(df.limit(0), scratch.path("a"), scratch)).count() == 0


def test_quality_counts(spark, docs, empty):
    def brute(t):
        w = words(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum((t or "").count(x) for x in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered)

    more = spark.createDataFrame([(900, "a b c a b c a b c"), (901, "a a a a"), (902, "l\nl\n\n l\nl x #|"), (903, "a b c")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(more)
    out = quality.cascade(df, quality.rules(), Scratch(spark, "t8"))
    for r in out.collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == brute(r["text"])
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r["base_failed"] and r["kept"])
    backwards = quality.counts(df, carry=["doc_id"]).select("doc_id", quality.first_rejection(quality.rules()[::-1]).isNull().alias("ok"))
    forwards = quality.counts(df, carry=["doc_id"]).select("doc_id", quality.first_rejection(quality.rules()).isNull().alias("ok"))
    assert sorted(map(str, backwards.collect())) == sorted(map(str, forwards.collect()))
    assert quality.cascade(empty, quality.rules(), Scratch(spark, "t8")).count() == 0


def test_quality_orders_by_rejections_per_cost(spark):
    rows = spark.createDataFrame([(i, "word " * (60 if i % 10 else 1)) for i in range(200)], "doc_id long, text string")
    from pyspark.sql import functions as F

    rules = [quality.Rule("never", F.col("n_words") < 0), quality.Rule("often", F.col("n_words") > 10)]
    assert [r.name for r in quality.ordered(quality.counts(rows, carry=["doc_id"]), rules, Scratch(spark, "t8"))] == ["often", "never"]
    clash = rows.selectExpr("doc_id", "text", "1 AS n_words", "2 AS on_words", "3 AS kept")
    out = quality.cascade(clash, rules, Scratch(spark, "t8"), carry=["n_words", "on_words", "kept", "text"])
    assert out.columns == ["doc_id", "on_words", *quality.COUNTS, "base_failed", "kept"]


def test_quality_order_against_all_orders():
    """The first rule is worth most, and each next one among what is left; equal ones stay in order."""
    verdicts = [([True, True, False], 50), ([False, True, False], 5), ([False, False, True], 20), ([False, False, False], 100)]
    assert quality.order(verdicts, [1.0, 1.5, 1.0]) == [0, 2, 1] and quality.order(verdicts, [1.0, 1.0, 1.0]) == [1, 2, 0]
    assert quality.order([([False, False], 9)], [1.0, 2.0]) == [0, 1]


def test_suffix_tree_base_and_sum(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    train = docs.filter("doc_id % 3 <> 0")
    kept = [t for k, t in rows if k is not None and k % 3]
    counts = Counter(w for t in kept for w in [*words((t or "").translate(LOWER)), None])
    total, kinds = sum(counts.values()), len(counts)
    for common in (5e-7, 0.01, 1.1):  # all, some and no counts are sent
        out = suffix_tree.score(docs, train, Scratch(spark, "t10"), common=common).collect()
        by = {r["doc_id"]: r for r in out}
        for k, t in rows:
            tokens = [*words((t or "").translate(LOWER)), None]
            r = by[k]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[x] > 0 for x in tokens), total)
            assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in tokens), rel_tol=1e-9)
            assert r["score"] < 0
    nothing = suffix_tree.score(docs, train.limit(0), Scratch(spark, "t10")).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in nothing)
    assert suffix_tree.score(docs.limit(0), train, Scratch(spark, "t10")).count() == 0


def test_suffix_tree_rebuilt_from_counts(spark, docs):
    """Counts, divergence test and smoothing as plain loops over all contexts."""
    depth, least, gain = 3, 5, 4.0
    model = suffix_tree.learn(docs, Scratch(spark, "t10"), depth=depth, gain=gain, least=least)
    counts = {d: Counter() for d in range(depth + 1)}
    for r in docs.collect():
        s = b"\n" * depth + b"".join(w.encode() + b" " for w in words((r["text"] or "").translate(LOWER))) + b"\n"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                counts[d][s[i - d : i], s[i]] += 1
    seen = sorted({x for _, x in counts[0]} | {10})
    nexts = {d: {} for d in counts}
    for d, c in counts.items():
        for (ctx, x), n in c.items():
            nexts[d].setdefault(ctx, {})[x] = n
    probability, keep = {}, {b""}
    for d in range(depth + 1):
        for ctx, n in nexts[d].items():
            total = sum(n.values())
            if d and total < least:
                continue
            up = probability[ctx[1:]] if d else {x: 1 / 256 for x in seen}
            back = len(n) / (total + len(n))
            probability[ctx] = {x: up[x] * back + n.get(x, 0) / (total + len(n)) for x in seen}
            if d and (d < suffix_tree.ROOT or sum(c * math.log(c / total / up[x]) for x, c in n.items()) >= gain):
                keep |= {ctx[len(ctx) - e :] for e in range(1, d + 1)}
    assert set(model.contexts) == keep and len(keep) > 30
    for i, ctx in enumerate(model.contexts):
        assert np.allclose([10.0 ** model.logp[i, model.classes[x]] for x in seen], [probability[ctx][x] for x in seen], rtol=1e-4)


def test_suffix_tree_limits_and_clashes(spark, docs):
    rows = docs.selectExpr("doc_id", "text", "1 AS score", "2 AS known", "3 AS rare", "4 AS n_tokens")
    few, all_of = (suffix_tree.score(rows, rows, Scratch(spark, "t10"), carry=["score", "known", "rare", "n_tokens"], depth=d, least=n, gain=g) for d, n, g in ((1, 16, 8.0), (7, 1, 0.0)))
    assert few.columns == ["doc_id", "known", "rare", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert all_of.agg({"score": "sum"}).first()[0] > 0.8 * few.agg({"score": "sum"}).first()[0]


def test_suffix_tree_against_walk(spark, docs):
    """Every distribution sums to one, and a text's score is that of a walk over its symbols with the longest suffix state."""
    model = suffix_tree.learn(docs, Scratch(spark, "t10"), depth=3, share=1e-3, gain=1.0)
    assert len(model.contexts) > 10
    full = np.take(10.0**model.logp, model.classes, axis=1)
    assert np.allclose(full.sum(axis=1), 1, atol=1e-3)
    state = {c: i for i, c in enumerate(model.contexts)}
    for t in (None, "", "One two w1 w2\tw3", "w1 " * 50):
        s = b"\n" * 3 + b"".join(w.encode() + b" " for w in words((t or "").translate(LOWER))) + b"\n"
        want = 0.0
        for i in range(3, len(s)):
            k = next(k for k in (3, 2, 1, 0) if s[i - k : i] in state)
            want += model.logp[state[s[i - k : i]], model.classes[s[i]]]
        data = np.frombuffer((t or "").encode(), np.uint8)
        got = model.score(*suffix_tree.symbols(suffix_tree.words(data, np.array([0, len(data)])), 1, 3), 1)[0]
        assert math.isclose(got, want, rel_tol=1e-5)


def test_suffix_tree_beats_chance_on_held_out(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(i, prose(rng, 300)) for i in range(60)], "doc_id long, text string")
    out = suffix_tree.score(rows, rows.filter("doc_id % 7 <> 2"), Scratch(spark, "t10")).filter("doc_id % 7 = 2").agg({"score": "sum", "n_tokens": "sum"}).first()
    assert out["sum(score)"] / out["sum(n_tokens)"] > -3.0


def test_suffix_tree_grows_with_the_corpus(spark):
    """A context of the fixed least count is a state however large the rest is, and contexts of more than five symbols are."""
    rng = random.Random(9)
    rare = [(0, "zxab yxac " * 30)]
    few, many = [rare + [(10 + i, prose(rng, 4000)) for i in range(k)] for k in (1, 700)]
    small, large = (suffix_tree.learn(spark.createDataFrame(x, "doc_id long, text string").repartition(4), Scratch(spark, "t10")).contexts for x in (few, many))
    assert b"zxa" in small and b"zxa" in large
    assert len(large) > 2 * len(small)
    assert max(map(len, large)) > 5


def test_suffix_tree_in_parts_is_the_whole_tree(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HOLD", 20_000)
    rng = random.Random(10)
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, prose(rng, 300)) for i in range(40)], "doc_id long, text string"))
    whole = suffix_tree.learn(more, Scratch(spark, "t10"))
    bounds, parts = suffix_tree.learn_parts(more, Scratch(spark, "t10"), part=200)
    assert len(parts) > 5
    held, want = suffix_tree._Held(bounds, parts), []
    for r in more.collect():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        w = suffix_tree.words(data, np.array([0, len(data)]))
        want.append(whole.score(*suffix_tree.symbols(w, 1, whole.depth), 1)[0])
        held.add(w, 1, None)
    assert np.allclose([x[0] for x, _ in held.scores()], want, rtol=1e-5)


def test_language(spark, docs):
    rng = random.Random(3)
    kinds = {"a": "the and of with that", "b": "der die und mit nicht", "c": "que los para con una"}
    rows = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(60)), k) for i in range(120) for k in kinds]
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    x, y = byte_cnn.sample(table, F.col("doc_id") % 4 != 0, "text", "lang", "doc_id")
    again = byte_cnn.sample(table.coalesce(1), F.col("doc_id") % 4 != 0, "text", "lang", "doc_id")
    assert (x == again[0]).all() and y == again[1]
    net = byte_cnn.fit(x, y)
    held = spark.createDataFrame([r for r in rows if not r[0] % 4], "doc_id long, text string, lang string")
    out = byte_cnn.predict(held, net, ["doc_id", "lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    odd = {r["doc_id"]: r for r in byte_cnn.predict(docs, net, ["doc_id", "grade"]).collect()}
    for r in docs.collect():
        got = odd[r["doc_id"]]
        assert (got["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or ""))
        assert 0 <= got["score"] <= 1
    digits = spark.createDataFrame([(1, "123 — …"), (2, "१२३")], "doc_id long, text string")
    assert {r["lang_pred"] for r in byte_cnn.predict(digits, net, ["doc_id"]).collect()} == {"und"}
    clash = held.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    assert byte_cnn.predict(clash, net, ["doc_id", "score", "lang_pred"]).schema.simpleString() == "struct<doc_id:bigint,lang_pred:string,score:double>"
    long = spark.createDataFrame([(1, "der die und mit nicht " * 100_000), (2, "der die und mit nicht ")], "doc_id long, text string")
    assert {r["lang_pred"] for r in byte_cnn.predict(long, net, ["doc_id"]).collect()} == {"b"}
    assert byte_cnn.predict(docs.limit(0), net, ["doc_id"]).count() == 0
    assert byte_cnn.fit(*byte_cnn.sample(docs.limit(0), F.lit(True), "text", "lang", "doc_id")) is None
    assert {r["lang_pred"] for r in byte_cnn.predict(docs, None, ["doc_id"]).collect()} == {"und"}


def test_windows_meet_every_place():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 191, 192, 193, 380, 1000]
    offsets = np.append(0, np.cumsum(sizes))
    buf = rng.integers(98, 120, offsets[-1]).astype(np.uint8)
    w, row = byte_cnn.windows(buf, offsets)
    wide = byte_cnn.OVERLAP + 1
    for k, size in enumerate(sizes):
        text = buf[offsets[k] : offsets[k + 1]].tobytes()
        seen = [x.tobytes()[i : i + wide] for x in w[row == k] for i in range(byte_cnn.WINDOW - wide + 1)]
        assert {text[i : i + wide] for i in range(size - wide + 1)} == {x for x in seen if 0 not in x}


def test_network_against_a_naive_one():
    """Convolution, pooling and softmax as loops; the gradient by differences."""
    rng = np.random.default_rng(2)
    wide = byte_cnn.WIDTHS
    p = [rng.standard_normal((256, byte_cnn.EMBED)) * 0.5, *(rng.standard_normal((k, byte_cnn.EMBED, byte_cnn.FILTERS)) * 0.3 for k in wide), rng.standard_normal(len(wide) * byte_cnn.FILTERS) * 0.1, rng.standard_normal((len(wide) * byte_cnn.FILTERS, 3)) * 0.3, rng.standard_normal(3)]
    w = rng.integers(97, 110, (5, 40)).astype(np.uint8)
    y, weight = np.array([0, 1, 2, 1, 0]), np.array([1.0, 2.0, 1.0, 0.5, 1.0])

    def probabilities(p, one):
        features = []
        for f in p[1:-3]:
            for j in range(byte_cnn.FILTERS):
                features.append(max(sum(p[0][one[i + k]] @ f[k][:, j] for k in range(len(f))) for i in range(len(one) - len(f) + 1)))
        z = np.exp(np.maximum(np.array(features) + p[-3], 0) @ p[-2] + p[-1])
        return z / z.sum()

    def loss(p):
        return sum(-v * np.log(probabilities(p, one)[k]) for one, k, v in zip(w, y, weight, strict=True)) / len(y)

    net = byte_cnn.Net(["a", "b", "c"], [np.stack([p[0] @ f[j] for j in range(len(f))]) for f in p[1:-3]], p[-3], p[-2], p[-1])
    assert np.allclose(net.predict(w.T), [probabilities(p, one) for one in w])
    g = byte_cnn._gradient(p, w.T, y, weight)
    for a, d in zip(p, g, strict=True):
        for at in [np.unravel_index(i, a.shape) for i in [*rng.integers(0, a.size, 3), int(np.abs(d).argmax())]]:
            old = a[at]
            a[at] = old + 1e-5
            up = loss(p)
            a[at] = old - 1e-5
            down = loss(p)
            a[at] = old
            assert math.isclose((up - down) / 2e-5, d[at], rel_tol=1e-3, abs_tol=1e-7)


def toxic_rows():
    rng = random.Random(5)
    bad = ["zorgl", "zorgling", "frumpet", "quarx"]
    rows = []
    for i in range(600):
        w = prose(rng, 60).split()
        for _ in range(i % 3 * 3):
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w), int(i % 3 > 0)))
    return rows


def test_toxicity(spark, docs):
    from pyspark.sql import functions as F

    rows = toxic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    sampled = toxicity.sample(df.filter("doc_id < 400"), df.select("doc_id", "toxic"), Scratch(spark, "t2"))
    assert sampled.count() == 400
    model = toxicity.learn(sampled)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    out = {r["doc_id"]: r for r in toxicity.score(df, model, ["doc_id"]).collect()}
    assert sum(out[i]["toxic"] == bool(t) for i, _, t in rows[400:]) >= 195
    mean = [np.mean([out[i]["expected_severity"] for i in range(400, 600) if i % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    odd = toxicity.score(docs, model, ["doc_id", "text"]).collect()
    assert len(odd) == docs.count() and not any(r["toxic"] for r in odd)
    assert toxicity.score(docs, model, ["doc_id", "grade"]).schema.simpleString() == "struct<doc_id:bigint,expected_severity:double,grade:int,toxic:boolean>"
    assert toxicity.clean(docs, model).count() == docs.count() and toxicity.clean(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0
    long = spark.createDataFrame([(1, "plain words " * 200_000 + "zorgl quarx frumpet")], "doc_id long, text string")
    assert toxicity.score(long, model, ["doc_id"]).first()["toxic"]
    none = toxicity.learn(toxicity.sample(df.limit(0), df.limit(0), Scratch(spark, "t2")))
    assert {r["expected_severity"] for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.0}
    one = toxicity.learn(toxicity.sample(df, df.select("doc_id", F.lit(1).alias("toxic")), Scratch(spark, "t2")))
    assert not len(one.thresholds)


def test_toxicity_against_naive_formulas(spark):
    """Features by counting, likelihood and severity term by term, the gradient by differences."""
    rows = toxic_rows()[:120]

    def of(t):
        w = [x.translate(LOWER) for x in words(t)]
        return {x.encode()[:k] for x in w for k in (None, *toxicity.PREFIXES)}

    up, down = Counter(f for _, t, y in rows if y for f in of(t)), Counter(f for _, t, y in rows if not y for f in of(t))
    n_up, n_down = (sum(y == v for *_, y in rows) for v in (1, 0))
    lift = {f: math.log((up[f] + 0.5) / (n_up + 1)) - math.log((down[f] + 0.5) / (n_down + 1)) for f in up}
    want = {f for f in up if up[f] >= toxicity.LEAST and lift[f] >= math.log(toxicity.LIFT)}
    sampled = spark.createDataFrame([(t, y, 1.0 + y) for _, t, y in rows], "t string, y int, weight double").repartition(3)
    features = toxicity.select(sampled)
    assert set(features.tolist()) == {word_key(f) for f in want}
    y, weight, row, at = toxicity._rows(sampled, features)
    have = sorted((int(y[i]), sorted(features[at[row == i]].tolist())) for i in range(len(y)))
    assert have == sorted((v, sorted(word_key(f) for f in of(t) & want)) for _, t, v in rows)
    rng = np.random.default_rng(1)
    grades = np.where(y > 0, 1 + (np.bincount(row, minlength=len(y)) > 5), 0)
    m, weight = len(features), weight / weight.sum()
    p = rng.standard_normal(m + 2) * 0.5
    t = [p[m], p[m] + math.exp(p[m + 1])]

    def naive(p):
        t = [p[m], p[m] + math.exp(p[m + 1])]
        total = toxicity.RIDGE * sum(x * x for x in p[:m])
        for i, g in enumerate(grades):
            x = sum(p[j] for j in at[row == i])
            below = [0.0, *(1 / (1 + math.exp(x - c)) for c in t), 1.0]
            total -= weight[i] * math.log(below[g + 1] - below[g])
        return total

    value, g = toxicity.loss(p, row, at, grades, weight, m)
    assert math.isclose(value, naive(p), rel_tol=1e-9)
    for j in [0, 1, m // 2, m, m + 1]:
        q = p.copy()
        q[j] += 1e-6
        r = p.copy()
        r[j] -= 1e-6
        assert math.isclose((naive(q) - naive(r)) / 2e-6, g[j], rel_tol=1e-4, abs_tol=1e-8)
    severity, grade, above = toxicity.Model(features, p[:m], np.array(t)).severity(np.array([0.3, -2.0, 5.0]))
    for x, s, k, a in zip((0.3, -2.0, 5.0), severity, grade, above, strict=True):
        below = [0.0, *(1 / (1 + math.exp(x - c)) for c in t), 1.0]
        each = [below[i + 1] - below[i] for i in range(3)]
        assert math.isclose(s, each[1] + 2 * each[2]) and k == max(range(3), key=lambda i: each[i]) and math.isclose(a, 1 - each[0])


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark))


def test_secrets(spark, docs, forest):
    held = secrets.labelled_findings(spark, secrets.FINDINGS + 1500).offset(secrets.FINDINGS)
    held = held.withColumnRenamed("value", "v").withColumnRenamed("is_secret", "label")
    out = secrets.findings(held, forest, path="path", carry=["v", "label"]).filter("v = value")
    right, n = out.filter("label = is_secret").count(), out.count()
    assert n > 1000 and right >= 0.96 * n
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(1, f'token = "{key}" and token = "{key}"', None, 1), (2, None, "p", 1), (3, "", "p", 1), (4, f"commit {key} was fine", "p", 1), (5, "word " * 5000 + f"password={key}", "p", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, found int")
    got = [(r["doc_id"], r["is_secret"]) for r in secrets.findings(df, forest, carry=["doc_id"]).collect()]
    assert sorted(got) == [(1, True), (1, True), (4, False), (5, True)]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df, forest).collect()}
    assert clean[1] == 'token = "[SECRET]" and token = "[SECRET]"' and clean[4] == rows[3][1] and clean[2] is None
    assert key not in clean[5] and secrets.redact(df, forest).columns == df.columns
    assert secrets.findings(docs.limit(0), forest, carry=["doc_id"]).count() == 0
    clash = df.selectExpr("*", "1 AS score", "'x' AS value", "2 AS __c")
    assert secrets.findings(clash, forest, carry=["doc_id", "score", "value"]).columns == ["doc_id", "word_at", "value", "score", "is_secret"]
    assert "Python" not in secrets.findings(docs, forest)._jdf.queryExecution().executedPlan().toString()


def test_secrets_that_are_short_or_full_of_symbols(spark, forest):
    texts = ["password=hunter2", "db_password: S3cr3t!Pass#2024x", "pwd=Tr0ub4dor&3!x", 'x {"password": "abc123xyz"} y', "the secret: because of this", "password: required field", "nothing = here1234"]
    df = spark.createDataFrame([(i, t, "src1") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {(r["doc_id"], r["value"]) for r in secrets.findings(df, forest, carry=["doc_id"]).filter("is_secret").collect()}
    assert got == {(0, "hunter2"), (1, "S3cr3t!Pass#2024x"), (2, "Tr0ub4dor&3!x"), (3, "abc123xyz")}
    clean = [r["text"] for r in secrets.redact(df, forest).orderBy("doc_id").collect()]
    assert clean == ["password=[SECRET]", "db_password: [SECRET]", "pwd=[SECRET]", 'x {"password": "[SECRET]"} y', *texts[4:]]


def test_secrets_forest_as_sql(spark):
    """The SQL gives each candidate the fitted forest's probability, and every group of features is asked for."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    rows = secrets.features(secrets.labelled_findings(spark, 2500)).cache()
    model = secrets.fit(rows)
    names = list(secrets._features("c"))
    table = VectorAssembler(inputCols=names, outputCol="x").transform(rows)
    both = model.transform(table).select(vector_to_array("probability")[1].alias("want"), F.expr(f"element_at(transform(array(array({', '.join(names)})), f -> {secrets.as_sql(model)}), 1)").alias("got"))
    assert both.count() > 2000 and both.filter("abs(want - got) > 1e-9").count() == 0
    asked = secrets.as_sql(model)
    for group in (["length"], ["transitions", "longest_kind", "upper", "digits"], ["dictionary"], ["test_path"], ["assigned", "keyword"], ["harmless"], ["harmless_right"]):
        assert any(f"f[{names.index(n)}]" in asked for n in group), group


def test_secrets_features(spark):
    """Each feature against Python on one candidate."""
    df = spark.createDataFrame([("set my api_key = abCD12ef_34 # example", "tests/a.py", "abCD12ef_34", True)], "text string, path string, value string, is_secret boolean")
    r = secrets.features(df).first().asDict()
    want = {"length": 11, "digits": 4 / 11, "upper": 2 / 11, "lower": 4 / 11, "vowels": 2 / 11, "transitions": 6 / 11, "longest_kind": 2 / 11, "different": 11 / 11, "hex": 0, "separators": 1, "prefixed": 0, "assigned": 1, "keyword": 1, "harmless": 0, "harmless_right": 1, "at_sign": 0, "url": 0, "symbols": 0, "test_path": 1, "label": 1}
    assert {k: r[k] for k in want} == pytest.approx(want) and 0 <= r["dictionary"] < 0.5
