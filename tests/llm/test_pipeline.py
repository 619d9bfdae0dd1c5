"""The pipeline against a brute-force version on a small folder of tables."""

import hashlib
import random

import public_tokenizers as P
import pytest

import corpus_pipeline
from weftcrawl.llm import bpe, decontaminate, secrets, toxicity
from weftcrawl.llm.registry import toxicity_model

from .test_operators import components, distance, prose

KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    base = [prose(rng, rng.randint(60, 120)) for _ in range(60)]
    items = [prose(rng, 30, 10**6) for _ in range(4)]
    texts = [None, "", *base, *base[:4], *(b + " more" for b in base[4:8]), f"{base[9]} {items[0]}", f"{base[10]} {items[1][:-3]}", f'{base[11]} token = "{KEY}"']
    toxic = {}
    for i in range(40):
        w = prose(rng, 60).split()
        w[5] = w[25] = w[40] = "zorgl"
        toxic[len(texts)] = 1
        texts.append(" ".join(w))
    out = tmp_path_factory.mktemp("tables")
    docs = [(i, t, "en", "src", len(t) if t else 0) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, toxic.get(i, 0)) for i in range(len(texts)) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), docs, items, set(toxic)


def test_pipeline(spark, folder):
    path, docs, items, toxic = folder
    model = toxicity_model(spark, path, spark.read.parquet(f"{path}/documents.parquet"))
    severity = {r["doc_id"]: r["toxic"] for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), model, ["doc_id"]).collect()}
    assert {i for i, x in severity.items() if x} == toxic
    left = [(i, t) for i, t, *_ in docs if i not in toxic]
    group = components(left, corpus_pipeline.NEAR)
    left = [(i, t) for i, t in left if group[i][1] == i]
    normal = [decontaminate.normal(x) for x in items]
    left = [(i, t) for i, t in left if all(distance(x, decontaminate.normal(t)) > len(x) * decontaminate.RATE for x in normal)]
    left = [(i, (t or "").replace(KEY, secrets.REDACTED)) for i, t in left]
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = []
    for (i, t), ids in zip(left, codec.whole([t for _, t in left]), strict=True):
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == want


def test_stages_keep_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
    changed = corpus_pipeline.without_secrets(spark, docs, path).filter("instr(text, '[SECRET]') > 0").first()
    assert changed["n_chars"] == len(changed["text"])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0, name


def test_stages_on_odd_rows(spark, folder):
    """Nulls, repeated rows, a very long text, and extra columns named like those the stages make."""
    rng = random.Random(12)
    long = prose(rng, 60_000, 10**6)
    texts = [None, "", long, long + " end", prose(rng, 80), "x", "x", f"say {KEY}"]
    rows = [(i if i != 6 else 5, t, None, None, None, 1, "g", 2, "v") for i, t in enumerate(texts)] + [(None, "null key", "en", "s", 8, 1, "g", 2, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sid int, grade string, __old int, value string").repartition(3)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns, name
        kept[name] = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in out.collect())
    every = [-1, 0, 1, 2, 3, 4, 5, 5, 7]
    assert kept == {"toxicity": every, "near_duplicates": [-1, 0, 1, 2, 4, 5, 5, 7], "decontamination": every, "secrets": every}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder[0]).count() == len(rows)
