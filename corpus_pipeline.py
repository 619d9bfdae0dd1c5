"""A cleaning pipeline over `documents`: toxicity, near duplicates, decontamination, secrets, tokens.

Each stage gets what its predecessor kept, written as Parquet and read again. All but the last return the columns of
documents, extra ones and those with any name included; clean documents pass them unchanged.

Null and empty texts are clean, and have no copies: they reach the last stage. Very long texts are taken whole. Of repeated
rows, as of any group of copies, the one with the smallest doc_id stays; rows that share it, and rows without a doc_id, all stay. Ties: a text that is as
probably toxic as not goes, a similarity of exactly 0.8 links, a candidate with a score of exactly 0.5 is a secret. An empty table
of documents gives none at every stage; without labels nothing is toxic, without a benchmark nothing has leaked.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcrawl.llm import bpe, decontaminate, partenum, secrets, toxicity
from weftcrawl.llm.common import read
from weftcrawl.llm.registry import toxicity_model
from weftcrawl.plans.runtime import Scratch

#: Near duplicates: five words, a similarity of 0.8 or more.
NEAR = partenum.Similarity(80, 100, 5)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are graded toxic go."""
    return toxicity.clean(docs, toxicity_model(spark, sf_dir, docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id."""
    return partenum.one_of_each(docs, NEAR, Scratch(spark, "pipeline-near"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows it."""
    old = docs.withColumn("__old", F.col("text"))
    new = secrets.redact(old, secrets.train(secrets.labelled_findings(spark)))
    return new.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col("__old")), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document that is left."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: Classifiers, edit distances and BPE are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
