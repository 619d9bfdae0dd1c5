"""The queries opN_<name>: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import Scratch, ship
from . import bpe, byte_cnn, decontaminate, partenum, quality, secrets, suffix_tree, tokenfile, toxicity, warc
from .common import doc_remainder, read


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(read(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings(spark)), carry=["doc_id"])
    return found.select("doc_id", "word_at", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("value_chars"), "score", "is_secret")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    ship(spark)
    scratch = Scratch(spark, "toxicity")
    model = toxicity.learn(toxicity.sample(docs, read(spark, sf_dir, "labels"), scratch))
    scratch.drop("sample")
    return model


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity_model(spark, sf_dir, docs), ["doc_id"])


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", doc_remainder(4) == 2)
    net = byte_cnn.fit(*byte_cnn.sample(docs, ~F.col("held_out"), "text", "lang", "doc_id"))
    return byte_cnn.predict(docs, net, ["doc_id", "held_out"])


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.linked(read(spark, sf_dir, "documents"), partenum.Similarity(85, 100, 4), Scratch(spark, "op5"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op7")
    return warc.read_back(warc.write(read(spark, sf_dir, "pages"), scratch.path("archives"), scratch))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(read(spark, sf_dir, "documents"), quality.rules(), Scratch(spark, "op8")).drop("text")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op9")
    manifest, dictionary = tokenfile.write(read(spark, sf_dir, "documents"), scratch.path("files"), scratch, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read_back(manifest, dictionary)


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", doc_remainder(7) == 2)
    return suffix_tree.score(docs, docs.filter(~F.col("held_out")), Scratch(spark, "op10"), carry=["held_out"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_toxicity": op2_toxicity,
    "op3_byte_cnn": op3_byte_cnn,
    "op4_bpe": op4_bpe,
    "op5_partenum": op5_partenum,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_token_files": op9_token_files,
    "op10_suffix_tree": op10_suffix_tree,
}

#: DuckDB SQL for the queries that it can express.
ORACLE: dict[str, str] = {
    "op7_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS largest FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM q
""",
    "op5_partenum": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
""",
    "op8_quality": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT doc_id, unnest(range(len(ws) - 2)) AS i, ws FROM w WHERE len(ws) > 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i + 1], ws[i + 2], ws[i + 3]) AS n FROM u),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, len(string_split(t, chr(10))) AS n_lines FROM d),
c AS (SELECT w.doc_id, t, n_lines, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS capitals,
  len(regexp_extract_all(t, '(\.\.\.|…)[\x20\t\r]*(\n|$)')) AS ellipses
  FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
    OR 10 * letters < 6 * word_chars OR 2 * capitals > letters OR 10 * ellipses > 3 * n_lines) AS kept
FROM b
""",
}
