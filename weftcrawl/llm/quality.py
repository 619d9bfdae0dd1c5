"""Quality rules as a short-circuit cascade (operator 8), in DataFrame and SQL functions only.

A rule is a condition on a text or its counts that rejects a document. Cost and selectivity of each rule are estimated on a
bounded sample of documents that pass the base rules, as only those are asked. The cascade begins with the rule of the most
rejections per cost; next comes the one with the most among what the rules before it leave, and so on. It stops at the first
rule that rejects. The order changes what a document costs, never the verdict; rules of equal worth stay in the given order.

Null and empty texts have no words, and so fail the base rules. Very long texts are counted whole, in memory at once. Repeated
rows are judged each. An empty table gives no rows, and the given order. A carried column named like a new one, or `text`, gives
way to it.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import Scratch
from .common import GAP, WORD, carried, sampled

#: Rows of the sample, before the base rules, on which costs and selectivities are estimated.
SAMPLE = 2000
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50


class Rule(NamedTuple):
    """reject: a condition on the columns of counts() and `text`; null does not reject."""

    name: str
    reject: Column


def sql_string(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _repeated(w: str) -> str:
    """SQL for the number of words of array w in windows of three that occur twice or more.

    Windows are sorted by their hash, with their place in the low bits, so that equal ones are neighbours; neighbours count
    when their words are equal. The windows found cover 3 words each, less what the one before has covered."""
    bits = f"int(ceil(log2(size({w}) + 1.0D)))"
    same = " AND ".join(f"w[int(x & m.low) + {k}] = w[int(y & m.low) + {k}]" for k in range(3))
    near = f"exists(array(get(s, i - 1), get(s, i + 1)), y -> (y & m.high) = (x & m.high) AND {same})"
    found = f"sort_array(transform(filter(s, (x, i) -> {near}), x -> x & m.low))"
    total = f"aggregate({found}, named_struct('p', -3L, 't', 0L), (a, p) -> named_struct('p', p, 't', a.t + least(3L, p - a.p)), a -> a.t)"
    packed = f"sort_array(transform(sequence(0, size({w}) - 3), i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & m.high) | i))"
    inner = f"element_at(transform(array({packed}), s -> {total}), 1)"
    masks = f"named_struct('high', shiftleft(-1L, {bits}), 'low', ~shiftleft(-1L, {bits}))"
    return f"CASE WHEN size({w}) < 4 THEN 0L ELSE element_at(transform(array({masks}), m -> {inner}), 1) END"


COUNTS = ["text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in carry, text, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    carry = carried(carry, COUNTS)
    # one evaluation of the words for what is counted on them: an element of an array of one is a name for its value
    over = f"element_at(transform(array(regexp_extract_all(__text, {sql_string(WORD)}, 0)), w -> named_struct('n', bigint(size(w)), 'r', {_repeated('w')})), 1)"
    lines = f"element_at(transform(array(filter(split(__text, '\n'), l -> l RLIKE {sql_string(WORD)})), l -> bigint(size(l) - size(array_distinct(l)))), 1)"
    df = df.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__on_words", F.expr(over))
    return df.select(
        *carry,
        F.col("__text").alias("text"),
        F.col("__on_words.n").alias("n_words"),
        F.length(F.regexp_replace("__text", GAP, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr(lines).alias("n_dup_lines"),
        F.col("__on_words.r").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def rules() -> list[Rule]:
    """The rules of the query; ratios are compared as whole numbers."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    lines = F.size(F.split("text", "\n"))
    return [
        Rule("short_words", F.col("word_chars") < 2 * F.col("n_words")),
        Rule("long_words", F.col("word_chars") > 15 * F.col("n_words")),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") > 3 * lines),
        Rule("few_letters", 10 * letters < 6 * F.col("word_chars")),
        Rule("capitals", 2 * F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) > letters),
        Rule("ellipses", 10 * F.regexp_count("text", F.lit(r"(\.\.\.|…)[\x20\t\r]*(\n|$)")) > 3 * lines),
    ]


def ordered(sample: DataFrame, rules: list[Rule], scratch: Scratch) -> list[Rule]:
    """The rules by rejections per cost on a sample with counts(), each among what those before it leave."""
    some = scratch.keep(sample, "sample", scratch.files(0))

    def run(c: Column) -> float:
        began = time.perf_counter()
        some.agg(F.count_if(c)).first()
        return time.perf_counter() - began

    # a row for each set of rules that reject together: no more than the rows of the sample
    verdicts = some.groupBy(F.array(*(F.coalesce(r.reject, F.lit(False)) for r in rules)).alias("v")).count().collect()
    if not verdicts or not rules:
        scratch.drop("sample")
        return list(rules)
    run(F.lit(True))
    idle = min(run(F.col("n_words") >= 0) for _ in range(2))
    costs = [max(min(run(F.coalesce(r.reject, F.lit(False))) for _ in range(2)) - idle, idle / 50) for r in rules]
    scratch.drop("sample")
    return [rules[i] for i in order([(r["v"], r["count"]) for r in verdicts], costs)]


def order(verdicts: list[tuple[list[bool], int]], costs: list[float]) -> list[int]:
    """Places of the rules in the order to ask them. verdicts: which rules reject, of how many documents."""
    out, left = [], list(range(len(costs)))
    while left:
        best = max(left, key=lambda i: sum(n for v, n in verdicts if v[i]) / costs[i])
        out.append(best)
        left.remove(best)
        verdicts = [(v, n) for v, n in verdicts if not v[best]]
    return out


def first_rejection(rules: list[Rule]) -> Column:
    """The name of the first of the rules that rejects, or null; those after it are not asked."""
    out = F
    for r in rules:
        out = out.when(F.coalesce(r.reject, F.lit(False)), F.lit(r.name))
    return out if rules else F.lit(None).cast("string")


def cascade(df: DataFrame, rules: list[Rule], scratch: Scratch, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """counts() with base_failed and kept; kept is the cascade's verdict on what has not failed the base rules."""
    carry = carried([key, *(carry or [])], [*COUNTS, "base_failed", "kept"])
    asked = counts(sampled(df, SAMPLE, key), text, carry).filter(~base_failed())
    chosen = ordered(asked, rules, scratch)
    return counts(df, text, carry).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & first_rejection(chosen).isNull())
