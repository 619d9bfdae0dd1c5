"""Statistics (A1-A9, T-1, T-2, T-6): counters are grouped aggregates of an event relation, rates are time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.runtime import running


def counters(events: DataFrame, prefix: str, dimension: str, value: Column | None = None) -> DataFrame:
    """(key, value) of a prefix's total and of each value of a dimension, by one rollup."""
    measure = F.count("*") if value is None else F.sum(value)
    rolled = events.filter(F.col(dimension).isNotNull()).rollup(dimension).agg(measure.alias("value"), F.grouping(dimension).alias("all"))
    key = F.when(F.col("all") == 1, F.lit(prefix)).otherwise(F.concat(F.lit(prefix + "/"), F.col(dimension).cast("string")))
    return rolled.select(key.alias("key"), F.col("value").cast("double").alias("value"))


def gauge(events: DataFrame, key: str, value: Column, how: str = "max") -> DataFrame:
    """A2."""
    return events.agg(getattr(F, how)(value).cast("double").alias("value")).select(F.lit(key).alias("key"), "value")


def last_value(events: DataFrame, key: str, value: Column, order: str) -> DataFrame:
    """A3."""
    return events.agg(F.max_by(value, order).cast("double").alias("value")).select(F.lit(key).alias("key"), "value")


def merged(parts: list[DataFrame], how: str = "sum") -> DataFrame:
    """Statistics of several rounds or crawls by key; A4: in the order of keys when written."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("key").agg(getattr(F, how)("value").alias("value"))


def rates(events: DataFrame, ts: str = "ts", seconds: int = 60, kind: str | None = None) -> DataFrame:
    """T-1: events in each tumbling window, the sum so far, and the rate a minute. Windows without events have no row; the
    difference to the row before is the window's own count."""
    start = F.window(ts, f"{seconds} seconds").start
    by = [kind] if kind else []
    n = events.groupBy(*by, start.alias("window_start")).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by).orderBy("window_start")
    return n.withColumn("total", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("delta", F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0))).withColumn("per_minute", F.col("delta") * (60.0 / seconds))


def sliding_rates(events: DataFrame, ts: str = "ts", seconds: int = 3, slide: int = 1) -> DataFrame:
    """T-6."""
    return events.groupBy(F.window(ts, f"{seconds} seconds", f"{slide} seconds").start.alias("window_start")).agg((F.count("*") / F.lit(float(seconds))).alias("per_second"))


def until(events: DataFrame, order: list[str], limits: dict[str, tuple[Column, int]], by: list[str] | None = None) -> DataFrame:
    """T-2: events up to and with the one that meets the first of the limits (name: condition that counts, number). 0: none.

    by: independent crawls; each is one ordered sequence."""
    real = {name: (c, n) for name, (c, n) in limits.items() if n > 0}
    hits = {name: F.coalesce(c, F.lit(False)).cast("int") for name, (c, _) in real.items()}
    rows = running(events, order, {f"__before_{name}": c for name, c in hits.items()}, by)
    open_, reason = F.lit(True), F.lit(None).cast("string")
    for name, (_, n) in real.items():
        open_ = open_ & (F.col(f"__before_{name}") < n)
        reason = F.coalesce(reason, F.when(F.col(f"__before_{name}") + hits[name] >= n, F.lit(f"closespider_{name}")))
    return rows.withColumn("close_reason", reason).filter(open_).drop(*(f"__before_{name}" for name in real))


def final_rates(stats: DataFrame, elapsed: str = "elapsed_time_seconds") -> DataFrame:
    """Responses and items a minute, from (key, value)."""
    wide = stats.agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(a) for k, a in ((elapsed, "e"), ("response_received_count", "r"), ("item_scraped_count", "i"))))
    pairs = F.create_map(F.lit("responses_per_minute"), F.try_divide(F.coalesce("r", F.lit(0.0)) * 60, F.col("e")), F.lit("items_per_minute"), F.try_divide(F.coalesce("i", F.lit(0.0)) * 60, F.col("e")))
    return wide.select(F.explode(pairs).alias("key", "value"))
