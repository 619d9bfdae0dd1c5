"""Structured Streaming forms: rates with watermarks, first-seen requests, and politeness by host with timers in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import urls


def rates(events: DataFrame, ts: str = "ts", window: str = "60 seconds", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """T-1, T-6: counts of each window; windows close once the watermark has passed."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def first_seen(requests: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """D1 over a stream: each fingerprint once while it is in the watermark's reach (T-5: state ends there)."""
    return requests.withColumn("fp", urls.simple_fingerprint("url")).withWatermark(ts, late).dropDuplicatesWithinWatermark(["fp"])


def polite(requests: DataFrame, delay: float, idle: str = "60 seconds", url: str = "url", arrival: str = "arrival_s") -> DataFrame:
    """The start of each request, `delay` seconds after the one before of its host; a host's state goes after `idle`.

    The state is one number for each host; rows of a host are handled batch by batch, never held."""
    schema = T.StructType([T.StructField("slot", T.StringType()), T.StructField("url", T.StringType()), T.StructField("arrival_s", T.DoubleType()), T.StructField("start_s", T.DoubleType())])
    state = T.StructType([T.StructField("free_s", T.DoubleType())])
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        if s.hasTimedOut:
            s.remove()
            return
        free = s.get[0] if s.exists else float("-inf")
        for f in frames:
            starts = []
            for a in f["arrival_s"]:
                at = max(a, free)
                starts.append(at)
                free = at + delay
            yield pd.DataFrame({"slot": key[0], "url": f["url"], "arrival_s": f["arrival_s"], "start_s": starts})
        s.update((free,))
        s.setTimeoutDuration(milliseconds)

    rows = requests.select(urls.host(url).alias("slot"), F.col(url).alias("url"), F.col(arrival).cast("double").alias("arrival_s"))
    return rows.groupBy("slot").applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.ProcessingTimeTimeout)
