"""Deduplication, priorities and admission (D1-D14, W18-W21) as window functions and anti-joins.

Requests have url, method, priority, dont_filter, seq (the order of arrival) and fp. A Frontier holds a crawl's queue and seen set
as tables of rounds in a shared folder, so that a crawl is taken up again where it was left.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.runtime import Scratch, running


def first_seen(requests: DataFrame, seen: DataFrame | None = None, fp: str = "fp", seq: str = "seq", bypass: str | None = "dont_filter") -> DataFrame:
    """The first request of each fingerprint that is not in seen; requests that bypass the filter all pass.

    The order of equal fingerprints is that of seq, so the result does not hang on partitions. min_by is a partial aggregate:
    a fingerprint that a third of all requests have is one row for each task."""
    columns = requests.columns
    passing = requests.filter(F.coalesce(F.col(bypass), F.lit(False))) if bypass else None
    rest = requests.filter(~F.coalesce(F.col(bypass), F.lit(False))) if bypass else requests
    one = rest.groupBy(fp).agg(F.min_by(F.struct(*columns), seq).alias("r")).select("r.*")
    if seen is not None:
        one = one.join(seen.select(fp).distinct(), fp, "left_anti").select(*columns)
    return one if passing is None else passing.unionByName(one)


def extended(seen: DataFrame | None, admitted: DataFrame, fp: str = "fp", bypass: str | None = "dont_filter") -> DataFrame:
    """Seen and the fingerprints of what was admitted by the filter; bypassing requests leave no trace."""
    new = admitted.filter(~F.coalesce(F.col(bypass), F.lit(False))) if bypass else admitted
    new = new.select(fp)
    return new.distinct() if seen is None else seen.select(fp).unionByName(new).distinct()


def with_fingerprint(requests: DataFrame, url: str = "url", method: str | None = "method", body: str | None = None, headers: str | None = None) -> DataFrame:
    return requests.withColumn("fp", urls.fingerprint(url, method, body, headers))


def next_requests(queue: DataFrame, k: int, priority: str | None = "priority", seq: str = "seq", memory: str | None = None, fifo: bool = False) -> DataFrame:
    """The k of highest priority, if there is one, the latest first among equals, or with fifo the earliest; those in
    memory before those on disk."""
    order = [F.col(memory).desc()] if memory else []
    order += [F.col(priority).desc()] if priority else []
    return queue.orderBy(*order, F.col(seq).asc() if fifo else F.col(seq).desc()).limit(k)


def popped_rank(priority: str = "priority", seq: str = "seq", by: list[str] | None = None) -> Column:
    """The place of a request in the order of popping, within each group."""
    return F.row_number().over(W.partitionBy(*(by or [])).orderBy(F.col(priority).desc(), F.col(seq).desc()))


def slot(url="url", override: str | None = None) -> Column:
    """W18."""
    host = urls.host(url)
    return F.coalesce(F.col(override), host) if override else host


def admitted(queue: DataFrame, slots: int = 8, total: int = 16, by: str = "slot", priority: str = "priority", seq: str = "seq") -> DataFrame:
    """At most `slots` for each slot and `total` in all, in the order of popping. The first cut leaves few rows of each
    slot, so the second is a top-k."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.col(priority).desc(), F.col(seq).desc()))
    return queue.withColumn("slot_rank", rank).filter(F.col("slot_rank") <= min(slots, total)).orderBy(F.col(priority).desc(), F.col(seq).desc()).limit(total)


def start_times(requests: DataFrame, delay: float, by: str = "slot", order: str = "seq", arrival: str | None = None, jitter: bool = False) -> DataFrame:
    """The earliest start of each request, `delay` seconds after the one before in its slot; with jitter half to one and a half
    times as long, by a hash of the request's place.

    With arrivals (seconds), start = max over earlier requests of (arrival_j + the pauses from j to i): a running maximum."""
    w = W.partitionBy(by).orderBy(order)
    pause = F.lit(float(delay)) * (F.lit(0.5) + F.pmod(F.xxhash64(by, order), F.lit(1000)) / F.lit(1000.0)) if jitter else F.lit(float(delay))
    waited = F.coalesce(F.sum(pause).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) if jitter else (F.row_number().over(w) - 1) * F.lit(float(delay))
    if arrival is None:
        return requests.withColumn("start_s", waited)
    return requests.withColumn("__w", waited).withColumn("start_s", F.max(F.col(arrival) - F.col("__w")).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("__w")).drop("__w")


def within_budget(responses: DataFrame, size: Column, budget: int = 5_000_000, least: int = 1024, by: list[str] | None = None, order: str = "seq") -> DataFrame:
    """Responses before which the active bytes are under the budget; each counts at least `least`."""
    return running(responses, [order], {"active_before": F.greatest(size, F.lit(least))}, by).filter(F.col("active_before") < budget)


class Store(Protocol):
    """What a crawl needs of a queue; a store of another kind may take the place of Frontier."""

    def push(self, requests: DataFrame, k: str) -> DataFrame: ...

    def pop(self, k: int) -> DataFrame: ...

    def has_pending(self) -> bool: ...

    def stats(self) -> dict[str, int]: ...


class Frontier:
    """Requests of each round that are new, as tables `fresh/round=k` that are only ever added to: their
    fingerprints are the seen set. With `admit`, a round takes that many of the highest priority and the others wait."""

    def __init__(self, scratch: Scratch, admit: int = 0, filtered: bool = True):
        self.scratch, self.admit, self.filtered = scratch, admit, filtered
        self.rounds: list[str] = []
        self.waiting: DataFrame | None = None
        self.fresh: DataFrame | None = None
        self.new = 0
        self.counts = {"enqueued": 0, "dequeued": 0, "filtered": 0}

    def resume(self, rounds: list[str], schema, waiting: str | None, counts: dict[str, int]) -> None:
        """From the tables of an earlier run."""
        self.rounds, self.counts = list(rounds), dict(counts)
        self.waiting = self.scratch.spark.read.schema(schema).parquet(self.scratch.path(waiting)) if waiting else None

    def seen(self) -> DataFrame | None:
        """The fingerprints of what the filter let through."""
        if not self.rounds:
            return None
        paths = [self.scratch.path(f"fresh/round={k}") for k in self.rounds]
        return self.scratch.spark.read.schema("fp string, dont_filter boolean").parquet(*paths).filter("NOT coalesce(dont_filter, false)").select("fp")

    def push(self, requests: DataFrame, k: str) -> DataFrame:
        """What of these requests is new; it is in the queue now."""
        came = Observation()
        rows = requests.observe(came, F.count("*").alias("n"))
        if self.filtered:
            # those that pass the filter are groups of their own
            rows = rows.withColumn("__own", F.when(F.coalesce("dont_filter", F.lit(False)), F.monotonically_increasing_id()))
            rows = rows.groupBy("fp", "__own").agg(F.min_by(F.struct(*requests.columns), "seq").alias("r")).select("r.*")
        seen = self.seen() if self.filtered else None
        if seen is None:
            fresh = self.scratch.keep(rows, f"fresh/round={k}")
            total = came.get["n"]
        else:
            one = self.scratch.keep(rows, f"came/round={k}")
            total = came.get["n"]
            # the seen set is asked for the new fingerprints: it stays where it lies while those are few enough to be sent
            known = seen.join(one.select("fp"), "fp", "left_semi").distinct().withColumn("__known", F.lit(True))
            fresh = one.join(known, "fp", "left").filter("__known IS NULL OR coalesce(dont_filter, false)").drop("__known").select(*requests.columns)
            fresh = self.scratch.keep(fresh, f"fresh/round={k}")
            self.scratch.drop(f"came/round={k}")
        self.rounds.append(k)
        new = fresh.count()
        self.counts["enqueued"] += new
        self.counts["filtered"] += int(total) - new
        # what came before and was not taken yet stays
        self.fresh, self.new = (fresh, new) if self.fresh is None else (self.fresh.unionByName(fresh), self.new + new)
        return fresh

    def pending(self) -> DataFrame | None:
        """What is in the queue."""
        if self.waiting is None or self.fresh is None:
            return self.fresh if self.waiting is None else self.waiting
        return self.waiting.unionByName(self.fresh)

    def __len__(self) -> int:
        df = self.pending()
        return 0 if df is None else df.count()

    def has_pending(self) -> bool:
        if self.fresh is not None and self.new:
            return True
        return self.waiting is not None and not self.waiting.isEmpty()

    def peek(self):
        """The request that is next, or None."""
        df = self.pending()
        return None if df is None else next_requests(df, 1).first()

    def pop(self, k: int) -> DataFrame:
        """The requests of round k; they leave the queue."""
        df = self.pending()
        if not self.admit:
            self.counts["dequeued"] += df.count()
            self.fresh = self.waiting = None
            return df
        # by place in the order of popping: one write says which go and which wait
        ranked = self.scratch.keep(df.join(next_requests(df, self.admit).select("seq", F.lit(True).alias("__go")).distinct(), "seq", "left"), f"ranked/round={k}")
        take = ranked.filter("__go").drop("__go")
        self.waiting, self.fresh = self.scratch.keep(ranked.filter("__go IS NULL").drop("__go"), f"waiting/round={k}"), None
        self.counts["dequeued"] += take.count()
        return take

    def stats(self) -> dict[str, int]:
        """D5, A8."""
        return {"scheduler/enqueued": self.counts["enqueued"], "scheduler/dequeued": self.counts["dequeued"], "dupefilter/filtered": self.counts["filtered"]}
