"""The crawl as a least fixpoint (C1-C12, O1, O2, O4, O5, R10, R11): rounds of dedup, admission, fetch, classification and following.

A spider says what to ask for and what to make of answers; middlewares, item stages, extensions and feeds hang on to it, and
settings say which. Each round is a plan over frames: what is new of its requests, and their answers, are written to the crawl's
folder, so lineage ends there and a lost executor costs a reread. A folder with a name of its own is a job: a crawl that was
paused or lost is taken up after its last whole round. `seq` is (round, depth, place by a hash), so the result does not hang on
partitions, and breadth-first rounds give each page its least depth.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import headers as H
from ..functions import urls
from ..plans.extensions import from_settings as extensions_from
from ..plans.runtime import Scratch
from ..plans.settings import Settings
from ..plans.signals import Extensions, Manager, Signal, log
from ..plans.stats import Stats
from ..sources.http import ANSWER
from . import downloader, export, filters, items, middleware
from .frontier import Frontier, Store
from .links import Extractor
from .requests import CALLBACKS, NO_CALLBACK, REQUEST, seeds

#: What the queue has besides a request's own columns.
BOOK = T.StructType(
    [
        T.StructField("depth", T.IntegerType()),
        T.StructField("retry_times", T.IntegerType()),
        T.StructField("redirect_times", T.IntegerType()),
        T.StructField("redirect_urls", T.ArrayType(T.StringType())),
        T.StructField("rule", T.IntegerType()),
        T.StructField("link_text", T.StringType()),
    ]
)


class CloseCrawl(Exception):
    """C11: raised by a callback or a hook; the crawl ends after the round."""


class Out(NamedTuple):
    """What a callback makes of a frame of responses. requests: url, and any of the other columns; depth or src_url says from where."""

    items: DataFrame | None = None
    requests: DataFrame | None = None


class Spider:
    """§2.17: hooks over whole frames. Responses have the request's columns, status, response_headers, response_body and what the
    fetcher adds."""

    name = "spider"
    start_urls: tuple[str, ...] | DataFrame = ()
    allowed_domains: tuple[str, ...] = ()
    #: Q5: settings of this spider, from plans.settings.typed() or as a dict.
    custom_settings: dict = {}

    def start(self, spark: SparkSession) -> DataFrame:
        return seeds(spark, self.start_urls if isinstance(self.start_urls, DataFrame) else list(self.start_urls))

    def parse(self, responses: DataFrame) -> Out:
        return Out()

    def callbacks(self) -> dict[str, Callable[[DataFrame], Out]]:
        """By name; those registered with requests.callback() are known too."""
        return {}

    def errbacks(self) -> dict[str, Callable[[DataFrame], Out]]:
        """Of failed downloads and refused answers, by the request's errback."""
        return {}

    def idle(self, rounds: int) -> DataFrame | None:
        """Asked when the queue is empty; may give more requests."""
        return None

    def closed(self, reason: str) -> None:
        pass


@dataclass
class Rule:
    """C1-C3. callback: a name; without one the links of what is found are followed, unless follow says otherwise."""

    extractor: Extractor = field(default_factory=Extractor)
    callback: str | None = None
    errback: str | None = None
    follow: bool | None = None
    #: Links to links, before the first rule of each URL is chosen.
    process_links: Callable[[DataFrame], DataFrame] | None = None
    #: Requests to requests, after that; rows that it leaves out are not asked for, nor by a later rule.
    process_request: Callable[[DataFrame], DataFrame] | None = None
    cb_kwargs: dict = field(default_factory=dict)

    def follows(self) -> bool:
        return self.callback is None if self.follow is None else self.follow


class RuleSpider(Spider):
    """Links are found by rules, and answers go to the callback of the rule that found them."""

    rules: tuple[Rule, ...] = ()

    def parse_start_url(self, responses: DataFrame) -> Out:
        return Out()

    def process_results(self, responses: DataFrame, out: Out) -> Out:
        return out

    def parse(self, responses: DataFrame) -> Out:
        """What has no callback of its own: start URLs, and answers by rule. The links of all that are followed are taken together."""
        known = {**CALLBACKS, **self.callbacks()}
        start = responses.filter("rule IS NULL")
        outs = [self._processed(start, self.parse_start_url(start))]
        for k, rule in enumerate(self.rules):
            if rule.callback in known:
                own = responses.filter(F.col("rule") == k)
                outs.append(self._processed(own, known[rule.callback](own, **rule.cb_kwargs)))
        if self.rules:
            followed = F.col("rule").isNull() | F.col("rule").isin([k for k, r in enumerate(self.rules) if r.follows()])
            outs.append(Out(requests=self.requests_to_follow(responses.filter(followed))))
        return merged(outs)

    def _processed(self, responses: DataFrame, out: Out) -> Out:
        return out if out.items is None and out.requests is None else self.process_results(responses, out)

    def requests_to_follow(self, responses: DataFrame) -> DataFrame:
        """Links of HTML answers; of equal URLs of a page that of the first rule."""
        kind = H.content_type(H.first("response_headers", "content-type"))
        pages = responses.filter(kind.isNull() | (kind == "") | kind.isin("text/html", "application/xhtml+xml"))
        html = F.col("html") if "html" in responses.columns else F.col("response_body").cast("string")
        # one row for each fetch of a page
        pages = pages.select("url", F.struct("seq", "depth").alias("from"), html.alias("html"))
        every = None
        for k, rule in enumerate(self.rules):
            found = rule.extractor.extract(pages, ["from", "url"])
            found = (rule.process_links(found) if rule.process_links else found).withColumn("rule", F.lit(k))
            every = found if every is None else every.unionByName(found)
        first = F.row_number().over(W.partitionBy("from", "src_url", "url").orderBy("rule", "pos"))
        one = every.withColumn("__n", first).filter("__n = 1").drop("__n")
        rows = one.select("url", "src_url", F.col("from.depth").alias("depth"), "rule", F.col("text").alias("link_text"))
        out = None
        for k, rule in enumerate(self.rules):
            own = rows.filter(F.col("rule") == k).withColumn("errback", F.lit(rule.errback).cast("string"))
            own = rule.process_request(own) if rule.process_request else own
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out


def merged(outs: list[Out]) -> Out:
    """The items of all, and the requests of all."""

    def union(frames: list[DataFrame | None]) -> DataFrame | None:
        out = None
        for f in frames:
            if f is not None:
                out = f if out is None else out.unionByName(f, allowMissingColumns=True)
        return out

    return Out(union([o.items for o in outs]), union([o.requests for o in outs]))


class Follow(Spider):
    """A spider of functions: follow gives (url, depth or src_url) of good answers, items gives items."""

    def __init__(self, start: DataFrame, follow: Callable[[DataFrame], DataFrame], items: Callable[[DataFrame], DataFrame] | None = None, domains: list[str] | None = None, name: str = "follow"):
        self.name, self._start, self._follow, self._items, self.allowed_domains = name, start, follow, items, tuple(domains or ())

    def start(self, spark: SparkSession) -> DataFrame:
        return self._start

    def parse(self, responses: DataFrame) -> Out:
        return Out(self._items(responses) if self._items else None, self._follow(responses))


class Crawl:
    """O1: one run of a spider. fetch: requests -> the same rows with ANSWER's columns and more; with an attribute `pure` it may be
    evaluated again.

    `folder` (or the setting JOBDIR) names a job: its tables stay, and a later run() goes on after its last whole round."""

    def __init__(self, spark: SparkSession, spider: Spider, fetch: Callable[[DataFrame], DataFrame], settings: Settings | dict | None = None, folder: str | None = None, paused: Callable[[], bool] | None = None, now: Callable[[], float] = time.time, round_limit: int = 0, admit: int = 0, frontier: Callable[[Scratch], Store] | None = None):
        self.spark, self.spider, self.fetch_pages = spark, spider, fetch
        self.settings = settings.copy() if isinstance(settings, Settings) else Settings(settings or {})
        self.settings.update(spider.custom_settings, "spider")
        folder = folder or self.settings.get("JOBDIR") or None
        self.paused, self.now, self.round_limit = paused or (lambda: False), now, round_limit
        self.scratch = Scratch(spark, f"crawl-{spider.name}", folder)
        self.named = bool(folder)
        self.frontier = frontier(self.scratch) if frontier else Frontier(self.scratch, admit)
        self.signals, self.stats = Manager(), Stats()
        self.downloads = middleware.from_settings(self.settings, self.scratch, self.settings.get("USER_AGENT"), now())
        self.outputs: list[tuple[int, filters.OutputMiddleware]] = []
        self.stages: list[items.Stage] = []
        self.feeds = export.feeds_from(self.settings)
        self.extensions = list(extensions_from(self.settings))
        self.rounds, self.reason = 0, "finished"
        self._found: list[int] = []
        self._stop: str | None = None

    # O2
    def add_downloader_middleware(self, m: middleware.Middleware, place: int) -> Crawl:
        self.downloads.append((place, m))
        return self

    def add_spider_middleware(self, m: filters.OutputMiddleware, place: int) -> Crawl:
        self.outputs.append((place, m))
        return self

    def add_stage(self, stage: items.Stage) -> Crawl:
        """A stage that has from_crawl is told of the crawl first."""
        self.stages.append(stage)
        return self

    def add_extension(self, extension, place: int = 0, name: str = "") -> Crawl:
        self.extensions.append((place, name or type(extension).__name__, extension))
        return self

    def add_feed(self, feed: export.Feed) -> Crawl:
        self.feeds.append(feed)
        return self

    def stop(self, reason: str) -> None:
        """O1, T-2: the crawl ends after the round."""
        self._stop = self._stop or reason

    def run(self) -> DataFrame:
        """(url, status, depth, round, retry_times, redirect_times) of every request that was answered, once for each answer.

        O5: whatever happens, extensions, stages and the spider are closed, in this order."""
        parts = Extensions(self.extensions)
        self.chain = [m for _, m in sorted(self.downloads, key=lambda x: x[0])]
        for m in self.chain:
            m.open(self)
        return items.life(self.stages, lambda: self._run(parts))

    def _run(self, parts: Extensions) -> DataFrame:
        parts.open(self)
        self.signals.send_and_log(Signal.ENGINE_STARTED)
        self.signals.send_and_log(Signal.SPIDER_OPENED, spider=self.spider)
        try:
            self._rounds()
        except BaseException:
            self.reason = "failed"
            raise
        finally:
            for k, v in self.frontier.stats().items():
                self.stats.set(k, v)
            self.signals.send_and_log(Signal.SPIDER_CLOSED, spider=self.spider, reason=self.reason)
            for m in reversed(self.chain):
                m.close()
            for e in parts.close():
                log.error("closing an extension failed: %s", e)
            self.spider.closed(self.reason)
            self.signals.send_and_log(Signal.ENGINE_STOPPED)
            if self.settings.get_bool("STATS_DUMP"):
                log.info("statistics: %s", self.stats.all())
        return self.answers().select("url", "status", "depth", "round", "retry_times", "redirect_times")

    def _rounds(self) -> None:
        again = self._resume()
        if again is None:
            self._push(self._shaped(self.spider.start(self.spark), 0), 1)
        elif self.rounds:
            self._push(again, self.rounds + 1)
        while True:
            if self._stop:
                self.reason = self._stop
                return
            if self.paused():
                self.reason = "paused"
                return
            if not self.frontier.has_pending():
                self.signals.send_and_log(Signal.SCHEDULER_EMPTY)
                more = self.spider.idle(self.rounds)
                stays = not self.signals.may_close(spider=self.spider)
                if more is not None and not more.isEmpty():
                    self._push(self._shaped(more, self.rounds), self.rounds + 1, "more")
                    continue
                if stays and self.frontier.has_pending():
                    continue
                return
            if self.round_limit and self.rounds >= self.round_limit:
                self.reason = "closespider_rounds"
                return
            self.rounds += 1
            try:
                queue = self._round(self.rounds)
            except CloseCrawl as e:
                self.reason = str(e) or "cancelled"
                self._save()
                return
            self._save()
            self._push(queue, self.rounds + 1)

    def _push(self, requests: DataFrame, k: int, part: str = "") -> None:
        before = self.frontier.stats()
        fresh = self.frontier.push(requests, f"{k}{part and '-' + part}")
        after = self.frontier.stats()
        self.signals.send_and_log(Signal.REQUEST_SCHEDULED, frame=fresh, count=after["scheduler/enqueued"] - before["scheduler/enqueued"])
        if dropped := after["dupefilter/filtered"] - before["dupefilter/filtered"]:
            self.signals.send_and_log(Signal.REQUEST_DROPPED, count=dropped)

    def _round(self, k: int) -> DataFrame:
        """Fetches what is queued, and gives the next round's requests."""
        take = self.frontier.pop(k)
        asked = take.withColumn("fate", F.lit(None).cast("string"))
        for m in self.chain:
            asked = m.process_request(asked, k)
        if any(m.joins for m in self.chain):
            asked = self.scratch.keep(asked, f"asked-{k}")
        self.signals.send_and_log(Signal.REQUEST_REACHED_DOWNLOADER, frame=asked)
        got = self.fetch_pages(asked.filter("fate IS NULL") if any(m.joins for m in self.chain) else asked)
        if not getattr(self.fetch_pages, "pure", False):
            # what comes from outside is asked for once, however often a step reads it
            got = self.scratch.keep(got, f"fetched-{k}")
        got = got.withColumns({f.name: F.lit(None).cast(f.dataType) for f in ANSWER.fields if f.name not in got.columns})
        if any(m.joins for m in self.chain):
            got = got.unionByName(asked.filter("fate IS NOT NULL"), allowMissingColumns=True)
        for m in reversed(self.chain):
            got = m.process_response(got, k)
        answers = self.scratch.keep(got, f"answers/round={k}")
        self._shape = answers.schema
        self.scratch.drop(f"asked-{k}", f"fetched-{k}")
        for m in self.chain:
            m.after(answers, k)
        self._count(answers)
        self.signals.send_and_log(Signal.RESPONSE_DOWNLOADED, frame=answers.filter("fate IS NULL OR fate <> 'forbidden'"))
        self.signals.send_and_log(Signal.REQUEST_LEFT_DOWNLOADER, frame=answers)
        self.signals.send_and_log(Signal.RESPONSE_RECEIVED, frame=answers.filter("fate IS NULL AND status IS NOT NULL"), count=self._round_counts["received"])
        return self._next(answers, k)

    def _count(self, answers: DataFrame) -> None:
        """A7, the part of the round: one pass."""
        counts = {"received": "status IS NOT NULL AND coalesce(fate, '') <> 'forbidden'", "failed": "error_kind IS NOT NULL", "forbidden": "fate = 'forbidden'", "retried": "fate = 'retry'", "redirected": "fate = 'redirect'", "ignored": "fate IS NULL AND status IS NOT NULL AND NOT (status >= 200 AND status < 300)"}
        row = answers.agg(*(F.count_if(F.expr(c)).alias(n) for n, c in counts.items()), F.max("depth").alias("deepest")).first()
        self._round_counts = row.asDict()
        for name, key in (("received", "response_received_count"), ("failed", "downloader/exception_count"), ("forbidden", "robotstxt/forbidden"), ("retried", "retry/count"), ("redirected", "redirect/count"), ("ignored", "httperror/response_ignored_count")):
            if row[name]:
                self.stats.inc(key, row[name])
        self.stats.maximum("request_depth_max", row["deepest"] or 0)

    def _next(self, answers: DataFrame, k: int) -> DataFrame:
        """Callbacks by name, errbacks, retries and redirects."""
        s = self.settings
        codes = [int(x) for x in s.get_list("HTTPERROR_ALLOWED_CODES")]
        own = F.from_json(F.try_element_at("meta", F.lit("handle_httpstatus_list")), "array<int>")
        ok = filters.http_ok("status", codes, s.get_bool("HTTPERROR_ALLOW_ALL"), middleware.flag("handle_httpstatus_all"), own)
        settled = answers.filter("fate IS NULL OR fate = 'gave_up'")
        good = filters.through(self.outputs, "input", settled.filter(F.col("error_kind").isNull() & F.coalesce(ok, F.lit(False))))
        outs: list[Out] = []
        known = {**CALLBACKS, **self.spider.callbacks()}
        named = F.col("callback").isNotNull() & (F.col("callback") != "")
        try:
            outs.append(self.spider.parse(good.filter(~named)))
            asked = {r["callback"] for r in good.filter(named).select("callback").distinct().collect()} if known else set()
            outs += [known[n](good.filter(F.col("callback") == n)) for n in sorted(asked) if n in known and n != NO_CALLBACK]
            errbacks = self.spider.errbacks()
            bad = settled.filter(F.col("error_kind").isNotNull() | ~F.coalesce(ok, F.lit(False)))
            outs += [f(bad.filter(F.col("errback") == n)) for n, f in errbacks.items()]
            handled = filters.through(self.outputs, "errors", bad.filter(~F.col("errback").isin(*errbacks) | F.col("errback").isNull()))
            if handled is not None:
                outs.append(Out(requests=handled) if "url" in handled.columns else Out(handled))
        except CloseCrawl:
            raise
        except Exception as e:
            self.stats.inc("spider_exceptions")
            self.signals.send_and_log(Signal.SPIDER_ERROR, error=e, spider=self.spider)
            raise
        out = merged([o if isinstance(o, Out) else Out(*o) for o in outs if o is not None])
        if out.items is not None:
            self._keep_items(out.items, k)
        queue = self._shaped(downloader.retry_requests(answers.withColumn("retry", F.col("fate") == "retry"), s.get_int("RETRY_PRIORITY_ADJUST")), k)
        if "location" in answers.columns:
            moved = downloader.redirects(answers.filter("fate = 'redirect'"), s.get_int("REDIRECT_MAX_TIMES"), s.get_int("REDIRECT_PRIORITY_ADJUST"))
            queue = queue.unionByName(self._shaped(moved, k))
        if out.requests is not None:
            queue = queue.unionByName(self._shaped(self._followed(out.requests, good), k))
        return queue

    def _followed(self, rows: DataFrame, good: DataFrame) -> DataFrame:
        """M3-M10 in the order in which counts are taken (T11): depth, length, referer, site."""
        s = self.settings
        if "depth" not in rows.columns:
            rows = rows.join(good.groupBy(F.col("url").alias("src_url")).agg(F.min("depth").alias("depth")), "src_url")
        rows = rows.withColumn("depth", filters.child_depth())
        if step := s.get_int("DEPTH_PRIORITY"):
            rows = rows.withColumn("priority", filters.depth_priority(F.coalesce("priority", F.lit(0)) if "priority" in rows.columns else F.lit(0), F.col("depth"), step))
        rows = rows.filter(filters.within_depth(F.col("depth"), s.get_int("DEPTH_LIMIT"))).filter(filters.short_enough("url", s.get_int("URLLENGTH_LIMIT")))
        if s.get_bool("REFERER_ENABLED") and "src_url" in rows.columns:
            own = F.col("headers") if "headers" in rows.columns else F.create_map().cast(middleware.EMPTY)
            rows = rows.withColumn("headers", middleware.set_header(own, "Referer", F.coalesce(H.first(own, "referer"), filters.referer())))
        rows = rows.filter(filters.on_site("url", list(self.spider.allowed_domains)))
        return filters.through(self.outputs, "requests", rows)

    def _keep_items(self, found: DataFrame, k: int) -> None:
        found = filters.through(self.outputs, "items", found)
        if self.stages:
            kept, lost = items.through(found, self.stages)
            lost = self.scratch.keep(lost, f"lost/round={k}")
        else:
            kept, lost = found, None
        kept = self.scratch.keep(kept, f"items/round={k}")
        self._found.append(k)
        count = kept.count()
        self.stats.inc("item_scraped_count", count)
        self.signals.send_and_log(Signal.ITEM_SCRAPED, frame=kept, count=count)
        if lost is not None:
            for r in lost.groupBy("kind").count().collect():
                self.stats.inc("item_dropped_count" if r["kind"] == "dropped" else "item_error_count", r["count"])
                self.signals.send_and_log(Signal.ITEM_DROPPED if r["kind"] == "dropped" else Signal.ITEM_ERROR, frame=lost.filter(F.col("kind") == r["kind"]), count=r["count"])

    def _shaped(self, df: DataFrame, k: int) -> DataFrame:
        """The queue's columns, with defaults for those that are missing; the fingerprint is of method, URL and body."""
        have = set(df.columns)
        start = {"method": F.lit("GET"), "headers": F.create_map(), "meta": F.create_map(), "cookies": F.create_map(), "priority": F.lit(0), "dont_filter": F.lit(False), "depth": F.lit(0), "retry_times": F.lit(0), "redirect_times": F.lit(0), "encoding": F.lit("utf-8")}

        def column(f: T.StructField) -> Column:
            c = F.col(f.name) if f.name in have else F.lit(None)
            return (F.coalesce(c.cast(f.dataType), start[f.name].cast(f.dataType)) if f.name in start else c.cast(f.dataType)).alias(f.name)

        # one value under one name: the canonical URL is made once, and is the key of the fetch too
        rows = df.select(*(column(f) for f in [*REQUEST.fields, *BOOK.fields])).withColumn("key", F.explode(F.array(urls.canonical("url"))))
        body = F.coalesce("body", F.lit("").cast("binary"))
        # the place within a round by a hash of what the request is: no global sort
        return rows.withColumns({"fp": F.sha1(F.concat(F.upper("method").cast("binary"), F.lit("|").cast("binary"), F.col("key").cast("binary"), F.lit("|").cast("binary"), body)), "seq": F.struct(F.lit(k).alias("round"), F.col("depth").alias("depth"), F.xxhash64("key", "method", "body", "depth", "retry_times", "rule").alias("place"))})

    # ---- state -----------------------------------------------------------------------------------------------------------------

    def _save(self) -> None:
        """What a later run needs besides the tables; the file is replaced as a whole."""
        if not self.named or not isinstance(self.frontier, Frontier):
            return
        f = self.frontier
        waiting = f"waiting/round={self.rounds}" if f.waiting is not None else None
        self.scratch.write_text("state.json", json.dumps({"rounds": self.rounds, "fresh": [str(k) for k in f.rounds], "waiting": waiting, "counts": f.counts, "items": self._found, "stats": self.stats.all(), "answers": self._shape.json()}))

    def _resume(self) -> DataFrame | None:
        """The requests that follow from the last whole round of an earlier run, or None."""
        text = self.scratch.read_text("state.json") if self.named else None
        if not text:
            return None
        state = json.loads(text)
        self.rounds, self._found = state["rounds"], state["items"]
        for k, v in state["stats"].items():
            self.stats.set(k, v)
        self._shape = T.StructType.fromJson(json.loads(state["answers"]))
        queue = T.StructType([*REQUEST.fields, *BOOK.fields])
        shape = self._shaped(self.spark.createDataFrame([], queue), 0).schema
        self.frontier.resume(state["fresh"], shape, state["waiting"], state["counts"])
        last = self.spark.read.schema(self._shape).parquet(self.scratch.path(f"answers/round={self.rounds}"))
        found, self._keep_items = self._keep_items, lambda *a: None
        try:
            return self._next(last, self.rounds)
        finally:
            self._keep_items = found

    def answers(self) -> DataFrame:
        """All answers of the run, by round."""
        if not self.rounds:
            return self.spark.createDataFrame([], T.StructType([*REQUEST.fields, *BOOK.fields, *ANSWER.fields, T.StructField("round", T.IntegerType()), T.StructField("fate", T.StringType())]))
        return self.spark.read.schema(T.StructType([*self._shape.fields, T.StructField("round", T.IntegerType())])).option("basePath", self.scratch.path("answers")).parquet(*(self.scratch.path(f"answers/round={k}") for k in range(1, self.rounds + 1)))

    def scraped(self) -> DataFrame | None:
        """All items of the run."""
        out = None
        for k in self._found:
            x = self.spark.read.parquet(self.scratch.path(f"items/round={k}"))
            out = x if out is None else out.unionByName(x, allowMissingColumns=True)
        return out


def table_fetcher(pages: DataFrame, scratch: Scratch | None = None, url: str = "url") -> Callable[[DataFrame], DataFrame]:
    """Pages of a table by canonical URL; the others are 404. Keys are made once and, with a scratch folder, written, so
    that a round reads the columns it needs. The join is by key: small rounds are sent to the pages, large ones meet them."""
    names = {"headers": "response_headers", "body": "response_body"}
    pages = pages.select(urls.canonical(url).alias("key"), *(F.col(c).alias(names.get(c, c)) for c in pages.columns if c != url))
    pages = pages if "status" in pages.columns else pages.withColumn("status", F.lit(200))
    if "location" in pages.columns:
        have = F.col("response_headers") if "response_headers" in pages.columns else F.create_map().cast(middleware.EMPTY)
        pages = pages.withColumn("response_headers", middleware.set_header(have, "Location", F.col("location"))).drop("location")
    pages = pages.withColumns({f.name: F.lit(None).cast(f.dataType) for f in ANSWER.fields if f.name not in pages.columns})
    if scratch is not None:
        pages = scratch.keep(pages, "keyed")

    def fetch(requests: DataFrame) -> DataFrame:
        rows = requests if "key" in requests.columns else requests.withColumn("key", urls.canonical("url"))
        return rows.join(pages, "key", "left").withColumn("status", F.coalesce("status", F.lit(404)))

    fetch.pure = True
    return fetch
