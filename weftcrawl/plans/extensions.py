"""G5, A7, A9, T-1, T-2, X15: the built-in extensions, observers of a crawl's signals. They are opened in the order of their places
and names, so that what one counts is there for the next (T15)."""

from __future__ import annotations

from datetime import UTC, datetime

from .signals import NotConfigured, Signal, log


class Extension:
    def open(self, crawl) -> None:
        """Raises NotConfigured where the settings do not ask for it."""
        self.crawl = crawl

    def close(self) -> None:
        pass


class CoreStats(Extension):
    """A7, A9."""

    def open(self, crawl) -> None:
        self.crawl, self.began = crawl, crawl.now()
        crawl.stats.set("start_time", datetime.fromtimestamp(self.began, UTC).isoformat())
        crawl.signals.connect(Signal.SPIDER_CLOSED, self.closed)

    def closed(self, spider, reason: str) -> None:
        stats, now = self.crawl.stats, self.crawl.now()
        seconds = now - self.began
        stats.set("finish_time", datetime.fromtimestamp(now, UTC).isoformat())
        stats.set("elapsed_time_seconds", seconds)
        stats.set("finish_reason", reason)
        for key, count in (("responses_per_minute", "response_received_count"), ("items_per_minute", "item_scraped_count")):
            stats.set(key, stats.get(count, 0) * 60 / seconds if seconds > 0 else None)


class CloseSpider(Extension):
    """T-2: limits of pages, items, errors and seconds; the crawl stops after the round that meets one (T5: as meant)."""

    LIMITS = {"pagecount": "response_received_count", "itemcount": "item_scraped_count", "errorcount": "spider_exceptions"}

    def open(self, crawl) -> None:
        self.crawl, self.began = crawl, crawl.now()
        self.limits = {name: n for name in self.LIMITS if (n := crawl.settings.get_int(f"CLOSESPIDER_{name.upper()}")) > 0}
        self.seconds = crawl.settings.get_duration("CLOSESPIDER_TIMEOUT")
        if not self.limits and self.seconds <= 0:
            raise NotConfigured
        for signal in (Signal.RESPONSE_RECEIVED, Signal.ITEM_SCRAPED):
            crawl.signals.connect(signal, self.look)

    def look(self, **_) -> None:
        stats = self.crawl.stats
        for name, n in self.limits.items():
            have = stats.get(self.LIMITS[name], 0) + (stats.get("downloader/exception_count", 0) + stats.get("item_error_count", 0) if name == "errorcount" else 0)
            if have >= n:
                self.crawl.stop(f"closespider_{name}")
        if 0 < self.seconds <= self.crawl.now() - self.began:
            self.crawl.stop("closespider_timeout")


class LogStats(Extension):
    """T-1: pages and items so far, a line for each round that ends after the interval."""

    def open(self, crawl) -> None:
        self.crawl, self.last = crawl, crawl.now()
        self.seconds = crawl.settings.get_duration("LOGSTATS_INTERVAL")
        if self.seconds <= 0:
            raise NotConfigured
        crawl.signals.connect(Signal.RESPONSE_RECEIVED, self.look)

    def look(self, **_) -> None:
        now = self.crawl.now()
        if now - self.last >= self.seconds:
            self.last = now
            log.info("round %d: %s pages, %s items", self.crawl.rounds, self.crawl.stats.get("response_received_count", 0), self.crawl.stats.get("item_scraped_count", 0))


class FeedExport(Extension):
    """All items go to every feed when the spider is closed."""

    def open(self, crawl) -> None:
        self.crawl = crawl
        if not crawl.feeds:
            raise NotConfigured
        crawl.signals.connect(Signal.SPIDER_CLOSED, self.closed)

    def closed(self, spider, reason: str) -> None:
        from ..operators import export

        found = self.crawl.scraped()
        if found is None:
            return
        for key, value in export.fan_out(found, self.crawl.feeds, spider.name).items():
            self.crawl.stats.set(key, value)


BUILT_IN = {"CoreStats": CoreStats, "CloseSpider": CloseSpider, "LogStats": LogStats, "FeedExport": FeedExport}


def from_settings(settings) -> list[tuple[int, str, Extension]]:
    places = settings.get_dict("EXTENSIONS_BASE") | settings.get_dict("EXTENSIONS")
    return [(places[n], n, BUILT_IN[n]()) for n in settings.components("EXTENSIONS") if n in BUILT_IN]
