"""The downloader's middlewares (W1-W17) as steps over a round's whole frame.

Requests pass in ascending order, responses in descending order. A step does not split a frame: it marks rows in the column
`fate`, so that a round is one plan and one write. Requests with a fate are not fetched; responses with one do not reach the
spider: `forbidden` (robots), `cached`, `retry`, `gave_up`, `redirect`.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import urls
from ..plans.runtime import Scratch
from ..sources.http import robots_files
from . import cache, downloader, robots

if TYPE_CHECKING:
    from .crawl import Crawl

EMPTY = "map<string,array<string>>"


def set_header(headers: Column, name: str, value: Column) -> Column:
    """headers with this one replaced, or as they are where the value is null."""
    headers = F.coalesce(headers, F.create_map().cast(EMPTY))
    others = F.map_filter(headers, lambda k, _: F.lower(k) != name.lower())
    return F.when(value.isNotNull(), F.map_concat(others, F.create_map(F.lit(name), F.array(value)))).otherwise(headers)


def fated(df: DataFrame, condition: Column, fate: str) -> DataFrame:
    return df.withColumn("fate", F.when(F.col("fate").isNull() & F.coalesce(condition, F.lit(False)), F.lit(fate)).otherwise(F.col("fate")))


def flag(name: str) -> Column:
    """A flag in a request's meta."""
    return F.lower(F.coalesce(F.try_element_at("meta", F.lit(name)), F.lit(""))).isin("true", "1")


class Middleware:
    """Any of the hooks. `joins`: its requests are written before the fetch, as they take joins."""

    joins = False

    def open(self, crawl: Crawl) -> None:
        self.crawl = crawl

    def process_request(self, requests: DataFrame, k: int) -> DataFrame:
        return requests

    def process_response(self, responses: DataFrame, k: int) -> DataFrame:
        """Rows with error_kind are failed downloads."""
        return responses

    def after(self, answers: DataFrame, k: int) -> None:
        """The round's answers, as they were written."""

    def close(self) -> None:
        pass


class RobotsTxt(Middleware):
    """Each site's file is asked for once, by the crawl's own fetcher."""

    joins = True

    def __init__(self, user_agent: str):
        self.user_agent, self.files = user_agent, None

    def process_request(self, requests: DataFrame, k: int) -> DataFrame:
        sites = requests.filter(urls.scheme("url").isin("http", "https")).select(urls.authority("url").alias("netloc"), "url").dropDuplicates(["netloc"])
        if self.files is not None:
            sites = sites.join(self.files.select("netloc"), "netloc", "left_anti")
        sites = sites.select("url", "netloc")
        got = robots_files(sites, self.crawl.fetch_pages)
        new = sites.join(got, "netloc", "left").select("netloc", "content")
        new = self.crawl.scratch.keep(new, f"robots/round={k}")
        self.files = new if self.files is None else self.files.unionByName(new)
        rules = robots.for_agent(robots.rules(self.files.filter("content IS NOT NULL")), self.user_agent)
        judged = robots.allowed(requests, rules)
        return fated(judged, ~F.col("allowed") & ~flag("dont_obey_robotstxt"), "forbidden").drop("allowed")


class DownloadTimeout(Middleware):
    """W3."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def process_request(self, requests: DataFrame, k: int) -> DataFrame:
        meta = F.coalesce("meta", F.create_map().cast("map<string,string>"))
        return requests.withColumn("meta", F.when(F.try_element_at(meta, F.lit("download_timeout")).isNull(), F.map_concat(meta, F.create_map(F.lit("download_timeout"), F.lit(str(self.seconds))))).otherwise(meta))


class DefaultHeaders(Middleware):
    """W1, W2."""

    def __init__(self, defaults: dict[str, str], user_agent: str | None = None):
        self.defaults, self.user_agent = defaults, user_agent

    def process_request(self, requests: DataFrame, k: int) -> DataFrame:
        return requests.withColumn("headers", downloader.with_defaults(F.col("headers"), self.defaults, self.user_agent))


class HttpAuth(Middleware):
    """The request's meta http_user and http_pass, else those of the settings."""

    def __init__(self, user: str, password: str, domain: str):
        self.user, self.password, self.domain = user, password, domain

    def process_request(self, requests: DataFrame, k: int) -> DataFrame:
        own = F.try_element_at("meta", F.lit("http_user"))
        user, word = F.coalesce(own, F.lit(self.user)), F.when(own.isNotNull(), F.coalesce(F.try_element_at("meta", F.lit("http_pass")), F.lit(""))).otherwise(F.lit(self.password))
        given = downloader.with_auth(F.coalesce("headers", F.create_map().cast(EMPTY)), F.col("url"), user, word)
        everywhere = own.isNotNull() if self.domain else F.lit(True)
        return requests.withColumn("headers", F.when(everywhere, given).otherwise(downloader.with_auth(F.coalesce("headers", F.create_map().cast(EMPTY)), F.col("url"), user, word, self.domain)))


class HttpProxy(Middleware):
    """Meta proxy, else the one of the scheme; credentials become a header."""

    def __init__(self, by_scheme: dict[str, str]):
        self.by_scheme = by_scheme

    def process_request(self, requests: DataFrame, k: int) -> DataFrame:
        address, word = downloader.proxy(F.try_element_at("meta", F.lit("proxy")), urls.scheme("url"), self.by_scheme)
        meta = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda n, _: n != "proxy")
        rows = requests.withColumns({"__proxy": address, "__word": word})
        meta = F.when(F.col("__proxy").isNotNull(), F.map_concat(meta, F.create_map(F.lit("proxy"), F.col("__proxy")))).otherwise(meta)
        return rows.withColumns({"meta": meta, "headers": set_header(F.col("headers"), "Proxy-Authorization", F.col("__word"))}).drop("__proxy", "__word")


class HttpCompression(Middleware):
    """Asks for what can be undone, and undoes it."""

    def process_request(self, requests: DataFrame, k: int) -> DataFrame:
        return requests.withColumn("headers", downloader.with_defaults(F.col("headers"), {"Accept-Encoding": "gzip, deflate"}))

    def process_response(self, responses: DataFrame, k: int) -> DataFrame:
        rows = responses.withColumn("__encoding", F.coalesce(H.first("response_headers", "content-encoding"), F.lit("")))
        out = downloader.decompressed(rows, "response_body", "__encoding", "method")
        others = F.map_filter("response_headers", lambda n, _: F.lower(n) != "content-encoding")
        left = F.when(F.col("__encoding") == "", others).otherwise(set_header(F.col("response_headers"), "Content-Encoding", F.col("__encoding")))
        return out.withColumn("response_headers", F.when(F.col("response_headers").isNotNull(), left)).drop("__encoding")


class Retry(Middleware):
    """By status and by error; meta dont_retry and max_retry_times."""

    def __init__(self, times: int, codes: tuple[int, ...], step: int):
        self.times, self.codes, self.step = times, codes, step

    def process_response(self, responses: DataFrame, k: int) -> DataFrame:
        rows = responses.withColumns({"max_retry_times": F.try_element_at("meta", F.lit("max_retry_times")).try_cast("int"), "dont_retry": flag("dont_retry")})
        judged = downloader.retries(rows, self.times, self.codes, error="error_kind")
        return fated(fated(judged, F.col("retry"), "retry"), F.col("gave_up") & F.col("error_kind").isNotNull(), "gave_up").drop("retry", "gave_up", "retry_reason", "max_retry_times", "dont_retry")


class Redirect(Middleware):
    """W8; meta dont_redirect. Answers that point nowhere, or too far, reach the spider."""

    def __init__(self, limit: int, step: int):
        self.limit, self.step = limit, step

    def process_response(self, responses: DataFrame, k: int) -> DataFrame:
        rows = responses.withColumn("location", H.first("response_headers", "location"))
        follows = downloader.redirected(F.col("status"), F.col("url"), F.col("location"), F.coalesce("redirect_times", F.lit(0)) + 1, self.limit)
        return fated(rows, follows & ~flag("dont_redirect"), "redirect")


class Cookies(Middleware):
    """A jar for each meta cookiejar; the request's own cookies go along and into the jar."""

    joins = True

    def __init__(self):
        self.jar: DataFrame | None = None

    def process_request(self, requests: DataFrame, k: int) -> DataFrame:
        rows = requests.withColumn("jar", F.coalesce(F.try_element_at("meta", F.lit("cookiejar")), F.lit("")))
        got = rows.withColumn("cookie", F.lit(None).cast("string")) if self.jar is None else downloader.with_cookies(rows, self.jar.withColumnRenamed("seq", "__seq"), "seq")
        own = F.array_join(F.transform(F.map_entries(F.coalesce("cookies", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
        line = F.concat_ws("; ", F.when(~flag("dont_merge_cookies"), F.col("cookie")), F.when(own != "", own))
        return got.withColumn("headers", set_header(F.col("headers"), "Cookie", F.when(line != "", line))).drop("jar", "cookie")

    def after(self, answers: DataFrame, k: int) -> None:
        sent = F.coalesce(H.every("response_headers", "set-cookie"), F.array().cast("array<string>"))
        own = F.transform(F.map_entries(F.coalesce("cookies", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        rows = answers.filter(~flag("dont_merge_cookies")).select(F.coalesce(F.try_element_at("meta", F.lit("cookiejar")), F.lit("")).alias("jar"), "url", "seq", F.concat(own, sent).alias("set_cookie")).filter(F.size("set_cookie") > 0)
        if rows.isEmpty():
            return
        self.jar = self.crawl.scratch.keep(downloader.set_cookies(self.jar, rows), f"jar/round={k}")


class DownloaderStats(Middleware):
    """W16."""

    def after(self, answers: DataFrame, k: int) -> None:
        fetched = answers.filter("fate IS NULL OR fate NOT IN ('forbidden', 'cached')")
        asked = fetched.select("method", F.coalesce(F.octet_length("body"), F.lit(0)).alias("bytes"))
        got = fetched.filter("status IS NOT NULL").select("status", F.coalesce(F.octet_length("response_body"), F.lit(0)).alias("bytes"), "latency_s")
        for r in downloader.transfer_stats(asked, got).filter("value IS NOT NULL").collect():
            self.crawl.stats.maximum(r["key"], r["value"]) if r["key"].endswith("max_download_time") else self.crawl.stats.inc(r["key"], r["value"])


class CachePolicy(Protocol):
    """Predicates over a round's columns; cached is a struct of status, headers, body and ts, or null."""

    def may_store(self, responses: DataFrame) -> Column: ...

    def is_fresh(self, now: float) -> Column: ...

    def still_valid(self) -> Column: ...


class DummyPolicy:
    """K4: everything is stored and fresh, but for some schemes and codes."""

    def __init__(self, schemes=("file",), codes=()):
        self.schemes, self.codes = tuple(schemes) or ("",), tuple(codes)

    def may_store(self, responses: DataFrame) -> Column:
        return cache.dummy_may_store(urls.scheme("url"), F.col("status"), self.schemes, self.codes)

    def is_fresh(self, now: float) -> Column:
        return F.lit(True)

    def still_valid(self) -> Column:
        return F.col("status") == 304


class Rfc2616Policy:
    """K5-K10."""

    def __init__(self, always: bool = False, schemes=("file",)):
        self.always, self.schemes = always, tuple(schemes) or ("",)

    def may_store(self, responses: DataFrame) -> Column:
        return ~urls.scheme("url").isin(*self.schemes) & cache.may_store(F.col("status"), F.col("response_headers"), F.col("headers"), self.always)

    def is_fresh(self, now: float) -> Column:
        return cache.is_fresh(F.col("cached.status"), F.col("cached.headers"), F.lit(int(now)), F.col("headers"))

    def still_valid(self) -> Column:
        return cache.still_valid(F.col("status"), F.col("cached.headers"))


class CacheStorage(Protocol):
    """Entries fp, status, headers, body, ts."""

    def read(self) -> DataFrame | None: ...

    def add(self, entries: DataFrame) -> None: ...


class ParquetStorage:
    """Parquet in a folder that later crawls read too."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch

    def read(self) -> DataFrame | None:
        return cache.stored(self.scratch.spark, self.scratch.path("entries")) if self.scratch.has("entries") else None

    def add(self, entries: DataFrame) -> None:
        cache.store(entries, self.scratch.path("entries"))


class HttpCache(Middleware):
    """Fresh entries answer; stale ones are asked for with their validators."""

    joins = True

    def __init__(self, policy: CachePolicy, storage: CacheStorage, now: float, expire: float = 0, missing: bool = False):
        self.policy, self.storage, self.now, self.expire, self.missing = policy, storage, now, expire, missing

    def process_request(self, requests: DataFrame, k: int) -> DataFrame:
        entries = self.storage.read()
        none = F.lit(None).cast("struct<status:int,headers:map<string,array<string>>,body:binary,ts:double>")
        if entries is None:
            rows = requests.withColumn("cached", none)
        else:
            entries = entries.select("fp", "status", "headers", "body", "ts")
            rows = cache.lookup(requests.withColumn("__not", flag("dont_cache")), entries, self.now, self.expire, dont_cache="__not").drop("__not")
        rows = fated(rows, F.col("cached").isNotNull() & self.policy.is_fresh(self.now), "cached")
        if self.missing:
            rows = fated(rows, F.col("cached").isNull(), "uncached")
        asks = F.col("cached").isNotNull() & F.col("fate").isNull()
        more = F.coalesce(cache.conditional(F.col("cached.headers")), F.create_map().cast("map<string,string>"))
        added = F.map_concat(F.coalesce("headers", F.create_map().cast(EMPTY)), F.map_from_entries(F.transform(F.map_entries(more), lambda e: F.struct(e["key"].alias("key"), F.array(e["value"]).alias("value")))))
        return rows.withColumn("headers", F.when(asks, added).otherwise(F.col("headers")))

    def process_response(self, responses: DataFrame, k: int) -> DataFrame:
        """An answer that says the entry holds, or an error, gives the entry in its place."""
        holds = F.col("cached").isNotNull() & (F.col("fate") == "cached")
        stands = F.col("cached").isNotNull() & F.col("fate").isNull() & (F.col("error_kind").isNotNull() | F.coalesce(self.policy.still_valid(), F.lit(False)))
        rows = responses.withColumn("__use", F.coalesce(holds | stands, F.lit(False))).withColumn("from_cache", F.when(stands, F.lit("revalidate")).when(holds, F.lit("hit")))
        use = F.col("__use")
        rows = rows.withColumns({"status": F.when(use, F.col("cached.status")).otherwise(F.col("status")), "response_headers": F.when(use, F.col("cached.headers")).otherwise(F.col("response_headers")), "response_body": F.when(use, F.col("cached.body")).otherwise(F.col("response_body")), "error_kind": F.when(~use, F.col("error_kind"))})
        return rows.withColumn("fate", F.when(~F.coalesce(holds, F.lit(False)), F.col("fate"))).drop("__use", "cached")

    def after(self, answers: DataFrame, k: int) -> None:
        new = answers.filter(F.col("from_cache").isNull() & F.col("status").isNotNull() & ~flag("dont_cache") & F.coalesce(self.policy.may_store(answers), F.lit(False)))
        rows = new.select("fp", "status", F.col("response_headers").alias("headers"), F.col("response_body").alias("body"), F.lit(float(self.now)).alias("ts"))
        counts = answers.groupBy(F.coalesce("from_cache", F.lit("miss")).alias("how")).count().collect()
        for r in counts:
            self.crawl.stats.inc(f"httpcache/{r['how']}", r["count"])
        if not rows.isEmpty():
            self.storage.add(rows)


def from_settings(settings, scratch: Scratch, user_agent: str, now: float) -> list[tuple[int, Middleware]]:
    """The base chain in the settings' order; what is switched off is left out."""
    on = settings.get_bool
    made = {
        "RobotsTxt": lambda: RobotsTxt(settings.get("ROBOTSTXT_USER_AGENT") or user_agent) if on("ROBOTSTXT_OBEY") else None,
        "DownloadTimeout": lambda: DownloadTimeout(settings.get_duration("DOWNLOAD_TIMEOUT")),
        "DefaultHeaders": lambda: DefaultHeaders(settings.get_dict("DEFAULT_REQUEST_HEADERS")),
        "HttpAuth": lambda: HttpAuth(settings.get("HTTP_USER"), settings.get("HTTP_PASS"), settings.get("HTTP_AUTH_DOMAIN")),
        "UserAgent": lambda: DefaultHeaders({}, user_agent),
        "Retry": lambda: Retry(settings.get_int("RETRY_TIMES"), tuple(int(x) for x in settings.get_list("RETRY_HTTP_CODES")), settings.get_int("RETRY_PRIORITY_ADJUST")) if on("RETRY_ENABLED") else None,
        "HttpCompression": lambda: HttpCompression() if on("COMPRESSION_ENABLED") else None,
        "Redirect": lambda: Redirect(settings.get_int("REDIRECT_MAX_TIMES"), settings.get_int("REDIRECT_PRIORITY_ADJUST")) if on("REDIRECT_ENABLED") else None,
        "Cookies": lambda: Cookies() if on("COOKIES_ENABLED") else None,
        "HttpProxy": lambda: HttpProxy(settings.get_dict("HTTP_PROXIES")) if on("HTTPPROXY_ENABLED") else None,
        "DownloaderStats": lambda: DownloaderStats() if on("DOWNLOADER_STATS") else None,
        "HttpCache": lambda: _http_cache(settings, scratch, now) if on("HTTPCACHE_ENABLED") else None,
    }
    places = settings.get_dict("DOWNLOADER_MIDDLEWARES_BASE") | settings.get_dict("DOWNLOADER_MIDDLEWARES")
    out = []
    for name in settings.components("DOWNLOADER_MIDDLEWARES"):
        if name in made and (m := made[name]()) is not None:
            out.append((places[name], m))
    return out


def _http_cache(settings, scratch: Scratch, now: float) -> HttpCache:
    schemes, codes = settings.get_list("HTTPCACHE_IGNORE_SCHEMES"), [int(x) for x in settings.get_list("HTTPCACHE_IGNORE_HTTP_CODES")]
    policy = Rfc2616Policy(settings.get_bool("HTTPCACHE_ALWAYS_STORE"), schemes) if settings.get("HTTPCACHE_POLICY") == "rfc2616" else DummyPolicy(schemes, codes)
    folder = settings.get("HTTPCACHE_DIR")
    place = folder if "/" in folder else scratch.path(folder)
    return HttpCache(policy, ParquetStorage(Scratch(scratch.spark, "httpcache", place)), now, settings.get_duration("HTTPCACHE_EXPIRATION_SECS"), settings.get_bool("HTTPCACHE_IGNORE_MISSING"))
