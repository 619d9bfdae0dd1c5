"""Whole crawls: a local site over HTTP with robots, cookies, encodings, redirects and errors; rules; jobs that are taken up again."""

import gzip
import json
import threading
import zlib
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from weftcrawl.functions import html as X
from weftcrawl.operators import crawl, export, filters, items, links, middleware, requests
from weftcrawl.operators.downloader import undo
from weftcrawl.plans import extensions, settings, signals
from weftcrawl.sources import http

QUIET = {"STATS_DUMP": False, "ROBOTSTXT_OBEY": False, "COOKIES_ENABLED": False, "COMPRESSION_ENABLED": False, "HTTPPROXY_ENABLED": False, "DOWNLOADER_STATS": False}


@pytest.fixture(scope="module")
def site():
    """(address, Counter of what was asked for, list of (path, headers))."""
    asked, seen = Counter(), []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status, body=b"", headers=()):
            self.send_response(status)
            for k, v in headers:
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        def do_GET(self):
            path = self.path
            asked[path] += 1
            seen.append((path, dict(self.headers.items())))
            page = lambda *to: ("<html>" + "".join(f'<a href="{t}">to <b>{t}</b></a>' for t in to) + "</html>").encode()
            html = ("Content-Type", "text/html; charset=utf-8")
            if path == "/robots.txt":
                self.answer(200, b"User-agent: *\nDisallow: /private\n")
            elif path == "/":
                self.answer(200, page("/login", "/private/a", "/gz", "/flaky", "/moved", "/gone", "/item/1"), [html])
            elif path == "/login":
                self.answer(200, page("/dashboard"), [html, ("Set-Cookie", "session=s1; Path=/"), ("Set-Cookie", "theme=dark; Path=/other")])
            elif path == "/dashboard":
                ok = "session=s1" in self.headers.get("Cookie", "")
                self.answer(200 if ok else 403, page("/item/2"), [html])
            elif path == "/gz":
                self.answer(200, gzip.compress(page("/item/3")), [html, ("Content-Encoding", "gzip")])
            elif path == "/flaky":
                self.answer(503 if asked[path] < 3 else 200, page("/item/4"), [html])
            elif path == "/moved":
                self.answer(302, b"", [("Location", "/item/5?from=moved")])
            elif path == "/etag":
                same = self.headers.get("If-None-Match") == '"v1"'
                self.answer(304 if same else 200, b"" if same else b"kept", [("ETag", '"v1"'), ("Cache-Control", "max-age=0"), html])
            elif path.startswith("/item/"):
                self.answer(200, f"<h1>item {path[6:]}</h1>".encode(), [html])
            else:
                self.answer(404)

        def do_POST(self):
            body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
            asked[f"POST {self.path} {body.decode()}"] += 1
            self.answer(200, b"posted " + body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked, seen
    server.shutdown()


class Shop(crawl.RuleSpider):
    name = "shop"
    rules = (
        crawl.Rule(links.Extractor(links.LinkRule(allow=(r"/item/",))), callback="item", cb_kwargs={"kind": "thing"}),
        crawl.Rule(process_request=lambda r: r.filter("url NOT LIKE '%/gone'")),
    )

    def __init__(self, address):
        self.start_urls = (f"{address}/",)
        self.allowed_domains = ("127.0.0.1",)

    def callbacks(self):
        return {"item": self.item}

    def item(self, responses, kind):
        title = X.get(X.select(F.col("response_body").cast("string"), {"t": "h1"})["t"])
        return crawl.Out(responses.select(title.alias("title"), F.lit(kind).alias("kind"), "link_text"))


def test_crawl_over_http(spark, site, tmp_path):
    """Robots, cookies, encodings, retries, redirects, rules, stages, feeds, extensions and signals in one run."""
    address, asked, seen = site
    sent, stages = Counter(), []
    c = crawl.Crawl(spark, Shop(address), http.fetcher(timeout=20), {"DOWNLOAD_DELAY": 0, "STATS_DUMP": False, "FEEDS": {f"{tmp_path}/%(name)s": {"format": "jsonlines"}}, "USER_AGENT": "tester/1"})
    c.add_stage(items.Stage("no fours", drop=F.col("title").contains("4"), opened=lambda: stages.append("open"), closed=lambda: stages.append("close")))
    for s in signals.Signal:
        c.signals.connect(s, lambda _s=s, **kw: sent.update([_s]))
    out = {(r["url"].removeprefix(address), r["status"]) for r in c.run().collect()}
    assert out >= {("/", 200), ("/dashboard", 200), ("/gz", 200), ("/flaky", 503), ("/flaky", 200), ("/moved", 302), ("/item/5?from=moved", 200)}
    assert asked["/robots.txt"] == 1 and asked["/private/a"] == 0 and asked["/gone"] == 0 and asked["/flaky"] == 3
    titles = {r["title"]: r for r in c.scraped().collect()}
    assert set(titles) == {"item 1", "item 2", "item 3"}
    assert titles["item 1"]["kind"] == "thing" and titles["item 1"]["link_text"] == "to"
    by = dict(seen)
    assert by["/dashboard"]["Cookie"] == "session=s1" and by["/dashboard"]["Referer"] == f"{address}/login"
    assert by["/gz"]["User-Agent"] == "tester/1" and "gzip" in by["/gz"]["Accept-Encoding"] and by["/gz"]["Accept-Language"] == "en"
    got = c.stats.all()
    assert got["finish_reason"] == "finished" and got["retry/count"] == 2 and got["robotstxt/forbidden"] == 1 and got["item_dropped_count"] == 1
    assert got["item_scraped_count"] == 3 and got["downloader/response_status_count/503"] == 2 and got["request_depth_max"] == 3
    assert got["feedexport/success_count"] == 1 and {r["title"] for r in spark.read.json(f"{tmp_path}/shop").collect()} == set(titles)
    assert stages == ["open", "close"]
    assert all(sent[s] == 1 for s in (signals.Signal.ENGINE_STARTED, signals.Signal.SPIDER_OPENED, signals.Signal.SPIDER_CLOSED, signals.Signal.ENGINE_STOPPED, signals.Signal.SPIDER_IDLE))
    assert sent[signals.Signal.ITEM_DROPPED] == 1 and sent[signals.Signal.RESPONSE_RECEIVED] == c.rounds


def test_requests_are_carried_whole(spark, site):
    """Equal URLs of different method or body are different requests; callbacks, meta and errbacks come back with the answers."""
    address, asked, _ = site
    rows = [requests.request(f"{address}/form", method="POST", body=b, callback="posted", meta={"n": b}) for b in ("a=1", "a=2", "a=1")]
    rows += [requests.request(f"{address}/nowhere", errback="lost"), requests.request("http://127.0.0.1:9/", errback="lost", meta={"max_retry_times": 0}), requests.request(f"{address}/item/9", callback=requests.NO_CALLBACK)]

    class Poster(crawl.Spider):
        def start(self, spark):
            return requests.frame(spark, rows)

        def parse(self, responses):
            return crawl.Out(responses.select(F.lit("parse").alias("by"), F.col("url").alias("x")))

        def callbacks(self):
            return {"posted": lambda r: crawl.Out(r.select(F.lit("posted").alias("by"), F.concat_ws("|", r.meta["n"], r.response_body.cast("string")).alias("x")))}

        def errbacks(self):
            return {"lost": lambda r: crawl.Out(r.select(F.lit("lost").alias("by"), F.coalesce(F.col("error_kind"), F.col("status").cast("string")).alias("x")))}

    c = crawl.Crawl(spark, Poster(), http.fetcher(timeout=20), QUIET)
    c.run()
    assert {(r["by"], r["x"]) for r in c.scraped().collect()} == {("posted", "a=1|posted a=1"), ("posted", "a=2|posted a=2"), ("lost", "404"), ("lost", "connection_refused")}
    assert asked["POST /form a=1"] == asked["POST /form a=2"] == 1 and c.stats.get("dupefilter/filtered") == 1


def test_cache_revalidates(spark, site, tmp_path):
    address, asked, _ = site
    folder, clock = f"{tmp_path}/cache", [1_700_000_000.0]

    class One(crawl.Spider):
        start_urls = (f"{address}/etag",)

        def parse(self, responses):
            return crawl.Out(responses.select(F.col("response_body").cast("string").alias("body"), "from_cache"))

    def go(policy):
        c = crawl.Crawl(spark, One(), http.fetcher(timeout=20), QUIET | {"HTTPCACHE_ENABLED": True, "HTTPCACHE_POLICY": policy, "HTTPCACHE_DIR": folder}, now=lambda: clock[0])
        c.run()
        return [tuple(r) for r in c.scraped().collect()]

    assert go("rfc2616") == [("kept", None)]
    clock[0] += 10
    before = asked["/etag"]
    assert go("rfc2616") == [("kept", "revalidate")] and asked["/etag"] == before + 1
    assert go("dummy") == [("kept", "hit")] and asked["/etag"] == before + 1


def chain(spark, n=6):
    pages = [(f"http://e.com/{i}", [f"/{i + 1}", f"/{i + 2}", "/0"]) for i in range(n)]
    df = spark.createDataFrame(pages, "url string, links array<string>")

    class Walk(crawl.Spider):
        start_urls = ("http://e.com/0",)
        allowed_domains = ("e.com",)

        def parse(self, responses):
            to = responses.select(F.col("url").alias("src_url"), "depth", F.explode("links").alias("href"))
            return crawl.Out(responses.select("url"), to.select("src_url", "depth", F.concat(F.lit("http://e.com"), "href").alias("url")))

    return Walk(), crawl.table_fetcher(df)


@pytest.mark.parametrize("admit", [0, 1])
def test_jobs_are_taken_up_again(spark, tmp_path, admit):
    """Any number of pauses gives what one run gives, and no page is fetched again."""
    spider, fetch = chain(spark, 4 if admit else 5)
    whole = crawl.Crawl(spark, spider, fetch, QUIET, admit=admit)
    want = sorted(map(tuple, whole.run().collect()))
    rounds, last = 0, None
    for _ in range(20):
        limit = iter([False, False, True])
        last = crawl.Crawl(spark, spider, fetch, QUIET, folder=f"{tmp_path}/job", paused=lambda it=limit: next(it), admit=admit)
        got = sorted(map(tuple, last.run().collect()))
        assert last.rounds > rounds or last.reason == "finished"
        rounds = last.rounds
        if last.reason == "finished":
            break
    assert got == want and last.reason == "finished"
    assert sorted(r["url"] for r in last.scraped().collect()) == sorted(r["url"] for r in whole.scraped().collect())
    assert last.stats.get("scheduler/enqueued") == whole.stats.get("scheduler/enqueued") and last.frontier.peek() is None and len(last.frontier) == 0


def test_limits_idle_and_errors(spark):
    spider, fetch = chain(spark)
    c = crawl.Crawl(spark, spider, fetch, QUIET | {"CLOSESPIDER_PAGECOUNT": 2})
    c.run()
    assert c.reason == c.stats.get("finish_reason") == "closespider_pagecount" and c.rounds == 2
    clock = iter(range(0, 10_000, 100))
    c = crawl.Crawl(spark, spider, fetch, QUIET | {"CLOSESPIDER_TIMEOUT": "2m"}, now=lambda: next(clock))
    c.run()
    assert c.reason == "closespider_timeout"

    class Again(type(spider)):
        closings: list = []

        def idle(self, rounds):
            return requests.seeds(spark, ["http://e.com/5"]) if rounds < 8 else None

        def closed(self, reason):
            self.closings.append(reason)

    c = crawl.Crawl(spark, Again(), fetch, QUIET)
    again = c.run().filter("url = 'http://e.com/5'").count()
    assert again > 1 and Again.closings == ["finished"]

    class Stops(type(spider)):
        def parse(self, responses):
            raise crawl.CloseCrawl("enough")

    c = crawl.Crawl(spark, Stops(), fetch, QUIET)
    c.run()
    assert c.reason == "enough" and c.rounds == 1

    class Fails(type(spider)):
        def parse(self, responses):
            raise ZeroDivisionError

    c, seen = crawl.Crawl(spark, Fails(), fetch, QUIET), []
    c.signals.connect(signals.Signal.SPIDER_ERROR, lambda error, **_: seen.append(type(error)))
    with pytest.raises(ZeroDivisionError):
        c.run()
    assert seen == [ZeroDivisionError] and c.reason == "failed"


def test_own_parts(spark):
    """Middlewares of both kinds, extensions and feeds that a user adds."""
    spider, fetch = chain(spark, 3)

    class Stamp(middleware.Middleware):
        def process_request(self, requests, k):
            return requests.withColumn("headers", middleware.set_header(F.col("headers"), "X-Round", F.lit(str(k))))

    class No2(filters.OutputMiddleware):
        def process_requests(self, rows):
            return rows.filter("url NOT LIKE '%/2'")

    class Watch(extensions.Extension):
        log: list = []

        def open(self, crawl):
            self.log.append("open")

        def close(self):
            self.log.append("close")

    class Off(extensions.Extension):
        def open(self, crawl):
            raise signals.NotConfigured

        def close(self):
            raise AssertionError

    c = crawl.Crawl(spark, spider, fetch, QUIET | {"DOWNLOADER_MIDDLEWARES": {"Retry": None}})
    assert not any(isinstance(m, middleware.Retry) for _, m in c.downloads)
    c.add_downloader_middleware(Stamp(), 10).add_spider_middleware(No2(), 10).add_extension(Watch()).add_extension(Off())
    assert {r["url"] for r in c.run().collect()} == {"http://e.com/0", "http://e.com/1"} | {"http://e.com/3"}
    assert {r["h"][0] for r in c.answers().filter("round = 2").select(F.col("headers")["X-Round"].alias("h")).collect()} == {"2"}
    assert Watch.log == ["open", "close"]


def test_rules_choose_the_first_and_mind_the_type(spark):
    html = '<a href="/x">one</a><a href="/y">two</a>'
    pages = spark.createDataFrame([("http://e.com/", html, {"Content-Type": ["text/html"]}), ("http://e.com/pdf", html, {"Content-Type": ["application/pdf"]})], "url string, html string, headers map<string,array<string>>")

    class Two(crawl.RuleSpider):
        start_urls = ("http://e.com/", "http://e.com/pdf")
        rules = (crawl.Rule(links.Extractor(links.LinkRule(allow=("/x",))), callback="a"), crawl.Rule(callback="b", process_links=lambda d: d.filter("text <> 'none'")))

        def callbacks(self):
            return {n: lambda r, _n=n: crawl.Out(r.select(F.lit(_n).alias("by"), "url", "status")) for n in "ab"}

        def parse_start_url(self, responses):
            return crawl.Out(responses.select(F.lit("start").alias("by"), "url", "status"))

        def process_results(self, responses, out):
            return crawl.Out(out.items.withColumn("seen", F.lit(1)), out.requests)

    assert crawl.Rule().follows() and not crawl.Rule(callback="a").follows() and crawl.Rule(callback="a", follow=True).follows()
    c = crawl.Crawl(spark, Two(), crawl.table_fetcher(pages), QUIET | {"HTTPERROR_ALLOW_ALL": True})
    c.run()
    assert {(r["by"], r["url"][12:], r["seen"]) for r in c.scraped().collect()} == {("start", "/", 1), ("start", "/pdf", 1), ("a", "/x", 1), ("b", "/y", 1)}


def test_bodies_are_undone_within_a_bound():
    body = b"x" * 100_000
    two = gzip.compress(body[:10]) + gzip.compress(body[10:20])
    raw = zlib.compressobj(wbits=-15)
    assert undo(two, ["gzip"]) == body[:20] and undo(zlib.compress(body), ["deflate"]) == body
    assert undo(raw.compress(body) + raw.flush(), ["deflate"]) == body
    assert undo(gzip.compress(body), ["gzip"], 99_999) is None and undo(gzip.compress(body)[:-20], ["gzip"]) is None and undo(b"junk", ["gzip"]) is None


def test_feeds_from_settings(tmp_path):
    s = settings.Settings({"FEEDS": {"a": {"format": "csv", "overwrite": True}}})
    assert [(f.uri, f.format, f.overwrite) for f in export.feeds_from(s)] == [("a", "csv", True)]
    assert export.feeds_from(settings.Settings({"FEED_URI": "x", "FEED_FORMAT": "json"}))[0].format == "json"
    with pytest.raises(ValueError):
        export.feeds_from(settings.Settings({"FEED_URI": "x"}))
    (tmp_path / "s.toml").write_text('closespider_pagecount = 3\n[feeds."out"]\nformat = "jsonlines"\n')
    s.load(tmp_path / "s.toml", "cmdline")
    assert s.get_int("CLOSESPIDER_PAGECOUNT") == 3 and json.dumps(s["FEEDS"]) == '{"out": {"format": "jsonlines"}}'


def test_settings_of_a_spider():
    assert settings.typed({"OWN": 1}, retry_times=5, download_delay="500ms", robotstxt_obey=False, user_agent=None) == {"OWN": 1, "RETRY_TIMES": 5, "DOWNLOAD_DELAY": 0.5, "ROBOTSTXT_OBEY": False}
    for bad in ({"no_such": 1}, {"retry_times": True}, {"robotstxt_obey": 1}, {"user_agent": 3}):
        with pytest.raises(TypeError):
            settings.typed(**bad)

    class Own(crawl.Spider):
        custom_settings = settings.typed(retry_times=5)

    assert settings.Settings({"RETRY_TIMES": 9}, "cmdline").priority("RETRY_TIMES") > settings.PRIORITIES["spider"]
