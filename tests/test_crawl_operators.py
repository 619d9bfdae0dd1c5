"""Links, queues, filters, robots, downloads, cache, items, feeds, settings, signals and the crawl loop on literal rows."""

import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F
from weftcrawl.functions import urls as U
from weftcrawl.operators import cache, crawl, downloader, export, filters, frontier, items, links, requests, robots, stats
from weftcrawl.plans import runner, settings, signals

PAGE = """<html><body><a href="/page/1#s">Page 1</a><a href="/page/1">again</a><a rel="x NoFollow" href="https://other.com/p">o</a><a href="mailto:x">m</a><a href="/a.PDF">pdf</a>
<!-- <a href="/hidden">h</a> --><area href="/area"><div class=content><a href="/in"><b>nested</b> text</a></div><a href="javascript:0">j</a><a href=" ">e</a><img src="/i.html"></body></html>"""


def urls_of(spark, page=PAGE, parse=True, **rule):
    df = spark.createDataFrame([("https://example.com/x/", page)], "url string, html string")
    get = links.parsed_links if parse else links.links
    return get(df, links.LinkRule(**rule)).orderBy("pos").collect()


def test_links(spark):
    got = urls_of(spark)
    assert [r["url"] for r in got] == ["https://example.com/page/1", "https://other.com/p", "https://example.com/area", "https://example.com/in"]
    assert got[0]["fragment"] == "s" and got[0]["text"] == "Page 1" and got[1]["nofollow"] and got[3]["text"] == "text"
    fast = urls_of(spark, parse=False, tags=("a",))
    assert [r["url"] for r in fast] == [r["url"] for r in urls_of(spark, tags=("a",))]
    assert len(urls_of(spark, unique=False)) == 5
    assert [r["url"] for r in urls_of(spark, strip_fragment=False)][0].endswith("#s")
    assert [r["url"] for r in urls_of(spark, restrict_css=("div.content",))] == ["https://example.com/in"]
    assert [r["url"] for r in urls_of(spark, restrict_xpath=("//div[@class='content']",))] == ["https://example.com/in"]
    assert len(urls_of(spark, restrict_css=("div.none",))) == 4
    assert [r["url"] for r in urls_of(spark, tags=("img",), attrs=("src",))] == ["https://example.com/i.html"]
    assert [r["url"] for r in urls_of(spark, allow=(r"/page/\d+", "["))] == ["https://example.com/page/1"]
    assert len(urls_of(spark, deny=("/page/",))) == 3 and len(urls_of(spark, allow=("(",))) == 0
    assert [r["url"] for r in urls_of(spark, allow_domains=("other.com",))] == ["https://other.com/p"]
    assert len(urls_of(spark, deny_domains=("other.com",))) == 3
    assert [r["text"] for r in urls_of(spark, restrict_text=("^Page",))] == ["Page 1"]
    based = PAGE.replace("<html>", '<html><base href="http://b.org/d/">')
    assert urls_of(spark, based)[0]["url"] == urls_of(spark, based, parse=False)[0]["url"] == "http://b.org/page/1"
    assert urls_of(spark, None) == [] and urls_of(spark, "") == [] and urls_of(spark, "", parse=False) == []


def test_rules_and_domains(spark):
    pages = spark.createDataFrame([(1, "http://e.com/", '<a href="/a">a</a><a href="/b">b</a>', "text/html; x"), (2, "http://e.com/j", '<a href="/a">a</a>', "application/json")], "page_id int, url string, html string, ct string")
    got = links.by_rules(pages, [links.LinkRule(allow=("/a",)), links.LinkRule()], content_type="ct")
    assert sorted((r["page_id"], r["url"], r["rule"]) for r in got.collect()) == [(1, "http://e.com/a", 0), (1, "http://e.com/b", 1)]
    df = spark.createDataFrame([("http://a.b.com/",), ("http://xb.com/",), ("http://c.org/",), (None,)], "url string")
    d = spark.createDataFrame([("b.com",)], "domain string")
    assert [r[0] for r in links.on_domains(df, d).collect()] == ["http://a.b.com/"]
    assert len(links.on_domains(df, d, keep_them=False).collect()) == 3


def test_frontier(spark):
    r = spark.createDataFrame([(1, "a", False), (2, "a", False), (3, "a", True), (4, "b", False), (5, "c", False), (6, "a", True)], "seq int, fp string, dont_filter boolean")
    for n in (1, 3):
        got = frontier.first_seen(r.repartition(n), spark.createDataFrame([("c",)], "fp string"))
        assert sorted(x["seq"] for x in got.collect()) == [1, 3, 4, 6]
    again = frontier.first_seen(got)
    assert sorted(x["seq"] for x in again.collect()) == [1, 3, 4, 6]
    assert sorted(x["fp"] for x in frontier.extended(None, got).collect()) == ["a", "b"]
    q = spark.createDataFrame([(1, 5), (2, 10), (3, 1), (4, 10)], "seq int, priority int")
    assert [x["seq"] for x in frontier.next_requests(q, 3).collect()] == [4, 2, 1]
    s = spark.createDataFrame([("h", i, 0, float(a)) for i, a in enumerate([0, 1, 10, 10])], "slot string, seq int, priority int, arrival double")
    assert [x["start_s"] for x in frontier.start_times(s, 3.0, arrival="arrival").orderBy("seq").collect()] == [0.0, 3.0, 10.0, 13.0]
    assert [x["seq"] for x in frontier.admitted(s, 2, 10).collect()] == [3, 2]
    b = frontier.within_budget(s.withColumn("n", F.lit(10)), F.col("n"), 2048)
    assert sorted(x["seq"] for x in b.collect()) == [0, 1]


def test_filters(spark):
    df = spark.createDataFrame([(200, None), (404, None), (500, None), (404, [404]), (200, [500]), (302, [404])], "status int, l array<int>")
    ok = [r[0] for r in df.select(filters.http_ok(allowed=[500], handle_list=F.col("l"))).collect()]
    assert ok == [True, False, True, True, True, False]
    u = spark.createDataFrame([("http://a.example.com/",), ("http://example.com.evil/",), ("http://Example.com/",), ("x",)], "url string")
    assert [r[0] for r in u.select(filters.on_site("url", ["example.com", "http://z", "q:1"])).collect()] == [True, False, False, False]
    assert all(r[0] for r in u.select(filters.on_site("url", [])).collect())
    p = spark.createDataFrame([("https://u:p@a.com/x#f", "https://b/"), ("https://a.com/", "http://b/"), ("file:///x", "http://b/")], "src_url string, url string")
    assert [r[0] for r in p.select(filters.referer()).collect()] == ["https://a.com/x", None, None]
    long = spark.createDataFrame([("http://a/" + "é" * 1100,), ("http://a/",)], "url string")
    assert [r[0] for r in long.select(filters.short_enough()).collect()] == [False, True]

    class Half(filters.OutputMiddleware):
        def process_requests(self, df):
            return df.limit(1)

        def process_errors(self, df):
            return df.limit(0)

    assert filters.through([(1, Half()), (2, filters.OutputMiddleware())], "requests", u).count() == 1
    assert filters.through([(1, filters.OutputMiddleware())], "errors", u) is None and filters.through([(1, Half())], "errors", u).count() == 0


ROBOTS_CASES = [("/admin/page", "/admin/", True), ("/admin", "/admin/", False), ("/admin/", "/admin/", True), ("/public", "/admin/", False), ("/file.json", "/*.json$", True), ("/file.json.bak", "/*.json$", False), ("/search/result", "/search*result", True), ("/", "/", True), ("/anything", "/", True), ("/a.json.json", "/*.json$", False), ("/x", "/x*", True), ("/axb", "/*a*b$", True)]


def test_robots_patterns(spark):
    df = spark.createDataFrame(ROBOTS_CASES, "path string, pattern string, want boolean")
    for r in df.withColumn("got", robots.path_matches(F.col("path"), F.col("pattern"))).collect():
        assert r["got"] == r["want"], r


def test_robots(spark):
    files = spark.createDataFrame([("e.com", "User-agent: *\nDisallow: /search*result # c\nDisallow: /*.json$\nDisallow:\nAllow: /search/ok/result\n\nUser-agent: bad\nUser-agent: worse\nDisallow: /"), ("f.com", "Disallow: /x")], "netloc string, content string")
    asked = ["http://e.com/search/result", "http://e.com/data.json", "http://e.com/data.json.bak", "http://e.com/search", "http://e.com/search/ok/result", "http://e.com", "http://g.com/x", "http://f.com/x"]
    r = spark.createDataFrame([(u,) for u in asked], "url string")
    rules = robots.rules(files)
    got = {x["url"]: x["allowed"] for x in robots.allowed(r, robots.for_agent(rules, "weft")).collect()}
    assert [got[u] for u in asked] == [False, False, True, True, True, True, True, False]
    assert not any(x["allowed"] for x in robots.allowed(r.filter("url LIKE '%e.com%'"), robots.for_agent(rules, "Very-Worse/2")).collect())


def test_retry_redirect_cookies(spark):
    df = spark.createDataFrame([(1, 503, 0, None, None), (2, 503, 2, None, None), (3, 200, 0, None, None), (4, 503, 2, 5, None), (5, 503, 0, None, True)], "id int, status int, retry_times int, max_retry_times int, dont_retry boolean").withColumns({"priority": F.lit(0), "dont_filter": F.lit(False)})
    judged = downloader.retries(df)
    assert [r["id"] for r in judged.filter("retry").orderBy("id").collect()] == [1, 4]
    assert [r["id"] for r in judged.filter("gave_up").collect()] == [2]
    again = downloader.retry_requests(judged).orderBy("id").first()
    assert again["retry_times"] == 1 and again["dont_filter"] and again["priority"] == -1
    assert {r["key"]: r["value"] for r in downloader.retry_counts(judged).collect()} == {"retry/count": 2.0, "retry/count/Service Unavailable": 2.0, "retry/max_reached": 1.0}
    rows = [("http://a/x", 302, "/y", "POST", 0), ("http://a/x", 303, "http://b/", "PUT", 0), ("http://a/x", 307, "ftp://c/", "GET", 0), ("http://a/x", 308, "z", "POST", 20), ("http://a/x", 301, "z", "GET", 10)]
    r = spark.createDataFrame(rows, "url string, status int, location string, method string, redirect_times int").withColumns({"redirect_urls": F.lit(None).cast("array<string>"), "priority": F.lit(0), "dont_filter": F.lit(False), "headers": F.expr("map('Cookie', array('c'), 'X', array('1'))"), "body": F.lit(b"b")})
    got = downloader.redirects(r).collect()
    assert [(x["url"], x["method"], sorted(x["headers"])) for x in got] == [("http://a/y", "GET", ["Cookie", "X"]), ("http://b/", "GET", ["X"]), ("http://a/z", "GET", ["Cookie", "X"])]
    assert len(downloader.redirects(r, mode="reference").collect()) == 2
    c = spark.createDataFrame([("j", "http://www.e.com/a/b", ["k=1; Path=/; Domain=e.com", "s=2; Secure", "h=3; Path=/a"], 1), ("j", "http://www.e.com/", ["k=9; Path=/; Domain=.e.com", "bad", "z=1; Domain=other.com"], 2), ("j", "http://www.e.com/a/b", ["h=; Path=/a; Max-Age=0"], 3)], "jar string, url string, set_cookie array<string>, seq int")
    jar = downloader.set_cookies(None, c)
    q = spark.createDataFrame([(1, "j", "http://e.com/"), (2, "j", "https://www.e.com/a/c"), (3, "k", "http://e.com/")], "id int, jar string, url string")
    assert [r["cookie"] for r in downloader.with_cookies(q, jar).orderBy("id").collect()] == ["k=9", "s=2; k=9", None]


def test_decompression(spark):
    raw = b"hello " * 100
    flate = zlib.compressobj(wbits=-15)
    rows = [(1, gzip.compress(raw), "gzip"), (2, flate.compress(raw) + flate.flush(), "deflate"), (3, b"broken", "gzip"), (4, raw, ""), (5, gzip.compress(raw), "br, gzip"), (6, b"", "gzip"), (7, raw, None), (8, zlib.compress(raw), "deflate")]
    out = {r["id"]: (bytes(r["body"]), r["content_encoding"]) for r in downloader.decompressed(spark.createDataFrame(rows, "id int, body binary, content_encoding string")).collect()}
    assert out == {1: (raw, ""), 2: (raw, ""), 3: (b"broken", "gzip"), 4: (raw, ""), 5: (raw, "br"), 6: (b"", "gzip"), 7: (raw, None), 8: (raw, "")}
    assert downloader.undo(gzip.compress(raw), ["gzip"], 10) is None


def test_request_defaults(spark):
    df = spark.createDataFrame([({"accept": ["x"]},), (None,)], "h map<string,array<string>>")
    got = [r[0] for r in df.select(downloader.with_defaults(F.col("h"), {"Accept": "y"}, "ua")).collect()]
    assert got == [{"accept": ["x"], "User-Agent": ["ua"]}, {"Accept": ["y"], "User-Agent": ["ua"]}]
    a = df.limit(1).select(downloader.with_auth(F.col("h"), F.lit("http://s.e.com/"), F.lit("u"), F.lit("p"), "e.com").alias("x")).first()["x"]
    assert a["Authorization"] == ["Basic dTpw"]
    p, w = downloader.proxy(F.lit(None).cast("string"), F.lit("http"), {"http": "http://u:p@proxy:1"})
    assert tuple(df.limit(1).select(p, w).first()) == ("http://proxy:1", "Basic dTpw")


def test_cache(spark):
    now = 784_111_777 + 100  # 100 s after Sun, 06 Nov 1994 08:49:37 GMT
    date = ["Sun, 06 Nov 1994 08:49:37 GMT"]
    rows = [
        (1, 200, {"Date": date, "Expires": ["Sun, 06 Nov 1994 09:49:37 GMT"]}),
        (2, 200, {"Date": date, "Last-Modified": ["Sat, 05 Nov 1994 22:49:37 GMT"]}),
        (3, 301, {"Date": date}),
        (4, 200, {"Date": date, "Cache-Control": ["max-age=50"], "Age": ["7"]}),
        (5, 200, {"Date": date, "Cache-Control": ["no-store, max-age=5"]}),
        (6, 200, {"Date": date}),
        (7, 200, {"Date": date, "Expires": ["0"]}),
    ]
    df = spark.createDataFrame(rows, "id int, status int, h map<string,array<string>>")
    s, h, t = F.col("status"), F.col("h"), F.lit(now)
    out = df.select("id", cache.freshness(s, h, t).alias("f"), cache.age(h, t).alias("a"), cache.is_fresh(s, h, t).alias("fresh"), cache.may_store(s, h).alias("store"), cache.is_fresh(s, h, t, F.expr("map('Cache-Control', array('max-stale'))")).alias("stale")).orderBy("id").collect()
    assert [r["f"] for r in out] == [3600.0, 3600.0, 31536000.0, 50.0, 5.0, 0.0, 0.0]
    assert {r["a"] for r in out} == {100.0}
    assert [r["fresh"] for r in out] == [True, True, True, False, False, False, False]
    assert [r["store"] for r in out] == [True, True, True, True, False, False, True]
    assert all(r["stale"] for r in out)
    r = spark.createDataFrame([("a",), ("b",), ("c",)], "fp string")
    e = spark.createDataFrame([("a", 1.0, 200), ("a", 5.0, 304), ("b", 1.0, 200)], "fp string, ts double, status int")
    found = {x["fp"]: x["cached"] and x["cached"]["status"] for x in cache.lookup(r, e, now=8.0, expire=4.0).collect()}
    assert found == {"a": 304, "b": None, "c": None}
    none = cache.lookup(r.withColumn("no", F.lit(True)), e, dont_cache="no").filter("cached IS NOT NULL")
    assert none.count() == 0
    v = spark.createDataFrame([(304, {"A": ["b"]}), (500, {"Cache-Control": ["must-revalidate"]}), (200, None)], "status int, h map<string,array<string>>")
    assert [x[0] for x in v.select(cache.outcome(F.col("status"), F.col("h"), F.lit(True))).collect()] == ["revalidate", "invalidate", "store"]


def test_cache_storage(spark, tmp_path):
    e = spark.createDataFrame([("aa1", 1.0), ("bb2", 2.0)], "fp string, ts double")
    cache.store(e, str(tmp_path / "c"))
    cache.store(e.limit(0), str(tmp_path / "c"))
    assert [r["fp"] for r in cache.stored(spark, str(tmp_path / "c"), e.limit(1)).collect()] in (["aa1"], ["bb2"])


def test_items(spark):
    schema = items.schema_of({"title": (str, "title,required"), "price": (float, "price,required"), "n": (int, "n,default=8080"), "author": (str, "author,default=Unknown"), "secret": (str, "-"), "bad": (int, "bad,default=x")})
    df = items.frame(spark, [{"title": "a", "price": 1.0}, {"title": "", "price": 0.0, "n": 5, "author": "b", "more": 1}, object()], schema)
    out = items.validated(df).collect()
    assert out[0]["n"] == 8080 and out[0]["author"] == "Unknown" and out[0]["errors"] == ["bad: invalid default"]
    assert out[1]["errors"] == ["title is required", "price is required", "bad: invalid default"] and out[1]["n"] == 5
    assert items.parse_tag("a, b=c,d") == ("a", {"b": "c", "d": "true"})
    assert items.adapt({1: 2}) is None
    opened = []
    with pytest.raises(ValueError):
        items.life([items.Stage("a", priority=1, opened=lambda: opened.append("a"), closed=lambda: opened.append("A")), items.Stage("b", priority=2, opened=lambda: (_ for _ in ()).throw(ValueError()))], lambda: 1)
    assert opened == ["a", "A"]


def test_feeds(spark, tmp_path):
    df = spark.createDataFrame([("Alice", 30, ["x", "y"], 1.5e-7), ('B"o,b', None, None, 2.0)], "name string, age int, tags array<string>, f double").coalesce(1)
    assert export.document(df.select("name", "age"), "csv", export.Feed("-")) == 'name,age\nAlice,30\n"B""o,b",\n'
    assert export.document(df.select("age"), "csv", export.Feed("-", header=False)) == "30\n\n"
    got = json.loads(export.document(df, "json", export.Feed("-")))
    assert got[1] == {"name": 'B"o,b', "age": None, "tags": None, "f": 2.0}
    xml = export.document(df.select("name", "tags"), "xml", export.Feed("-"))
    assert "<item><name>Alice</name><tags><value>x</value><value>y</value></tags></item>" in xml and "<tags></tags>" in xml
    many = spark.range(1000).repartition(4).select("id", F.lit("<&>").alias("t"))
    for kind in ("json", "xml"):
        path = f"{tmp_path}/out.{kind}"
        assert export.write(many, export.Feed(path, kind))["items"] == 1000
        text = open(path).read()
        if kind == "json":
            assert sorted(x["id"] for x in json.loads(text)) == list(range(1000))
        else:
            import xml.etree.ElementTree as ET

            assert len(ET.fromstring(text)) == 1000
    assert export.write(many.limit(0), export.Feed(f"{tmp_path}/none", "csv", store_empty=False)) == {"items": 0}
    assert json.loads(export.document(many.limit(0), "json", export.Feed("-"))) == []
    counts = export.fan_out(many, [export.Feed(f"{tmp_path}/a", "jl", where=F.col("id") < 10), export.Feed(f"{tmp_path}/b", "nope"), export.Feed(f"{tmp_path}/c", "csv", fields=["t", "zz"])])
    assert counts[f"feedexport/items_count/{tmp_path}/a"] == 10 and counts["feedexport/failed_count"] == 1 and counts["feedexport/success_count"] == 2
    assert export.expand("%(name)s/%(batch_id)d-%(x)s-%(time)s", "n", 0, x="q") == "n/1-q-1970-01-01T00-00-00"
    assert export.target("-")[0] == "stdout" and export.target("file:///a")[1] == "/a"
    assert [r["f"] for r in export.flat(df).collect()] == ["0.00000015", "2"]


def test_requests(spark):
    r = requests.request("http://a/", method="post", meta={"d": 1}, body="x")
    assert r["method"] == "POST" and requests.from_dict(requests.to_dict(r)) == r
    assert requests.to_dict(requests.request("http://a/")) == {"url": "http://a/"}
    with pytest.raises(ValueError):
        requests.request("a")
    c = requests.from_curl("curl 'http://a/x' -H 'A: b' -b 'k=v; z' -d 'q=1' -d r=2 --unknown v -u u:p -A ua")
    assert c["method"] == "POST" and c["body"] == b"q=1&r=2" and c["cookies"] == {"k": "v"} and c["headers"]["User-Agent"] == ["ua"]
    assert requests.from_curl(requests.to_curl(c))["body"] == c["body"]
    assert requests.from_curl("wget x") is None and requests.from_curl("curl a.com")["url"] == "http://a.com"
    assert requests.form_request("http://a/?x=1", {"b": ["2", "3"], "a": "1"}, "GET")["url"] == "http://a/?x=1&a=1&b=2&b=3"
    assert json.loads(requests.json_request("http://a/", {"x": 1})["body"]) == {"x": 1}
    kind, body = requests.multipart({"a": "b"}, {"f": ("n.txt", b"data", "text/plain")})
    assert kind.split("=")[1].encode() in body and body == requests.multipart({"a": "b"}, {"f": ("n.txt", b"data", "text/plain")})[1]
    assert requests.replaced(r, url="http://b/")["url"] == "http://b/"
    assert requests.frame(spark, [r, c]).count() == 2
    assert [x["url"] for x in requests.seeds(spark, ["http://a/", "b"]).collect()] == ["http://a/"]


def test_stats(spark):
    e = spark.createDataFrame([(i, "GET" if i % 3 else "POST", float(i)) for i in range(9)], "seq int, m string, v double")
    assert {r["key"]: r["value"] for r in stats.counters(e, "n", "m").collect()} == {"n": 9.0, "n/GET": 6.0, "n/POST": 3.0}
    u = stats.until(e, ["seq"], {"itemcount": (F.col("m") == "POST", 2)})
    assert [r["seq"] for r in u.orderBy("seq").collect()] == [0, 1, 2, 3]
    assert u.filter("close_reason IS NOT NULL").first()["close_reason"] == "closespider_itemcount"
    s = spark.createDataFrame([("elapsed_time_seconds", 30.0), ("response_received_count", 10.0)], "key string, value double")
    assert {r["key"]: r["value"] for r in stats.final_rates(s).collect()} == {"responses_per_minute": 20.0, "items_per_minute": 0.0}


def test_settings(tmp_path, monkeypatch):
    s = settings.Settings({"A": "1"}, "project")
    s.set("A", "2", "default")
    assert s.get_int("A") == 1
    s.set("A", "3", "cmdline")
    assert s.get_int("A") == 3 and s.get_bool("RETRY_ENABLED") and s.get_list("HTTPCACHE_IGNORE_SCHEMES") == ["file"]
    assert settings.duration("1h2m3.5s") == 3723.5 and settings.duration(5) == 5.0 and settings.duration("2") == 2.0
    s.set("SPIDER_MIDDLEWARES", {"Referer": -1, "Mine": 10})
    assert s.components("SPIDER_MIDDLEWARES") == ["Mine", "HttpError", "Offsite", "UrlLength", "Depth"]
    path = tmp_path / "weftcrawl.toml"
    path.write_text('depth_limit = 3\nlog_level = "INFO"\n')
    monkeypatch.chdir(tmp_path)
    assert s.autoload() and s.get_int("DEPTH_LIMIT") == 3
    frozen = s.freeze()
    with pytest.raises(TypeError):
        s.set("A", 1)
    with pytest.raises(TypeError):
        frozen["A"] = 1


def test_signals_and_runner(spark):
    m, seen = signals.Manager(), []
    n = m.connect(signals.Signal.ITEM_SCRAPED, lambda item: seen.append(item))
    m.connect(signals.Signal.ITEM_SCRAPED, lambda item: 1 / 0)
    assert len(m.send(signals.Signal.ITEM_SCRAPED, item=1)) == 1 and seen == [1]
    assert m.disconnect(signals.Signal.ITEM_SCRAPED, n) and m.count(signals.Signal.ITEM_SCRAPED) == 1

    def stay(**_):
        raise signals.DontClose

    assert m.may_close()
    m.connect(signals.Signal.SPIDER_IDLE, stay)
    assert not m.may_close()
    assert runner.Runner(spark).add("a", lambda: spark.range(3).count()).add("b", lambda: 2).run() == {"a": 3, "b": 2}
    with pytest.raises(ExceptionGroup):
        runner.Runner(spark).add("a", lambda: 1 / 0).add("b", lambda: 2).run(concurrent=False)


def test_crawl(spark):
    site = {"/": ["/a", "/b", "http://out.com/"], "/a": ["/c", "/"], "/b": ["/r", "/bad"], "/c": ["/d"], "/d": ["/e"], "/e": []}
    pages = [(f"http://e.com{p}", 200, None, to) for p, to in site.items()] + [("http://e.com/r", 302, "/d", []), ("http://e.com/bad", 503, None, [])]
    df = spark.createDataFrame(pages, "url string, status int, location string, links array<string>")

    def follow(ok):
        return ok.select(F.col("url").alias("src_url"), "depth", F.explode("links").alias("href")).withColumn("url", U.join("src_url", "href")).select("src_url", "depth", "url")

    def go(parts, settings=None, **more):
        spider = crawl.Follow(requests.seeds(spark, ["http://e.com/"]), follow, items=lambda ok: ok.select("url", F.size("links").alias("n")), domains=["e.com"])
        return crawl.Crawl(spark, spider, crawl.table_fetcher(df.repartition(parts)), settings or {}, **more)

    results = []
    for parts in (1, 3):
        c = go(parts)
        results.append(sorted(map(tuple, c.run().collect())))
        assert c.reason == "finished" and {r["url"] for r in c.scraped().collect()} == {f"http://e.com{p}" for p in site}
    assert results[0] == results[1]
    depth = {}
    for url, _, d, *_ in results[0]:
        depth.setdefault(url.removeprefix("http://e.com"), []).append(d)
    assert {k: min(v) for k, v in depth.items()} == {"/": 0, "/a": 1, "/b": 1, "/c": 2, "/r": 2, "/bad": 2, "/d": 2, "/e": 3}
    assert len(depth["/bad"]) == 3
    # the seed passes the filter, so that the link back to it is new
    assert c.stats.get("retry/count") == 2 and c.stats.get("item_scraped_count") == 7 and c.stats.get("request_depth_max") == 3
    assert c.stats.get("scheduler/enqueued") == c.stats.get("scheduler/dequeued") == len(results[0])
    assert {r["url"] for r in go(2, {"DEPTH_LIMIT": 1}).run().collect()} == {"http://e.com/", "http://e.com/a", "http://e.com/b"}
    c = go(2, round_limit=1)
    assert c.run().count() == 1 and c.reason == "closespider_rounds"
    assert go(2, paused=lambda: True).run().count() == 0


def test_streams(spark, tmp_path):
    from weftcrawl.streaming import crawl_streams

    rows = [("2024-01-01 00:00:01", "http://a/1", 0.0), ("2024-01-01 00:00:02", "http://a/1#x", 0.5), ("2024-01-01 00:01:01", "http://a/2", 10.0), ("2024-01-01 02:00:00", "http://b/1", 10.5)]
    spark.createDataFrame(rows, "t string, url string, arrival_s double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t string, url string, arrival_s double").parquet(f"{tmp_path}/in").withColumn("ts", F.to_timestamp("t"))
    for name, df in (("rates", crawl_streams.rates(stream)), ("seen", crawl_streams.first_seen(stream).select("url")), ("polite", crawl_streams.polite(stream, 2.0))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("rates").collect()) == [1, 2]
    assert sorted(r["url"][:10] for r in spark.table("seen").collect()) == ["http://a/1", "http://a/2", "http://b/1"]
    assert sorted((r["slot"], r["start_s"]) for r in spark.table("polite").collect()) == [("a", 0.0), ("a", 2.0), ("a", 10.0), ("b", 10.5)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


PIECES = [
    '<a href="/a">plain</a>', "<a href='/b?x=1&amp;y=2'>t &lt;i&gt;</a>", "<a class=x href=/c>bare</a>", '<a href="/d">one <b>two</b></a>', '<a href="/e">open ', "<a>none</a>", "<A HREF='/F'>caps</A >",
    '<!-- <a href="/no">no</a> -->', '<script>var s = "<a href=\'/no\'>no</a>";</script>', "<style>a{}</style>", '<area href="/area">', '<a href=" /sp ">  pad　</a>', '<a href="">empty</a>', "<a href>bare</a>",
    '<a data-href="/no">no</a>', '<a title="href=/no" href="/g">g</a>', '<a title="a>b" href="/h">h</a>', '<a rel="nofollow" href="/i">i</a>', '<a href="/j" rel="x nofollow y">j</a>', "<a rel=nofollow href=/k>k</a>",
    '<a rel="notnofollow" href="/l">l</a>', "<title>t <a href='/no'>no</a></title>", '<textarea><a href="/no">no</a></textarea>', '<a href="/m">a &copy; b</a>', '<a href="/n">a & b</a>', "<p>text", "<br/>", '<a href="/o"/>self', '<a href="/p" href="/q">two</a>',
    "<svg><a href='/r'>r</a></svg>", '<a href="/s">x</a><a href="/s">again</a>', "<abbr>no</abbr>", "<article>no</article>", '<a\nhref="/u">line\nbreak</a>', "<a href=/v>v<a href=/w>w</a>", '<base href="/deep/x">',
]


def test_links_by_expression_are_those_of_a_parse(spark):
    import random

    rng = random.Random(6)
    pages = [(i, "http://e.com/x/", p) for i, p in enumerate(PIECES)] + [(100 + i, "http://e.com/x/", " ".join(rng.choices(PIECES[:7] if i % 2 else PIECES, k=rng.randint(2, 5)))) for i in range(160)]
    pages += [(400, "http://e.com/", None), (401, "http://e.com/", "")]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    for rule in (links.LinkRule(unique=False), links.LinkRule(restrict_text=("^[a-z]",))):
        fast, slow = ({tuple(r) for r in links.links(df, rule, carry=["page_id", "url"], parse=p).drop("src_url").collect()} for p in (None, True))
        assert fast == slow and len(fast) > 100
    assert df.filter(links.plain("html")).count() > 40


def test_rules_with_scopes_tags_and_attributes(spark):
    html = '<div class="main"><a href="/in">in</a><img src="/pic"></div><div id="side"><a href="/out" rel="nofollow">out</a><link href="/feed"></div>'
    df = spark.createDataFrame([("http://e.com/", html)], "url string, html string")
    get = lambda **r: [x["url"].removeprefix("http://e.com") for x in links.links(df, links.LinkRule(**r)).orderBy("pos").collect()]
    assert get() == ["/in", "/out"] and get(restrict_css=(".main",)) == ["/in"] and get(restrict_xpath=('//div[@id="side"]',)) == ["/out"]
    assert get(tags=("img", "link"), attrs=("src", "href")) == ["/pic", "/feed"]
    assert [r["url"][12:] for r in links.by_rules(df.withColumn("page_id", F.lit(1)), [links.LinkRule(restrict_css=("#side",))]).collect()] == ["/out"]
    assert links.Extractor(links.LinkRule(restrict_css=(".main",))).extract(df, ["url"]).count() == 1


def test_pages_of_any_depth(spark):
    from weftcrawl.functions import html as X

    deep = "<div>" * 3000 + "<p class='k'>end</p>" + "</div>" * 3000
    df = spark.createDataFrame([(deep,), ("<p>a&b<script>1<2</script></p>",)], "html string")
    rows = df.select(X.select("html", {"p": "p", "d": "div"}, markup=True).alias("s")).collect()
    assert rows[0]["s"]["p"][0]["text"] == "end" and rows[0]["s"]["d"][0]["html"].count("<div>") == 3000 and rows[0]["s"]["p"][0]["html"] == '<p class="k">end</p>'
    assert rows[1]["s"]["p"][0]["html"] == "<p>a&amp;b<script>1<2</script></p>"
    assert df.select(X.select("html", {"d": "div"}).alias("s")).first()["s"]["d"][0]["html"] is None


def test_running_totals_over_a_whole_table(spark):
    """Without groups, sums and limits are those of one ordered sequence, though no task has all of it."""
    import random

    rng = random.Random(4)
    rows = [(i, rng.randint(0, 3000), rng.random() < 0.1) for i in range(400)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "seq int, size int, bad boolean").repartition(5)
    got = {r["seq"]: r["active_before"] for r in frontier.within_budget(df, F.col("size"), 10**9).collect()}
    total = 0
    for seq, size, _ in rows:
        assert got[seq] == total
        total += max(size, 1024)
    assert frontier.within_budget(df, F.col("size"), 5000).count() == sum(1 for v in got.values() if v < 5000)
    errors = [seq for seq, _, bad in rows if bad]
    out = stats.until(df, ["seq"], {"errorcount": (F.col("bad"), 3), "pagecount": (F.lit(True), 1000)}).orderBy("seq").collect()
    assert [r["seq"] for r in out] == list(range(errors[2] + 1)) and out[-1]["close_reason"] == "closespider_errorcount" and out[0]["close_reason"] is None
    plan = stats.until(df, ["seq"], {"errorcount": (F.col("bad"), 3)})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_queues_jitter_and_stores(spark):
    q = spark.createDataFrame([(1, 5), (2, 9), (3, 5)], "seq int, priority int")
    get = lambda **k: [r["seq"] for r in frontier.next_requests(q, 2, **k).collect()]
    assert get() == [2, 3] and get(priority=None) == [3, 2] and get(priority=None, fifo=True) == [1, 2]
    df = spark.createDataFrame([("a", i, 0.0) for i in range(50)] + [("b", 1, 7.0)], "slot string, seq int, at double")
    starts = [r["start_s"] for r in frontier.start_times(df, 2.0, jitter=True, arrival="at").orderBy("slot", "seq").collect()]
    gaps = [b - a for a, b in zip(starts[:50], starts[1:50], strict=False)]
    assert starts[0] == 0.0 and starts[50] == 7.0 and all(1.0 <= g <= 3.0 for g in gaps) and len(set(gaps)) > 20
    kept = []
    export.STORES["mem"] = lambda rows, feed: kept.append((feed.uri, rows.count()))
    try:
        assert export.write(df, export.Feed("mem://x", "jsonlines"))["items"] == 51 and kept == [("mem://x", 51)]
        assert export.fan_out(df, [export.Feed("mem://%(name)s"), export.Feed("/x", "none")], "s")["feedexport/error//x"].startswith("ValueError")
    finally:
        export.STORES.clear()
