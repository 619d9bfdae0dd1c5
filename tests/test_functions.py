"""URL, header and HTML functions on literal rows."""

import pytest
from pyspark.sql import functions as F
from weftcrawl.functions import headers as H
from weftcrawl.functions import html as X
from weftcrawl.functions import urls as U


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v")).alias("x")).collect()]


def test_canonical(spark):
    cases = {
        "HTTP://EXAMPLE.com/Path": "http://example.com/Path",
        "http://example.com:80/": "http://example.com/",
        "https://example.com:443/": "https://example.com/",
        "http://example.com:8080/": "http://example.com:8080/",
        "http://example.com/?b=2&a=1": "http://example.com/?a=1&b=2",
        "http://example.com/?b=2&a=2&a=1&x": "http://example.com/?a=1&a=2&b=2&x=",
        "http://example.com/p#frag": "http://example.com/p",
        "http://example.com": "http://example.com/",
        "http://example.com/für x?q=a b*~": "http://example.com/f%C3%BCr%20x?q=a+b%2A~",
        "http://u:p@example.com/%7ea": "http://u:p@example.com/%7ea",
        "no url": "no url",
        None: None,
    }
    assert column(spark, cases, U.canonical) == list(cases.values())
    assert column(spark, ["http://a.com/x#f"], lambda c: U.canonical(c, keep_fragment=True)) == ["http://a.com/x#f"]


def test_parts(spark):
    urls = ["http://user@Sub.example.com:8080/a/b.tar.GZ?q#f", "example.com", "mailto:x", ""]
    assert column(spark, urls, U.host) == ["Sub.example.com", "", "", ""]
    assert column(spark, urls, U.authority)[0] == "Sub.example.com:8080"
    assert column(spark, urls, U.extension)[0] == ".gz"
    assert column(spark, urls, U.is_valid) == [True, False, False, False]
    assert column(spark, ["about:blank", "data:x", "http://a", "a/b"], U.has_scheme) == [True, True, True, False]
    assert column(spark, ["a.b.c"], U.suffixes) == [["a.b.c", "b.c", "c"]]
    assert column(spark, ["a.com", "http://a.com"], U.with_default_scheme) == ["https://a.com", "http://a.com"]


@pytest.mark.parametrize("ref,want", [("/c", "http://e.com/c"), ("d", "http://e.com/a/d"), ("../d", "http://e.com/d"), ("../../d", "http://e.com/d"), ("?q=1", "http://e.com/a/b?q=1"), ("#f", "http://e.com/a/b?x#f"), ("//h/x", "http://h/x"), ("https://z.org/ü", "https://z.org/%C3%BC"), ("", "http://e.com/a/b?x"), ("./", "http://e.com/a/"), ("g/./h/../i", "http://e.com/a/g/i"), ("mailto:x", "mailto:x"), (" /c ", "http://e.com/c")])
def test_join(spark, ref, want):
    assert column(spark, [ref], lambda c: U.join(F.lit("http://e.com/a/b?x"), c)) == [want]


def test_fingerprints(spark):
    known = "2e868ecb75ea7f727bc3491cbb6f0fd016357caf"
    a, b, c = column(spark, ["http://ththre.example.com/fr/825?page=2&ref=x", "http://ththre.example.com/fr/825?ref=x&page=2#top", "http://ththre.example.com/fr/826"], U.fingerprint)
    assert a == b == known != c
    df = spark.createDataFrame([("http://a/", "get", b"x", {"A": ["1"]}), ("http://a/", "POST", b"x", {"A": ["1"]}), ("http://a/", "GET", b"y", {"A": ["1"]}), ("http://a/", "GET", b"x", {"A": ["2"]})], "u string, m string, b binary, h map<string,array<string>>")
    assert df.select(U.fingerprint("u", "m", "b", "h").alias("x")).distinct().count() == 4


def test_headers(spark):
    assert column(spark, ["Text/HTML; charset='UTF-16'", "application/json", "image/png"], H.content_type) == ["text/html", "application/json", "image/png"]
    assert column(spark, ["text/html; charset=\"utf-16\"", "text/html"], H.charset) == ["utf-16", "utf-8"]
    assert column(spark, ["a=1; b=2;; =x; c; a=3"], H.cookies) == [{"a": "3", "b": "2"}]
    assert column(spark, ["Max-Age=60, no-Store, private=\"x\"", None], H.cache_control) == [{"max-age": "60", "no-store": "", "private": '"x"'}, {}]
    assert column(spark, [503, 418], H.reason, "int") == ["Service Unavailable", "HTTP 418"]
    assert column(spark, ["a.PNG", "b.tar.gz", "c"], H.mime_type) == ["image/png", "application/gzip", "application/octet-stream"]
    dates = ["Mon, 02 Jan 2006 15:04:05 GMT", "Mon, 2 Jan 2006 15:04:05 GMT", "Monday, 02-Jan-06 15:04:05 GMT", "Mon Jan  2 15:04:05 2006", "Mon, 02 Jan 2006 15:04:05 -0700", "soon", "", None]
    assert column(spark, dates, H.http_date) == [1136214245] * 4 + [1136214245 + 7 * 3600, None, None, None]
    df = spark.createDataFrame([({"A": ["1", "2"]}, {"A": ["3"], "B": ["4"]})], "a map<string,array<string>>, b map<string,array<string>>")
    r = df.select(H.merged("a", "b").alias("o"), H.merged("a", "b", False).alias("f"), H.flattened("a").alias("x"), H.first(F.col("a"), "a").alias("g"), H.response_bytes("a", F.lit("xyz")).alias("n")).first()
    assert r["o"] == {"A": ["3"], "B": ["4"]} and r["f"] == {"A": ["1", "2"], "B": ["4"]} and r["x"] == {"A": "1"} and r["g"] == "1"
    assert r["n"] == 15 + 2 * (1 + 2 + 1 + 2) + 2 + 3
    assert column(spark, ["u"], lambda c: H.basic_auth(c, F.lit("p"))) == ["Basic dTpw"]


QUOTES = """<html><body><div class="quote first"><span class="text">One &amp; only</span><span class="author">Albert Einstein</span><a class="tag" href="/t/a">a</a><a class="tag" href="/t/b">b</a></div>
<div class="quote"><span class="text">Two</span><span class="author">J.K. Rowling</span><a class="tag" href="/t/c">c</a><a class="tag" href="">d</a></div><li class="next"><a href="/page/2">Next</a></li><div id="empty"></div><p>x<p>y<b>z</p></body></html>"""


@pytest.mark.parametrize(
    "query,want",
    [
        ("span.text", ["One & only", "Two"]),
        ("div.quote span.author::text", ["Albert Einstein", "J.K. Rowling"]),
        ("div.quote > a.tag", ["a", "b", "c", "d"]),
        ("a::attr(href)", []),
        ("#empty", [""]),
        ("li.next a[href]", ["Next"]),
        ("a[href^='/t/'], li a", ["a", "b", "c", "Next"]),
        ("a[href$=b]", ["b"]),
        ("a[href*='age']", ["Next"]),
        ("[class~=first] span:first-child", ["One & only"]),
        ("div.quote:not(.first) span.text", ["Two"]),
        ("span.text + span", ["Albert Einstein", "J.K. Rowling"]),
        ("span.text ~ a", ["a", "b", "c", "d"]),
        ("a.tag:nth-child(4)", ["b", "d"]),
        ("p", ["x", "yz"]),
        ("div[", []),
        ("//div[@class='quote']/span[1]", ["Two"]),
        ("//div[contains(@class, \"quote\")]//a/@href", ["/t/a", "/t/b", "/t/c", ""]),
        ("//span[@class='author']/text()", ["Albert Einstein", "J.K. Rowling"]),
        ("//a[text()='Next']/ancestor::li[1]/@class", ["next"]),
        ("//div[span='Two']/a[last()]", ["d"]),
        ("//a[@href='/t/c' or @href='/t/a'][1]", ["a", "c"]),
        ("//nothing", []),
        ("//[", []),
    ],
)
def test_selectors(query, want):
    assert [x if isinstance(x, str) else x.text() for x in X._select(X.parse(QUOTES), query)] == want


def test_select_columns(spark):
    df = spark.createDataFrame([(1, QUOTES), (2, ""), (3, None)], "id int, html string")
    s = X.select("html", {"t": "span.text", "q": ["div.quote", "a"], "e": "#empty"}, markup=True)
    rows = df.select("id", s.alias("s")).select("id", X.get(F.col("s.t"), "none").alias("first"), X.get_all(F.col("s.t")).alias("all"), X.attr_all(F.col("s.q"), "href").alias("href"), F.get("s.q", F.lit(0))["html"].alias("html"), X.has_class(F.get("s.q", F.lit(0)), "tag").alias("tag"), X.get(F.col("s.e"), "d").alias("e")).orderBy("id").collect()
    assert rows[0]["first"] == "One & only" and rows[0]["all"] == ["One & only", "Two"] and rows[0]["href"] == ["/t/a", "/t/b", "/t/c", ""]
    assert rows[0]["html"] == '<a class="tag" href="/t/a">a</a>' and rows[0]["tag"] and rows[0]["e"] == "d"
    assert rows[1]["first"] == rows[2]["first"] == "none" and rows[2]["all"] == []


def test_tree_is_tolerant():
    page = X.parse("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><script>var t='</p>';</script><p>open <b>bold")
    assert [n.text() for n in page.walk() if n.tag == "li"] == ["a", "b"]
    assert [n.text() for n in page.walk() if n.tag == "td"] == ["1", "2", "3"]
    assert X.parse("<br/><img src=x>t").text() == "t"
    assert len(list(X.parse("<div>" * 3000).walk())) == 3000


FORM = """<form name=f1 action="/login" method="post"><input type=hidden name=csrf value=t><input name=user value=old><input type=password name=pw><input type=checkbox name=r checked><input type=checkbox name=no>
<select name=s><option value=1>a<option value=2 selected>b</select><select name=m multiple><option selected>x</option><option selected>y</option></select><textarea name=t>
hi</textarea><input type=submit name=go value=Go><button name=b value=B>b</button></form><form id=f2 action="?a=1#x"><input name=q value="x y"></form>"""


def test_forms():
    r = X.form_request(FORM, "http://e.com/p", {"user": ["new"]})
    assert (r["method"], r["url"]) == ("POST", "http://e.com/login")
    assert r["body"] == "csrf=t&go=Go&m=x&m=y&pw=&r=on&s=2&t=hi&user=new"
    assert X.form_request(FORM, "http://e.com/p", locator={"id": "f2"}) == {"method": "GET", "url": "http://e.com/p?q=x+y", "body": ""}
    assert "b=B" in X.form_request(FORM, "http://e.com/p", locator={"name": "f1"}, click={"name": "b"})["body"]
    assert "go=" not in X.form_request(FORM, "http://e.com/p", click=False)["body"]
    assert X.form_request(FORM, "http://e.com/p", locator={"xpath": "//input[@name='q']"})["url"].endswith("q=x+y")
    assert X.form_request(FORM, "http://e.com/p", locator={"number": 5}) is None
    assert X.form_request("", "http://e.com/") is None


def test_domains_of_any_number(spark):
    df = spark.createDataFrame([("http://a.e.com/",), ("http://e.com:8/",), ("http://notd.com/",), ("http://x.org/",), ("nothing",)], "url string")
    few, many = ["e.com", "d.com"], ["e.com", "d.com", *(f"d{i}.net" for i in range(50))]
    rows = df.select(U.in_domains("url", few).alias("a"), U.in_domains("url", many).alias("b"), U.in_domains("url", many, sub=False).alias("c")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] == [True, True, False, False, False]
    assert [r["c"] for r in rows] == [False, True, False, False, False]
