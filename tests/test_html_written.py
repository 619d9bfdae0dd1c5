"""Markup as it is written in a page, and the queries that take titles from it."""

import duckdb
from weftcrawl.functions import html as X
from weftcrawl.plans.more_queries import ORACLE, QUERIES

TITLES = ["a &amp; b", "cut &amp", "cut &am", "cut &", "say &quot;x&quot; &lt;", "&#65;&eacute;&nbsp;", "", "two\nlines\r\n&amp;amp;", "ünï 漢字 😀 &amp;"]
PAGES = [f"<!DOCTYPE html>\n<html lang=\"en\"><head><title>{t}</title></head><body><p>x</body></html>" for t in TITLES] + ["<p>none</p>", "", None]


def test_content_as_written():
    page = "<div id=a>1 &amp;amp <b>two</b>\n&lt;<img src=x>\n</div><ul><li>é&eacute;\n<li>y<p>z &am</ul><script>a && b</script><br/><i/><p>open &quot"
    root = X.parse(page, True)
    got = {(n.tag, page[slice(*n.content)]) for n in root.walk()}
    assert got == {
        ("div", "1 &amp;amp <b>two</b>\n&lt;<img src=x>\n"), ("b", "two"), ("img", ""), ("ul", "<li>é&eacute;\n<li>y<p>z &am"), ("li", "é&eacute;\n"),
        ("li", "y<p>z &am"), ("p", "z &am"), ("script", "a && b"), ("br", ""), ("i", ""), ("p", "open &quot"),
    }
    assert all(n.content is None for n in X.parse(page).walk())


def same(spark, tmp_path, name, *columns):
    pages = [(i, f"http://e.com/{i}", h) for i, h in enumerate(PAGES)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = {r[0]: r[1:] for r in c.sql(f"SELECT page_id, {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()}
    assert got == want and len(want) == len(PAGES)


def test_titles_with_references(spark, tmp_path):
    same(spark, tmp_path, "html_title", "title")


def test_values_with_references(spark, tmp_path):
    same(spark, tmp_path, "html_values", "hrefs", "texts", "n", "title", "ad")
