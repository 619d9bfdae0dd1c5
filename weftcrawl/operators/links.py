"""Link extraction (L1-L18): a projection of regular expressions where a page's anchors are plain, an HTML parse where they are not, and
predicates that Catalyst can push and reorder.

links(...) gives one row for each link: the carried columns, pos, href, url, text, fragment, nofollow.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls

# Extensions of files that are no pages, and schemes of links.
IGNORED_EXTENSIONS = (
    ".7z .7zip .bz2 .rar .tar .tar.gz .xz .zip "
    ".mng .pct .bmp .gif .jpg .jpeg .png .pst .psp .tif .tiff .ai .drw .dxf .eps .ps .svg .cdr .ico .webp "
    ".mp3 .wma .ogg .wav .ra .aac .mid .au .aiff "
    ".3gp .asf .asx .avi .mov .mp4 .mpg .qt .rm .swf .wmv .m4a .m4v .flv .webm "
    ".xls .xlsm .xlsx .xltm .xltx .potm .potx .ppt .pptm .pptx .pps .doc .docb .docm .docx .dotm .dotx .odt .ods .odg .odp "
    ".css .pdf .exe .bin .rss .dmg .iso .apk .jar .sh .rb .js .hta .bat .cpl .msi .msp .py"
).split()
LINK_SCHEMES = ("http", "https", "file", "ftp")


@dataclass(frozen=True)
class LinkRule:
    """What an extractor keeps. Patterns are searched for; those that do not compile are ignored."""

    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    allow_domains: tuple[str, ...] = ()
    deny_domains: tuple[str, ...] = ()
    deny_extensions: tuple[str, ...] = tuple(IGNORED_EXTENSIONS)
    restrict_text: tuple[str, ...] = ()
    restrict_css: tuple[str, ...] = ()
    restrict_xpath: tuple[str, ...] = ()
    tags: tuple[str, ...] = ("a", "area")
    attrs: tuple[str, ...] = ("href",)
    unique: bool = True
    canonicalize: bool = False
    strip_fragment: bool = True
    follow: bool = True
    callback: str | None = None
    extra: dict = field(default_factory=dict, hash=False, compare=False)


def _compiles(pattern: str) -> bool:
    """Patterns in the common dialect: no look-around and no back-reference."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        return False
    return not re.search(r"\(\?[=!<]|\\[1-9]", pattern)


def any_match(x: Column, patterns: tuple[str, ...]) -> Column | None:
    good = [p for p in patterns if _compiles(p)]
    if not good:
        return F.lit(False) if patterns else None
    out = x.rlike(good[0])
    for p in good[1:]:
        out = out | x.rlike(p)
    return out


def valid_link(url) -> Column:
    """L6."""
    return urls.scheme(url).isin(*LINK_SCHEMES)


def keep(rule: LinkRule, url="url", text="text") -> Column:
    """L6, L10-L14 as one predicate, cheap tests first."""
    u = urls._col(url)
    out = valid_link(u)
    if rule.deny_extensions:
        out = out & ~urls.extension(u).isin(*rule.deny_extensions)
    out = out & matches(rule, u)
    if rule.restrict_text:
        out = out & F.coalesce(any_match(urls._col(text), rule.restrict_text), F.lit(False))
    return out


def matches(rule: LinkRule, url="url") -> Column:
    """Domains, allow and deny only."""
    u = urls._col(url)
    out = F.lit(True)
    if rule.allow_domains:
        out = out & urls.in_domains(u, list(rule.allow_domains))
    if rule.deny_domains:
        out = out & ~urls.in_domains(u, list(rule.deny_domains))
    if (ok := any_match(u, rule.allow)) is not None:
        out = out & ok
    if (bad := any_match(u, rule.deny)) is not None:
        out = out & ~bad
    return out


def on_domains(df: DataFrame, domains: DataFrame, url: str = "url", domain: str = "domain", keep_them: bool = True) -> DataFrame:
    """L12 for a table of domains: hosts are exploded into their suffixes, so that it is an equi-join; no size limit.

    Rows on any of the domains, or with keep_them=False all others."""
    hosts = df.select(urls.host(url).alias("__host")).distinct()
    hit = hosts.withColumn("__d", F.explode(urls.suffixes("__host"))).join(domains.select(F.col(domain).alias("__d")).distinct(), "__d", "left_semi").select("__host").distinct()
    return df.withColumn("__host", urls.host(url)).join(hit, "__host", "left_semi" if keep_them else "left_anti").drop("__host")


_ANCHOR = r"(?is)<a\s[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'`=<]+))[^<>]*>([^<]*)</a\s*>"
#: What the expressions do not decide: other tags with links, elements whose content is no markup, other references than the five.
_HARD = r"(?is)<(?:area|base)\b|<a\s[^<>]*(?:[\w:.\-]href\b|=\s*(?:\"[^\"<>]*\bhref\b|'[^'<>]*\bhref\b))|<(title|textarea|noscript|iframe|template|xmp|noembed|noframes|svg|math|plaintext|select|frameset)\b[^>]*>[^<]*<a\b|<a(?:/|\s[^<>]*(?:<|\brel\s*=\s*[^\s\"'>]|\bhref\b[^>]*\bhref\b|/>))|&(?!amp;|lt;|gt;|quot;|#39;)[#A-Za-z]|<[^!/a-z\s]?!\[CDATA"
_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"


def plain(html) -> Column:
    """Every link of the page is an anchor with an href and text alone, so that anchors() gives what a parse gives."""
    h = F.regexp_replace(urls._col(html), _HIDDEN, "")
    return F.coalesce((F.regexp_count(h, F.lit(r"(?i)<a(?=[\s>/])")) == F.regexp_count(h, F.lit(_ANCHOR))) & ~h.rlike(_HARD) & ~h.rlike(r"(?i)<(!--|script\b|style\b)"), F.lit(True))


def anchors(html) -> Column:
    """L4, L8, L9 without a parse, for plain() pages: array of (pos, href, text, nofollow) in document order. Comments, scripts
    and styles are cut out first."""
    tags = F.regexp_extract_all(F.regexp_replace(urls._col(html), _HIDDEN, ""), F.lit(_ANCHOR), F.lit(0))
    found = F.transform(
        tags,
        lambda t: F.struct(
            _trim(entities(F.regexp_replace(t, "^" + _ANCHOR + "$", "$1$2$3"))).alias("href"),
            _trim(entities(F.regexp_replace(t, r"(?is)^<a\s[^>]*>|</a\s*>$", ""))).alias("text"),
            t.rlike(r"(?is)^<a\s[^>]*\brel\s*=\s*(\"([^\">]*\s)?nofollow(\s[^\">]*)?\"|'([^'>]*\s)?nofollow(\s[^'>]*)?')").alias("nofollow"),
        ),
    )
    return F.transform(F.filter(found, lambda x: x["href"] != ""), lambda x, i: F.struct(i.alias("pos"), x["href"].alias("href"), x["text"].alias("text"), x["nofollow"].alias("nofollow")))


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def entities(x: Column) -> Column:
    """The five named references and no more: the fast path's text."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return x


def base_url(html, url) -> Column:
    """L2: the first <base href>, resolved against the page's URL; else the URL."""
    href = F.regexp_extract(urls._col(html), r"(?is)<base\s[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    return F.when(href == "", urls._col(url)).otherwise(urls.join(url, href))


def resolved(found: DataFrame, base: str, rule: LinkRule, carry: list[str]) -> DataFrame:
    """Absolute URLs, fragments split off, the first of each URL of a page."""
    # an explode of one value: a name for it that filters are not pushed below, so that it is computed once
    df = found.withColumn("__full", F.explode(F.array(urls.join(base, "href")))).withColumns({"url": urls.without_fragment("__full") if rule.strip_fragment else F.col("__full"), "fragment": urls.fragment("__full")})
    df = df.filter(keep(rule))
    if rule.unique:
        key = urls.link_key("url") if rule.canonicalize else F.col("url")
        df = df.withColumn("__rn", F.row_number().over(W.partitionBy(*carry, key).orderBy("pos"))).filter("__rn = 1")
    return df.select(*carry, "pos", "href", "url", "text", "fragment", "nofollow")


def links(pages: DataFrame, rule: LinkRule = LinkRule(), url: str = "url", html: str = "html", carry: list[str] | None = None, parse: bool | None = None) -> DataFrame:
    """L1. Pages whose anchors are plain are read by expressions, the others by one parse each; both give the same rows. A rule with
    scopes (L3) or other tags and attributes (L18), or parse=True, has all pages parsed. Uniqueness is by page, so a page's links
    are told apart by the carried columns."""
    from ..functions.html import link_rows

    carry = carry or [url]
    own = rule.restrict_css or rule.restrict_xpath or tuple(rule.tags) != ("a", "area") or tuple(rule.attrs) != ("href",)
    if own or parse:
        found = pages.select(*carry, F.col(url).alias("__url"), F.explode(link_rows(html, rule)).alias("__a")).select(*carry, "__url", "__a.*")
        found = found.withColumn("__base", F.when(F.col("base") == "", F.col("__url")).otherwise(urls.join("__url", "base")))
    else:
        page = pages.select(*carry, F.col(url).alias("__url"), F.col(html).alias("__html"))
        # one value under one name, so that the page is looked at once
        page = page.withColumn("__plain", F.explode(F.array(plain("__html"))))
        page = page.withColumn("__hard", link_rows(F.when(~F.col("__plain"), F.col("__html")), rule))
        hard = F.transform("__hard", lambda x: F.struct(x["pos"].alias("pos"), x["href"].alias("href"), x["text"].alias("text"), x["nofollow"].alias("nofollow")))
        base = F.when(F.col("__plain") | (F.size("__hard") == 0), F.col("__url")).otherwise(F.when(F.get("__hard", F.lit(0))["base"] == "", F.col("__url")).otherwise(urls.join("__url", F.get("__hard", F.lit(0))["base"])))
        found = page.select(*carry, base.alias("__base"), F.explode(F.when(F.col("__plain"), anchors("__html")).otherwise(hard)).alias("__a")).select(*carry, "__base", "__a.*")
    if url in carry:
        found = found.withColumnRenamed(url, "src_url")
        carry = ["src_url" if c == url else c for c in carry]
    return resolved(found, "__base", rule, carry)


def parsed_links(pages: DataFrame, rule: LinkRule = LinkRule(), url: str = "url", html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """L1 with every page parsed."""
    return links(pages, rule, url, html, carry, parse=True)


class Extractor:
    """What any link extractor has, links of pages and a test of a URL; this one goes by a rule."""

    def __init__(self, rule: LinkRule = LinkRule()):
        self.rule = rule

    def extract(self, pages: DataFrame, carry: list[str]) -> DataFrame:
        """(the carried columns, of which url is src_url; pos, href, url, text, fragment, nofollow)."""
        return links(pages, self.rule, carry=carry)

    def matches(self, url: Column) -> Column:
        return matches(self.rule, url)


def by_rules(pages: DataFrame, rules: list[LinkRule], url: str = "url", html: str = "html", content_type: str | None = None, parse: bool = False, key: str = "page_id") -> DataFrame:
    """The links of all rules with the rule's number; of equal URLs of a page those of the first rule. Pages whose
    content type is known and no HTML give none."""
    if content_type:
        kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
        pages = pages.filter(F.col(content_type).isNull() | (F.col(content_type) == "") | kind.isin("text/html", "application/xhtml+xml"))
    out = None
    for k, rule in enumerate(rules):
        own = links(pages, rule, url, html, [key, url], parse=parse).withColumn("rule", F.lit(k))
        out = own if out is None else out.unionByName(own)
    first = F.row_number().over(W.partitionBy(key, "url").orderBy("rule", "pos"))
    return out.withColumn("__rn", first).filter("__rn = 1").drop("__rn")
