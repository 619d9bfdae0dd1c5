"""Predicates and projections over what a callback returns (M1-M12). Order: depth, length, referer, offsite, HTTP errors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

MAX_URL = 2083


def http_ok(status="status", allowed: list[int] | None = None, allow_all: bool = False, handle_all: Column | None = None, handle_list: Column | None = None) -> Column:
    """M1. A request's own list decides alone where it is given."""
    s = urls._col(status)
    out = F.when((s >= 200) & (s < 300), F.lit(True))
    if handle_all is not None:
        out = out.when(F.coalesce(handle_all, F.lit(False)), F.lit(True))
    if handle_list is not None:
        out = out.when(handle_list.isNotNull(), F.array_contains(handle_list, s))
    return out.otherwise(F.lit(True) if allow_all else s.isin(*(allowed or [-1])))


def ignored_counts(responses: DataFrame, ok: Column, status: str = "status") -> DataFrame:
    """M2: (key, value) of all that are ignored and of each status."""
    n = responses.filter(~ok).rollup(status).agg(F.count("*").alias("value"))
    key = F.when(F.col(status).isNull(), F.lit("httperror/response_ignored_count")).otherwise(F.concat(F.lit("httperror/response_ignored_status_count/"), F.col(status).cast("string")))
    return n.select(key.alias("key"), "value").filter("value > 0")


def child_depth(parent="depth") -> Column:
    """M3."""
    return F.coalesce(urls._col(parent), F.lit(0)) + 1


def within_depth(depth: Column, limit: int = 0) -> Column:
    return F.lit(True) if limit <= 0 else depth <= limit


def depth_priority(priority: Column, depth: Column, step: int) -> Column:
    """M4."""
    return priority - depth * step


def depth_counts(requests: DataFrame, depth: str = "depth") -> DataFrame:
    """M5: (key, value) of each depth and the largest, in one pass."""
    by = requests.groupBy(depth).agg(F.count("*").alias("n"))
    each = by.select(F.concat(F.lit("request_depth_count/"), F.col(depth).cast("string")).alias("key"), F.col("n").alias("value"))
    return each.unionByName(by.agg(F.max(depth).cast("long").alias("value")).select(F.lit("request_depth_max").alias("key"), "value"))


def short_enough(url="url", limit: int = MAX_URL) -> Column:
    """M6, in bytes."""
    return F.lit(True) if limit <= 0 else F.octet_length(urls._col(url)) <= limit


def clean_domains(domains: list[str]) -> list[str]:
    """M8: entries that are URLs or have ports are no domains."""
    return [d for d in domains if d and not re.match(r"^https?://", d) and ":" not in d]


def on_site(url="url", domains: list[str] | None = None, dont_filter: Column | None = None, allow_offsite: Column | None = None) -> Column:
    """M7. With no valid domain all are on site; without a host none is."""
    good = clean_domains(domains or [])
    if not good:
        return F.lit(True)
    h = urls.host(url)
    out = h.rlike("^(.*\\.)?(" + "|".join(re.escape(d) for d in good) + ")$") & (h != "")
    for flag in (dont_filter, allow_offsite):
        if flag is not None:
            out = out | F.coalesce(flag, F.lit(False))
    return out


def offsite_counts(requests: DataFrame, ok: Column, url: str = "url") -> DataFrame:
    """M9."""
    n = requests.filter(~ok).agg(F.count("*").alias("a"), F.count_distinct(urls.host(url)).alias("b"))
    return n.select(F.explode(F.create_map(F.lit("offsite/filtered"), "a", F.lit("offsite/domains"), "b")).alias("key", "value"))


def referer(page="src_url", target="url", current: Column | None = None) -> Column:
    """The page without fragment and user info; none from local pages or from https to http."""
    p, t = urls._col(page), urls._col(target)
    bare = F.regexp_replace(urls.without_fragment(p), r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/?#@]*@", "$1")
    out = F.when(urls.scheme(p).isin("http", "https") & ~((urls.scheme(p) == "https") & (urls.scheme(t) == "http")), bare)
    return out if current is None else F.coalesce(current, out)


class OutputMiddleware:
    """Hooks over whole DataFrames; each returns what passes on."""

    def process_input(self, responses: DataFrame) -> DataFrame:
        return responses

    def process_requests(self, requests: DataFrame) -> DataFrame:
        return requests

    def process_items(self, items: DataFrame) -> DataFrame:
        return items

    def process_errors(self, errors: DataFrame) -> DataFrame | None:
        """None: not handled here; a frame, empty or not, ends the search."""
        return None


def through(middlewares: list[tuple[int, OutputMiddleware]], kind: str, df: DataFrame) -> DataFrame | None:
    """Input in ascending priority; requests, items and errors in descending."""
    for _, m in sorted(middlewares, key=lambda x: x[0], reverse=kind != "input"):
        if kind == "errors":
            out = m.process_errors(df)
            if out is not None:
                return out
        else:
            df = getattr(m, f"process_{kind}")(df)
    return None if kind == "errors" else df
