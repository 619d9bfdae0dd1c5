"""Header, status and size functions as Column expressions (F9-F17, F20, F21, F24, F25). Headers: map of name to array of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import _col

# Reasons of retried statuses, types by extension, patterns of HTTP dates.
REASONS = {400: "Bad Request", 408: "Request Timeout", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout", 522: "Connection Timed Out", 524: "A Timeout Occurred"}
MIME_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".svg": "image/svg+xml",
    ".bmp": "image/bmp",
    ".ico": "image/x-icon",
    ".pdf": "application/pdf",
    ".zip": "application/zip",
    ".gz": "application/gzip",
    ".tar": "application/x-tar",
    ".json": "application/json",
    ".xml": "application/xml",
    ".html": "text/html",
    ".htm": "text/html",
    ".css": "text/css",
    ".js": "application/javascript",
    ".txt": "text/plain",
    ".csv": "text/csv",
    ".mp3": "audio/mpeg",
    ".mp4": "video/mp4",
    ".avi": "video/x-msvideo",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
DATE_FORMATS = ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "EEE, dd MMM yyyy HH:mm:ss zzz", "EEE, dd MMM yyyy HH:mm:ss xx", "EEE, d MMM yyyy HH:mm:ss 'GMT'", "EEEE, dd-MMM-yy HH:mm:ss 'GMT'", "EEE MMM d HH:mm:ss yyyy")
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def first(headers, name: str) -> Column:
    """The first value of a header, its name in any case; null where it is missing."""
    hit = F.filter(F.map_entries(_col(headers)), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(F.get(hit, F.lit(0))["value"], F.lit(0))


def every(headers, name: str) -> Column:
    """All values of a header, whatever its case; null where it is missing."""
    found = F.map_filter(_col(headers), lambda k, _: F.lower(k) == name.lower())
    return F.when(F.size(found) > 0, F.flatten(F.map_values(found)))


def content_type(value) -> Column:
    """what stands before the semicolon, trimmed and lowered."""
    return F.lower(F.trim(F.substring_index(_col(value), ";", 1)))


def charset(value, default: str = "utf-8") -> Column:
    """F10."""
    found = F.regexp_extract(_col(value), r"(?i)charset\s*=\s*[\"']?([^\"';\s]+)", 1)
    return F.when(found == "", F.lit(default)).otherwise(F.coalesce(found, F.lit(default)))


def is_text(value) -> Column:
    """F11."""
    t = content_type(value)
    return t.startswith("text/") | t.isin("application/json", "application/xml", "application/xhtml+xml", "application/javascript") | t.endswith("+xml") | t.endswith("+json")


def merged(headers, more, override: bool = True) -> Column:
    """more over headers, or only where headers has none."""
    a, b = _col(headers), _col(more)
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x) if override else F.coalesce(x, y))


def flattened(headers) -> Column:
    """the first value of each."""
    return F.transform_values(_col(headers), lambda _, v: F.get(v, F.lit(0)))


def basic_auth(user, password) -> Column:
    """F13."""
    return F.concat(F.lit("Basic "), F.base64(F.concat(_col(user), F.lit(":"), _col(password)).cast("binary")))


def _last_of_each(pairs: Column) -> Column:
    """A map of (k, v) structs in which the last of equal keys wins."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"]))


def cookies(value) -> Column:
    """`k=v; k2=v2` as a map; parts without = or a name go, the last wins."""
    parts = F.filter(F.transform(F.split(_col(value), ";"), lambda x: F.trim(x)), lambda p: p.contains("=") & ~p.startswith("="))
    return _last_of_each(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_extract(p, "=(.*)$", 1)).alias("v"))))


def cache_control(value) -> Column:
    """directives as a map, names lowered, quotes of values kept, empty where there is no value."""
    parts = F.filter(F.transform(F.split(F.coalesce(_col(value), F.lit("")), ","), lambda x: F.trim(x)), lambda p: p != "")
    return _last_of_each(F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.trim(F.regexp_extract(p, "=(.*)$", 1)).alias("v"))))


def directive_seconds(directives, name: str) -> Column:
    """F16: null where missing or no integer, else at least 0."""
    n = F.element_at(_col(directives), name).try_cast("bigint")
    return F.when(n.isNotNull(), F.greatest(n, F.lit(0)))


def http_date(value) -> Column:
    """seconds since 1970 of a date in any of the six formats, or null. Fields are cut out, so no parser mode matters."""
    v = F.trim(_col(value))
    month = lambda c: F.array_position(F.array(*map(F.lit, _MONTHS)), c).cast("int")

    def stamp(pattern: str, y: int, m: int, d: int, t: int, two: bool = False) -> Column:
        g = lambda i: F.regexp_extract(v, pattern, i)
        year = g(y).try_cast("int")
        if two:
            year = F.when(year >= 69, year + 1900).otherwise(year + 2000)
        text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month(g(m)).cast("string"), 2, "0"), F.lit("-"), F.lpad(F.trim(g(d)), 2, "0"), F.lit(" "), g(t))
        return F.when(v.rlike(pattern), F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))))

    rfc1123 = r"^\w{3}, (\d{1,2}) (\w{3}) (\d{4}) (\d\d:\d\d:\d\d) (?:[A-Z]{3,4}|[+-]\d{4})$"
    zone = F.regexp_extract(v, r" ([+-])(\d\d)(\d\d)$", 2).try_cast("int") * 3600 + F.regexp_extract(v, r" ([+-])(\d\d)(\d\d)$", 3).try_cast("int") * 60
    sign = F.when(v.rlike(r" -\d{4}$"), F.lit(1)).otherwise(F.lit(-1))
    return F.coalesce(
        stamp(rfc1123, 3, 2, 1, 4) + F.when(v.rlike(r" [+-]\d{4}$"), sign * zone).otherwise(F.lit(0)),
        stamp(r"^\w+, (\d\d)-(\w{3})-(\d\d) (\d\d:\d\d:\d\d) GMT$", 3, 2, 1, 4, True),
        stamp(r"^\w{3} (\w{3}) ( ?\d{1,2}) (\d\d:\d\d:\d\d) (\d{4})$", 4, 1, 2, 3),
    )


def reason(status) -> Column:
    """F20."""
    s = _col(status)
    table = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, s.cast("int")), F.concat(F.lit("HTTP "), s.cast("string")))


def _header_bytes(headers: Column) -> Column:
    size = F.transform(F.map_entries(headers), lambda e: F.aggregate(e["value"], F.lit(0), lambda n, v: n + F.octet_length(e["key"]) + 2 + F.octet_length(v) + 2))
    return F.aggregate(size, F.lit(0), lambda a, b: a + b)


def request_bytes(method, url, headers, body) -> Column:
    """method, a space, URL and 11 for the request line; headers with 4 each; 2; the body."""
    return F.octet_length(_col(method)) + 1 + F.octet_length(_col(url)) + 11 + _header_bytes(_col(headers)) + 2 + F.coalesce(F.octet_length(_col(body)), F.lit(0))


def response_bytes(headers, body) -> Column:
    """15 for the status line."""
    return F.lit(15) + _header_bytes(_col(headers)) + 2 + F.coalesce(F.octet_length(_col(body)), F.lit(0))


def mime_type(name) -> Column:
    """F24, by the extension of a file name."""
    ext = F.lower(F.regexp_extract(_col(name), r"(\.[^./\\]*)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in MIME_TYPES.items() for x in kv)), ext), F.lit("application/octet-stream"))


def describe_request(method, url) -> Column:
    """F25."""
    return F.format_string("<%s %s>", _col(method), _col(url))


def describe_response(status, url) -> Column:
    return F.format_string("<%d %s>", _col(status), _col(url))


def describe_link(url, text) -> Column:
    return F.format_string("Link(url=%s, text=%s)", _col(url), _col(text))

