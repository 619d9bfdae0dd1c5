"""Request and response transforms around a fetch (W1-W11, W16, F18, F19): projections that give the next round's rows.
`operators.middleware` has them as the steps of a crawl."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import headers as H
from ..functions import urls
from ..plans.runtime import ship
from .stats import counters, gauge, merged

# Statuses that are asked for again, errors likewise, statuses of redirects.
RETRY_CODES = (500, 502, 503, 504, 522, 524, 408, 429)
RETRY_ERRORS = ("connection_refused", "connection_reset", "timeout", "dns_failure", "incomplete_body")
REDIRECTS = (301, 302, 303, 307, 308)


def with_defaults(headers: Column, defaults: dict[str, str], user_agent: str | None = None) -> Column:
    """Defaults where a header is missing."""
    more = dict(defaults) | ({"User-Agent": user_agent} if user_agent else {})
    if not more:
        return headers
    have = F.transform(F.map_keys(F.coalesce(headers, F.create_map().cast("map<string,array<string>>"))), lambda k: F.lower(k))
    add = F.map_filter(F.create_map(*(x for k, v in more.items() for x in (F.lit(k), F.array(F.lit(v))))), lambda k, _: ~F.array_contains(have, F.lower(k)))
    return F.map_concat(F.coalesce(headers, F.create_map().cast("map<string,array<string>>")), add)


def timeout(own: Column, default: float) -> Column:
    """W3."""
    return F.coalesce(own, F.lit(default))


def with_auth(headers: Column, url: Column, user: Column, password: Column, domain: str = "") -> Column:
    """Unless there is an Authorization header, on the domain and below it (any host where it is empty)."""
    here = F.lit(True) if not domain else urls.in_domains(url, [domain])
    add = F.create_map(F.lit("Authorization"), F.array(H.basic_auth(user, password)))
    return F.when(here & H.first(headers, "authorization").isNull() & (user != ""), F.map_concat(headers, add)).otherwise(headers)


def proxy(own: Column, scheme: Column, by_scheme: dict[str, str]) -> tuple[Column, Column]:
    """(proxy without credentials, Proxy-Authorization or null): the request's own, else that of its scheme."""
    table = F.create_map(*(F.lit(x) for kv in by_scheme.items() for x in kv)) if by_scheme else None
    p = F.coalesce(own, F.try_element_at(table, scheme)) if table is not None else own
    user = F.regexp_extract(p, r"^[a-z0-9]+://([^:@/]*):?([^@/]*)@", 1)
    word = F.regexp_extract(p, r"^[a-z0-9]+://([^:@/]*):?([^@/]*)@", 2)
    return F.regexp_replace(p, r"^([a-z0-9]+://)[^@/]*@", "$1"), F.when(user != "", H.basic_auth(user, word))


def retries(responses: DataFrame, times: int = 2, codes: tuple[int, ...] = RETRY_CODES, step: int = -1, error: str | None = None) -> DataFrame:
    """Responses with `retry` and `retry_reason`. Columns retry_times, and if there max_retry_times and dont_retry."""
    has = set(responses.columns)
    most = F.coalesce("max_retry_times", F.lit(times)) if "max_retry_times" in has else F.lit(times)
    never = F.coalesce("dont_retry", F.lit(False)) if "dont_retry" in has else F.lit(False)
    bad = F.coalesce(F.col("status").isin(*codes), F.lit(False))
    why = F.when(bad, H.reason("status"))
    if error:
        bad = bad | F.coalesce(F.col(error).isin(*RETRY_ERRORS), F.lit(False))
        why = F.coalesce(F.when(F.col(error).isin(*RETRY_ERRORS), F.col(error)), why)
    tried = F.coalesce("retry_times", F.lit(0))
    return responses.withColumns({"retry": bad & ~never & (tried < most), "gave_up": bad & ~never & (tried >= most), "retry_reason": why})


def retry_requests(judged: DataFrame, step: int = -1) -> DataFrame:
    """The next round's rows: one more try, past the duplicate filter, at a lower priority."""
    return judged.filter("retry").withColumns({"retry_times": F.coalesce("retry_times", F.lit(0)) + 1, "dont_filter": F.lit(True), "priority": F.coalesce("priority", F.lit(0)) + step})


def retry_counts(judged: DataFrame) -> DataFrame:
    return merged([counters(judged.filter("retry"), "retry/count", "retry_reason"), judged.filter("gave_up").agg(F.count("*").cast("double").alias("value")).select(F.lit("retry/max_reached").alias("key"), "value")])


def redirected(status: Column, url: Column, location: Column, times: Column, limit: int = 20, mode: str = "documented") -> Column:
    """Whether an answer is followed as the `times`-th redirect of its request."""
    target = urls.join(url, location)
    follows = status.isin(*REDIRECTS) & location.isNotNull() & (location != "") & urls.scheme(target).isin("http", "https")
    return follows & (times <= limit if mode == "documented" else times <= limit + 1 - times)


def redirects(responses: DataFrame, limit: int = 20, step: int = 2, mode: str = "documented") -> DataFrame:
    """The requests that redirects give. mode `reference`: the limit shrinks as the count grows.

    Columns url, status, location, method, redirect_times, redirect_urls, priority, dont_filter, headers, body."""
    times = F.coalesce("redirect_times", F.lit(0)) + 1
    target = urls.join("url", "location")
    follows = redirected(F.col("status"), F.col("url"), F.col("location"), times, limit, mode)
    get = (F.col("status").isin(301, 302) & (F.col("method") == "POST")) | ((F.col("status") == 303) & ~F.col("method").isin("GET", "HEAD"))
    away = urls.host(target) != urls.host("url")
    # as columns first: inside the lambda, url would be the new one
    rows = responses.filter(follows).withColumns({"__away": away, "__get": get})
    kept = F.map_filter("headers", lambda k, _: ~(F.col("__away") & F.lower(k).isin("cookie", "authorization")) & ~(F.col("__get") & F.lower(k).isin("content-type", "content-length")))
    out = rows.withColumns(
        {
            "redirect_urls": F.array_append(F.coalesce("redirect_urls", F.array().cast("array<string>")), F.col("url")),
            "url": target,
            "method": F.when(get, F.lit("GET")).otherwise(F.col("method")),
            "body": F.when(get, F.lit(None)).otherwise(F.col("body")),
            "headers": kept,
            "redirect_times": times,
            "priority": F.coalesce("priority", F.lit(0)) + step,
        }
    )
    return out.drop("__away", "__get")


def set_cookies(jar: DataFrame | None, responses: DataFrame) -> DataFrame:
    """The jar (jar, domain, path, name, value, seq) after the responses' Set-Cookie headers; the last of each cookie wins,
    and an empty or expired one goes. Columns jar, url, set_cookie (array), seq; dont_merge_cookies if there."""
    if "dont_merge_cookies" in responses.columns:
        responses = responses.filter(~F.coalesce("dont_merge_cookies", F.lit(False)))
    one = responses.select("jar", "url", "seq", F.explode("set_cookie").alias("c"))
    attribute = lambda n: F.regexp_extract("c", rf"(?i);\s*{n}=([^;]*)", 1)
    own = F.regexp_replace(F.lower(F.trim(attribute("domain"))), r"^\.", "")
    host = urls.host("url")
    domain = F.when(own == "", host).otherwise(own)
    path = F.when(F.startswith(attribute("path"), F.lit("/")), attribute("path")).otherwise(F.regexp_replace(F.when(urls.path("url") == "", F.lit("/")).otherwise(urls.path("url")), "(.)/[^/]*$", "$1"))
    new = one.filter(F.col("c").rlike("^[^=;]+=") & ((own == "") | (host == own) | host.endswith(F.concat(F.lit("."), own)))).select(
        "jar", domain.alias("domain"), path.alias("path"), F.trim(F.regexp_extract("c", "^([^=;]+)=", 1)).alias("name"), F.trim(F.regexp_extract("c", "^[^=;]+=([^;]*)", 1)).alias("value"), (own == "").alias("host_only"), F.col("c").rlike(r"(?i);\s*secure").alias("secure"), F.col("c").rlike(r"(?i);\s*max-age=(0|-)").alias("gone"), "seq"
    )
    if jar is not None:
        new = jar.withColumn("gone", F.lit(False)).unionByName(new, allowMissingColumns=True)
    last = new.groupBy("jar", "domain", "path", "name").agg(F.max_by(F.struct("value", "host_only", "secure", "gone", "seq"), "seq").alias("x"))
    return last.select("jar", "domain", "path", "name", "x.*").filter("NOT gone").drop("gone")


def with_cookies(requests: DataFrame, jar: DataFrame, key: str = "id") -> DataFrame:
    """Requests with a `cookie` header value of all cookies that fit, longer paths first. The jar is one row for each jar and
    domain, the cookies of a domain in an array, so that a request meets at most one row for each suffix of its host."""
    by_domain = jar.groupBy("jar", "domain").agg(F.collect_list(F.struct("path", "name", "value", "host_only", "secure")).alias("__have"))
    r = requests.select(F.col(key).alias("__id"), "jar", "url").withColumns({"host": urls.host("url"), "p": F.when(urls.path("url") == "", F.lit("/")).otherwise(urls.path("url")), "safe": urls.scheme("url") == "https"}).withColumn("domain", F.explode(urls.suffixes("host")))

    def fits(c: Column) -> Column:
        below = (F.col("p") == c["path"]) | (F.startswith("p", c["path"]) & (c["path"].endswith("/") | (F.substring("p", F.length(c["path"]) + 1, F.lit(1)) == "/")))
        return (~c["host_only"] | (F.col("host") == F.col("domain"))) & (~c["secure"] | F.col("safe")) & below

    got = r.join(by_domain, ["jar", "domain"]).select("__id", F.filter("__have", fits).alias("__fit")).filter(F.size("__fit") > 0)
    ordered = F.array_sort(F.transform(F.flatten(F.collect_list("__fit")), lambda c: F.struct((-F.length(c["path"])).alias("l"), c["name"].alias("name"), c["value"].alias("value"))))
    line = got.groupBy("__id").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["name"], F.lit("="), x["value"])), "; ").alias("cookie"))
    return requests.join(line, F.col(key) == F.col("__id"), "left").drop("__id")


def decodable(encoding: str) -> tuple[list[str], list[str]]:
    """(encodings that stay, encodings to undo from the last): the longest suffix that can be undone."""
    parts = [p.strip().lower() for p in (encoding or "").split(",") if p.strip()]
    k = len(parts)
    while k and parts[k - 1] in ("gzip", "x-gzip", "deflate"):
        k -= 1
    return parts[:k], parts[k:]


def _inflated(body: bytes, wbits: int, most: int) -> bytes:
    """All members of a stream, decoded piece by piece; stops beyond `most` bytes."""
    out, size, rest = [], 0, body
    while rest:
        d = zlib.decompressobj(wbits)
        while not d.eof:
            piece = d.decompress(rest, min(1 << 20, most + 1 - size))
            out.append(piece)
            size += len(piece)
            if size > most:
                return b"".join(out)
            if not piece and not d.unconsumed_tail and not d.eof:
                raise EOFError("the stream ends too early")
            rest = d.unconsumed_tail
        rest = d.unused_data if wbits == 31 and d.unused_data[:2] == b"\x1f\x8b" else b""
    return b"".join(out)


def undo(body: bytes, encodings: list[str], most: int = 1 << 30) -> bytes | None:
    """null where it fails or gives more than `most` bytes; no more than those are ever decoded."""
    try:
        for e in reversed(encodings):
            if "gzip" in e:
                body = _inflated(body, 31, most)
            else:
                try:
                    body = _inflated(body, -15, most)
                except (zlib.error, EOFError):
                    body = _inflated(body, 15, most)
            if len(body) > most:
                return None
        return body
    except (zlib.error, gzip.BadGzipFile, EOFError):
        return None


def decompressed(responses: DataFrame, body: str = "body", encoding: str = "content_encoding", method: str | None = None) -> DataFrame:
    """Bodies decoded and the encodings that are left; HEAD, empty and broken bodies stay as they are. Only rows with an
    encoding go through Python."""
    schema = T.StructType([T.StructField(body, T.BinaryType()) if f.name == body else f for f in responses.schema.fields])
    names = responses.columns
    at, enc = names.index(body), names.index(encoding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, left = [], []
            for x, e in zip(b.column(at).to_pylist(), b.column(enc).to_pylist(), strict=True):
                stay, gone = decodable(e)
                out = undo(bytes(x), gone) if x and gone else None
                bodies.append(x if out is None else out)
                left.append(e if out is None else ", ".join(stay))
            columns = list(b.columns)
            columns[at], columns[enc] = pa.array(bodies, pa.binary()), pa.array(left, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    ship(responses.sparkSession)
    as_bytes = responses.withColumn(body, F.col(body).cast("binary"))
    packed = F.coalesce(F.col(encoding) != "", F.lit(False))
    if method:
        packed = packed & (F.upper(method) != "HEAD")
    return as_bytes.filter(packed).mapInArrow(run, schema).unionByName(as_bytes.filter(~packed))


def transfer_stats(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Counts and bytes by method and status. Columns method, bytes; status, bytes."""
    total = lambda df, k: df.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("double").alias("value")).select(F.lit(k).alias("key"), "value")
    rename = lambda df, a, b: df.withColumn("key", F.regexp_replace("key", f"^{a}/", f"{b}/"))
    a = counters(requests, "downloader/request_count", "method")
    b = counters(responses, "downloader/response_count", "status")
    parts = [rename(a, "downloader/request_count", "downloader/request_method_count"), rename(b, "downloader/response_count", "downloader/response_status_count"), total(requests, "downloader/request_bytes"), total(responses, "downloader/response_bytes")]
    if "latency_s" in responses.columns:
        parts.append(gauge(responses, "downloader/max_download_time", F.col("latency_s")))
    return merged(parts)

