"""HTTP fetch (S4-S6, S10): a fetcher over requests for clusters with a network, one connection pool for each task. Pages of a
table (operators.crawl.table_fetcher) are the offline form with the same columns."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..plans.runtime import ship

#: What a fetch adds to a request's columns.
ANSWER = T.StructType(
    [
        T.StructField("status", T.IntegerType()),
        T.StructField("response_headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("response_body", T.BinaryType()),
        T.StructField("error_kind", T.StringType()),
        T.StructField("latency_s", T.DoubleType()),
    ]
)


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *a):
        return None


def error_kind(e: Exception) -> str:
    """The five kinds of errors that are retried (T7), or other."""
    r = getattr(e, "reason", e)
    name = type(r).__name__.lower()
    for word, kind in (("refused", "connection_refused"), ("reset", "connection_reset"), ("timeout", "timeout"), ("gaierror", "dns_failure"), ("incomplete", "incomplete_body")):
        if word in name or word in str(r).lower():
            return kind
    return "other"


def fetch(requests: DataFrame, timeout: float = 180.0, most: int = 1 << 30, by_slot: bool = True, proxies: dict[str, str] | None = None, delay: float = 0.0, jitter: bool = False) -> DataFrame:
    """The requests with ANSWER's columns; redirects are not followed and bodies are as sent. Requests of a host go to a few tasks,
    salted, so that a host with a third of all pages is not one task's. W20: a task waits `delay` seconds between requests of a
    host, with jitter half to one and a half times as long. meta download_timeout and proxy count before the arguments."""
    schema = T.StructType([*requests.schema.fields, *ANSWER.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        openers: dict[str, urllib.request.OpenerDirector] = {}
        free: dict[str, float] = {}

        def opener(proxy: str | None):
            if (proxy or "") not in openers:
                table = {"http": proxy, "https": proxy} if proxy else proxies or {}
                openers[proxy or ""] = urllib.request.build_opener(_NoRedirect(), urllib.request.ProxyHandler(table))
            return openers[proxy or ""]

        def one(r: dict) -> dict:
            meta = dict(r.get("meta") or [])
            host = urlsplit(r["url"]).netloc
            if delay:
                pause = delay * (0.5 + (zlib.crc32(r["url"].encode()) % 1000) / 1000 if jitter else 1.0)
                now = time.time()
                time.sleep(max(0.0, free.get(host, now) - now))
                free[host] = time.time() + pause
            began = time.time()
            row = {"status": None, "response_headers": None, "response_body": None, "error_kind": None}
            try:
                q = urllib.request.Request(r["url"], method=r.get("method") or "GET", data=r.get("body"), headers={k: v[0] for k, v in (r.get("headers") or []) if v})
                try:
                    answer = opener(meta.get("proxy")).open(q, timeout=float(meta.get("download_timeout") or timeout))
                except urllib.error.HTTPError as e:
                    answer = e
                with answer:
                    names = dict.fromkeys(answer.headers.keys())
                    body = answer.read(most + 1)
                    if len(body) > most:
                        raise ValueError("too large")
                    row |= {"status": answer.status, "response_headers": [(k, answer.headers.get_all(k)) for k in names], "response_body": body}
            except Exception as e:  # noqa: BLE001
                row |= {"status": None, "response_headers": None, "response_body": None, "error_kind": error_kind(e)}
            return row | {"latency_s": time.time() - began}

        kind = pa.schema([("status", pa.int32()), ("response_headers", pa.map_(pa.string(), pa.list_(pa.string()))), ("response_body", pa.binary()), ("error_kind", pa.string()), ("latency_s", pa.float64())])
        wanted = [n for n in ("url", "method", "headers", "body", "meta") if n in schema.names]
        for b in batches:
            for k in range(0, b.num_rows, 100):
                some = b.slice(k, 100)
                got = pa.RecordBatch.from_pylist([one(r) for r in some.select(wanted).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*some.columns, *got.columns], schema.names)

    ship(requests.sparkSession)
    if by_slot:
        requests = requests.repartition(urls.host("url"), F.pmod(F.xxhash64("url"), F.lit(8)))
    return requests.mapInArrow(run, schema)


def fetcher(**options):
    """fetch() with these options, as a crawl's fetcher."""
    return lambda requests: fetch(requests, **options)


def robots_files(requests: DataFrame, fetcher) -> DataFrame:
    """(netloc, content) of each site once; without an answer of 2xx there is no row, and all is allowed."""
    sites = requests.select(F.concat(urls.scheme("url"), F.lit("://"), urls.authority("url"), F.lit("/robots.txt")).alias("url"), urls.authority("url").alias("netloc")).filter("netloc <> ''").dropDuplicates(["netloc"])
    got = fetcher(sites.select("url")).filter((F.col("status") >= 200) & (F.col("status") < 300))
    text = F.col("response_body").cast("string")
    return got.join(sites, "url").select("netloc", (F.coalesce(text, "html") if "html" in got.columns else text).alias("content"))
