"""HTTP cache (S7, K1-K12, T-5): lookups are joins by fingerprint, policies are CASE expressions over headers and a clock.

Entries: fp, url, method, status, ts (seconds), headers (map of name to array), body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers as H

DAY, YEAR = 86_400, 31_536_000


def _cc(headers: Column, name: str = "cache-control") -> Column:
    return H.cache_control(H.first(headers, name))


def _has(directives: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(directives, name), F.lit(False))


def _named(value: Column, make) -> Column:
    """make(value) with the value computed once: a lambda's variable is a name that the optimizer does not write out."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _dates(headers: Column, now: Column) -> Column:
    """Date, Expires, Last-Modified and Age of a response, each parsed once."""
    expires = H.first(headers, "expires")
    return F.struct(
        F.coalesce(H.http_date(H.first(headers, "date")), now).cast("bigint").alias("date"),
        expires.isNotNull().alias("expires_there"),
        H.http_date(expires).cast("bigint").alias("expires"),
        H.http_date(H.first(headers, "last-modified")).cast("bigint").alias("modified"),
        F.coalesce(H.first(headers, "age").try_cast("bigint"), F.lit(0)).alias("age"),
    )


def _life(status: Column, d: Column, cc: Column) -> Column:
    return F.coalesce(
        H.directive_seconds(cc, "max-age"),
        F.when(d["expires_there"], F.greatest(F.coalesce(d["expires"] - d["date"], F.lit(0)), F.lit(0))),
        F.when(d["modified"] <= d["date"], (d["date"] - d["modified"]) / 10),
        F.when(status.isin(300, 301, 308), F.lit(YEAR)),
        F.lit(0),
    ).cast("double")


def _old(d: Column, now: Column) -> Column:
    return F.greatest(now - d["date"], d["age"], F.lit(0)).cast("double")


def freshness(status: Column, headers: Column, now: Column, cc: Column | None = None) -> Column:
    """K6, in seconds: max-age; Expires - Date; a tenth of Date - Last-Modified; a year for 300, 301 and 308; 0."""
    cc = _cc(headers) if cc is None else cc
    return _named(F.struct(_dates(headers, now).alias("d"), cc.alias("cc")), lambda x: _life(status, x["d"], x["cc"]))


def age(headers: Column, now: Column) -> Column:
    """K7: the later of now - Date and Age."""
    return _named(_dates(headers, now), lambda d: _old(d, now))


def may_store(status: Column, headers: Column, request_headers: Column | None = None, always: bool = False) -> Column:
    """K5."""
    cc = _cc(headers)
    forbidden = _has(cc, "no-store")
    if request_headers is not None:
        forbidden = forbidden | _has(_cc(request_headers), "no-store")
    validator = H.first(headers, "last-modified").isNotNull() | H.first(headers, "etag").isNotNull()
    dated = _has(cc, "max-age") | H.first(headers, "expires").isNotNull()
    yes = F.lit(True) if always else dated | status.isin(300, 301, 308) | (status.isin(200, 203, 401) & validator)
    return ~forbidden & (status != 304) & yes


def assessed(status: Column, headers: Column, now: Column, request_headers: Column | None = None) -> Column:
    """K6-K8 at once, a struct of freshness, age and fresh: dates and directives are parsed once for all three."""
    none = F.create_map().cast("map<string,string>")
    rc = _cc(request_headers) if request_headers is not None else none

    def judge(x: Column) -> Column:
        d, cc, rc = x["d"], x["cc"], x["rc"]
        life, old = _life(status, d, cc), _old(d, now)
        most = F.least(life, F.coalesce(H.directive_seconds(rc, "max-age").cast("double"), life))
        stale = F.when(_has(rc, "max-stale") & ~_has(cc, "must-revalidate"), F.when(F.element_at(rc, "max-stale") == "", F.lit(float("inf"))).otherwise(F.coalesce(H.directive_seconds(rc, "max-stale").cast("double"), F.lit(0.0)))).otherwise(F.lit(0.0))
        return F.struct(life.alias("freshness"), old.alias("age"), (~_has(cc, "no-cache") & ~_has(rc, "no-cache") & (old < most + stale)).alias("fresh"))

    return _named(F.struct(_dates(headers, now).alias("d"), _cc(headers).alias("cc"), rc.alias("rc")), judge)


def is_fresh(status: Column, headers: Column, now: Column, request_headers: Column | None = None) -> Column:
    """K8: no-cache on either side; the request's max-age and max-stale, unless the answer must be revalidated."""
    return assessed(status, headers, now, request_headers)["fresh"]


def conditional(headers: Column) -> Column:
    """K9: headers of a request that asks whether an entry still holds."""
    pairs = F.filter(F.array(F.struct(F.lit("If-Modified-Since").alias("k"), H.first(headers, "last-modified").alias("v")), F.struct(F.lit("If-None-Match").alias("k"), H.first(headers, "etag").alias("v"))), lambda p: p["v"].isNotNull())
    return F.map_from_entries(pairs)


def still_valid(status: Column, cached_headers: Column) -> Column:
    """K10."""
    return (status == 304) | ((status >= 500) & ~_has(_cc(cached_headers), "must-revalidate"))


def dummy_may_store(url_scheme: Column, status: Column, ignore_schemes=("file",), ignore_codes=()) -> Column:
    """K4."""
    return ~url_scheme.isin(*ignore_schemes) & (~status.isin(*ignore_codes) if ignore_codes else F.lit(True))


def lookup(requests: DataFrame, entries: DataFrame, now: float | None = None, expire: float = 0, fp: str = "fp", dont_cache: str | None = None) -> DataFrame:
    """K1, S7, T-5: requests with `cached`, null where there is no entry. Entries older than `expire` seconds are none."""
    if expire > 0:
        entries = entries.filter(F.col("ts") >= F.lit(float(now) - expire))
    last = entries.groupBy(fp).agg(F.max_by(F.struct(*[c for c in entries.columns if c != fp]), "ts").alias("cached"))
    found = requests.join(last, fp, "left")
    return found if dont_cache is None else found.withColumn("cached", F.when(~F.coalesce(F.col(dont_cache), F.lit(False)), F.col("cached")))


def outcome(status: Column, cached_headers: Column, storable: Column, error: Column | None = None) -> Column:
    """K2, K3: what a fetched answer does to the cache: revalidate, invalidate, store, uncacheable or errorrecovery."""
    had = cached_headers.isNotNull()
    out = F.when(had & error.isNotNull(), F.lit("errorrecovery")) if error is not None else F.when(F.lit(False), F.lit(""))
    return out.when(had & still_valid(status, cached_headers), F.lit("revalidate")).when(had & storable, F.lit("invalidate")).when(storable, F.lit("store")).otherwise(F.lit("uncacheable"))


def store(entries: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by the first two digits of the fingerprint, as one shuffle by those."""
    entries.withColumn("fp2", F.substring("fp", 1, 2)).repartition("fp2").write.mode(mode).partitionBy("fp2").parquet(path)


def stored(spark, path: str, fps: DataFrame | None = None) -> DataFrame:
    """The entries; partitions are pruned by the fingerprints asked for."""
    df = spark.read.option("basePath", path).parquet(path)
    return df if fps is None else df.join(fps.select("fp", F.substring("fp", 1, 2).alias("fp2")).distinct(), ["fp2", "fp"], "left_semi")
