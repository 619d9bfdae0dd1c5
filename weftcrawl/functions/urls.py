"""URL functions as Column expressions (F1-F8, F22, F27): codegen'd, pushed down, never a Python call per row.

All of them give null for null and for strings that are no URL; none throws under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ports that a scheme implies, characters that a path keeps as they are.
DEFAULT_PORT = {"http": ":80", "https": ":443"}
_PATH_OK = r"^([A-Za-z0-9\-._~!$&'()*+,;=:@/\[\]]|%[0-9A-Fa-f]{2})*$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _part(url: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(url, pattern, group)


def scheme(url) -> Column:
    return F.lower(_part(_col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):"))


def authority(url) -> Column:
    """Host and port as written, without user info."""
    return _part(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)")


def host(url) -> Column:
    """Host without port (F2), empty where there is none."""
    return F.regexp_replace(authority(url), r":\d*$", "")


def path(url) -> Column:
    return _part(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)")


def query(url) -> Column:
    return _part(_col(url), r"^[^?#]*\?([^#]*)")


def fragment(url) -> Column:
    return _part(_col(url), r"#(.*)$")


def without_fragment(url) -> Column:
    return F.regexp_replace(_col(url), "#.*$", "")


def is_valid(url) -> Column:
    """a scheme and a host."""
    return (scheme(url) != "") & (authority(url) != "")


def has_scheme(url) -> Column:
    """F5."""
    u = _col(url)
    return u.contains("://") | u.startswith("about:") | u.startswith("data:")


def query_escape(x) -> Column:
    """Form encoding: a space is +, and only letters, digits and - _ . ~ stay."""
    return F.replace(F.replace(F.url_encode(_col(x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def path_escape(x) -> Column:
    """A path as it is where it is well formed; else decoded and escaped anew, but for / and $ & + , : ; = @ ~."""
    p = _col(x)
    raw = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    out = F.replace(query_escape(raw), F.lit("+"), F.lit("%20"))
    for sign in "$&+,/:;=@":
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return F.when(p.rlike(_PATH_OK), p).otherwise(out)


def sorted_query(q) -> Column:
    """The pairs of a query by key and value, encoded anew; pairs that can't be decoded go."""
    pairs = F.transform(
        F.filter(F.split(_col(q), "&"), lambda p: (p != "") & ~p.contains(";")),
        lambda p: F.struct(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)).alias("v")),
    )
    good = F.filter(pairs, lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    return F.array_join(F.transform(F.array_sort(good), lambda x: F.concat(query_escape(x["k"]), F.lit("="), query_escape(x["v"]))), "&")


def canonical(url, keep_fragment: bool = False) -> Column:
    """lower-case scheme and host, no default port, an escaped path of at least /, a sorted query, no fragment."""
    u = _col(url)
    s, a = scheme(u), F.lower(authority(u))
    for name, port in DEFAULT_PORT.items():
        a = F.when((s == name) & a.endswith(port), F.left(a, F.length(a) - len(port))).otherwise(a)
    p, q = path_escape(path(u)), sorted_query(query(u))
    user = _part(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#@]*@)")
    out = F.concat(s, F.lit("://"), user, a, F.when(p == "", F.lit("/")).otherwise(p), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
    if keep_fragment:
        f = fragment(u)
        out = F.concat(out, F.when(f == "", F.lit("")).otherwise(F.concat(F.lit("#"), f)))
    return F.when(is_valid(u), out).otherwise(u)


def link_key(url) -> Column:
    """The extractor's own canonical form (T4): scheme and host lowered, all else as written."""
    u = _col(url)
    head = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
    return F.concat(F.lower(_part(u, head)), F.regexp_replace(u, head, ""))


def join(base, ref) -> Column:
    """ref resolved against an absolute base (RFC 3986): absolute, //host, /path, ?query, #fragment and relative paths."""
    b, r = _col(base), F.trim(_col(ref))
    s = scheme(b)
    root = F.concat(s, F.lit("://"), _part(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"))
    folder = F.regexp_replace(F.when(path(b) == "", F.lit("/")).otherwise(path(b)), "[^/]*$", "")
    rp, tail = _part(r, r"^([^?#]*)"), _part(r, r"^[^?#]*(.*)$")
    full = F.when(rp.startswith("/"), rp).otherwise(F.concat(folder, rp))
    return (
        F.when(r == "", without_fragment(b))
        .when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(is_valid(r), F.concat(scheme(r), F.lit("://"), _part(r, r"://([^/?#]*)"), path_escape(path(r)), _part(r, r"://[^/?#]*[^?#]*(.*)$"))).otherwise(r))
        .when(r.startswith("//"), F.concat(s, F.lit(":"), r))
        .when(r.startswith("#"), F.concat(without_fragment(b), r))
        .when(r.startswith("?"), F.concat(root, path(b), r))
        .otherwise(F.concat(root, path_escape(_without_dots(full)), tail))
    )


def _without_dots(p: Column) -> Column:
    """A path without . and .. segments."""
    segments = F.slice(F.split(p, "/"), 2, 1_000_000)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.array_append(acc, x)),
    )
    ends = p.rlike(r"/\.{1,2}$")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))


def _json(x: Column) -> Column:
    """A string inside JSON, with & < > as escapes."""
    out = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for sign in "&<>":
        out = F.replace(out, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return out


def fingerprint(url, method=None, body=None, headers=None) -> Column:
    """SHA-1 of JSON of body, headers, method and canonical URL, keys sorted. headers: map of name to array, names included."""
    hexed = F.lower(F.hex(F.coalesce(_col(body).cast("binary"), F.lit("").cast("binary")))) if body is not None else F.lit("")
    names = F.lit("{}")
    if headers is not None:
        one = lambda e: F.concat(
            F.lit('"'), F.lower(F.hex(F.lower(e["key"]).cast("binary"))), F.lit('":['), F.array_join(F.transform(e["value"], lambda v: F.concat(F.lit('"'), F.lower(F.hex(v.cast("binary"))), F.lit('"'))), ","), F.lit("]")
        )
        names = F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(F.map_entries(_col(headers)), one)), ","), F.lit("}"))
    m = F.upper(_col(method)) if method is not None else F.lit("GET")
    return F.sha1(F.concat(F.lit('{"body":"'), hexed, F.lit('","headers":'), names, F.lit(',"method":"'), _json(m), F.lit('","url":"'), _json(canonical(url)), F.lit('"}')).cast("binary"))


def simple_fingerprint(url, method=None) -> Column:
    """F8."""
    m = F.upper(_col(method)) if method is not None else F.lit("GET")
    return F.sha1(F.concat(m, F.lit("|"), canonical(url)).cast("binary"))


def in_domains(url, domains: list[str], sub: bool = True) -> Column:
    """Host equal to one of a list of domains or below one: a few comparisons, or for longer lists each suffix of the host against a
    hash set. Tables of domains go through operators.links.on_domains."""
    h = host(url)
    if not sub:
        return h.isin(domains)
    if len(domains) > 8:
        return F.exists(suffixes(h), lambda x: x.isin(domains))
    exact = h.isin(domains)
    for d in domains:
        exact = exact | h.endswith("." + d)
    return exact


def suffixes(x) -> Column:
    """All domain suffixes of a host, itself first: turns "is below a domain" into an equi-join."""
    labels = F.split(_col(x), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def extension(url) -> Column:
    """Lower-case last extension of the path, dot included; empty where there is none."""
    return F.lower(_part(path(url), r"(\.[^./]*)$"))


def with_default_scheme(x) -> Column:
    """F22."""
    c = _col(x)
    return F.when(c.contains("://"), c).otherwise(F.concat(F.lit("https://"), c))
