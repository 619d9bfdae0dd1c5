"""Requests as rows (R1-R11, S1, S2, S14, F26): builders, JSON form, curl commands, multipart bodies, callbacks by name."""

from __future__ import annotations

import base64
import hashlib
import json
import shlex
from collections.abc import Callable
from urllib.parse import urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls

HEADERS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
#: §1.4
REQUEST = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("headers", HEADERS),
        T.StructField("body", T.BinaryType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("cookies", T.MapType(T.StringType(), T.StringType())),
        T.StructField("priority", T.IntegerType()),
        T.StructField("dont_filter", T.BooleanType()),
        T.StructField("callback", T.StringType()),
        T.StructField("errback", T.StringType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
        T.StructField("cb_kwargs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("encoding", T.StringType()),
    ]
)
DEFAULTS = {"method": "GET", "headers": {}, "body": None, "meta": {}, "cookies": {}, "priority": 0, "dont_filter": False, "callback": None, "errback": None, "flags": [], "cb_kwargs": {}, "encoding": "utf-8"}
#: Responses of such requests are dropped.
NO_CALLBACK = "__none__"
#: R11.
CALLBACKS: dict[str, Callable[[DataFrame], object]] = {}


def request(url: str, **options) -> dict:
    """A row of REQUEST; the URL needs a scheme, the method is in capitals."""
    if "://" not in url and not url.startswith(("about:", "data:")):
        raise ValueError(f"no scheme in {url!r}")
    if unknown := set(options) - set(DEFAULTS):
        raise TypeError(f"unknown options {sorted(unknown)}")
    out = {"url": url} | {k: options.get(k, v) for k, v in DEFAULTS.items()}
    out["method"] = out["method"].upper()
    out["headers"] = {k: v if isinstance(v, list) else [v] for k, v in out["headers"].items()}
    out["meta"] = {k: v if isinstance(v, str) else json.dumps(v) for k, v in out["meta"].items()}
    if isinstance(out["body"], str):
        out["body"] = out["body"].encode(out["encoding"])
    return out


def replaced(r: dict, **options) -> dict:
    """R2."""
    return request(options.pop("url", r["url"]), **({k: r[k] for k in DEFAULTS} | options))


def json_request(url: str, data, **options) -> dict:
    """R3."""
    headers = {"Content-Type": ["application/json"], "Accept": ["application/json, text/javascript, */*; q=0.01"]} | options.pop("headers", {})
    return request(url, **{"method": "POST", "body": json.dumps(data, separators=(",", ":"), sort_keys=True), "headers": headers} | options)


def form_request(url: str, data: dict[str, list[str] | str], method: str = "POST", **options) -> dict:
    """Keys sorted; a GET has them in its query."""
    body = urlencode(sorted((k, x) for k, v in data.items() for x in (v if isinstance(v, list) else [v])))
    if method.upper() == "GET":
        return request(url + ("&" if urlsplit(url).query else "?") + body, method="GET", **options)
    return request(url, method=method, body=body, headers={"Content-Type": ["application/x-www-form-urlencoded"]} | options.pop("headers", {}), **options)


def multipart(fields: dict[str, str], files: dict[str, tuple[str, bytes, str]]) -> tuple[str, bytes]:
    """(content type, body); the boundary follows from the content, so equal forms have equal bytes. files: name -> (file name, content, type)."""
    mark = "----weft" + hashlib.sha256(repr((sorted(fields.items()), sorted(files.items()))).encode()).hexdigest()[:24]
    parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
    parts += [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"; filename="{n}"\r\nContent-Type: {t}\r\n\r\n'.encode() + b + b"\r\n" for k, (n, b, t) in files.items()]
    return f"multipart/form-data; boundary={mark}", b"".join(parts) + f"--{mark}--\r\n".encode()


def to_dict(r: dict) -> dict:
    """What differs from the defaults; the body in base64."""
    out = {k: v for k, v in r.items() if k == "url" or v != DEFAULTS.get(k)}
    if out.get("body") is not None:
        out["body"] = base64.b64encode(out["body"]).decode()
    return out


def from_dict(d: dict) -> dict:
    d = dict(d)
    if d.get("body"):
        d["body"] = base64.b64decode(d["body"])
    return request(d.pop("url"), **{k: v for k, v in d.items() if k in DEFAULTS})


_TAKES = {"-X": "method", "--request": "method", "-H": "header", "--header": "header", "-b": "cookie", "--cookie": "cookie", "-d": "data", "--data": "data", "--data-raw": "data", "--data-binary": "data", "--data-urlencode": "data", "-u": "user", "--user": "user", "-A": "agent", "--user-agent": "agent", "--url": "url"}
_ALONE = {"--compressed", "-k", "--insecure", "-s", "--silent", "-v", "--verbose", "-#", "--progress-bar", "-i", "--include", "-L", "--location", "-g", "--globoff", "-G", "--get"}


def from_curl(command: str) -> dict | None:
    """A curl command as a request row; None where there is no URL. An unknown flag takes a value with it."""
    try:
        words = shlex.split(command.replace("\\\n", " "))
    except ValueError:
        return None
    if not words or words[0] != "curl":
        return None
    found: dict[str, list[str]] = {}
    i = 1
    while i < len(words):
        w = words[i]
        name, sep, value = w.partition("=") if w.startswith("--") else (w, "", "")
        if w in _ALONE:
            found.setdefault(w, [])
        elif name in _TAKES and sep:
            found.setdefault(_TAKES[name], []).append(value)
        elif w in _TAKES:
            i += 1
            found.setdefault(_TAKES[w], []).extend(words[i : i + 1])
        elif w[:2] in _TAKES and not w.startswith("--"):
            found.setdefault(_TAKES[w[:2]], []).append(w[2:])
        elif w.startswith("-"):
            i += 1
        else:
            found.setdefault("url", []).append(w)
        i += 1
    if not found.get("url"):
        return None
    url = found["url"][0]
    headers: dict[str, list[str]] = {}
    cookies: dict[str, str] = {}
    lines = [*found.get("cookie", [])]
    for h in found.get("header", []):
        k, _, v = h.partition(":")
        if k.strip().lower() == "cookie":
            lines.append(v)
        elif k.strip():
            headers.setdefault(k.strip(), []).append(v.strip())
    for line in lines:
        cookies |= {k.strip(): v.strip() for k, sep, v in (p.partition("=") for p in line.split(";")) if sep and k.strip()}
    if "user" in found:
        user, _, word = found["user"][-1].partition(":")
        headers["Authorization"] = ["Basic " + base64.b64encode(f"{user}:{word}".encode()).decode()]
    if "agent" in found:
        headers["User-Agent"] = found["agent"][-1:]
    body = "&".join(found["data"]) if "data" in found else None
    if body is not None and not any(k.lower() == "content-type" for k in headers):
        headers["Content-Type"] = ["application/x-www-form-urlencoded"]
    method = found["method"][-1] if "method" in found else "POST" if body is not None else "GET"
    return request(url if "://" in url else "http://" + url, method=method, headers=headers, cookies=cookies, body=body)


def to_curl(r: dict) -> str:
    """Headers in the order of their names."""
    parts = ["curl", "-X", r["method"], shlex.quote(r["url"])]
    for k in sorted(r["headers"]):
        parts += [x for v in r["headers"][k] for x in ("-H", shlex.quote(f"{k}: {v}"))]
    if r["cookies"]:
        parts += ["-b", shlex.quote("; ".join(f"{k}={v}" for k, v in sorted(r["cookies"].items())))]
    if r["body"]:
        parts += ["--data-raw", shlex.quote(r["body"].decode("utf-8", "replace"))]
    return " ".join(parts)


def curl_column(command: str | Column) -> Column:
    """(method, url, body, headers as JSON) of each command."""
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("method", "url", "body", "headers")])

    @F.arrow_udf(kind)
    def run(x: pa.Array) -> pa.Array:
        out = []
        for c in x:
            r = from_curl(c.as_py() or "")
            out.append(r and {"method": r["method"], "url": r["url"], "body": (r["body"] or b"").decode(), "headers": json.dumps({k: v[0] for k, v in sorted(r["headers"].items())})})
        return pa.array(out, pa.struct([(n, pa.string()) for n in ("method", "url", "body", "headers")]))

    return run(command)


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([[r[f.name] for f in REQUEST.fields] for r in rows], REQUEST)


def seeds(spark: SparkSession, start: list[str] | DataFrame, callback: str | None = None) -> DataFrame:
    """One request for each start URL, past the duplicate filter; URLs without scheme and host go."""
    df = start if isinstance(start, DataFrame) else spark.createDataFrame([(u,) for u in start], "url string")
    df = df.filter(urls.is_valid("url"))
    return df.select("url", F.lit("GET").alias("method"), F.lit(True).alias("dont_filter"), F.lit(0).alias("priority"), F.lit(0).alias("depth"), F.lit(callback).cast("string").alias("callback"))


def callback(name: str):
    """Registers a function of a frame of responses under a name."""

    def add(f):
        CALLBACKS[name] = f
        return f

    return add
