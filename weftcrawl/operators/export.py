"""Feeds (X1-X16): projection, filter and serializers per feed, then a writer. JSON Lines, CSV and Parquet are Spark's own
writers and run in parallel; a single JSON array or XML document is made of parts that each task writes, joined in order."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of formats.
FORMATS = {"json": "json", "jsonlines": "jsonlines", "jsonl": "jsonlines", "jl": "jsonlines", "csv": "csv", "xml": "xml", "parquet": "parquet"}
#: Of a column; unknown names change nothing.
SERIALIZERS: dict[str, Callable[[Column], Column]] = {"to_upper": F.upper, "to_lower": F.lower, "to_int": lambda c: c.try_cast("bigint"), "to_string": lambda c: c.cast("string"), "trim": F.trim}
#: Formats and stores of one's own: functions of the rows and the feed, by format and by the URI's scheme.
WRITERS: dict[str, Callable] = {}
STORES: dict[str, Callable] = {}


@dataclass
class Feed:
    uri: str
    format: str = "jsonlines"
    fields: list[str] | None = None
    where: Column | None = None
    overwrite: bool = False
    store_empty: bool = True
    header: bool = True
    join: str = ","
    root: str = "items"
    item: str = "item"
    indent: int = 0
    options: dict = field(default_factory=dict)


def projected(items: DataFrame, fields: list[str] | None) -> DataFrame:
    """The fields in their order; unknown ones are null."""
    if not fields:
        return items
    return items.select(*(F.col(f) if f in items.columns else F.lit(None).cast("string").alias(f) for f in fields))


def serialized(items: DataFrame) -> DataFrame:
    """By the `serializer` in a field's metadata."""
    todo = {f.name: SERIALIZERS[f.metadata["serializer"]](F.col(f.name)) for f in items.schema.fields if f.metadata.get("serializer") in SERIALIZERS}
    return items.withColumns(todo) if todo else items


def flat(items: DataFrame, join: str = ",") -> DataFrame:
    """Lists joined, maps and structs as JSON, so that a line of text can hold them; numbers without exponents."""
    todo = {}
    for f in items.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.MapType, T.ArrayType)):
            todo[f.name] = F.array_join(F.transform(c, lambda x: x.cast("string")), join)
        elif isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
            todo[f.name] = F.to_json(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            text = F.regexp_replace(F.regexp_replace(F.format_number(c.cast("decimal(38,10)"), 10), ",", ""), r"\.?0+$", "")
            todo[f.name] = F.when(F.abs(c) < 1e27, text).otherwise(c.cast("string"))
    return items.withColumns(todo) if todo else items


def json_line() -> Callable[[DataFrame], Column]:
    return lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def _escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _element(name: str, c: Column, kind: T.DataType) -> Column:
    """Lists as repeated <value>, maps and structs nested, null as an empty element."""
    if isinstance(kind, T.ArrayType):
        inner = F.array_join(F.transform(c, lambda x: _element("value", x, kind.elementType)), "")
    elif isinstance(kind, T.StructType):
        inner = F.concat(*(_element(f.name, c[f.name], f.dataType) for f in kind.fields))
    elif isinstance(kind, T.MapType):
        inner = F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(F.lit("<"), e["key"], F.lit(">"), _escaped(e["value"].cast("string")), F.lit("</"), e["key"], F.lit(">"))), "")
    else:
        inner = _escaped(c.cast("string"))
    return F.concat(F.lit(f"<{name}>"), F.coalesce(inner, F.lit("")), F.lit(f"</{name}>"))


def xml_item(df: DataFrame, item: str = "item") -> Column:
    return F.concat(F.lit(f"<{item}>"), *(_element(f.name, F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(f"</{item}>"))


def document(items: DataFrame, kind: str, feed: Feed) -> str:
    """A small document as one string (standard output, tests)."""
    if kind == "csv":
        rows = flat(items, feed.join)
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
        quoted = [F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
        line = rows.select(F.concat_ws(",", *quoted).alias("x"))
        return "".join(x + "\n" for x in ([",".join(items.columns)] if feed.header else []) + [r[0] for r in line.toLocalIterator()])
    if kind == "xml":
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<{feed.root}>' + "".join(r[0] for r in items.select(xml_item(items, feed.item)).toLocalIterator()) + f"</{feed.root}>"
    lines = [r[0] for r in items.select(json_line()(items)).toLocalIterator()]
    return "".join(x + "\n" for x in lines) if kind == "jsonlines" else "[" + ",\n".join(lines) + "]"


def expand(template: str, name: str, now: float | None = None, batch: int = 1, **extra) -> str:
    """%(name)s, %(time)s, %(batch_time)s, %(batch_id)d and the spider's own values; unknown ones stay."""
    stamp = time.strftime("%Y-%m-%dT%H-%M-%S", time.gmtime(now))
    out = template
    for k, v in {"name": name, "time": stamp, "batch_time": stamp, "batch_id": batch, **extra}.items():
        out = out.replace(f"%({k})s", str(v)).replace(f"%({k})d", str(v))
    return out


def target(uri: str) -> tuple[str, str]:
    """X11: (stdout | file, path); file:// and plain paths are files, other schemes are the cluster's own stores."""
    if uri == "-" or uri.startswith("stdout:"):
        return "stdout", ""
    return "file", uri if urlparse(uri).scheme not in ("", "file") else uri.removeprefix("file://")


def write(items: DataFrame, feed: Feed) -> dict[str, int]:
    """Writes one feed; returns its counts (X16). The rows are counted by the writing job itself."""
    from pyspark.sql import Observation

    kind = FORMATS.get(feed.format, feed.format)
    if kind not in {*FORMATS.values(), *WRITERS}:
        raise ValueError(f"no exporter for format {feed.format!r}")
    rows = items if feed.where is None else items.filter(feed.where)
    rows = serialized(projected(rows, feed.fields))
    if not feed.store_empty and rows.isEmpty():
        return {"items": 0}
    where, path = target(feed.uri)
    seen = Observation()
    rows = rows.observe(seen, F.count("*").alias("items"))
    mode = "overwrite" if feed.overwrite else "append"
    if urlparse(feed.uri).scheme in STORES:
        STORES[urlparse(feed.uri).scheme](rows, feed)
    elif kind in WRITERS:
        WRITERS[kind](rows, feed)
    elif where == "stdout":
        print(document(rows, kind, feed), end="")
    elif kind == "csv":
        flat(rows, feed.join).write.mode(mode).option("header", feed.header).option("emptyValue", "").option("escape", '"').csv(path)
    elif kind == "jsonlines":
        rows.write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif kind == "parquet":
        rows.write.mode(mode).parquet(path)
    else:
        from ..sources.documents import write_document

        line = json_line()(rows) if kind == "json" else xml_item(rows, feed.item)
        ends = ("[", ",\n", "]") if kind == "json" else (f'<?xml version="1.0" encoding="UTF-8"?>\n<{feed.root}>', "", f"</{feed.root}>")
        write_document(rows.select(line.alias("value")), path, ends, feed.overwrite)
    return {"items": seen.get["items"]}


def fan_out(items: DataFrame, feeds: list[Feed], name: str = "spider") -> dict[str, int | str]:
    """Every feed gets every item; one feed's error does not touch the others. Statistics by URI, with the errors' texts."""
    stats: dict[str, int | str] = {}
    items = items.persist()
    try:
        for f in feeds:
            f = replace(f, uri=expand(f.uri, name))
            try:
                stats[f"feedexport/items_count/{f.uri}"] = write(items, f)["items"]
                stats["feedexport/success_count"] = stats.get("feedexport/success_count", 0) + 1
            except Exception as e:  # noqa: BLE001
                stats["feedexport/failed_count"] = stats.get("feedexport/failed_count", 0) + 1
                stats[f"feedexport/error/{f.uri}"] = f"{type(e).__name__}: {e}"
    finally:
        items.unpersist()
    return stats


def feeds_from(settings) -> list[Feed]:
    """The FEEDS mapping, or FEED_URI and FEED_FORMAT."""
    feeds = settings.get("FEEDS") or {}
    out = [Feed(uri, **{k: v for k, v in o.items() if k in Feed.__dataclass_fields__}) for uri, o in feeds.items()]
    if not out and settings.get("FEED_URI"):
        if not settings.get("FEED_FORMAT"):
            raise ValueError("FEED_FORMAT is empty")
        out = [Feed(settings["FEED_URI"], settings["FEED_FORMAT"], store_empty=settings.get("FEED_STORE_EMPTY", True))]
    return out
