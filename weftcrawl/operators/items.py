"""Items (I1-I18): rows of a declared schema whose field metadata says what is required, defaulted and serialized; pipelines are
transforms with side outputs for what is dropped."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType()}


def parse_tag(tag: str) -> tuple[str, dict[str, str]]:
    """I8: `name,opt,opt=value` as (name, options); an option without a value is `true`."""
    name, *rest = [p.strip() for p in tag.split(",")]
    return name, {k: v if sep else "true" for k, sep, v in (p.partition("=") for p in rest if p)}


def schema_of(tags: dict[str, tuple[T.DataType | type, str]]) -> T.StructType:
    """From field -> (type, tag); the name `-` hides a field."""
    fields = []
    for attribute, (kind, tag) in tags.items():
        name, options = parse_tag(tag)
        if name != "-":
            fields.append(T.StructField(name or attribute, kind if isinstance(kind, T.DataType) else _KINDS[kind], True, options))
    return T.StructType(fields)


#: Newest first; each turns an object into a dict or gives None.
FACTORIES: list[Callable] = []


def adapt(x) -> dict | None:
    """Asked in turn: factories, mappings, dataclasses, rows; None for anything else."""
    for f in FACTORIES:
        if (out := f(x)) is not None:
            return out
    if isinstance(x, dict):
        return x if all(isinstance(k, str) for k in x) else None
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return {f.name: getattr(x, f.name) for f in dataclasses.fields(x) if not f.name.startswith("_")}
    return x.asDict() if hasattr(x, "asDict") else None


def frame(spark: SparkSession, items: list, schema: T.StructType) -> DataFrame:
    """Items of any adaptable kinds as rows of one schema; missing fields are null, others go."""
    rows = [[(adapt(x) or {}).get(f.name) for f in schema.fields] for x in items]
    return spark.createDataFrame(rows, schema)


def is_zero(c: str, kind: T.DataType) -> Column:
    """Null, "", 0 and false count as missing."""
    x = F.col(c)
    if isinstance(kind, T.StringType):
        return x.isNull() | (x == "")
    if isinstance(kind, T.NumericType):
        return x.isNull() | (x == 0)
    if isinstance(kind, T.BooleanType):
        return x.isNull() | ~x
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return x.isNull() | (F.size(x) == 0)
    return x.isNull()


def validated(items: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Defaults where a field is zero, then `errors` with all required fields that still are."""
    fields = (schema or items.schema).fields
    out, errors = items, []
    defaults = {f.name: f.metadata["default"] for f in fields if "default" in f.metadata}
    bad = {}
    for f in fields:
        if f.name in defaults:
            value = F.lit(defaults[f.name]).try_cast(f.dataType)
            bad[f.name] = is_zero(f.name, f.dataType) & value.isNull()
            out = out.withColumn(f.name, F.when(is_zero(f.name, f.dataType), value).otherwise(F.col(f.name)))
    for f in fields:
        if f.metadata.get("required") == "true":
            errors.append(F.when(is_zero(f.name, f.dataType), F.lit(f"{f.name} is required")))
        if f.name in bad:
            errors.append(F.when(is_zero(f.name, f.dataType) & F.lit(_not(defaults[f.name], f.dataType)), F.lit(f"{f.name}: invalid default")))
    return out.withColumn("errors", F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array().cast("array<string>"))


def _not(value: str, kind: T.DataType) -> bool:
    """Whether a default can't be of a kind."""
    try:
        if isinstance(kind, T.IntegralType):
            int(value)
        elif isinstance(kind, T.NumericType):
            float(value)
        elif isinstance(kind, T.BooleanType):
            return value.lower() not in ("true", "false", "1", "0", "t", "f")
    except ValueError:
        return True
    return False


@dataclass(frozen=True)
class Stage:
    """One step of a pipeline. drop and fail: conditions with reasons; transform: of the rows that are left; type: only rows of
    that kind (I16), the others pass unchanged."""

    name: str
    transform: Callable[[DataFrame], DataFrame] | None = None
    drop: Column | None = None
    fail: Column | None = None
    type: str | None = None
    priority: int = 0
    opened: Callable[[], None] | None = None
    closed: Callable[[], None] | None = None


DROPPED = T.StructType([T.StructField("item_json", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("kind", T.StringType())])


def through(items: DataFrame, stages: list[Stage], kind: str = "_type", validate: bool = False) -> tuple[DataFrame, DataFrame]:
    """(items, what was dropped or failed as item_json, stage, kind), stages in ascending priority."""
    lost: list[DataFrame] = []

    def side(rows: DataFrame, stage: str, what: str) -> None:
        lost.append(rows.select(F.to_json(F.struct(*rows.columns)).alias("item_json"), F.lit(stage).alias("stage"), F.lit(what).alias("kind")))

    if validate:
        checked = validated(items)
        side(checked.filter(F.size("errors") > 0), "validate", "error")
        items = checked.filter(F.size("errors") == 0).drop("errors")
    for s in sorted(stages, key=lambda s: s.priority):
        own, others = (items.filter(F.col(kind) == s.type), items.filter(~F.col(kind).eqNullSafe(s.type))) if s.type else (items, None)
        for condition, what in ((s.drop, "dropped"), (s.fail, "error")):
            if condition is not None:
                hit = F.coalesce(condition, F.lit(False))
                side(own.filter(hit), s.name, what)
                own = own.filter(~hit)
        if s.transform:
            own = s.transform(own)
        items = own if others is None else own.unionByName(others, allowMissingColumns=True)
    out = items.sparkSession.createDataFrame([], DROPPED)
    for x in lost:
        out = out.unionByName(x)
    return items, out


def life(stages: list[Stage], work: Callable[[], object]) -> object:
    """Opens in order and stops at the first error; closes all that were opened, whatever happens."""
    opened: list[Stage] = []
    try:
        for s in sorted(stages, key=lambda s: s.priority):
            if s.opened:
                s.opened()
            opened.append(s)
        return work()
    finally:
        errors = []
        for s in reversed(opened):
            try:
                if s.closed:
                    s.closed()
            except Exception as e:  # noqa: BLE001
                errors.append(e)
        if errors:
            raise errors[0]
