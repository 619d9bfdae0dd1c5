"""Connected components of an edge table.

Up to FEW edges, a bound that is checked, go to one task, which finds their components in numpy. More are contracted by
alternating large-star and small-star steps: each is a grouped minimum and a join, so a node with any number of neighbours is
spread over tasks. Every step is written to the shared folder; nothing of the graph comes to the driver but a row count and a
checksum. Edges that come later are put between the components that are known, so that work follows what is new.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import Scratch

FEW = 1 << 20


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) of edges that are all in this task: the least root each node can reach, by merging and halving paths."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not parts:
        return
    ids, at = np.unique(np.concatenate(parts, 1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(ids))
    while (root[a] != root[b]).any():
        a, b = root[a], root[b]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["u", "v"])


def components(edges: DataFrame, scratch: Scratch, name: str = "components", rows: int = 0) -> DataFrame:
    """(u, v): each node with an edge but the least of its component, and that least node. edges: (u, v), longs, u <> v; about so many rows."""
    now = scratch.keep(edges.select("u", "v").distinct(), f"{name}-0", scratch.files(rows))
    before, k = None, 0
    while True:
        n, sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, sign) == before or not n:
            return now
        before, k = (n, sign), k + 1
        last = n <= FEW
        after = scratch.keep(now.coalesce(1).mapInArrow(_together, "u long, v long") if last else _small(_large(now)), f"{name}-{k}", scratch.files(n))
        scratch.drop(f"{name}-{k - 1}")
        now = after
        if last:
            return now


def contracted(edges: DataFrame, known: DataFrame | None, scratch: Scratch, name: str, rows: int = 0) -> DataFrame:
    """components() of edges and of all that went into known, kept as the table `name`."""
    if known is not None:
        of = known.select(F.col("u").alias("x"), F.col("v").alias("root"))
        for end in ("u", "v"):
            edges = edges.join(of.withColumnRenamed("x", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        edges = edges.filter("u <> v")
    steps = f"{name}-step"
    new = components(edges, scratch, steps, rows)
    if known is None:
        out = new
    else:
        moved = known.join(new.select(F.col("u").alias("v"), F.col("v").alias("root")), "v", "left")
        out = moved.select("u", F.coalesce("root", "v").alias("v")).unionByName(new.select("u", "v"))
    out = scratch.keep(out, name, scratch.files(new.count() + (known.count() if known is not None else 0)))
    scratch.drop(*(f"{steps}-{k}" for k in range(40)))
    return out
