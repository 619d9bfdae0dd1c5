"""Session helpers: shipping the package to executors, shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset, and driver and executors are one machine, a local one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weftcrawl-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df on all cores: a table of fewer splits than cores is dealt out, a larger one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def running(df: DataFrame, order: list[str], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """df with the sum of each value over the rows before a row, in an order; `by`: in each group.

    Without groups no task has all rows: ranges of the order are summed first, and each range begins with what the ones before
    it have. The ranges are written, so that both passes see the same."""
    if by:
        before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})
    rows = df.select("*", *(c.alias(f"__v{i}") for i, c in enumerate(sums.values()))).repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    rows = Scratch(df.sparkSession, "running").keep(rows, "ranges")
    each = rows.groupBy("__range").agg(*(F.sum(f"__v{i}").alias(f"__v{i}") for i in range(len(sums)))).orderBy("__range").collect()
    starts, total = [], [0] * len(sums)
    for r in each:
        starts.append((r["__range"], *total))
        total = [t + (r[f"__v{i}"] or 0) for i, t in enumerate(total)]
    kinds = ", ".join(f"__s{i} {'double' if isinstance(rows.schema[f'__v{i}'].dataType, T.FractionalType) else 'long'}" for i in range(len(sums)))
    # a row for each partition
    table = df.sparkSession.createDataFrame(starts, f"__range int, {kinds}")
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(table), "__range").withColumns({n: F.col(f"__s{i}") + F.coalesce(F.sum(f"__v{i}").over(within), F.lit(0)) for i, n in enumerate(sums)})
    return out.drop("__range", *(f"__v{i}" for i in range(len(sums))), *(f"__s{i}" for i in range(len(sums))))


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor costs a reread, never a recomputation from the start.

    A folder without a name of its own goes when the application ends; one with a name stays, so that later runs find it.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.spark, self.root = spark, folder or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if not folder:
            p, fs = self._at(self.root)
            fs.mkdirs(p)
            fs.deleteOnExit(p)

    def _at(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def files(self, rows: int) -> int:
        """Files for a table that is made of so many rows: no more than there are cores, but for half a million rows each."""
        return max(2, self.spark.sparkContext.defaultParallelism, rows >> 19)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str, files: int = 0) -> DataFrame:
        """df as a table of the folder, in so many files at most."""
        if files:
            df = df.coalesce(files)
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        for table in tables:
            p, fs = self._at(self.path(table))
            fs.delete(p, True)

    def has(self, table: str) -> bool:
        p, fs = self._at(self.path(table))
        return fs.exists(p)

    def write_text(self, name: str, text: str) -> None:
        """A small file, replaced as a whole."""
        p, fs = self._at(self.path(name))
        fresh = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}.new")
        out = fs.create(fresh, True)
        try:
            out.write(text.encode())
        finally:
            out.close()
        fs.delete(p, False)
        fs.rename(fresh, p)

    def read_text(self, name: str) -> str | None:
        """That file, or where its replacement was cut short, the new one."""
        for path in (self.path(name), f"{self.path(name)}.new"):
            p, fs = self._at(path)
            if fs.exists(p):
                stream = fs.open(p)
                try:
                    return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
                finally:
                    stream.close()
        return None

    def spent(self) -> None:
        """Shuffle files that nothing refers to go once the driver's collector has seen it; after a large shuffle it is asked to look."""
        self.spark._jvm.System.gc()
