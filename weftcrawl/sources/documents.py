"""A single JSON array or XML document of any size (X1, X4): tasks write parts, the driver's JVM joins their bytes, never rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def write_document(lines: DataFrame, path: str, ends: tuple[str, str, str], overwrite: bool) -> None:
    """lines: one column `value`. ends: what opens, separates and closes; lines without a separator have one of their own. The parts
    are written by Spark next to the target, each line with the separator behind it, and copied into it in order without the last."""
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = jvm.org.apache.hadoop.fs.Path(path)
    fs = out.getFileSystem(conf)
    if fs.exists(out) and not overwrite:
        raise FileExistsError(f"{path}: a document can't be appended to")
    between = ends[1] or "\n"
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    lines.write.option("lineSep", between).text(parts)
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    try:
        found = sorted((s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())
        stream = fs.create(out, True)
        stream.write(bytearray(ends[0].encode()))
        for s in found:
            reader = fs.open(s.getPath())
            jvm.org.apache.commons.io.IOUtils.copyLarge(reader, stream, 0, s.getLen() - (len(between.encode()) if s is found[-1] else 0))
            reader.close()
        stream.write(bytearray(ends[2].encode()))
        stream.close()
    finally:
        fs.delete(folder, True)
