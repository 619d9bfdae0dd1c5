"""Token-id output: files of separately compressed documents with a shared dictionary (operator 9).

Layout of a file: MAGIC, the SHA-256 of the dictionary; one zstd frame for each document, of its ids as little-endian
unsigned 32-bit integers; the index (doc_id int64, end of the frame uint64, n_tokens uint32, null flag uint8, as four arrays);
its start and the number of documents as uint64; MAGIC. A reader takes the index and then any one document, or all in turn.
The dictionary lies beside the files under its hash.

Texts that are null or empty give the end id alone. Very long texts are one frame; their ids lie in memory at once. Rows with
equal doc_ids stay and lie side by side in any order, null ids first. An empty table gives no files and no rows. Of other
columns none is read, whatever its name.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import Scratch, ship
from .common import chunks, sampled, within
from .parts import PartCoder
from .store import create, open_file

MAGIC = b"WTOKENS1"
#: Documents that the dictionary is trained on at most, their bytes, and bytes of the dictionary.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 1000, 4 << 20, 64 << 10
LEVEL = 3
_TAIL = struct.Struct("<QQ8s")


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def _added(path: str):
    """What finds the content of an added token in a text; the library gives such content the token's id wherever it is."""
    contents = sorted({t.content for t in _tokenizer(path).get_added_tokens_decoder().values()}, key=lambda c: (-len(c), c))
    return re.compile("|".join(map(re.escape, contents)).encode()) if contents else None


def _whole(tokenizer, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(2)
def _coder(path: str) -> PartCoder:
    """Of the library's tokenizer. Words are encoded in one call with newlines between, whose id marks where a word ends."""
    tokenizer = _tokenizer(path)
    line = _whole(tokenizer, ["\n"])[0]

    def encode(texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for k in range(0, len(texts), 5000):
            some = texts[k : k + 5000]
            # not what begins or ends with white space or has newlines, but for one space in front
            joins = len(line) == 1 and all(t[1:].isprintable() and (t[0] == " " or t[0].isprintable()) and t[-1] != " " and "  " not in t for t in some)
            if joins:
                ids = np.array(_whole(tokenizer, ["\n".join(some)])[0])
                ends = np.flatnonzero(ids == line[0])
                if len(ends) == len(some) - 1:
                    flat = ids.tolist()
                    out += [flat[i:j] for i, j in zip([0, *(ends + 1).tolist()], [*ends.tolist(), len(flat)], strict=True)]
                    continue
            out += _whole(tokenizer, some)
        return out

    return PartCoder(encode)


def encode(path: str, texts: pa.Array, end: int | None) -> Iterator[bytes]:
    """Each text's ids in their serial form, then end. The library encodes each different part of the texts once, and whole the texts
    that hold the content of an added token."""
    tail = b"" if end is None else struct.pack("<I", end)
    added = _added(path)
    for _, buf, offsets in chunks(texts):
        ids, cut = _coder(path).chunk(buf, offsets)
        data, cut = ids.astype("<u4").tobytes(), (cut * 4).tolist()
        raw = buf.tobytes()
        marked = added is not None and added.search(raw) is not None
        for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
            if marked and added.search(raw, offsets[k], offsets[k + 1]):
                yield np.array(_whole(_tokenizer(path), [raw[offsets[k] : offsets[k + 1]].decode()])[0], "<u4").tobytes() + tail
            else:
                yield data[i:j] + tail


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A zstd dictionary; where the samples are too few for training, their last bytes."""
    samples = [x for x in samples if len(x) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


class Writer:
    def __init__(self, uri: str, dictionary: bytes):
        self.uri, self.file = uri, create(uri)
        self.codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_dict_id=False, write_checksum=True)
        head = MAGIC + hashlib.sha256(dictionary).digest()
        self.file.write(head)
        self.at, self.tokens = len(head), 0
        self.index: tuple[list, list, list, list] = ([], [], [], [])

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.codec.compress(ids)
        self.file.write(frame)
        self.at += len(frame)
        self.tokens += len(ids) // 4
        for x, v in zip(self.index, (doc_id or 0, self.at, len(ids) // 4, doc_id is None), strict=True):
            x.append(v)

    def close(self) -> None:
        for x, kind in zip(self.index, ("<i8", "<u8", "<u4", "u1"), strict=True):
            self.file.write(np.array(x, kind).tobytes())
        self.file.write(_TAIL.pack(self.at, len(self.index[0]), MAGIC))
        self.file.close()


class Reader:
    """One file. ids(k): those of the k-th document, for which only its frame is read."""

    def __init__(self, uri: str, dictionary: bytes):
        self.file = open_file(uri)
        size = self.file.size()
        start, n, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        head = self.file.read_at(40, 0)
        if head[:8] != MAGIC or magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        if head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        index = self.file.read_at(21 * n, start)
        self.doc_id = [None if null else i for i, null in zip(np.frombuffer(index, "<i8", n).tolist(), np.frombuffer(index, "u1", n, 20 * n).tolist(), strict=True)]
        self.end = np.frombuffer(index, "<u8", n, 8 * n).astype(np.int64)
        self.start = np.append(40, self.end)[:n]
        self.n_tokens = np.frombuffer(index, "<u4", n, 16 * n).astype(np.int64)
        self.codec = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, k: int) -> bytes:
        return self.codec.decompress(self.file.read_at(int(self.end[k] - self.start[k]), int(self.start[k])))

    def all(self, block: int = 4 << 20) -> Iterator[bytes]:
        k, n = 0, len(self.end)
        while k < n:
            last = max(k + 1, int(np.searchsorted(self.end, self.start[k] + block, "right")))
            base = int(self.start[k])
            data = self.file.read_at(int(self.end[last - 1]) - base, base)
            for i in range(k, last):
                yield self.codec.decompress(data[int(self.start[i]) - base : int(self.end[i]) - base])
            k = last


FILES = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType())])


def write(df: DataFrame, folder: str, scratch: Scratch, tokenizer: str, end: int | None = 0, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, bytes]:
    """Writes the texts' ids in ascending order of key, a file for each range of keys. Returns the manifest (part, path,
    documents, tokens), which has only the files of attempts that Spark committed, and the dictionary."""
    spark = df.sparkSession
    ship(spark)
    df = df.select(F.col(key).cast("long").alias(key), text)
    sample = within(sampled(df, SAMPLE, key), text, SAMPLE_BYTES)
    dictionary = train(list(encode(tokenizer, pa.array(sample, pa.string()), end)))
    name = hashlib.sha256(dictionary).hexdigest()
    with create(f"{folder}/dictionary-{name}.zdict") as f:
        f.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), None
        for b in batches:
            if out is None and b.num_rows:
                out = Writer(f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.wtok", dictionary)
            for i, x in zip(b.column(0).to_pylist(), encode(tokenizer, b.column(1), end), strict=True):
                out.add(i, x)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out.uri]), pa.array([len(out.index[0])], pa.int64()), pa.array([out.tokens], pa.int64())], FILES.names)

    ordered = df.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    return scratch.keep(ordered.mapInArrow(run, FILES), "manifest"), dictionary


def read_back(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. The number of files is that of the partitions."""
    spark = manifest.sparkSession
    ship(spark)
    files, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((r["path"], start))
        start += r["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = Reader(path, dictionary)
                crc = np.fromiter((zlib.crc32(x) for x in r.all()), np.int64, len(r.doc_id))
                yield pa.RecordBatch.from_arrays([pa.array(r.doc_id, pa.int64()), pa.array(first + np.cumsum(r.n_tokens) - r.n_tokens), pa.array(r.n_tokens), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(files, "path string, start long")
    return table.repartition(max(1, len(files)), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
