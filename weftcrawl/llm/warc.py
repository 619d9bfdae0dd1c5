"""WARC archives with a Zstandard dictionary (operator 7).

Each file begins with a skippable frame that holds the dictionary; then follows one zstd frame for each record. Of pages with
equal payloads one is stored as a response and the others as revisits that refer to it. The dictionary is trained on a
bounded sample of the records that are written.

Null payloads are empty ones. Rows with the same page_id and payload are all responses if they are the largest. Pages without
an id are revisits of any page with one, and responses otherwise. Very long payloads are one record, which lies in memory at
once. An empty table gives no files and no rows. Of other columns none is read, whatever its name.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import Scratch, ship
from .common import sampled, within
from .parts import SLICE
from .store import create, open_file
from .tokenfile import train

#: The magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Records that the dictionary is trained on at most, their bytes, and bytes of the dictionary.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 1000, 8 << 20, 64 << 10
#: Repeated digests up to this number are sent to the executors, so that payloads stay where they are read; more are joined.
SENT = 300_000
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def deduplicated(pages: DataFrame, scratch: Scratch, least: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, sha1, refers_to): refers_to is null for responses. Payloads under `least` bytes are all responses."""
    df = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    df = df.withColumn("sha1", F.sha1(F.encode("payload", "UTF-8")))
    largest = df.filter(F.octet_length("payload") >= least).groupBy("sha1").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # the digests that repeat; where they are joined, Spark splits what one of them has too much of
    largest = scratch.keep(largest, "repeated")
    out = df.join(F.broadcast(largest) if largest.count() <= SENT else largest, "sha1", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return out.select("page_id", "url", "payload", "sha1", F.when(revisit, F.col("largest")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: {digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    def __init__(self, uri: str, dictionary: bytes):
        self.uri, self.file, self.records = uri, create(uri), 0
        self.codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        self.file.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)

    def add(self, data: bytes) -> None:
        self.file.write(self.codec.compress(data))
        self.records += 1

    def close(self) -> None:
        self.file.close()


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file, in turn; the dictionary comes from the file."""
    file = open_file(uri)
    magic, size = struct.unpack("<II", file.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError(f"{uri} does not begin with a dictionary")
    dictionary = file.read(size)
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    with io.BufferedReader(codec.stream_reader(file, read_across_frames=True), 1 << 20) as stream:
        while line := stream.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"{uri}: a record begins with {line[:40]!r}")
            headers = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode().partition(":")
                headers[name.lower()] = value.strip()
            block = stream.read(int(headers["content-length"]))
            stream.read(4)
            yield headers, block


def page(headers: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of a record; a response's payload is held to its digest."""

    def number(name: str) -> int | None:
        x = headers.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x and x != "none" else None

    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))[15:])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {headers['warc-record-id']} differs from its digest")
    return number("warc-record-id"), size, digest, headers["warc-type"], number("warc-refers-to")


FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def write(pages: DataFrame, folder: str, scratch: Scratch, least: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Archives the pages, a file for each task. Returns the manifest (path, records) of committed attempts."""
    ship(pages.sparkSession)
    some = within(sampled(pages.select(F.col(key).alias("page_id"), F.col(payload).alias("payload")), SAMPLE, "page_id"), "payload", SAMPLE_BYTES)
    dictionary = train([record(None, "", t.encode(), "00" * 20, None) for t in some], DICTIONARY)
    rows = deduplicated(pages, scratch, least, key, url, payload)
    base = rows.select("page_id", "url", F.encode("payload", "UTF-8").alias("payload"), "sha1", "refers_to")
    return scratch.keep(base.mapInArrow(_archiver(folder, dictionary), FILES), "manifest")


def _archiver(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                if out is None:
                    out = Writer(f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst", dictionary)
                for row in zip(*(b.column(i).slice(k, SLICE).to_pylist() for i in range(5)), strict=True):
                    out.add(record(*row))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([out.uri]), pa.array([out.records], pa.int64())], FILES.names)

    return run


def read_back(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, from the files."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                found = []
                for r in records(path):
                    found.append(page(*r))
                    if len(found) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f) for x, f in zip(zip(*found, strict=True), TYPES, strict=True)], PAGES.names)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f) for x, f in zip(zip(*found, strict=True), TYPES, strict=True)], PAGES.names)

    TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    files = manifest.count()
    return manifest.select("path").repartition(max(1, files), "path").mapInArrow(run, PAGES)
