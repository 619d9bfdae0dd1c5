"""Operators 4 and 9 against the libraries, on odd texts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer
from weftcrawl.llm import bpe, tokenfile
from weftcrawl.plans.runtime import Scratch

RANKS = P.path("byte_bpe_50k.tiktoken")


def texts():
    rng = random.Random(3)
    signs = "ab  \n\t  é漢字'sll're0123,.;-\x1c\x85 ABC<|endoftext|>"
    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return [None, "", " ", "a", "a", "It's  two", "x" * 5000, "ab" * 3000, "aaaa" * 77, "end <|endoftext|> ", *odd]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i - 1 if i else None, t, "clash", i) for i, t in enumerate(texts())], "doc_id long, text string, ids_sha256 string, start long")


def test_codec_equals_library():
    codec = bpe.codec(RANKS, P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [library.encode_ordinary(t or "") for t in texts()]
    assert codec.whole([t or "" for t in texts()]) == want
    for _ in range(2):  # the second time from what is remembered
        ((_, ids, cut),) = codec.encode(pa.array(texts()))
        assert [ids[i:j].tolist() for i, j in zip(cut, cut[1:], strict=False)] == want
    data, ends = codec.decode(ids, cut)
    assert [data[i:j] for i, j in zip(ends, ends[1:], strict=False)] == [(t or "").encode() for t in texts()]


def test_parts_equal_whole_texts():
    rng = random.Random(5)
    codec = bpe.codec(RANKS, P.PATTERN)
    signs = " \n\ta.\u00a0\u2003\u0085,'sé\u3000b"
    some = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 7))) for _ in range(3000)]
    ((_, ids, cut),) = codec.encode(pa.array(some))
    assert [ids[i:j].tolist() for i, j in zip(cut, cut[1:], strict=False)] == codec.whole(some)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(some, add_special_tokens=False)]
    assert list(tokenfile.encode(P.path("byte_bpe_50k.json"), pa.array(some), None)) == want


def test_bpe_columns(rows):
    df = bpe.decode(bpe.encode(rows, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert df.columns == ["doc_id", "text", "ids_sha256", "start", "ids", "decoded"]
    for r in df.collect():
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode(rows.limit(0), RANKS, P.PATTERN).count() == 0


def test_bpe_digests(rows):
    codec = bpe.codec(RANKS, P.PATTERN)
    want = {(None if not i else i - 1): (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in enumerate(codec.whole([t or "" for t in texts()]))}
    got = bpe.digests(rows, RANKS, P.PATTERN).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in got} == want
    assert len(got) == len(texts())


def test_token_files_round_trip(spark, rows):
    scratch = Scratch(spark, "t9")
    path = P.path("byte_bpe_50k.json")
    manifest, dictionary = tokenfile.write(rows, scratch.path("files"), scratch, path)
    library = Tokenizer.from_file(path)
    assert 50256 in library.encode("hello <|endoftext|> there", add_special_tokens=False).ids
    start, want = 0, []
    for i, t in enumerate(texts()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((None if not i else i - 1, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tokenfile.read_back(manifest, dictionary).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    file = manifest.orderBy("part").first()
    reader = tokenfile.Reader(file["path"], dictionary)
    assert [reader.ids(k) for k in range(3)] == list(reader.all())[:3]
    with pytest.raises(ValueError):
        tokenfile.Reader(file["path"], dictionary + b"x")


def test_token_files_empty_and_repeated(spark):
    scratch = Scratch(spark, "t9")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.read_back(*tokenfile.write(empty, scratch.path("files"), scratch, P.path("byte_bpe_50k.json"))).count() == 0
    scratch = Scratch(spark, "t9")
    same = spark.createDataFrame([(7, "a b")] * 5, "doc_id long, text string")
    got = tokenfile.read_back(*tokenfile.write(same, scratch.path("files"), scratch, P.path("byte_bpe_50k.json"))).collect()
    assert sorted(r["start"] for r in got) == [0, 3, 6, 9, 12]
