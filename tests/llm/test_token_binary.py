"""Operator 3: exact round trip and offsets."""

import os
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusprep.llm import queries as q
from corpusprep.llm import token_binary as tb
from corpusprep.llm.common import read, scratch_path
from conftest import SMALL
from llm import brute


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 70_001])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(1).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    assert (tb.from_planes(tb.to_planes(ids, bits), n, bits) == ids).all()


def test_crc32_join():
    a, b = os.urandom(999), os.urandom(70_003)
    assert tb.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert tb.crc32_join(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def expect(rows):
    lib = Tokenizer.from_file(q.vocabulary())
    out, start = [], 0
    for key, text in rows:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_plain_encoding(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in read(spark, SMALL, "documents").collect())
    got = sorted(map(tuple, q.QUERIES["op3_token_planes"](spark, SMALL).collect()))
    assert got == expect(rows)


@pytest.mark.parametrize("bits", [False, True])
def test_awkward_rows_and_tiny_chunks(spark, bits):
    docs = brute.awkward(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    path = scratch_path(spark, "t")
    tb.write(docs, path, q.vocabulary(), chunk_ids=64, bits=bits)
    got = sorted(map(tuple, tb.read_documents(spark, path).collect()))
    assert got == expect(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    index = spark.read.parquet(path).select("shard", "chunk", "first", "n_ids").collect()
    assert max(r["n_ids"] for r in index) == 64


def test_repeated_and_null_keys_stay(spark):
    docs = brute.awkward(spark)
    path = scratch_path(spark, "t")
    tb.write(docs, path, q.vocabulary())
    got = sorted(tb.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert len(got) == docs.count()
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    keys = [r["doc_id"] for r in got]
    assert keys[:2] == [None, None] and keys[2:] == sorted(keys[2:])
    path = scratch_path(spark, "t")
    tb.write(brute.empty(spark), path, q.vocabulary())
    assert tb.read_documents(spark, path).count() == 0
