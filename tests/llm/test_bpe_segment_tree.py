"""Operator 13 against the tiktoken library, text by text."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusprep.llm import bpe_segment_tree as seg
from corpusprep.llm import queries as q
from corpusprep.llm.common import read
from conftest import SMALL
from llm import brute

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def lib():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def own():
    return seg.encoder(PATH, public_tokenizers.PATTERN)


def expect(lib, text):
    ids = lib.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(lib.decode_bytes(ids)).hexdigest())


def listed(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_query_equals_library(spark, lib):
    texts = {r["doc_id"]: r["text"] for r in read(spark, SMALL, "documents").collect()}
    rows = q.QUERIES["op13_bpe_segment_tree"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expect(lib, texts[r["doc_id"]])


def test_awkward_rows(spark, lib):
    docs = brute.awkward(spark)
    want = sorted((r["doc_id"] or 0, *expect(lib, r["text"])) for r in docs.collect())
    out = seg.encode_decode(docs, PATH, public_tokenizers.PATTERN, with_ids=True)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    rows = out.collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    assert all(hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] for r in rows)
    assert seg.encode_decode(brute.empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_plan_has_no_shuffle(spark):
    out = seg.encode_decode(brute.awkward(spark), PATH, public_tokenizers.PATTERN)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_odd_characters_in_any_order(lib):
    alpha = list("abcdetsvlmrTH'’ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　.,!?-_<|>#$%0123éèàñ中文😀©²½۝ा") + [
        "<|endoftext|>", "'s", "'ll", "  ", "\n\n", " \n", "ing", "tion"]
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 150))) for _ in range(5000)]
    texts += [f"a{chr(c)} b{chr(c)}'s{chr(c)}{chr(c)}x  {chr(c)}" for c in range(0x2100)]
    for t, raw in zip(texts, own().encode_batch(texts)):
        assert listed(raw) == lib.encode_ordinary(t), repr(t)
        assert own().decode(raw) == t.encode()


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from("abeinrst "), st.characters(codec="utf-8"))), max_size=5))
def test_any_texts(lib, texts):
    for t, raw in zip(texts, own().encode_batch(texts)):
        assert listed(raw) == lib.encode_ordinary(t)


def test_forest_and_single_tree_agree():
    rnd = random.Random(5)
    for width in seg.WIDTHS:
        words = ["".join(rnd.choice("aeinrstlo") for _ in range(rnd.randint(2, width))).encode() for _ in range(500)]
        assert [listed(x) for x in own().merge_forest(words, width)] == [own().merge_one(w) for w in words]


def test_runs_without_boundaries(lib, monkeypatch):
    rnd = random.Random(7)
    texts = ["ab" * 20_000, "a" * 30_001, "".join(rnd.choice("acdeginorst") for _ in range(50_000)), " " * 5000 + "x", "é中" * 4000]
    for t in texts:
        assert listed(own().encode_batch([t])[0]) == lib.encode_ordinary(t)
    # a long text is cut into matches bit by bit, with the same ids
    monkeypatch.setattr(seg, "CHUNK_CHARS", 100)
    monkeypatch.setattr(seg, "CHUNK_WORDS", 7)
    t = "it's 12 words, and more of them\n\n  here " * 50
    assert [listed(x) for x in own().encode_batch([t, "short", t])] == [lib.encode_ordinary(x) for x in (t, "short", t)]


def test_cache_stays_bounded(lib, monkeypatch):
    monkeypatch.setattr(seg, "CACHE_ENTRIES", 50)
    enc = seg.SegmentEncoder(PATH, public_tokenizers.PATTERN)
    for i in range(30):
        t = " ".join(f"word{i}x{j}" for j in range(40))
        assert listed(enc.encode_batch([t])[0]) == lib.encode_ordinary(t)
        assert len(enc.seen) <= 50 + 200


def test_segment_tree_keeps_the_leftmost_minimum():
    rnd = random.Random(9)
    for n in (1, 2, 3, 7, 64, 100):
        values = [rnd.choice([None, rnd.randint(0, 9)]) for _ in range(n)]
        tree = seg.SegmentTree(values)
        for _ in range(300):
            i, v = rnd.randrange(n), rnd.choice([None, rnd.randint(0, 9)])
            values[i] = v
            tree.update(i, v)
            want = min(((x, k) for k, x in enumerate(values) if x is not None), default=None)
            assert tree.lowest() == want
