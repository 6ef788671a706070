"""Operator 10 against the tokenizers library, text by text."""

import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from corpusprep.llm import bpe_boundary as bb
from corpusprep.llm import queries as q
from corpusprep.llm.common import read
from conftest import SMALL
from llm import brute


def expect(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    raw = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(
        lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_equals_library(spark):
    lib = Tokenizer.from_file(q.vocabulary())
    texts = {r["doc_id"]: r["text"] for r in read(spark, SMALL, "documents").collect()}
    rows = q.QUERIES["op10_bpe_boundary"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expect(lib, texts[r["doc_id"]])


def test_awkward_rows(spark):
    lib = Tokenizer.from_file(q.vocabulary())
    docs = brute.awkward(spark)
    want = sorted(((r["doc_id"] or 0, *expect(lib, r["text"])) for r in docs.collect()))
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                 for r in bb.encode_decode(docs, q.vocabulary()).collect())
    assert got == want
    assert bb.encode_decode(brute.empty(spark), q.vocabulary()).count() == 0


def test_odd_characters_in_any_order():
    enc = bb.encoder(q.vocabulary())
    alpha = list("abcdetsvlmrTH'’ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　.,!?-_<|>#$%0123éèàñ中文😀©²½۝ा") + [
        "<|endoftext|>", "'s", "'ll", "  ", "\n\n", " \n"]
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 40))) for _ in range(8000)]
    texts += [f"a{chr(c)} b{chr(c)}'s{chr(c)}{chr(c)}x  {chr(c)}" for c in range(0x2100)]
    lib = enc.lib.encode_batch_fast(texts, add_special_tokens=False)
    for t, a, e in zip(texts, enc.encode_batch(texts), lib):
        assert np.frombuffer(a, "<u4").tolist() == e.ids, repr(t)
        assert enc.decode(a).decode() == enc.lib.decode(e.ids, skip_special_tokens=False)


def test_no_boundary_is_inside_a_token():
    enc = bb.encoder(q.vocabulary())
    for b in enc.bytes_of.values():
        assert not enc.cuts(b).any()


def test_invalid_ids_decode_with_replacement():
    enc = bb.encoder(q.vocabulary())
    half = next(i for i, b in enc.bytes_of.items() if b == b"\xc3")
    ids = [half, half]
    assert enc.decode(np.array(ids, "<u4").tobytes()).decode() == enc.lib.decode(ids, skip_special_tokens=False)


def _inner_blank_vocabulary(path):
    """A vocabulary made by hand whose tokens hold blanks inside, and whose
    pre-tokeniser leaves the text whole."""
    from tokenizers import decoders, models, pre_tokenizers
    back = {b: c for c, b in bb.byte_symbols().items()}
    merges = [("a", back[32]), ("a" + back[32], "b"), ("o", "f"), (back[32], "t"), ("of", back[32] + "t"), ("!", back[32]), ("c", "d")]
    vocab = {c: i for i, c in enumerate(bb.byte_symbols())}
    for x, y in merges:
        vocab[x + y] = len(vocab)
    lib = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    lib.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    lib.decoder = decoders.ByteLevel()
    lib.save(path)
    return Tokenizer.from_file(path)


def test_blanks_are_cut_by_the_table(tmp_path):
    path = str(tmp_path / "inner.json")
    lib = _inner_blank_vocabulary(path)
    enc = bb.BoundaryEncoder(path)
    assert ord('a') in enc.held and ord('d') not in enc.held
    rng = random.Random(3)
    texts = ["a b", "of the", "x a b c of t", "cd cd", "hi! a", "d c", "", " ", "a  b"]
    texts += ["".join(rng.choices(["a", "b", "of", " ", " t", "!", "cd", "\u00e9", "x"], k=rng.randrange(1, 60))) for _ in range(3000)]
    for t, got in zip(texts, enc.encode_batch(texts)):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t
    # the given vocabulary has a token of this byte and a blank: the blank is not cut from letters that end in it
    given = bb.BoundaryEncoder(q.vocabulary())
    assert given.held == {0xA0}
    assert given.words("il va \u00e0 la mer") == (["il"], ["va", "\u00e0 la", "mer"])
    lib = Tokenizer.from_file(q.vocabulary())
    for t in ("il va \u00e0 la mer", "\u00e0 \u00e0 \u00e0", "\u00e0 ", " \u00e0 's", "\u0420 \u0420\u00a0 x"):
        assert np.frombuffer(given.encode_batch([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t
