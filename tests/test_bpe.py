"""BPE training and encoding against the public `tokenizers` trainer
(test-only dependency): identical vocabulary, merges and ids."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from corpusprep.operators import bpe
from corpusprep.profiles import BASE_SPECIALS
from corpusprep.sources import tables as tb

tokenizers = pytest.importorskip("tokenizers")


def _library(texts, vocab_size):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers
    tok = Tokenizer(models.BPE(unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Metaspace()
    tok.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=vocab_size, special_tokens=BASE_SPECIALS,
                                                       show_progress=False))
    return tok


def test_toy_corpus_merges(spark):
    texts = ["low low low lower", "newest newest widest low"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    vocab, merges = bpe.train_bpe(df, 40, BASE_SPECIALS)
    lib = _library(texts, 40)
    assert {r["piece"]: r["id"] for r in vocab.collect()} == lib.get_vocab()


def test_documents_match_library(spark):
    df = tb.text_table(spark, SMALL).filter(F.col("doc_id") < 60)
    docs = sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    vocab, merges = bpe.train_bpe(df, 220, BASE_SPECIALS)
    lib = _library([t for _, t in docs], 220)
    assert {r["piece"]: r["id"] for r in vocab.collect()} == lib.get_vocab()
    model = bpe.make_bpe_model(vocab, merges, BASE_SPECIALS)
    enc = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_bpe(df.select("doc_id", "text"), model).collect()}
    for d, t in docs:
        assert enc[d] == lib.encode(t).ids


def test_encode_specials_and_unknown(spark):
    df = spark.createDataFrame([("ab ab",)], "text string")
    vocab, merges = bpe.train_bpe(df, 12, BASE_SPECIALS + ["<USER>"])
    model = bpe.make_bpe_model(vocab, merges, BASE_SPECIALS + ["<USER>"])
    out = bpe.encode_bpe(spark.createDataFrame([("<USER>ab zb",)], "text string"), model).first()["ids"]
    ids = {r["piece"]: r["id"] for r in vocab.collect()}
    assert out[0] == ids["<USER>"] and ids["[UNK]"] in out


def test_vectorised_merge_matches_left_to_right():
    import numpy as np
    rows = [[1, 1, 1], [1, 1, 1, 1], [2, 3, 1, 1], [3, 2], [1, 2, 3, 2, 3]]
    table = {(1, 1): 9, (2, 3): 8}
    flat = np.array([x for r in rows for x in r], dtype=np.int64)
    offs = np.cumsum([0] + [len(r) for r in rows]).astype(np.int64)
    items = sorted((a * bpe._PAIR_SHIFT + b, n) for (a, b), n in table.items())
    vals, new_offs = bpe._merge_flat(flat, offs, np.array([k for k, _ in items]), np.array([n for _, n in items]))
    got = [list(vals[new_offs[i]:new_offs[i + 1]]) for i in range(len(rows))]
    assert got == [bpe._merge_symbols(r, table) for r in rows] == [[9, 1], [9, 9], [8, 9], [3, 2], [1, 8, 8]]


@pytest.mark.parametrize("pull", [0, 1200, 100_000])
def test_fetching_words_gives_the_same_merges(spark, pull):
    """Rounds over few fetched words, over all of them, or over the whole table."""
    df = tb.text_table(spark, SMALL).filter(F.col("doc_id") < {0: 2, 1200: 4}.get(pull, 30))
    texts = [r["text"] for r in df.orderBy("doc_id").collect()]
    size = {0: 60, 1200: 160}.get(pull, 700)
    vocab, merges = bpe.train_bpe(df, size, BASE_SPECIALS, pull_words=pull)
    assert {r["piece"]: r["id"] for r in vocab.collect()} == _library(texts, size).get_vocab()


def test_until_no_pair_is_left(spark):
    """A vocabulary larger than the corpus can fill ends with every word one token."""
    df = tb.text_table(spark, SMALL).filter(F.col("doc_id") < 25).select("doc_id", "text")
    docs = sorted((r["doc_id"], r["text"]) for r in df.collect())
    lib = _library([t for _, t in docs], 32_000)
    for pull in (5000, 100_000):
        vocab, merges = bpe.train_bpe(df, 32_000, BASE_SPECIALS, pull_words=pull)
        assert {r["piece"]: r["id"] for r in vocab.collect()} == lib.get_vocab()
    model = bpe.make_bpe_model(vocab, merges, BASE_SPECIALS)
    enc = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_bpe(df, model).collect()}
    for d, t in docs:
        assert enc[d] == lib.encode(t).ids


def test_long_piece_is_merged_in_line_with_its_length(spark):
    import random
    import time
    df = tb.text_table(spark, SMALL).filter(F.col("doc_id") < 10)
    texts = [r["text"] for r in df.orderBy("doc_id").collect()]
    vocab, merges = bpe.train_bpe(df, 900, BASE_SPECIALS)
    model, lib = bpe.make_bpe_model(vocab, merges, BASE_SPECIALS), _library(texts, 900)
    rnd = random.Random(1)
    letters = [r["piece"] for r in vocab.collect() if len(r["piece"]) == 1 and r["piece"].isalpha()]
    word = "".join(rnd.choice(letters) for _ in range(100_000))
    t0 = time.time()
    got = model.encode_piece("▁" + word)
    assert time.time() - t0 < 20 and got == lib.encode(word).ids
    for w in ("aaaaaaa", "abababab", "eeteeteet", "nnn"):
        assert model.encode_piece("▁" + w) == lib.encode(w).ids


@pytest.mark.parametrize("pull", [1, 12])
def test_rounds_over_distinct_runs_give_the_same_merges(spark, pull):
    """Rounds of few runs, tokens that two merges make and runs of one symbol
    among them, against one-at-a-time training over all words."""
    from collections import Counter
    r = random.Random(pull)
    words = Counter("".join(r.choice("aaabbc") for _ in range(r.randint(1, 9))) for _ in range(60))
    df = spark.createDataFrame([(" ".join([w] * n),) for w, n in words.items()], "text string")
    _, merges = bpe.train_bpe(df, 20, [], pull_words=pull)
    counts = Counter()
    for w, n in words.items():
        counts["▁" + w] += n
    pieces = sorted({c for w in counts for c in w})
    ids, table, want = {c: i for i, c in enumerate(pieces)}, {}, []
    table = {w: [ids[c] for c in w] for w in counts}
    while len(pieces) < 20:
        pairs = Counter()
        for w, s in table.items():
            for p in zip(s, s[1:]):
                pairs[p] += counts[w]
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        if pieces[a] + pieces[b] not in ids:
            ids[pieces[a] + pieces[b]] = len(pieces)
            pieces.append(pieces[a] + pieces[b])
        new = ids[pieces[a] + pieces[b]]
        want.append((a, b, new, n))
        table = {w: bpe._merge_symbols(s, {(a, b): new}) for w, s in table.items()}
    got = [(m["left_id"], m["right_id"], m["id"], m["count"]) for m in merges.orderBy("rank").collect()]
    assert got == want
