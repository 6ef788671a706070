"""Counts of hashed keys over many blocks of data, by shards of the hash.

A block asks each shard for the keys it holds in the shard's range, once per
key, with its own counts; a shard adds up what all blocks sent and answers in
the order asked. Keys travel sorted, as differences in compressed byte planes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusprep.llm.token_binary import from_planes, to_planes

ASK = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("shard", T.IntegerType()),
                    T.StructField("block", T.LongType()), T.StructField("n", T.LongType()),
                    T.StructField("keys", T.ArrayType(T.BinaryType())),
                    T.StructField("counts", T.ArrayType(T.BinaryType()))])


def pack(a: np.ndarray) -> list[bytes]:
    """Compressed byte planes of unsigned 64-bit numbers, low half then high half."""
    return to_planes((a & np.uint64(0xFFFFFFFF)).astype(np.uint32)) + to_planes((a >> np.uint64(32)).astype(np.uint32))


def unpack(p: list[bytes], n: int) -> np.ndarray:
    return from_planes(p[:4], n).astype(np.uint64) | (from_planes(p[4:], n).astype(np.uint64) << np.uint64(32))


def shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Borders of the shards (equal ranges of the hash) in sorted keys."""
    step = (1 << 64) // shards
    return np.searchsorted(keys, np.array([i * step for i in range(1, shards)], np.uint64))


def entry(keys: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Sorted keys and their counts as an ask carries them."""
    return pack(np.diff(keys, prepend=np.uint64(0))), pack(counts.astype(np.uint64))


def answer(asked: DataFrame) -> DataFrame:
    """(level, shard, block, n, totals, sum, known): the counts over all blocks,
    in the order asked (not for blocks below 0, which only contribute); on one
    row per shard also the sum of its counts and its keys of a count over 0."""
    schema = "level int, shard int, block long, n long, totals array<binary>, sum long, known long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpack(list(k), n), dtype=np.uint64) for k, n in zip(pdf["keys"], pdf["n"])]
        counts = np.concatenate([unpack(list(c), n) for c, n in zip(pdf["counts"], pdf["n"])])
        uniq, inv = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(uniq), np.uint64)
        np.add.at(total, inv, counts)
        ends = np.cumsum(pdf["n"].to_numpy())
        out = pdf[["level", "shard", "block", "n"]].copy()
        out["totals"] = [pack(total[inv[e - n:e]]) if b >= 0 else [] for e, n, b in zip(ends, pdf["n"], pdf["block"])]
        out["sum"], out["known"] = 0, 0
        out.iloc[0, -2:] = [int(total.sum()), int((total > 0).sum())]
        return out

    return asked.groupBy("level", "shard").applyInPandas(run, schema)
