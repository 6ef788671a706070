"""Repeated substrings of a word table by distributed suffix sorting.

Every word gives its suffixes, cut after ``max_len + 1`` characters (one row
each, equal ones added up), which are range-partitioned and sorted. A substring
that is followed by two different characters somewhere (the end of a word is
one) is the common prefix of a run of sorted suffixes: an LCP interval. One walk
over each partition holds the intervals open at the current suffix (at most
``max_len``) and gives out those that branch. An interval that reaches a
partition's first or last suffix may go on beyond it, so its part is given out
in any case, and parts of the same substring are added up.

So n characters make n suffix rows and fewer intervals than that, not a row for
each of their ``n * max_len`` substrings, and a task holds no more than one
suffix and its prefixes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "\0"      # follows a word's last character; substrings with it do not count
SUFFIX_ROWS = 1 << 16


def suffixes(words: DataFrame, max_len: int) -> DataFrame:
    """(suffix, freq): distinct cut suffixes of ``words(piece, freq)``."""
    schema = T.StructType([T.StructField("suffix", T.StringType()), T.StructField("freq", T.LongType())])

    def run(batches):
        out, weight = [], []
        for b in batches:
            for w, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w += END
                for i in range(len(w) - 1):
                    out.append(w[i:i + max_len + 1])
                weight += [f] * (len(w) - 1)
                if len(out) >= SUFFIX_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(weight, pa.int64())], schema.names)
                    out, weight = [], []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(weight, pa.int64())], schema.names)

    rows = words.filter(F.col("piece").isNotNull()).select("piece", F.col("freq").cast("long").alias("freq")).mapInArrow(run, schema)
    return rows.groupBy("suffix").agg(F.sum("freq").alias("freq"))


def intervals(rows, max_len: int):
    """LCP intervals of sorted ``(suffix, freq)`` pairs: (substring, freq, first
    and last character behind it), those that branch here or touch either end."""
    prev, head, total = "", None, 0
    opened: list[tuple[str, int]] = [("", 0)] * (max_len + 2)    # per depth: first suffix, total before it

    def close(upto: int, last: bool):
        end = prev.find(END)
        for d in range(min(max_len, len(prev) - 1 if end < 0 else end), upto, -1):
            first, before = opened[d]
            if first[d] != prev[d] or last or first is head:
                yield prev[:d], total - before, first[d], prev[d]

    for suffix, freq in rows:
        if head is None:
            head, common = suffix, 0
        else:
            common, top = 0, min(len(prev), len(suffix))
            while common < top and prev[common] == suffix[common]:
                common += 1
            yield from close(common, False)
        for d in range(common + 1, min(len(suffix), max_len + 1) + 1):
            opened[d] = (suffix, total)
        prev, total = suffix, total + freq
    if head is not None:
        yield from close(0, True)


def repeated_substrings(words: DataFrame, max_len: int = 16, min_freq: int = 2) -> DataFrame:
    """(sub, freq): every substring of 1 to ``max_len`` characters of the words
    that stands in them ``min_freq`` times or more (by the words' frequency) and
    before at least two different characters, the end of a word being one. What
    is left out is always followed by the same character, so a longer substring
    stands as often. Words with U+0000 are read as if they ended there."""
    schema = T.StructType([T.StructField("sub", T.StringType()), T.StructField("freq", T.LongType()),
                           T.StructField("lo", T.StringType()), T.StructField("hi", T.StringType())])

    def run(batches):
        rows = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        out: list[tuple] = []
        for x in intervals(rows, max_len):
            out.append(x)
            if len(out) >= SUFFIX_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema.names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema.names)

    s = suffixes(words, max_len)
    parts = s.repartitionByRange("suffix").sortWithinPartitions("suffix").mapInArrow(run, schema)
    return (parts.groupBy("sub").agg(F.sum("freq").alias("freq"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .filter((F.col("lo") != F.col("hi")) & (F.col("freq") >= min_freq)).select("sub", "freq"))
