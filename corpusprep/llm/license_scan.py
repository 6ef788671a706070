"""Operator 9: licence scan by a positional index of licence words.

The index holds, for every word of the templates (wordings of licence notices),
its postings: the templates it stands in and where. Of a file the licence words
of highest IDF over the scanned documents are looked up: those at least as rare
as the ``VOTES`` rarest words of every mandatory phrase, so that a phrase always
has that many of its words among them, in a file of any length and with any
number of notices. Every occurrence of such a word and every posting of it name
a template and the place where it would begin; places that ``VOTES`` occurrences
name are the intersection of the postings by relative position. A place counts
if the template's mandatory phrase stands there, a few words up or down, and
enough of the wording does.

The templates are fixed and few; the documents are scanned batch by batch as
arrays of word hashes, so work and memory follow the batch: an occurrence gives
as many rows as its word has postings, whatever the number of templates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.llm import wordhash as wh

# Phrases and their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Label, wording of the notice, mandatory phrase inside it.
NOTICES = (
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation "
                 "either version 3 of the license or at your option any later version",
     "gnu affero general public license as published by the free software foundation either version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license 2 0", "apache license 2 0"),
    ("apache-2.0", "apache license version 2 0 january 2004", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                     "or promote products derived from this software without specific prior written permission",
     "may be used to endorse or promote products derived from this software"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software "
                "and accompanying documentation covered by this license",
     "any person or organization obtaining a copy of the software"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     "creative commons attribution noncommercial 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
     "creative commons attribution sharealike 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights "
                "to this work", "waived all copyright and related or neighboring rights"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public "
                "license 2 0", "eclipse public license 2 0"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2",
     "gnu general public license version 2"),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation "
                "either version 2 of the license or at your option any later version",
     "gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation "
                "either version 3 of the license or at your option any later version",
     "gnu general public license as published by the free software foundation either version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
            "is hereby granted", "permission to use copy modify and or distribute"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee "
            "is hereby granted", "permission to use copy modify and distribute this software"),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation "
                 "either version 2 1 of the license or at your option any later version",
     "gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3.0", "under the terms of the gnu lesser general public license as published by the free software foundation "
                 "either version 3 of the license or at your option any later version",
     "gnu lesser general public license as published by the free software foundation either version 3"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction",
     "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software",
     "authors be held liable for any damages arising from the use of this software"),
)

# Label, the words of its identifier in a tag.
TAGS = (
    ("agpl-3.0", "agpl 3 0"), ("apache-2.0", "apache 2 0"), ("bsd", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"),
    ("bsl-1.0", "bsl 1 0"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-nc-4.0", "cc by nc 4 0"), ("cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc0-1.0", "cc0 1 0"), ("epl-2.0", "epl 2 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("isc", "isc"),
    ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3.0", "lgpl 3 0"), ("mit", "mit"), ("mpl-2.0", "mpl 2 0"), ("unlicense", "unlicense"),
    ("zlib", "zlib"),
)
TAG = "spdx license identifier"
TEMPLATES = NOTICES + tuple((label, f"{TAG} {words}", f"{TAG} {words}") for label, words in TAGS)

VOTES = 2       # occurrences that must name the same place
SHARE = 0.5     # of the wording that must stand there
SLACK = 2       # words by which the mandatory phrase may be off

#: What stands between words (of the lower-cased text).
SEPARATORS = wh.separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def vocabulary() -> list[str]:
    return sorted({w for p, _ in BASE for w in p.split()} | {w for _, t, _ in TEMPLATES for w in t.split()})


class Words:
    """Words of a batch as numbers of the licence vocabulary (-1: any other)."""

    def __init__(self, words: list[str]):
        h = np.array([wh.hash_word(w) for w in words], np.uint64)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        self.number = {w: i for i, w in enumerate(words)}

    def ids(self, col: pa.Array):
        """(ids, first): word numbers, and each text's first word."""
        raw, off = wh.buffer_of(col)
        s, e, first = wh.word_spans(raw, off, SEPARATORS)
        h = wh.word_hashes(raw, s, e)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1).astype(np.int32), first

    def of(self, phrase: str) -> np.ndarray:
        return np.array([self.number[w] for w in phrase.split()], np.int32)


def phrase_places(ids: np.ndarray, last: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Word positions at which the phrase stands inside one text; ``last`` is
    each word's end of text."""
    at = np.flatnonzero(ids == phrase[0])
    at = at[at + len(phrase) <= last[at]]
    for i in range(1, len(phrase)):
        at = at[ids[at + i] == phrase[i]]
    return at


def idf(docs: DataFrame, text: str) -> dict[str, float]:
    """IDF over all documents of the licence words that occur (a row per
    vocabulary word)."""
    vocab = vocabulary()

    def run(batches):
        w = Words(vocab)
        df, n = np.zeros(len(vocab), np.int64), 0
        for b in batches:
            _, off = wh.buffer_of(b.column(0))
            for i, j in wh.pieces(off):
                ids, first = w.ids(b.column(0).slice(i, j - i))
                doc = np.repeat(np.arange(j - i), np.diff(first))
                pair = np.unique(doc[ids >= 0] * len(vocab) + ids[ids >= 0])
                df += np.bincount(pair % len(vocab), minlength=len(vocab))
                n += j - i
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(vocab)), -1], pa.int32()),
                                          pa.array([*df.tolist(), n], pa.int64())], ["word", "df"])

    got = docs.select(text).mapInArrow(run, "word int, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
    df = {r["word"]: r["df"] for r in got}
    n = df.get(-1, 0)
    # a word that stands nowhere cannot point to a place
    return {w: math.log((n + 1) / (df[i] + 0.5)) for i, w in enumerate(vocab) if df.get(i)}


class Index:
    """Postings of the licence words: word -> (template, place in it)."""

    def __init__(self, w: Words):
        self.wordings = [w.of(t) for _, t, _ in TEMPLATES]
        self.phrases = [w.of(p) for _, _, p in TEMPLATES]
        self.phrase_at = [f" {t} ".split(f" {p} ")[0].count(" ") if not t.startswith(p) else 0 for _, t, p in TEMPLATES]
        post = sorted((x, t, q) for t, words in enumerate(self.wordings) for q, x in enumerate(words.tolist()))
        word, self.template, self.place = (np.array(c, np.int64) for c in zip(*post))
        self.first = np.searchsorted(word, np.arange(len(w.number) + 1))
        self.longest = max(map(len, self.wordings))


def idf_floor(idfs: dict[str, float], votes: int = VOTES) -> float:
    """IDF from which a licence word is looked up: each mandatory phrase whose
    words all occur has ``votes`` words (all, if fewer) of that IDF or more."""
    tops = [sorted((idfs[w] for w in set(p.split())), reverse=True)[:votes]
            for _, _, p in TEMPLATES if set(p.split()) <= set(idfs)]
    return min((t[-1] for t in tops), default=math.inf)


def found_places(index: Index, ids: np.ndarray, first: np.ndarray, doc_of: np.ndarray, hits: np.ndarray, votes: int,
                 share: float, slack: int):
    """(document, label, word, share) of every template found, once a label and
    place of the mandatory phrase (the best share, then the first word)."""
    n = index.first[ids[hits] + 1] - index.first[ids[hits]]
    at = np.repeat(hits, n)
    ends = np.cumsum(n)
    slot = np.repeat(index.first[ids[hits]] - (ends - n), n) + np.arange(len(at))
    doc = doc_of[at]
    span = int(np.diff(first).max(initial=0)) + index.longest + 1
    # a place may lie before its text: the beginning of the notice is cut off
    key = (doc * len(TEMPLATES) + index.template[slot]) * span + at - index.place[slot] - first[doc] + index.longest
    key, count = np.unique(key, return_counts=True)
    key = key[count >= votes]
    doc, template = key // span // len(TEMPLATES), key // span % len(TEMPLATES)
    begin = key % span - index.longest + first[doc]
    best: dict[tuple, tuple] = {}
    for t in np.unique(template).tolist():
        mine = template == t
        d, b = doc[mine], begin[mine]
        lo, hi = first[d], first[d + 1]

        def there(p, word):
            return (p >= lo) & (p < hi) & (ids[np.clip(p, 0, len(ids) - 1)] == word)

        phrase_at = np.full(len(b), -1)
        for off in sorted(range(-slack, slack + 1), key=abs):
            p = b + index.phrase_at[t] + off
            ok = phrase_at < 0
            for i, word in enumerate(index.phrases[t].tolist()):
                ok &= there(p + i, word)
            phrase_at[ok] = p[ok]
        wording = index.wordings[t]
        same = sum(there(b + i, word).astype(np.int64) for i, word in enumerate(wording.tolist()))
        part = same / len(wording)
        for i in np.flatnonzero((phrase_at >= 0) & (part >= share)).tolist():
            k = (int(d[i]), TEMPLATES[t][0], int(phrase_at[i]))
            v = (-float(part[i]), int(max(b[i], lo[i]) - lo[i]))
            best[k] = min(best.get(k, v), v)
    return [(d, label, word, -part) for (d, label, _), (part, word) in best.items()]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", votes: int = VOTES,
         share: float = SHARE, slack: int = SLACK) -> DataFrame:
    """Per row of ``docs``: ``key, n_words, n_base`` (places of the base
    phrases), ``first_word, last_word`` (smallest and largest start of one,
    words from 0; null without any), ``base_labels, labels`` (with the
    templates'; distinct, sorted, comma-joined, empty for none), ``score`` (best
    share of a found template's words in place, 1 for a base phrase, else 0)
    and ``places`` (label, first word, share of every template found).

    A null or empty text has no words and no labels. Repeated rows are scanned
    each; extra columns are ignored; an empty table gives an empty result."""
    weight = idf(docs, text)
    vocab = vocabulary()
    floor = idf_floor(weight, votes)
    place = T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType()),
                          T.StructField("share", T.DoubleType())])
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("places", T.ArrayType(place))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        w = Words(vocab)
        index = Index(w)
        rare = np.array([x in weight and weight[x] >= floor for x in vocab] + [False])     # the last: any other word
        base = [(w.of(p), label) for p, label in BASE]
        for b in batches:
            _, off = wh.buffer_of(b.column(1))
            for i, j in wh.pieces(off):
                ids, first = w.ids(b.column(1).slice(i, j - i))
                size = np.diff(first)
                doc_of = np.repeat(np.arange(j - i), size)
                last = np.repeat(first[1:], size)
                count = np.zeros(j - i, np.int64)
                low = np.full(j - i, np.iinfo(np.int64).max)
                high = np.full(j - i, -1)
                own: dict[int, set] = {}
                for phrase, label in base:
                    p = phrase_places(ids, last, phrase)
                    doc = doc_of[p]
                    np.add.at(count, doc, 1)
                    np.minimum.at(low, doc, p - first[doc])
                    np.maximum.at(high, doc, p - first[doc])
                    for x in np.unique(doc).tolist():
                        own.setdefault(x, set()).add(label)
                found: dict[int, list] = {}
                for doc, label, word, part in found_places(index, ids, first, doc_of, np.flatnonzero(rare[ids]), votes,
                                                           share, slack):
                    found.setdefault(doc, []).append({"label": label, "word": word, "share": part})
                rows = range(j - i)
                join = lambda s: ",".join(sorted(s))
                cols = [b.column(0).slice(i, j - i), size, count,
                        [int(low[x]) if count[x] else None for x in rows],
                        [int(high[x]) if count[x] else None for x in rows],
                        [join(own.get(x, ())) for x in rows],
                        [join(own.get(x, set()) | {f["label"] for f in found.get(x, ())}) for x in rows],
                        [1.0 if x in own else max((f["share"] for f in found.get(x, ())), default=0.0) for x in rows],
                        [sorted(found.get(x, []), key=lambda f: (f["word"], f["label"])) for x in rows]]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow)], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)
