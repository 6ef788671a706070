"""Operator 9 against a word-by-word scan."""

import re

from corpusprep.llm import license_scan as ls
from corpusprep.llm import queries as q
from corpusprep.llm.common import read
from conftest import SMALL
from llm import brute


def plain(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
    at = [(j, lab) for p, lab in ls.BASE for j in range(len(w)) if w[j:j + len(p.split())] == p.split()]
    return (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None,
            ",".join(sorted({lab for _, lab in at})))


def base(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in read(spark, SMALL, "documents").collect()}
    rows = q.QUERIES["op9_license_scan"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert base(r) == plain(texts[r["doc_id"]])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


TEXTS = {
    1: "x y. Released under the MIT License. z",
    2: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
       "documentation files (the \"Software\"), to deal in the Software without restriction",
    3: "licensed under the Apache License, Version 2.0 and all rights reserved; CC BY cc-by CC\nBY",
    4: "the license of the version under this is MIT-like work",
    5: "This work is licensed under the GNU General Public License, version 3.",
    6: "cc" * 3 + " by general public licence all rights",
    7: "All Rights Reserved " * 50,
    8: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
    9: "éall rights reserved", 10: "all rights\x00reserved", 11: "cc by cc  by",
}


def test_templates_and_edges(spark):
    rows = [(k, t, "x", "x") for k, t in TEXTS.items()] + [(12, None, None, None), (13, "", "", ""), (1, TEXTS[1], "", "")]
    got = ls.scan(spark.createDataFrame(rows, "doc_id long, text string, word string, labels string")).collect()
    assert len(got) == len(rows)
    labels = {}
    for r in got:
        assert base(r) == plain(TEXTS.get(r["doc_id"]))
        labels[r["doc_id"]] = r["labels"]
    assert labels[1] == "mit" and labels[2] == "mit" and labels[3] == "apache-2.0,cc-by,reserved"
    assert labels[4] == "" and labels[5] == "gpl,gpl-3.0" and labels[6] == "" and labels[8] == "bsd"
    assert labels[12] == labels[13] == ""
    assert ls.scan(brute.empty(spark)).count() == 0


def test_awkward_rows(spark):
    docs = brute.awkward(spark)
    want = brute.key_of((r["doc_id"], *plain(r["text"])) for r in docs.collect())
    assert brute.key_of((r["doc_id"], *base(r)) for r in ls.scan(docs).collect()) == want


def test_a_place_is_reported(spark):
    r = ls.scan(spark.createDataFrame([(1, "a b c released under the mit license")], "doc_id long, text string")).first()
    assert [(p["label"], p["word"], p["share"]) for p in r["places"]] == [("mit", 3, 1.0)]


def by_definition(texts):
    """Places of every text from the operator's definition: phrases first, then
    begins around them, then votes of the looked-up words and the shared wording."""
    import math
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(t or "")) for t in texts]
    vocab = ls.vocabulary()
    df = {v: sum(v in set(w) for w in words) for v in vocab}
    idf = {v: math.log((len(texts) + 1) / (n + 0.5)) for v, n in df.items() if n}
    phrases = [set(p.split()) for _, _, p in ls.TEMPLATES]
    floor = min(sorted(idf[x] for x in p)[-min(ls.VOTES, len(p))] for p in phrases if all(x in idf for x in p))
    out = []
    for w in words:
        looked = {i for i, x in enumerate(w) if x in idf and idf[x] >= floor}
        best = {}
        for label, wording, phrase in ls.TEMPLATES:
            t, p = wording.split(), phrase.split()
            at = next(i for i in range(len(t)) if t[i:i + len(p)] == p)
            for j in (j for j in range(len(w)) if w[j:j + len(p)] == p):
                for off in range(-ls.SLACK, ls.SLACK + 1):
                    begin = j - at - off
                    nearer = [o for o in range(-ls.SLACK, ls.SLACK + 1) if (abs(o), o) < (abs(off), off)
                              and begin + at + o >= 0 and w[begin + at + o:begin + at + o + len(p)] == p]
                    same = [begin + i for i, x in enumerate(t) if 0 <= begin + i < len(w) and w[begin + i] == x]
                    if nearer or len(set(same) & looked) < ls.VOTES or len(same) / len(t) < ls.SHARE:
                        continue
                    v = (-len(same) / len(t), max(begin, 0))
                    best[label, j] = min(best.get((label, j), v), v)
        out.append(sorted((label, v[1], round(-v[0], 9)) for (label, _), v in best.items()))
    return out


NOTICE_TEXTS = {
    "gpl,gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                   "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                   "option) any later version.",
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice appears.",
    "mit": "// SPDX-License-Identifier: MIT\nint main() {}",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file)",
    "lgpl-2.1": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file",
    "cc-by-nc-4.0": "x" * 40 + " Licensed under CC BY-NC 4.0.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission.",
}


def test_notices_of_common_licences_wherever_they_stand(spark):
    rows, want, filler = [], {}, "this text is of the words that stand in a notice and of no other "
    for i, (labels, text) in enumerate(NOTICE_TEXTS.items()):
        for j, body in enumerate((text, filler * 9 + text, filler * 700 + text + " " + filler * 3, text.upper() + filler)):
            rows.append((4 * i + j, body))
            want[4 * i + j] = set(labels.split(",")) | ({"cc-by"} if "CC BY" in text.upper().replace("-", " ") else set())
    every = " ".join(NOTICE_TEXTS.values())                   # a file with all of them
    rows.append((1000, every))
    want[1000] = set().union(*want.values())
    rows += [(1001, filler * 50), (1002, "mit license"), (1003, "a licence by the apache people, version 2 0 of it")]
    want |= {1001: set(), 1002: None, 1003: set()}
    got = {r["doc_id"]: r for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, labels in want.items():
        if labels is not None:
            assert set(got[k]["labels"].split(",")) - {""} == labels, k


def test_labels_scores_and_places_equal_the_definition(spark):
    import random
    rng = random.Random(5)
    pool = [w for _, t, _ in ls.TEMPLATES for w in t.split()] + ["und", "der", "zz"] * 20
    texts = [r["text"] for r in read(spark, SMALL, "documents").limit(60).collect()] + list(NOTICE_TEXTS.values()) + list(TEXTS.values())
    for _, t, _ in ls.TEMPLATES:                               # notices cut, with words lost and put in, and repeated
        w = t.split()
        for _ in range(4):
            x = [y for y in w if rng.random() > 0.12]
            x.insert(rng.randrange(len(x) + 1), rng.choice(pool))
            texts.append(" ".join(rng.choices(pool, k=rng.randrange(40)) + x[rng.randrange(3):] + rng.choices(pool, k=rng.randrange(40))))
        texts.append(" ".join([t] * 5))
    texts += ["", None, "mit license " * 300]
    got = ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = by_definition(texts)
    for r in got:
        t = texts[r["doc_id"]] or ""
        places = want[r["doc_id"]]
        assert sorted((p["label"], p["word"], round(p["share"], 9)) for p in r["places"]) == places, t
        labels = {p[0] for p in places} | (set(plain(t)[4].split(",")) - {""})
        assert set(r["labels"].split(",")) - {""} == labels
        assert abs(r["score"] - (1.0 if r["base_labels"] else max((p[2] for p in places), default=0.0))) < 1e-9
    assert sum(bool(p) for p in want) >= 80     # not an empty comparison
