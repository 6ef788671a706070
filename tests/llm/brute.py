"""Plain versions that the tests compare with, and awkward rows."""

import re
from collections import Counter, defaultdict

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, h string, size string, doc string, score string"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows,
    extra columns with names that the operators use inside."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    near = [f"n{i}" for i in range(200)]
    rows = [
        (1, "alpha beta gamma delta epsilon zeta\nsame line here", "en", "a"),
        (1, "alpha beta gamma delta epsilon zeta\nsame line here", "en", "a"),
        (2, "alpha beta gamma delta epsilon zeta\nsame line here", "en", "b"),
        (3, None, "en", "a"), (4, "", None, "a"), (5, " \n\t ", "fr", None),
        (None, "no key but text", "en", "b"), (None, None, None, None),
        (6, long, "en", "c"), (7, long + " tail", "de", None),
        (8, "one", "en", "a"), (9, "one", "en", None), (10, "One", "en", "b"),
        (11, " ".join(near), "en", "b"), (12, " ".join(near[:-2] + ["x", "y"]), "en", "c"),
        (13, "cut\x00zero é’s    wide　space <|endoftext|> 'll\r\nend", "es", "d"),
        (20, "alpha beta gamma", "en", "d"), (40, "ONE", "en", "d"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", "x", "x", "x", "x") for r in rows],
                                 DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def jaccard_links(texts, similarity=0.8, k=5):
    """{(i, j): True} over row numbers, and each row's smallest reachable row."""
    sets = []
    for t in texts:
        w = words(lower(t))
        sets.append({tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    inv, both = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for g in s:
            inv[g].append(i)
    for rows in inv.values():
        for a in range(len(rows)):
            for b in range(a):
                both[rows[b], rows[a]] += 1
    return [p for p, c in both.items() if c / (len(sets[p[0]]) + len(sets[p[1]]) - c) >= similarity]


def reach(n, links):
    par = list(range(n))

    def f(x):
        while par[x] != x:
            x = par[x]
        return x
    for a, b in links:
        a, b = f(a), f(b)
        par[max(a, b)] = min(a, b)
    return [f(i) for i in range(n)]


def key_of(rows):
    """Rows as a multiset that can be compared."""
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
