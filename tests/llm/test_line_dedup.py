"""Operator 4 against its SQL on awkward rows; plan without Python."""

import time

import duckdb

from corpusprep.llm import line_dedup as ld
from llm import brute


def rows(n=40):
    out = []
    for i in range(n):
        body = "\n".join(f"own line {i} {j} with some more words" for j in range(4))
        out.append((i, f"site banner\n{body}\n  shared on six \t\nfour only" if i % 10 < 6 else f"{body}\n\nfour only" if i % 10 < 9 else body,
                    f"s{i % 10}"))
    out += [(100, None, "s1"), (101, "", "s1"), (102, "\n\n", None), (103, "site banner", "s2"), (None, "site banner\nrest of it all", None),
            (1, out[1][1], "s1"), (1, out[1][1], "s1")]
    return out


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute("create table t (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into t values (?, ?, ?)", rows())
    df = spark.createDataFrame([(*r, "x", "x") for r in rows()], "doc_id long, text string, source string, line string, site string")
    for sites in (2, 5, 6, 7):
        want = con.execute(ld.oracle("t", sites)).fetchall()
        out = ld.remove_spread_lines(df, min_sites=sites)
        assert out.columns == [*df.columns, "_ld_lines", "_ld_removed"]
        got = out.select("doc_id", "text", "_ld_lines", "_ld_removed").collect()
        assert brute.key_of(got) == brute.key_of(want)


def test_awkward_rows(spark):
    out = ld.remove_spread_lines(brute.awkward(spark), min_sites=2)
    assert out.count() == brute.awkward(spark).count()
    # a text that stands whole on enough sites is a copied document: left whole
    assert {r["text"] for r in out.filter("doc_id = 8").collect()} == {"one"}
    assert {r["text"] for r in out.filter("doc_id in (1, 2)").collect()} == {"alpha beta gamma delta epsilon zeta\nsame line here"}
    assert ld.remove_spread_lines(brute.empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    out = ld.remove_spread_lines(brute.awkward(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mostly_boilerplate_is_removed(spark):
    """However much of a document spread lines are, they go; only copies of a
    whole text on enough sites stay."""
    banner = "one line of the banner\nanother line of the banner"
    rows = [(i, f"{banner}\nown {i}", f"s{i}") for i in range(6)] + [(10, banner, "s1"), (11, banner, "s2"), (12, "one line of the banner", "s1")]
    rows += [(20 + i, "a copied page\nof two lines", f"s{i}") for i in range(5)]
    rows += [(30, "a copied page\nwith its own end", "s0")]
    out = {r["doc_id"]: (r["text"], r["_ld_removed"]) for r in ld.remove_spread_lines(
        spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i] == (f"own {i}", 2) for i in range(6))
    assert out[10] == out[11] == ("", 2) and out[12] == ("", 1)
    assert all(out[20 + i] == ("a copied page\nof two lines", 0) for i in range(5))
    assert out[30] == ("with its own end", 1)


def test_exempt_documents_are_copies(spark):
    """On the given table: every document that keeps a spread line has its whole text on five sites."""
    from corpusprep.llm.common import read
    from conftest import SMALL

    docs = read(spark, SMALL, "documents")
    rows = docs.collect()
    on = {}
    for r in rows:
        on.setdefault(r["text"], set()).add(r["source"])
    site = {}
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            if x.strip(" \t\r\x0b\x0c"):
                site.setdefault(x.strip(" \t\r\x0b\x0c"), set()).add(r["source"])
    spread = {x for x, s in site.items() if len(s) >= ld.MIN_SITES}
    for r in ld.remove_spread_lines(docs).collect():
        left = [x for x in (r["text"] or "").split("\n") if x.strip(" \t\r\x0b\x0c") in spread]
        assert not left or len(on[r["text"]]) >= ld.MIN_SITES


def test_very_long_documents(spark):
    """Work grows with the lines of a text, not with their square."""
    big = "\n".join(f"line {i} of all" for i in range(60_000))
    docs = spark.createDataFrame([(i, f"{big}\nown {i}", f"s{i}") for i in range(5)], "doc_id long, text string, source string")
    t0 = time.time()
    got = ld.remove_spread_lines(docs).select("doc_id", "text", "_ld_lines", "_ld_removed").collect()
    assert sorted(tuple(r) for r in got) == [(i, f"own {i}", 60_001, 60_000) for i in range(5)]
    assert time.time() - t0 < 150
