"""Operator 11 against a plain Merkle tree, its SQL, and the layout's own rules."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusprep.llm import merkle
from corpusprep.llm import queries as q
from corpusprep.llm.common import ascii_lower, read, scratch_path
from conftest import SMALL
from llm import brute

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row, **now):
    vals = [now.get(f, row[f]) for f in FIELDS]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))


def climb(nodes, at):
    """(root, siblings of node ``at`` level by level, its place per level)."""
    path = []
    while len(nodes) > 1:
        run = nodes[at // 8 * 8:at // 8 * 8 + 8]
        path.append((run[:at % 8], run[at % 8 + 1:]))
        nodes, at = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)], at // 8
    return nodes[0], path


def plain(rows):
    """Rows of op11 by lists."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        rs = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[g] = (rs, [leaf_of(r) for r in rs])
    subs = [climb(trees[g][1], 0)[0] for g in langs]
    out = []
    for k, g in enumerate(langs):
        root, over = climb(subs, k)
        for i, r in enumerate(trees[g][0]):
            path = climb(trees[g][1], i)[1] + over
            low = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            now = brute.lower(r["text"]) if low and r["text"] is not None else r["text"]
            cur = leaf_of(r, text=now)
            for a, z in path:
                cur = sha("".join([*a, cur, *z]))
            out.append((r["doc_id"], trees[g][1][i], subs[k], root, sha("".join("".join(a + z) for a, z in path)), cur, cur == root))
    return out


def run(spark, docs, **options):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    now = {"text": F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))}
    path = scratch_path(spark, "merkle-test")
    merkle.write(merkle.leaves(docs, "doc_id", FIELDS, "lang", now), path, **options)
    return path


def test_query_equals_plain_tree(spark):
    rows = q.QUERIES["op11_merkle"](spark, SMALL).collect()
    want = plain(read(spark, SMALL, "documents").collect())
    assert Counter(map(tuple, rows)) == Counter(want)
    assert 0 < sum(r["verified"] for r in rows) < len(rows)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_tiers_of_small_subtrees_give_the_same(spark, levels):
    docs = read(spark, SMALL, "documents").unionByName(
        spark.range(150).select((F.col("id") + 10_000).alias("doc_id"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text"),
                                F.concat(F.lit("x"), F.col("id").cast("string")).alias("lang"), F.lit(None).cast("string").alias("source"),
                                F.lit(None).cast("long").alias("n_chars")))
    path = run(spark, docs, levels=levels)
    got = merkle.verify(spark, path, levels=levels).collect()
    assert Counter(map(tuple, got)) == Counter(plain(docs.collect()))
    assert spark.read.parquet(f"{path}/meta").first()["groups"] > 1 or levels == 3


def test_awkward_rows_and_sql(spark):
    docs = brute.awkward(spark)
    path = run(spark, docs)
    got = merkle.verify(spark, path, with_path=True)
    rows = got.collect()
    want = plain(docs.collect())
    assert Counter(tuple(r)[:7] for r in rows) == Counter(want)
    for r in rows:      # the path itself leads from the leaf to the root
        assert merkle.fold(r["leaf"], [(p["left"], p["right"]) for p in r["path"]]) == r["root"]
    con = duckdb.connect()
    con.execute("create table t (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into t values (?, ?, ?, ?, ?)", [tuple(r)[:5] for r in docs.collect()])
    assert Counter(con.execute(merkle.oracle("t")).fetchall()) == Counter(want)


def test_empty_and_single(spark):
    assert merkle.verify(spark, run(spark, brute.empty(spark))).count() == 0
    one = brute.awkward(spark).filter("doc_id = 8")
    r = merkle.verify(spark, run(spark, one)).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == sha("")


def test_text_keys_and_no_changes(spark):
    docs = brute.awkward(spark).withColumn("name", F.col("doc_id").cast("string"))
    path = scratch_path(spark, "merkle-test")
    merkle.write(merkle.leaves(docs, "name", ["name", "text"], "source"), path)
    rows = merkle.verify(spark, path, key="name").collect()
    assert len(rows) == docs.count() and all(r["verified"] for r in rows)
    assert {r["name"] for r in rows} == {r["name"] for r in docs.collect()}


@pytest.mark.parametrize("levels", range(1, 6))
def test_van_emde_boas_addresses(levels):
    n = merkle.n_nodes(levels)
    at = [merkle.address(levels, d, np.arange(8 ** d)) for d in range(levels)]
    assert sorted(np.concatenate(at).tolist()) == list(range(n))       # each place once
    assert at[0].tolist() == [0]
    top = levels // 2
    if top:
        # the upper half comes first, then each lower subtree in one piece, laid out the same way
        assert max(int(a.max()) for a in at[:top]) == merkle.n_nodes(top) - 1
        size = merkle.n_nodes(levels - top)
        for i in (0, 1, 8 ** top - 1):
            piece = np.concatenate([at[d].reshape(8 ** top, -1)[i] for d in range(top, levels)])
            low = merkle.n_nodes(top) + i * size
            assert sorted(piece.tolist()) == list(range(low, low + size))
            assert (at[levels - 1].reshape(8 ** top, -1)[i] - low == merkle.address(levels - top, levels - top - 1, np.arange(8 ** (levels - top - 1)))).all()


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 500, 513])
def test_subtree_equals_plain(n):
    leaves = [sha(str(i)) for i in range(n)]
    h = merkle.height_of(n)
    nodes = merkle.build([bytes.fromhex(x) for x in leaves], h)
    levels = merkle.levels_hex(nodes, n, h)
    root = climb(leaves, 0)[0]
    assert levels[-1] == root == nodes[:32].hex()
    for i in (0, n // 2, n - 1):
        path = merkle.siblings(levels, i)
        assert path == [("".join(a), "".join(z)) for a, z in climb(leaves, i)[1]]
        assert merkle.fold(leaves[i], path) == root and merkle.unpack(merkle.pack(path)) == path
