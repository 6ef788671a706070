"""Operator 6: similarity join on word n-grams by MinHash banding.

1. Each text becomes the set of its word n-grams (hashed to 64 bits) and a
   MinHash signature, cut into bands; band and row counts follow from the
   similarity threshold and the recall wanted there.
2. Exact copies share one node (keyed by the text), so a group of copies is one
   row from here on.
3. A shuffle on the band hashes brings nodes together; inside a bucket every
   node is linked to the smallest one only. These candidate edges fall into
   connected groups.
4. Every group is verified on full n-gram sets: all its pairs, counted inside
   tasks as matrix products, with no row per pair. A large group is dealt out
   as pairs of blocks of a bounded number of nodes and words.
5. Links are counted per node (copies included) and closed to classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.llm import wordhash as wh
from corpusprep.llm.common import table, text_key
from corpusprep.llm.components import components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
ROWS = 5            # rows a band; more rows, fewer chance meetings of unlike texts
BLOCK_NODES = 1024
BLOCK_WORDS = 1_000_000
DENSE_DF = 24       # n-grams in more texts than this are counted by matrix product
DENSE_COLUMNS = 4096


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` rows such that a pair at ``similarity`` meets in one
    of them with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows)))


def shingle_sets(col: pa.Array, k: int):
    """(hashes, at): the n-gram hashes of each text, repeats included; text i
    owns ``hashes[at[i]:at[i + 1]]``. Words are compared without the case of A-Z."""
    raw, off = wh.buffer_of(col)
    s, e, first = wh.word_spans(raw, off, wh.SPACE)
    return wh.windows(wh.word_hashes(raw, s, e), first, k)


def signatures(docs: DataFrame, key: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """(doc, node, n, bands): the text's key, its number of n-grams (repeats
    included) and its band hashes (empty for a text without words)."""
    kt = docs.schema[key].dataType
    schema = T.StructType([T.StructField("doc", kt), T.StructField("node", T.BinaryType()),
                           T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    rng = np.random.default_rng(6)
    mul = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches):
        for b in batches:
            col = b.column(2)
            _, off = wh.buffer_of(col)
            for i, j in wh.pieces(off, 1 << 19):
                h, at = shingle_sets(col.slice(i, j - i), k)
                n = np.diff(at)
                some = np.flatnonzero(n > 0)
                out = np.zeros((len(some), bands), np.uint64)
                if len(some):
                    starts = at[:-1][some]
                    for c in range(bands):
                        band = np.full(len(some), c, np.uint64)
                        for r in range(c * rows, (c + 1) * rows):
                            low = np.minimum.reduceat(h * mul[r] + add[r], starts)
                            band = wh.mix(band * np.uint64(0x9E3779B97F4A7C15) + low)
                        out[:, c] = band
                size = np.zeros(len(n), np.int64)
                size[some] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()),
                                                 pa.array(out.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n), lists], schema.names)

    src = docs.select(F.col(key).alias("doc"), text_key(F.col(text)).alias("node"), F.col(text).alias("t"))
    return src.mapInArrow(run, schema)


def closure(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each row of a link matrix reaches."""
    n = len(linked)
    root = np.arange(n)
    while True:     # smallest label among the neighbours, then along pointers
        near = np.where(linked, root[None, :], n).min(axis=1, initial=n)
        new = np.minimum(root, near)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def link_counts(sets: list[np.ndarray], side: np.ndarray, weight: np.ndarray, similarity: float):
    """Links among the texts of one block (``side`` all equal), or between the
    two blocks that ``side`` tells apart: per text the weights of its partners
    and a smaller index that it reaches, or its own. Between blocks only the
    first text of what is linked inside a block names another one, so the second
    list holds the edges that the blocks' own texts do not give already."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(n), size.astype(np.int64))
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    df = np.diff(np.append(begin, len(every)))
    common = np.zeros((n, n), np.float32)
    # rare n-grams: their few pairs one distance at a time
    rare = np.repeat((df > 1) & (df <= DENSE_DF), df)
    r_owner, r_gram = owner[rare], np.repeat(np.arange(len(df)), df)[rare]
    for step in range(1, DENSE_DF):
        if len(r_owner) <= step:
            break
        same = r_gram[step:] == r_gram[:-step]
        if not same.any():
            break
        flat = r_owner[:-step][same] * n + r_owner[step:][same]
        if len(flat) * 4 > n * n:
            common += np.bincount(flat, minlength=n * n).reshape(n, n).astype(np.float32)
        else:
            at, times = np.unique(flat, return_counts=True)
            common.ravel()[at] += times
    common += common.T
    # frequent ones: matrix products over blocks of columns
    dense = np.flatnonzero(df > DENSE_DF)
    for i in range(0, len(dense), DENSE_COLUMNS):
        cols = dense[i:i + DENSE_COLUMNS]
        m = np.zeros((n, len(cols)), np.float32)
        for j, c in enumerate(cols):
            m[owner[begin[c]:begin[c] + df[c]], j] = 1
        common += m @ m.T
    union = size[:, None] + size[None, :] - common
    linked = common.astype(np.float64) / np.maximum(union, 1) >= similarity
    np.fill_diagonal(linked, False)
    across = side[:, None] != side[None, :]
    if not across.any():
        return linked @ weight, closure(linked)
    own, both = closure(linked & ~across), closure(linked)
    return (linked & across) @ weight, np.where(own == np.arange(n), both, np.arange(n))


def verify(groups: DataFrame, k: int, similarity: float) -> DataFrame:
    """(node, links, root) per node and group of ``groups(label, i, j, block,
    node, copies, t)``, sorted so that a group stands together: links of the node
    to others in the group (inside block i, or block i against block j), and a
    smaller node of the group that it reaches, or itself. Nodes with neither are
    left out. Edges (node, root) number at most one per node for a block, and for
    two blocks one per class inside either of them."""
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("links", T.LongType()),
                           T.StructField("root", T.BinaryType())])

    def solve(rows):
        rows.sort(key=lambda r: r[2])
        h, at = shingle_sets(pa.array([r[4] for r in rows], pa.string()), k)
        sets = [np.unique(h[a:z]) for a, z in zip(at[:-1], at[1:])]
        side = np.array([r[1] for r in rows])
        links, root = link_counts(sets, side, np.array([r[3] for r in rows], np.int64), similarity)
        some = np.flatnonzero((links > 0) | (root != np.arange(len(rows)))).tolist()
        return [rows[x][2] for x in some], links[some], [rows[int(root[x])][2] for x in some]

    def run(batches):
        held, now = [], None
        out: list[list] = [[], [], []]
        for b in batches:
            label, gi, gj, block, node, copies, t = (b.column(c).to_pylist() for c in range(7))
            for x in zip(zip(label, gi, gj), block, node, copies, t):
                if x[0] != now:
                    if len(held) > 1:
                        for o, v in zip(out, solve(held)):
                            o.extend(v)
                    if len(out[0]) > 4096:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()),
                             pa.array(out[2], pa.binary())], schema.names)
                        out = [[], [], []]
                    held, now = [], x[0]
                held.append(x)
        if len(held) > 1:
            for o, v in zip(out, solve(held)):
                o.extend(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()),
                                              pa.array(out[2], pa.binary())], schema.names)

    return groups.mapInArrow(run, schema)


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS,
            similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS,
            block_nodes: int = BLOCK_NODES, block_words: int = BLOCK_WORDS,
            with_text_key: bool = False) -> DataFrame:
    """Per row of ``docs``: ``key``, ``copy_of`` (smallest key among its exact
    copies), ``class_id`` (smallest key reachable by links), ``n_links`` (other
    rows whose n-gram sets reach the similarity; exact copies count) and
    ``kept`` (one row of each class; all of it if that very row is repeated).

    A text of fewer than ``k`` words has one n-gram of all its words; a text
    without words (null, empty, blank) links with nothing and is its own class.
    Repeated rows (the same key and text twice) are copies of each other. Null
    keys are never the smallest unless a class has no other. Extra columns are ignored. Tables may be
    empty."""
    spark = docs.sparkSession
    n_bands = bands_for(similarity, recall, rows)
    sig = table(signatures(docs, key, text, k, n_bands, rows), "signatures")
    nodes = table(sig.filter(F.col("n") > 0).groupBy("node")
                  .agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"),
                       F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    rows_of = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    first = (rows_of.groupBy("band", "h").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("m"))
             .filter(F.col("m") > 1).drop("m"))
    edges = (rows_of.join(first, ["band", "h"]).filter(F.col("node") != F.col("v"))
             .select(F.col("node").alias("u"), "v").distinct())
    group = components(edges)

    # blocks: as many as the group's nodes and words ask for
    member = group.join(nodes.select("node", "copies", "n"), "node")
    blocks = (member.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
              .select("label", F.greatest(F.ceil(F.col("m") / block_nodes), F.ceil(F.col("w") / block_words))
                      .cast("int").alias("nb")))
    member = member.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("node"), "nb").cast("int"))
    texts = (docs.select(text_key(F.col(text)).alias("node"), F.col(key).alias("doc"), F.col(text).alias("t")))
    one = (texts.join(nodes.join(group.select("node"), "node", "left_semi").select("node", "rep"),
                      (texts["node"] == nodes["node"]) & texts["doc"].eqNullSafe(nodes["rep"]), "left_semi")
           .dropDuplicates(["node"]).drop("doc"))
    dealt = (member.join(one, "node")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "block", "node", "copies", "t")
             .repartition("label", "i", "j").sortWithinPartitions("label", "i", "j"))
    found = table(verify(dealt, k, similarity), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.filter(F.col("node") != F.col("root")).select(
        F.col("node").alias("u"), F.col("root").alias("v")))
    known = (nodes.select("node", "rep", "copies").join(links, "node", "left").join(label, "node", "left")
             .withColumn("label", F.coalesce("label", "node")))
    # the class goes by its smallest key (null last, equal keys by node)
    first = F.struct(F.col("rep").isNull().alias("none"), "rep", "node")
    best = known.groupBy("label").agg(F.min(first).alias("f")).select(
        "label", F.col("f.rep").alias("class_id"), F.col("f.node").alias("class_node"))
    known = known.join(best, "label").select(
        "node", "rep", "class_id", "class_node",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sig.select("doc", "node").join(known, "node", "left")
    kept = F.col("class_node").isNull() | (
        (F.col("node") == F.col("class_node")) & F.col("doc").eqNullSafe(F.col("class_id")))
    return out.select(F.col("doc").alias(key), F.when(F.col("n_links").isNull(), F.col("doc"))
                      .otherwise(F.col("rep")).alias("copy_of"),
                      F.when(F.col("n_links").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"),
                      *([F.col("node").alias("text_key")] if with_text_key else []))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, all columns kept."""
    kept = (similar(docs, key, text, with_text_key=True, **options).filter("kept")
            .select(F.col(key).alias("_nj_key"), F.col("text_key").alias("_nj_text")).distinct())
    d = docs.withColumn("_nj_own", text_key(F.col(text)))
    d = d.join(kept, F.col(key).eqNullSafe(F.col("_nj_key")) & (F.col("_nj_own") == F.col("_nj_text")), "left_semi")
    # a kept row that is repeated stays once; texts without words all stay
    empty = F.coalesce(F.col(text), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    return (d.filter(~empty).dropDuplicates([key, "_nj_own"]).unionByName(d.filter(empty))
            .select(*docs.columns))
