"""Operator 5: near-duplicate vectors by lattice hashing.

In each of several tables a unit vector is projected at random to eight
dimensions and decoded to the nearest point of the E8 lattice: its cell. Every
vector stands in its own cell of each table and probes that cell and the
neighbouring cells it is nearest to. Vectors that meet in a cell are verified by
cosine in double precision, as matrix products inside tasks; a crowded cell is
dealt out as pairs of blocks. A linked pair is counted in the first cell in
which it meets only, so there is no row per pair; exact copies are one node.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.llm.common import table
from corpusprep.llm.components import components
from corpusprep.llm.wordhash import mix

COSINE = 0.98
RECALL = 0.999      # of pairs at the very threshold
PROBES = 6          # neighbouring cells probed besides the own one
BLOCK = 1024
SEED = 8


def d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8 (integer vectors of even sum)."""
    f = np.round(x)
    odd = f.sum(axis=1) % 2 != 0
    gap = x - f
    far = np.abs(gap).argmax(axis=1)
    i = np.flatnonzero(odd)
    f[i, far[i]] += np.where(gap[i, far[i]] >= 0, 1.0, -1.0)
    return f


def e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: D8 and D8 shifted by one half."""
    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.where(nearer[:, None], b, a)


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        if bin(m).count("1") % 2 == 0:
            out.append(np.array([-0.5 if m >> i & 1 else 0.5 for i in range(8)]))
    return np.stack(out)


def cells(y: np.ndarray, probes: int) -> np.ndarray:
    """(n, 1 + probes, 8): own lattice point, then the neighbours nearest to y."""
    p = e8(y)
    v = shortest()
    top = np.argsort(-((y - p) @ v.T), axis=1, kind="stable")[:, :probes]
    return np.concatenate([p[:, None, :], p[:, None, :] + v[top]], axis=1)


def scale_for(n: int) -> float:
    """Lattice scale at which the cells grow with the number of vectors (a unit
    vector's projection covers about (4.13 scale)**8 cells)."""
    return float(max((8.0 * max(n, 1)) ** 0.125 / 4.13, 0.8))


def tables_for(scale: float, probes: int, cosine: float = COSINE, recall: float = RECALL, samples: int = 4000) -> int:
    """Tables that let a pair at ``cosine`` meet with probability ``recall``
    (the chance of one table is measured on random pairs)."""
    rng = np.random.default_rng(SEED)
    gap = math.sqrt(2 - 2 * cosine)
    x = scale * rng.standard_normal((samples, 8))
    y = x + scale * gap * rng.standard_normal((samples, 8))
    a, b = cells(x, probes), cells(y, probes)
    meet = (a[:, None, 0] == b).all(axis=2).any(axis=1) | (b[:, None, 0] == a).all(axis=2).any(axis=1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(max(meet.mean(), 1e-4), 0.999))))


def projections(tables: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((tables, dim, 8)), rng.uniform(0, 1, (tables, 8))


def cell_hashes(x: np.ndarray, label: np.ndarray, scale: float, tables: int, probes: int) -> np.ndarray:
    """(n, tables, 1 + probes) 64-bit cell keys of unit vectors ``x``."""
    proj, shift = projections(tables, x.shape[1])
    out = np.empty((len(x), tables, 1 + probes), np.uint64)
    for t in range(tables):
        points = cells(scale * (x @ proj[t]) + shift[t], probes)
        twice = np.round(2 * points).astype(np.int64).view(np.uint64)
        h = mix(label.astype(np.int64).view(np.uint64) * np.uint64(1009) + np.uint64(t * 131 + x.shape[1] * 65537))[:, None]
        for i in range(8):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + twice[:, :, i])
        out[:, t] = h
    return out


def units(vecs: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision of stored raw vectors of one length."""
    x = np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def prepare(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, vec): valid vectors as bytes of doubles, null for the others;
    a label of any type goes by the hash of its text."""
    kt = vectors.schema[key].dataType
    schema = T.StructType([T.StructField("id", kt), T.StructField("label", T.LongType()),
                           T.StructField("vec", T.BinaryType())])

    def run(batches):
        for b in batches:
            out = []
            for lab, v in zip(b.column(1).to_pylist(), b.column(2)):
                x = v.values
                if lab is None or x is None or not len(x) or x.null_count:
                    out.append(None)
                    continue
                x = x.to_numpy(zero_copy_only=False).astype("<f8")
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int64()), pa.array(out, pa.binary())],
                                             schema.names)

    hashed = F.when(F.col(label).isNotNull(), F.xxhash64(F.col(label).cast("string")))
    return vectors.select(F.col(key).alias("id"), hashed.alias("label"), vector).mapInArrow(run, schema)


def owned(cell: int, a: dict, b: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs (index row i, probe row j), which meet in ``cell``, are
    counted there: no earlier table brings them together, and of the cells of
    this table it is the smaller one (for their common cell: i before j)."""
    ca, cb = a["sig"][i], b["sig"][j]           # (pairs, tables, 1 + probes)
    meet_a = (ca[:, :, :1] == cb).any(axis=2)   # b stands in or probes a's cell
    meet_b = (cb[:, :, :1] == ca).any(axis=2)
    first = (meet_a | meet_b).argmax(axis=1)
    at = np.arange(len(i))
    own_a, own_b = ca[at, first, 0], cb[at, first, 0]
    here = own_a == np.uint64(cell)
    same = own_a == own_b
    other = meet_b[at, first]
    mine = np.where(same, a["rank"][i] < b["rank"][j], ~other | (own_a < own_b))
    return here & mine


def verify(dealt: DataFrame, cosine: float, tables: int, width: int) -> DataFrame:
    """(node, links, root) per node and cell block."""
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("links", T.LongType()),
                           T.StructField("root", T.BinaryType())])

    def side(rows):
        return {"node": [r[2] for r in rows], "copies": np.array([r[3] for r in rows], np.int64),
                "x": units([r[4] for r in rows]),
                "sig": np.stack([r[5] for r in rows]).view(np.uint64).reshape(len(rows), tables, width)}

    def solve(cell, rows):
        left, right = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
        if not left or not right:
            return
        a, b = side(left), side(right)
        order = {n: k for k, n in enumerate(sorted({*a["node"], *b["node"]}))}
        for s in (a, b):
            s["rank"] = np.array([order[n] for n in s["node"]])
        linked = (a["x"] @ b["x"].T >= cosine) & (a["rank"][:, None] != b["rank"][None, :])
        i, j = np.nonzero(linked)
        if not len(i):
            return
        links = np.zeros(len(order), np.int64)
        for at in range(0, len(i), 1 << 16):
            x, y = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            ok = owned(cell, a, b, x, y)
            np.add.at(links, a["rank"][x[ok]], b["copies"][y[ok]])
            np.add.at(links, b["rank"][y[ok]], a["copies"][x[ok]])
        root = np.arange(len(order))
        u, v = a["rank"][i], b["rank"][j]
        while True:
            new = root.copy()
            np.minimum.at(new, u, root[v])
            np.minimum.at(new, v, root[u])
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        names = sorted(order)
        for k in np.unique(np.concatenate([u, v])).tolist():
            yield names[k], int(links[k]), names[int(root[k])]

    def run(batches):
        held, now, out = [], None, []

        def batch():
            n, l, r = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(n, pa.binary()), pa.array(l, pa.int64()),
                                               pa.array(r, pa.binary())], schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            sig = b.column(7)
            flat = sig.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            cell, bi, bp, role, node, copies, vec = (b.column(c).to_pylist() for c in range(7))
            for k in range(b.num_rows):
                group = (cell[k], bi[k], bp[k])
                if group != now:
                    if len(held) > 1:
                        out.extend(solve(held[0][0], held))
                    if len(out) > 4096:
                        yield batch()
                        out = []
                    held, now = [], group
                held.append((cell[k] & 0xFFFFFFFFFFFFFFFF, role[k], node[k], copies[k], vec[k], flat[k].copy()))
        if len(held) > 1:
            out.extend(solve(held[0][0], held))
        if out:
            yield batch()

    return dealt.mapInArrow(run, schema)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = COSINE, recall: float = RECALL, probes: int = PROBES,
                    block: int = BLOCK) -> DataFrame:
    """Per row of ``vectors``: ``key, n_links`` (other rows of its label at
    ``cosine`` or more), ``component_id`` (smallest key reachable by links) and
    ``kept`` (``key`` is it).

    A vector that is null, empty, zero, has a null or non-finite component, or
    has no label links with nothing and is its own component. Vectors of
    different lengths never link. Repeated rows are copies of each other; extra
    columns are ignored; an empty table gives an empty result. Nothing below
    ``cosine`` links; of pairs at the very threshold at least ``recall`` are
    found (nearer ones more surely)."""
    rows = table(prepare(vectors, key, vector, label)
                 .withColumn("node", F.when(F.col("vec").isNotNull(), F.unhex(F.md5(F.concat(
                     F.col("label").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("vec")))))), "vectors")
    nodes = table(rows.filter(F.col("node").isNotNull()).groupBy("node")
                  .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
                       F.first("vec").alias("vec")), "vector-nodes")
    n = nodes.count()
    scale = scale_for(n)
    tables = tables_for(scale, probes, cosine, recall)
    width = 1 + probes
    schema = T.StructType([*nodes.schema.fields, T.StructField("sig", T.ArrayType(T.LongType()))])

    def sign(batches):
        for b in batches:
            vec, lab = b.column(4).to_pylist(), b.column(3).to_numpy(zero_copy_only=False)
            sig = np.empty((b.num_rows, tables * width), np.uint64)
            size = np.array([len(v) for v in vec])
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                for k in range(0, len(at), 2048):
                    p = at[k:k + 2048]
                    sig[p] = cell_hashes(units([vec[x] for x in p]), lab[p], scale, tables, probes).reshape(len(p), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * sig.shape[1], pa.int32()),
                                             pa.array(sig.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], schema.names)

    signed = table(nodes.mapInArrow(sign, schema), "vector-cells")
    stands = signed.select("node", F.posexplode("sig").alias("p", "cell")).withColumn("own", F.col("p") % width == 0)
    met = (stands.groupBy("cell").agg(F.count(F.when(F.col("own"), 1)).alias("ni"), F.count(F.lit(1)).alias("np"),
                                      F.min("node").alias("lo"), F.max("node").alias("hi"))
           .filter((F.col("ni") > 0) & (F.col("lo") != F.col("hi")))
           .select("cell", F.ceil(F.col("ni") / block).cast("int").alias("bi"),
                   F.ceil(F.col("np") / block).cast("int").alias("bp")))
    s = stands.join(met, "cell").withColumn("h", F.xxhash64("node"))
    mine_i, mine_p = F.pmod("h", "bi").cast("int"), F.pmod("h", "bp").cast("int")
    index = (s.filter("own").select("cell", mine_i.alias("bi"), F.explode(F.sequence(F.lit(0), F.col("bp") - 1)).alias("bp"),
                                    F.lit(0).alias("role"), "node"))
    probe = s.select("cell", F.explode(F.sequence(F.lit(0), F.col("bi") - 1)).alias("bi"), mine_p.alias("bp"),
                     F.lit(1).alias("role"), "node")
    dealt = (index.unionByName(probe).join(signed.select("node", "copies", "vec", "sig"), "node")
             .select("cell", "bi", "bp", "role", "node", "copies", "vec", "sig")
             .repartition("cell", "bi", "bp").sortWithinPartitions("cell", "bi", "bp"))
    found = table(verify(dealt, cosine, tables, width), "vector-links")
    label_of = components(found.filter(F.col("node") != F.col("root"))
                          .select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = (nodes.select("node", "rep", "copies")
             .join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
             .join(label_of.withColumnRenamed("label", "group"), "node", "left")
             .withColumn("group", F.coalesce("group", "node")))
    best = known.groupBy("group").agg(F.min("rep").alias("component_id"))
    known = known.join(best, "group").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "node").join(known, "node", "left")
    comp = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))
