"""Operator 12: hard negatives by cover trees over norm-augmented candidates.

A vector x gets one more component, sqrt(M^2 - |x|^2), M being the largest norm:
all candidates then lie on a sphere of radius M, and as an anchor's extra
component is 0, the order by inner product is the order by distance. A cover
tree halves its covering radius from level to level: a node's children are
centres that lie further apart than the next radius, each with the points within
it. As a node's points lie within a measured radius of its centre on the sphere,
its inner products with an anchor lie between two cosines. The descent takes
nodes best first, skips those whose bounds lie outside an anchor's windows or
below what it has found, and verifies leaves by exact integer products.

The coarsest level is laid over the whole table: centres of a bounded sample,
every row in the cell of its nearest one, cells of measured radius. An anchor
goes only to the cells that its windows can reach; a cell is dealt by hash into
shards of a bounded number of rows, each with its own tree, and the anchors of a
shard into ranges. Positives are searched in the same way in the shards of the
anchor's own label.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.llm.common import small, table

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95      # a negative's score in per cent of the positive's
SHARD_ROWS = 4096
RANGE_ANCHORS = 1 << 16
CELLS = 64              # centres of the coarsest level, at most
SAMPLE_ROWS = 2048      # rows that the centres are chosen from
LEAF = 32
QUERY_BLOCK = 256
COLUMNS = 1024          # leaf points scored at a time
EXACT = float(1 << 53)  # products below this are exact in double precision
MOST = 9.2e18           # squared norms beyond this have no score in 64 bits


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows of ``x`` on the sphere of radius ``norm``."""
    x = x.astype(np.float64)
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def bounds(score: np.ndarray, q_norm: np.ndarray, radius: np.ndarray, norm: float):
    """(lowest, highest) inner product of each anchor (row) with a point within
    ``radius`` of a centre (column) on the sphere, given the centres' products."""
    reach = np.maximum(q_norm * norm, 1e-300)[:, None]
    angle = np.arccos(np.clip(score / reach, -1, 1))
    wide = 2 * np.arcsin(np.clip(radius / (2 * max(norm, 1e-300)), 0, 1))[None, :]
    slack = 1e-9 * reach + 1
    return (reach * np.cos(np.minimum(angle + wide, math.pi)) - slack,
            reach * np.cos(np.maximum(angle - wide, 0)) + slack)


class Node:
    __slots__ = ("centre", "radius", "start", "stop", "children")

    def __init__(self, centre: int, radius: float, start: int, stop: int):
        self.centre, self.radius, self.start, self.stop = centre, radius, start, stop
        self.children: list[Node] = []      # none: a leaf, its points are start..stop


class CoverTree:
    """Cover tree over the rows of ``x``; ``order`` lists them so that each
    node's points stand together."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        self.points = augmented(x, self.norm)
        self.order = np.arange(len(x))
        far = self.distance(0, self.order) if len(x) else np.zeros(1)
        self.root = Node(0, float(far.max()), 0, len(x))
        self.visited = self.verified = 0
        todo = [(self.root, self.root.radius)]
        while todo:
            todo += self.split(*todo.pop())

    def distance(self, centre: int, rows: np.ndarray) -> np.ndarray:
        gap = self.points[rows] - self.points[centre]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def split(self, node: Node, cover: float) -> list[tuple[Node, float]]:
        """Give ``node`` its children at half the covering radius; those that
        are to be split themselves, with that radius."""
        if node.stop - node.start <= self.leaf or node.radius == 0:
            return []
        cover /= 2
        while cover >= node.radius:
            cover /= 2
        rows, centre = self.order[node.start:node.stop].copy(), node.centre
        at, loose, below = node.start, [], []
        while len(rows):
            far = self.distance(centre, rows)
            near = far <= cover
            mine = rows[near]
            if len(mine) == 1:      # a centre that covers itself only
                loose.append(mine[0])
            else:
                self.order[at:at + len(mine)] = mine
                child = Node(centre, float(far[near].max()), at, at + len(mine))
                node.children.append(child)
                below.append((child, cover))
                at += len(mine)
            rows = rows[~near]
            if len(rows):
                centre = int(rows[0])
        if loose:                   # all of them together are one leaf
            self.order[at:node.stop] = loose
            node.children.append(Node(node.centre, node.radius, at, node.stop))
        return below

    def search(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, allowed, ids: np.ndarray):
        """The first ``k`` points in each window of each row of ``q`` by score,
        then id. ``low``, ``high``: (anchors, windows), both ends inside;
        ``allowed(anchors, points)`` is a mask. Returns (anchor, window, point,
        score) arrays."""
        m, w = low.shape
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, q.dtype)) for _ in range(w)]
        bar = np.full((m, w), -np.inf)              # k-th best score so far
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        none = low > high
        heap, ticket = [], 0

        def wanted(rows, lo, hi):
            """Which windows of ``rows`` points between ``lo`` and ``hi`` can still enter."""
            return (~none[rows] & (hi[:, None] >= low[rows]) & (lo[:, None] <= high[rows])
                    & (np.minimum(hi[:, None], high[rows]) >= bar[rows]))

        def push(node, rows, lo, hi):
            nonlocal ticket
            use = wanted(rows, lo, hi).any(axis=1)
            if use.any():
                ticket += 1
                heapq.heappush(heap, (-float(hi[use].max()), ticket, node, rows[use], lo[use], hi[use]))

        if not len(self.x):
            return found
        everyone = np.arange(m)
        lo, hi = bounds(q.astype(np.float64) @ self.x[[0]].T.astype(np.float64), norm, np.array([self.root.radius]), self.norm)
        push(self.root, everyone, lo[:, 0], hi[:, 0])
        while heap:
            _, _, node, rows, lo, hi = heapq.heappop(heap)
            use = wanted(rows, lo, hi).any(axis=1)
            rows = rows[use]
            if not len(rows):
                continue
            self.visited += len(rows)
            if node.children:
                centres = np.array([c.centre for c in node.children])
                radius = np.array([c.radius for c in node.children])
                score = q[rows].astype(np.float64) @ self.x[centres].T.astype(np.float64)
                lo, hi = bounds(score, norm[rows], radius, self.norm)
                for c, child in enumerate(node.children):
                    push(child, rows, lo[:, c], hi[:, c])
                continue
            for a in range(node.start, node.stop, COLUMNS):
                points = self.order[a:min(a + COLUMNS, node.stop)]
                self.verified += len(rows) * len(points)
                score = q[rows] @ self.x[points].T
                fit = allowed(rows, points)
                for i in range(w):
                    ok = fit & (score >= low[rows, i][:, None]) & (score <= high[rows, i][:, None])
                    ok &= score >= bar[rows, i][:, None]
                    if len(points) > k:             # the k-th best of these and its ties
                        top = np.partition(np.where(ok, score, -np.inf), len(points) - k, axis=1)[:, len(points) - k]
                        ok &= score >= top[:, None]
                    r, c = np.nonzero(ok)
                    if not len(r):
                        continue
                    old = found[i]
                    again = np.isin(old[0], rows)
                    row = np.concatenate([old[0][again], rows[r]])
                    point = np.concatenate([old[1][again], points[c]])
                    got = np.concatenate([old[2][again], score[r, c]])
                    by = np.lexsort((ids[point], -got, row))
                    row, point, got = row[by], point[by], got[by]
                    first = np.searchsorted(row, row)
                    rank = np.arange(len(row)) - first
                    keep = rank < k
                    full = rank == k - 1
                    bar[row[full], i] = got[full]
                    found[i] = tuple(np.concatenate([o[~again], n[keep]]) for o, n in zip(old, (row, point, got)))
        return found


def matrix(lists: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column as one array, shorter ones filled with zeros."""
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(size.max(initial=0)) if dim is None else dim
    out = np.zeros((len(size), width))
    at = np.concatenate([[0], np.cumsum(size)])
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width).astype(np.float64)
    for i, n in enumerate(size.tolist()):
        n = min(n, width)
        out[i, :n] = flat[at[i]:at[i] + n]
    return out


def exactly(x: np.ndarray, q: np.ndarray) -> type:
    """Type in which all products of rows of ``x`` and ``q`` are exact."""
    top = max((np.float64(a) ** 2).sum(axis=1).max(initial=0) for a in (x, q))
    return np.float64 if top < EXACT else np.int64


_FOUND = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("w", T.IntegerType()),
                       T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])


def probe(dealt: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(anchor, w, id, score): the first ``k`` candidates of each shard in each
    window of its anchors. ``dealt(shard, role, uid, id, label, vec, low, high)``
    has candidates as role 0 and anchors as role 1; null windows take all scores."""

    def answer(tree, uid, ids, label, block):
        q = np.zeros((len(block), tree.x.shape[1]))
        raw = matrix(pa.array([r[3] for r in block], pa.list_(pa.float64())))
        width = min(q.shape[1], raw.shape[1])
        q[:, :width] = raw[:, :width]
        kind = exactly(tree.x, q)
        if kind != tree.x.dtype:
            tree.x = tree.x.astype(kind)
        q = q.astype(kind)
        w = max((len(r[4]) for r in block if r[4] is not None), default=1)
        edge = np.array([-MOST, MOST]).astype(kind)
        low, high = (np.array([list(r[c]) + [edge[1 - s]] * (w - len(r[c])) if r[c] is not None else [edge[s]] * w
                               for r in block], kind).reshape(len(block), w) for s, c in ((0, 4), (1, 5)))
        own, mine = np.array([r[0] for r in block]), np.array([r[2] for r in block], object)

        def allowed(rows, points):
            same = mine[rows][:, None] == label[points][None, :]
            return same & (own[rows][:, None] != uid[points][None, :]) if same_label else ~same

        for i, (row, point, score) in enumerate(tree.search(q, low, high, k, allowed, ids)):
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[row], pa.int64()), pa.array(np.full(len(row), i), pa.int32()),
                     pa.array(ids[point], pa.int64()), pa.array(score.astype(np.int64), pa.int64())], _FOUND.names)

    def run(batches):
        now, rows, tree, block = None, [], None, []

        def grown():
            x = matrix(pa.array([r[3] for r in rows], pa.list_(pa.float64())))
            return (CoverTree(x), np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64),
                    np.array([r[2] for r in rows], object))

        for b in batches:
            shard, role, *rest = (c.to_pylist() for c in b.columns[:5])
            vec = b.column(5).to_pylist()
            low, high = b.column(6).to_pylist(), b.column(7).to_pylist()
            for s, kind, *r in zip(shard, role, *rest, vec, low, high):
                if s != now:
                    if block and rows:
                        yield from answer(*(tree or grown()), block)
                    now, rows, tree, block = s, [], None, []
                if kind == 0:
                    rows.append(r)
                    continue
                block.append(r)
                if len(block) == QUERY_BLOCK:
                    if rows:
                        tree = tree or grown()
                        yield from answer(*tree, block)
                    block = []
        if block and rows:
            yield from answer(*(tree or grown()), block)

    dealt = dealt.select("shard", "role", "uid", "id", "label", "vec", "low", "high")
    return dealt.repartition("shard").sortWithinPartitions("shard", "role").mapInArrow(run, _FOUND)


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor's window over all shards, with ``rank``."""
    order = Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def shards(candidates: DataFrame, anchors: DataFrame, by: Column, sizes: DataFrame, n_sizes: int,
           shard_rows: int, range_anchors: int) -> DataFrame:
    """Candidates and anchors dealt to the shards of their group ``by`` (label or
    cell): parts of about ``shard_rows`` rows, ranges of ``range_anchors`` anchors."""
    sizes = sizes.select(F.col("group").alias("_g"), F.greatest(F.ceil(F.col("n") / shard_rows), F.lit(1)).cast("int").alias("parts"),
                         F.greatest(F.ceil(F.col("na") / range_anchors), F.lit(1)).cast("int").alias("ranges"))
    sizes = small(sizes, n_sizes)
    h = F.xxhash64("uid")
    part, rng = F.pmod(h, "parts").cast("int"), F.pmod(F.xxhash64("uid", F.lit(7)), "ranges").cast("int")

    def dealt(df, part, rng, role, low, high):
        d = df.withColumn("_by", by.cast("string")).join(sizes, F.col("_by") == F.col("_g"))
        d = d.withColumn("part", part).withColumn("range", rng)
        return d.select(F.concat_ws("|", "part", "range", "_by").alias("shard"), F.lit(role).alias("role"), "uid", "id",
                        "label", "vec", low.alias("low"), high.alias("high"))

    no = F.lit(None).cast("array<bigint>")
    low, high = (F.col(c) if c in anchors.columns else no for c in ("low", "high"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    return (dealt(candidates, part, every("ranges"), 0, no, no)
            .unionByName(dealt(anchors, every("parts"), rng, 1, low, high)))


def centres(rows: DataFrame, norm: float, cells: int, sample: int) -> np.ndarray:
    """At most ``cells`` rows of a bounded seeded sample, each the furthest from
    those before it (on the sphere)."""
    got = rows.orderBy(F.xxhash64("uid", F.lit(3)), "uid").limit(sample).select("vec").toPandas()["vec"]
    x = matrix(pa.array(list(got), pa.list_(pa.float64())))
    p = augmented(x, norm)
    chosen, far = [0], np.sqrt(((p - p[0]) ** 2).sum(axis=1))
    while len(chosen) < min(cells, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(((p - p[chosen[-1]]) ** 2).sum(axis=1)))
    return x[chosen]


def fitted(vec: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows cut or filled to ``dim`` components, what the rest of each weighs)."""
    full = matrix(vec)
    x = np.zeros((len(full), dim))
    w = min(dim, full.shape[1])
    x[:, :w] = full[:, :w]
    return x, np.sqrt((full[:, w:] ** 2).sum(axis=1))


def placed(rows: DataFrame, pivots: np.ndarray, norm: float) -> DataFrame:
    """``rows`` with ``cell`` (nearest pivot on the sphere) and ``far`` (distance to it)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    at = rows.columns.index("vec")
    on = augmented(pivots, norm)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(at), max(pivots.shape[1], int(np.diff(b.column(at).offsets.to_numpy()).max())))
            wide = np.zeros((len(on), x.shape[1] + 1))
            wide[:, :pivots.shape[1]], wide[:, -1] = on[:, :-1], on[:, -1]
            p = augmented(x, norm)
            gap = (p * p).sum(axis=1)[:, None] + (wide * wide).sum(axis=1)[None, :] - 2 * p @ wide.T
            cell = gap.argmin(axis=1)
            far = np.sqrt(((p - wide[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(far)], schema.names)

    return rows.mapInArrow(run, schema)


def reached(anchors: DataFrame, pivots: np.ndarray, radius: dict[int, float], norm: float) -> DataFrame:
    """``anchors(uid, id, label, vec, low, high)`` once per cell that one of its
    windows can reach."""
    schema = T.StructType([*anchors.schema.fields, T.StructField("cell", T.IntegerType())])
    names = anchors.columns
    cells = np.array(sorted(radius), np.int64)
    r = np.array([radius[c] for c in cells.tolist()])

    def run(batches):
        for b in batches:
            if not b.num_rows or not len(cells):
                continue
            x, _ = fitted(b.column(names.index("vec")), pivots.shape[1])
            whole = matrix(b.column(names.index("vec")))
            lo, hi = bounds(x @ pivots[cells].T, np.sqrt((whole ** 2).sum(axis=1)), r, norm)
            low, high = (b.column(names.index(c)).to_pylist() for c in ("low", "high"))
            hit = np.array([[any(a <= z and hi[i, c] >= a and lo[i, c] <= z for a, z in zip(low[i], high[i]))
                             for c in range(len(cells))] for i in range(b.num_rows)]).reshape(b.num_rows, len(cells))
            i, c = np.nonzero(hit)
            if len(i):
                out = b.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells[c], pa.int32())], schema.names)

    return anchors.mapInArrow(run, schema)


def mine(vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         shard_rows: int = SHARD_ROWS, range_anchors: int = RANGE_ANCHORS, cells: int = CELLS) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` where ``anchor`` holds: for each
    and each of its first ``positives`` other rows of its label, the first
    ``negatives`` rows of another label whose score is ``low`` to ``high`` per
    cent of the positive's. ``vector`` holds whole numbers (any numeric type); a
    score is their inner product; higher scores come first, ties by smaller key.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``. Rows with a null key, label, vector or component, or a
    component that is not finite, take no part, nor does one whose squared norm
    is beyond 9.2e18 (its scores need not fit 64 bits). A shorter vector counts
    as filled with zeros, an empty one as all zeros. Repeated rows are rows of
    their own (one is the other's positive, and a repeated anchor has its rows
    twice). Labels of any type are compared as text. An empty table, no anchors
    or one label only give an empty result. Extra columns are ignored."""
    whole = F.transform(F.col(vector), lambda x: x.cast("double"))
    odd = F.exists(F.col("vec"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("id"),
                           F.col(label).cast("string").alias("label"), whole.alias("vec"),
                           F.coalesce(anchor, F.lit(False)).alias("anchor"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
            .filter(~F.coalesce(odd, F.lit(True)))
            .withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
            .filter(F.col("norm2") < MOST))
    rows = table(rows, "vectors")
    anchors = rows.filter("anchor").drop("anchor")
    sizes = table(rows.groupBy(F.col("label").alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("na")).filter("na > 0"), "label-sizes")
    near = shards(rows, anchors, F.col("label"), sizes, sizes.count(), shard_rows, range_anchors)
    pos = table(first_of(probe(near, positives, True), positives).select(
        "anchor", F.col("rank").alias("prank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # windows: low and high per cent of the positive's score, in whole numbers
    rest = F.pmod(F.col("positive_score"), F.lit(100))
    hundreds = F.expr("(positive_score - pmod(positive_score, 100L)) div 100")
    edge = F.struct("prank", (hundreds * low + F.ceil(rest * low / 100)).cast("long").alias("low"),
                    (hundreds * high + F.floor(rest * high / 100)).cast("long").alias("high"))
    windows = (pos.groupBy("anchor").agg(F.sort_array(F.collect_list(edge)).alias("e"))
               .select("anchor", F.col("e.low").alias("low"), F.col("e.high").alias("high")))
    asked = anchors.join(windows, F.col("uid") == F.col("anchor")).select("uid", "id", "label", "vec", "low", "high")

    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("m")).first()
    norm = math.sqrt(total["m"] or 0.0)
    if total["n"]:
        pivots = centres(rows, norm, max(1, min(cells, math.ceil(total["n"] / shard_rows))), SAMPLE_ROWS)
    else:
        pivots = np.zeros((1, 0))
    cell = table(placed(rows.drop("anchor", "norm2"), pivots, norm), "vector-cells")
    asked = table(asked, "asked")
    stats = cell.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
    radius = {r["cell"]: r["far"] for r in stats}
    to = table(reached(asked, pivots, radius, norm), "asked-cells")
    count = to.groupBy("cell").agg(F.count(F.lit(1)).alias("na"))
    sizes = cell.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(count, "cell").select(
        F.col("cell").cast("string").alias("group"), "n", "na")
    sizes = table(sizes, "cell-sizes")
    far = shards(cell, to, F.col("cell"), sizes, len(stats), shard_rows, range_anchors)
    neg = first_of(probe(far, negatives, False), negatives).withColumn("prank", F.col("w") + 1)
    names = anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    return (neg.join(pos, ["anchor", "prank"]).join(names, "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def oracle(table_name: str = "embeddings") -> str:
    """DuckDB SQL of op12."""
    return f"""
with v as (select row_number() over () as uid, vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from {table_name}
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.uid, a.vec_id as anchor_id, b.vec_id as id, b.uid as other, a.label = b.label as same,
    cast(list_dot_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id % 50 = 0),
p as (select uid, anchor_id, id as positive_id, score as positive_score, row_number() over (
    partition by uid order by score desc, id) as prank from s where same and other <> uid qualify prank <= {POSITIVES})
select p.anchor_id, p.positive_id, cast(row_number() over w as integer) as rank, n.id as negative_id, p.positive_score, n.score as negative_score
from p join s n on n.uid = p.uid and not n.same and {LOW} * p.positive_score <= 100 * n.score and 100 * n.score <= {HIGH} * p.positive_score
window w as (partition by p.uid, p.prank order by n.score desc, n.id) qualify rank <= {NEGATIVES}"""
