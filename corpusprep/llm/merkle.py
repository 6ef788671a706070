"""Operator 11: Merkle manifest of a dataset in van Emde Boas layout.

Every row is a leaf. The leaves of a group ascend by key; every 8 consecutive
nodes become one until a group has one, its subroot, and the subroots become the
root in the same way. The tree is stored as aligned subtrees of ``BLOCK_LEVELS``
levels of hashing (4,096 leaves): a subtree is one row, its digests in van Emde
Boas order (cut at half height, the upper half first, then each lower half, all
laid out the same way), so a leaf's path stays within few contiguous pieces at
any block size. Where a node stands follows by arithmetic from its depth and
index; construction and sibling retrieval use the same addresses. The roots of a
tier's subtrees are the leaves of the next tier, until one subtree is left.

Positions come from a distributed rank, subtrees are built inside tasks, and a
proof is handed down from the top tier: a subtree's row meets the path above it,
one row each, so no group, however large, meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.llm.common import table
from corpusprep.operators.order import global_rank, rank_within

ARITY = 8
BLOCK_LEVELS = 4
DIGEST = 32
HEX = 2 * DIGEST


def n_nodes(levels: int) -> int:
    """Nodes of a full tree of so many levels of nodes."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of ``depth`` (0: the root) stand in the van Emde
    Boas order of a full tree with ``levels`` levels of nodes."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    bottom, span = levels - top, ARITY ** (depth - top)
    return n_nodes(top) + index // span * n_nodes(bottom) + address(bottom, depth - top, index % span)


def height_of(n: int) -> int:
    """Levels of hashing that bring ``n`` nodes down to one."""
    h = 0
    while ARITY ** h < n:
        h += 1
    return h


def digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def build(leaves: list[bytes], height: int) -> bytes:
    """The subtree over ``leaves`` in van Emde Boas order; places of a full tree
    that have no node stay zero."""
    nodes = np.zeros((n_nodes(height + 1), DIGEST), np.uint8)
    row = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, DIGEST)
    nodes[address(height + 1, height, np.arange(len(row)))] = row
    for depth in range(height - 1, -1, -1):
        below = nodes[address(height + 1, depth + 1, np.arange(len(row)))].tobytes().hex()
        up = [digest(below[i:i + ARITY * HEX]) for i in range(0, len(below), ARITY * HEX)]
        row = np.frombuffer(b"".join(up), np.uint8).reshape(-1, DIGEST)
        nodes[address(height + 1, depth, np.arange(len(row)))] = row
    return nodes.tobytes()


def levels_hex(nodes: bytes, n: int, height: int) -> list[str]:
    """The digests of each level, leaves first, as hex text in order."""
    a = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    out = []
    for depth in range(height, -1, -1):
        out.append(a[address(height + 1, depth, np.arange(n))].tobytes().hex())
        n = -(-n // ARITY)
    return out


def siblings(levels: list[str], leaf: int) -> list[tuple[str, str]]:
    """Per level below the subtree's root, what stands left and right of the
    leaf's node in its run."""
    out = []
    for row in levels[:-1]:
        run, here = leaf // ARITY * ARITY * HEX, leaf * HEX
        out.append((row[run:here], row[here + HEX:run + ARITY * HEX]))
        leaf //= ARITY
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf gives with the siblings of its path."""
    for left, right in path:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def pack(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{a},{b}" for a, b in path)


def unpack(path: str) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in path.split(";")] if path else []


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its bytes in UTF-8 counted,
    a colon and the value."""
    v = value.cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def leaves(docs: DataFrame, key: str, fields: Sequence[str], group: str, now: dict[str, Column] | None = None) -> DataFrame:
    """(g, key, leaf, probe): each row's group (null first, then bytewise), its
    digest, and the digest of the row as it is ``now`` (columns that replace
    fields; null where it is the same)."""
    now = now or {}
    g = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit(""))
    leaf = leaf_hash([F.col(f) for f in fields])
    same = F.lit(True)
    for f, c in now.items():
        same = same & c.eqNullSafe(F.col(f))
    probe = F.when(~same, leaf_hash([now.get(f, F.col(f)) for f in fields])) if now else F.lit(None).cast("binary")
    return docs.select(g.alias("g"), F.col(key).alias("key"), leaf.alias("leaf"), probe.alias("probe"))


def _blocks(rows: DataFrame, levels: int, key_type: T.DataType | None) -> DataFrame:
    """One row per aligned subtree of ``rows(g, pos, leaf[, key, probe])``:
    (g, block, n, height, nodes[, keys, probes]). A first subtree that is not
    full is its group's only one and as high as it needs; all others are full height."""
    fields = [T.StructField("g", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()),
              T.StructField("height", T.IntegerType()), T.StructField("nodes", T.BinaryType())]
    if key_type is not None:
        fields += [T.StructField("keys", T.ArrayType(key_type)), T.StructField("probes", T.ArrayType(T.BinaryType()))]
    schema = T.StructType(fields)
    span = ARITY ** levels
    payload = ["key", "probe"] if key_type is not None else []

    def block(now, held, types):
        g, at = now
        height = levels if at else height_of(len(held))
        nodes = build([r[0] for r in held], height)
        cols = [[g], [at], [len(held)], [height], [nodes]]
        cols += [[[r[1 + i] for r in held]] for i in range(len(payload))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], schema.names)

    def run(batches):
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        held, now = [], None
        for b in batches:
            if payload and len(types) == 5:
                types += [pa.list_(b.schema.field("key").type), pa.list_(pa.binary())]
            g, at, *rest = (c.to_pylist() for c in b.columns)
            for x, r in zip(zip(g, at), zip(*rest)):
                if x != now:
                    if held:
                        yield block(now, held, types)
                    held, now = [], x
                held.append(r)
        if held:
            yield block(now, held, types)

    at = F.floor(F.col("pos") / span).cast("long")
    dealt = rows.withColumn("block", at).repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    return dealt.select("g", "block", "leaf", *payload).mapInArrow(run, schema)


def _root(nodes: str = "nodes") -> Column:
    return F.substring(F.col(nodes), 1, DIGEST)


def _single(tier: DataFrame) -> DataFrame:
    """(g): groups that one subtree holds."""
    return tier.filter(F.col("block") <= 1).groupBy("g").agg(F.max("block").alias("last")).filter("last = 0").select("g")


def _tiers(rows: DataFrame, path: str, name: str, levels: int, key_type: T.DataType | None = None) -> tuple[int, DataFrame]:
    """Write the tiers over ``rows`` as ``<path>/<name><tier>``; their number and
    (g, leaf): the root of each group."""
    spark = rows.sparkSession
    t, roots = 0, None
    while True:
        _blocks(rows, levels, key_type if t == 0 else None).write.parquet(f"{path}/{name}{t}")
        tier = spark.read.parquet(f"{path}/{name}{t}").select("g", F.col("block"), _root().alias("leaf"))
        t += 1
        one = _single(tier)
        done = tier.join(one, "g", "left_semi").select("g", "leaf")
        roots = done if roots is None else roots.unionByName(done)
        if not tier.filter("block = 1").limit(1).count():
            return t, roots
        rows = tier.join(one, "g", "left_anti").select("g", F.col("block").alias("pos"), "leaf")


def write(leaf_rows: DataFrame, path: str, levels: int = BLOCK_LEVELS) -> None:
    """Write the manifest of ``leaf_rows`` (see ``leaves``) under ``path``: the
    tiers of the groups' trees (tier 0 with keys and probes), those of the tree
    over the subroots, and how many there are of each.

    Leaves of a group stand by key (null first), equal keys by their digest, so
    repeated rows are leaves of their own with the same result in any order. An
    empty table gives tiers without rows."""
    spark = leaf_rows.sparkSession
    rows = table(leaf_rows, "merkle-leaves")
    ranked = rank_within(rows, "g", ["key", "leaf"], "pos", unique=False).withColumn("pos", F.col("pos") - 1)
    n, roots = _tiers(ranked, path, "group", levels, rows.schema["key"].dataType)
    order = global_rank(table(roots, "merkle-subroots"), ["g"], "pos")
    top = order.select(F.lit("").alias("g"), (F.col("pos") - 1).alias("pos"), "leaf", F.col("g").alias("key"),
                       F.lit(None).cast("binary").alias("probe"))
    m, _ = _tiers(top, path, "top", levels, T.StringType())
    spark.createDataFrame([(n, m)], "groups int, tops int").write.parquet(f"{path}/meta")


_PATHS = T.StructType([T.StructField("g", T.StringType()), T.StructField("block", T.LongType()),
                       T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()),
                       T.StructField("path", T.StringType())])
_KEYED = T.StructType([*_PATHS.fields[:2], T.StructField("key", T.StringType()), *_PATHS.fields[2:]])


def _down(tier: DataFrame, above: DataFrame, span: int, keyed: bool) -> DataFrame:
    """Paths of the leaves of a tier from those of its subtrees. The subroot is
    that of the first subtree on the way down that has none above it."""
    schema = _KEYED if keyed else _PATHS

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                levels = levels_hex(r["nodes"], r["n"], r["height"])
                for i in range(0, r["n"], 512):
                    part = range(i, min(i + 512, r["n"]))
                    paths = [";".join(x for x in (pack(siblings(levels, j)), r["path"]) if x) for j in part]
                    n = len(paths)
                    cols = {"g": [r["g"]] * n, "block": [r["block"] * span + j for j in part],
                            "subroot": [r["subroot"] or levels[-1]] * n, "root": [r["root"] or levels[-1]] * n, "path": paths}
                    if keyed:
                        cols["key"] = [r["keys"][j] for j in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[f.name], pa.int64() if f.name == "block" else pa.string()) for f in schema], schema.names)

    tier = tier.select("g", "block", "n", "height", "nodes", *(["keys"] if keyed else []))
    return tier.join(above, ["g", "block"]).mapInArrow(run, schema)


def verify(spark: SparkSession, path: str, key: str = "doc_id", levels: int = BLOCK_LEVELS,
           with_path: bool = False) -> DataFrame:
    """Per row of the manifest under ``path``: ``key, leaf, subroot, root,
    proof_sha256`` (of the siblings' digests, level by level to the root),
    ``folded_root`` (from the row as it was found, with the stored siblings),
    ``verified`` (that is the root) and with ``with_path`` the path itself: per
    level what stands left and right in the run, as hex text."""
    span = ARITY ** levels
    meta = spark.read.parquet(f"{path}/meta").first()
    above = spark.createDataFrame([("", 0, None, None, "")], _PATHS)
    for t in range(meta["tops"] - 1, -1, -1):
        tier = spark.read.parquet(f"{path}/top{t}")
        above = _down(tier, above, span, keyed=t == 0)
    # the tree over subroots ends at a group's last subtree
    top = table(above.select(F.col("key").alias("g"), F.lit(0).cast("long").alias("block"),
                             F.lit(None).cast("string").alias("subroot"), "root", "path"), "merkle-paths")
    deeper = None
    for t in range(meta["groups"] - 1, -1, -1):
        tier = spark.read.parquet(f"{path}/group{t}")
        up = top.join(_single(tier), "g", "left_semi")
        up = up if deeper is None else up.unionByName(deeper)
        if t:
            deeper = table(_down(tier, up, span, False), "merkle-paths")

    kt = tier.schema["keys"].dataType.elementType
    text = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    side = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
    schema = T.StructType([T.StructField(key, kt), *text, T.StructField("verified", T.BooleanType()),
                           *([T.StructField("path", side)] if with_path else [])])

    def run(batches):
        for b in batches:
            keys, probes = b.column(b.schema.get_field_index("keys")), b.column(b.schema.get_field_index("probes"))
            rest = b.select([c for c in b.schema.names if c not in ("keys", "probes")]).to_pylist()
            for at, r in enumerate(rest):
                own = levels_hex(r["nodes"], r["n"], r["height"])
                over = unpack(r["path"])
                tail = "".join(a + z for a, z in over)
                subroot, root = r["subroot"] or own[-1], r["root"]
                proofs, folded, paths = [], [], []
                found = probes[at].values.to_pylist()
                for i in range(r["n"]):
                    near = siblings(own, i)
                    proofs.append(hashlib.sha256(("".join(a + z for a, z in near) + tail).encode()).hexdigest())
                    leaf = found[i].hex() if found[i] is not None else own[0][i * HEX:(i + 1) * HEX]
                    folded.append(fold(fold(leaf, near), over))
                    if with_path:
                        paths.append([{"left": a, "right": z} for a, z in near + over])
                n = r["n"]
                cols = [keys[at].values, pa.array([own[0][i * HEX:(i + 1) * HEX] for i in range(n)]),
                        pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded),
                        pa.array([f == root for f in folded])]
                if with_path:
                    cols.append(pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))))
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return tier.select("g", "block", "n", "height", "nodes", "keys", "probes").join(up, ["g", "block"]).mapInArrow(run, schema)


def oracle(table_name: str = "documents") -> str:
    """DuckDB SQL of op11 (fields doc_id, source, lang, n_chars, text; groups by
    lang; rows whose crc32 of the decimal doc_id 3 divides are tampered)."""
    f = lambda c: (f"coalesce(octet_length(encode(cast({c} as varchar)))::varchar || ':' || cast({c} as varchar), '-')")
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    marks = ", -1" * 8
    return f"""
with recursive d as (select *, coalesce('s' || lang, '') as g,
    list_reduce(flatten([[4294967295::bigint],
      flatten([[ord(x)::bigint{marks}] for x in string_split(cast(doc_id as varchar), '')])]),
      lambda c, b: case when b >= 0 then xor(c, b) else xor(c >> 1, (c & 1) * 3988292384) end) as inv from {table_name}),
h as (select doc_id, g, xor(inv, 4294967295) % 3 = 0 as tampered,
    sha256({f('doc_id')} || {f('source')} || {f('lang')} || {f('n_chars')} || {f('text')}) as leaf,
    sha256({f('doc_id')} || {f('source')} || {f('lang')} || {f('n_chars')} || {f(low)}) as low from d),
l as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by g) as n from h),
t as (select 0 as lv, g, pos, leaf as dig, n from l
  union all select lv + 1, g, pos // 8, sha256(string_agg(dig, '' order by pos)), (n + 7) // 8
    from t where n > 1 group by lv, g, pos // 8, n),
sub as (select g, dig as subroot, row_number() over (order by encode(g)) - 1 as pos, count(*) over () as n from t where n = 1),
u as (select 0 as lv, pos, subroot as dig, n from sub
  union all select lv + 1, pos // 8, sha256(string_agg(dig, '' order by pos)), (n + 7) // 8
    from u where n > 1 group by lv, pos // 8, n),
rid as (select *, row_number() over () as rid from l),
p as (select r.rid, 0 as tree, a.lv, coalesce(string_agg(b.dig, '' order by b.pos) filter (b.pos < a.pos), '') as lft,
    coalesce(string_agg(b.dig, '' order by b.pos) filter (b.pos > a.pos), '') as rgt
  from rid r join t a on a.g = r.g and a.n > 1 and a.pos = r.pos // (8 ** a.lv)::bigint
  join t b on b.g = a.g and b.lv = a.lv and b.pos // 8 = a.pos // 8 group by r.rid, a.lv
  union all select r.rid, 1, a.lv, coalesce(string_agg(b.dig, '' order by b.pos) filter (b.pos < a.pos), ''),
    coalesce(string_agg(b.dig, '' order by b.pos) filter (b.pos > a.pos), '')
  from rid r join sub s on s.g = r.g join u a on a.n > 1 and a.pos = s.pos // (8 ** a.lv)::bigint
  join u b on b.lv = a.lv and b.pos // 8 = a.pos // 8 group by r.rid, a.lv),
q as (select *, row_number() over (partition by rid order by tree, lv) as k from p),
f as (select rid, 0 as k, case when tampered then low else leaf end as cur from rid
  union all select f.rid, q.k, sha256(q.lft || f.cur || q.rgt) from f join q on q.rid = f.rid and q.k = f.k + 1),
z as (select rid, arg_max(cur, k) as folded from f group by rid),
o as (select rid, string_agg(lft || rgt, '' order by k) as proof from q group by rid)
select r.doc_id, r.leaf, s.subroot, (select dig from u where n = 1) as root, sha256(coalesce(o.proof, '')) as proof_sha256,
  z.folded as folded_root, z.folded = (select dig from u where n = 1) as verified
from rid r join sub s using (g) join z using (rid) left join o using (rid)"""
