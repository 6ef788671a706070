"""Conversation forest jobs.

Messages are an edge list (message_id, parent_id). Closures double the way up
in each round (log2 of the depth, lineage cut by a reliable checkpoint each
round); only keys and depth travel through the loop, text is attached
afterwards. Contexts are a running concatenation along the paths. Sibling order is (coalesce(rank, 0), message_id) - a distributed
rank, so a parent with a huge fan-out still spreads over all tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.functions import text as tx
from corpusprep.operators.order import hash_order, rank_within, ranged
from corpusprep.session import BROADCAST_ROW_LIMIT, reliable_checkpoint


def is_root(parent: str = "parent_id"):
    p = F.col(parent)
    return p.isNull() | (p == "")


def roots(m: DataFrame) -> DataFrame:
    """G1: messages with a null or empty parent."""
    return m.filter(is_root())


def edges(m: DataFrame) -> DataFrame:
    return m.filter(~is_root()).select("parent_id", "message_id")


def rank_children(m: DataFrame) -> DataFrame:
    """(parent_id, message_id, rn, n_children) with rn 1 = best child."""
    c = m.filter(~is_root()).withColumn("_r", F.coalesce(F.col("rank"), F.lit(0)))
    ranked = rank_within(c.select("parent_id", "message_id", "_r"), "parent_id", ["_r", "message_id"], out="rn")
    n = c.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"))  # partial agg
    return ranked.join(n, "parent_id").drop("_r")


def children_of(m: DataFrame) -> DataFrame:
    """A5/G2 adjacency: parent -> ordered child ids (a row per parent)."""
    rc = rank_children(m)
    return rc.groupBy("parent_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "message_id"))),
                    lambda s: s["message_id"]).alias("children"))


def closure(start: DataFrame, edge: DataFrame) -> DataFrame:
    """start(root_id, message_id) -> every node reachable over
    ``edge(parent_id, message_id)``, with depth (0 for the start nodes, which
    have no parent in ``edge``).

    Path doubling: every message knows an ancestor and how far up it is, at
    first its parent; a round replaces it by that ancestor's own ancestor, so
    depth d takes log2(d) rounds of one join on unique keys. Messages whose way
    up ends elsewhere drop out (orphans, other trees), and so do cycles, which
    are what is left when a round brings no message to a root."""
    state = (start.select("message_id", F.col("root_id").alias("up"), F.lit(0).alias("depth"), F.lit(True).alias("done"))
             .unionByName(edge.select("message_id", F.col("parent_id").alias("up"), F.lit(1).alias("depth"), F.lit(False).alias("done"))))
    state, left = reliable_checkpoint(state), None
    while True:
        ways = state.filter(~F.col("done"))
        n = ways.count()
        if n == 0 or n == left:
            break
        left = n
        over = state.select(F.col("message_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_more"),
                            F.col("done").alias("_done"))
        moved = ways.join(over, "up").select("message_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_more")).alias("depth"),
                                             F.col("_done").alias("done"))
        state = reliable_checkpoint(state.filter("done").unionByName(moved))
    return state.filter("done").select(F.col("up").alias("root_id"), "message_id", "depth")


def descendants(m: DataFrame, root_ids: DataFrame) -> DataFrame:
    """(root_id, message_id, depth) for every message below the given roots
    (root included), breadth-first."""
    start = root_ids.select(F.col("message_id").alias("root_id"), "message_id")
    return closure(start, edges(m))


def best_path(m: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """From every root follow the only / best-ranked child."""
    rc = ranked if ranked is not None else rank_children(m)
    best = rc.filter(F.col("rn") == 1).select("parent_id", "message_id")
    start = roots(m).select(F.col("message_id").alias("root_id"), "message_id")
    return closure(start, best)


def render_context(path: DataFrame, m: DataFrame, upto: DataFrame) -> DataFrame:
    """For each (node_id, root_id, depth) in ``upto`` the rendered turns of
    its path prefix (depth 0..depth, in order) + '<MODEL>'.

    A running concatenation along (root_id, depth) in two phases: the turns are
    range-partitioned and sorted, one row each, and a partition needs from the
    ones before it only the text of the path that crosses its border. No prefix
    is taken apart into rows of its own."""
    far = upto.groupBy("root_id").agg(F.max("depth").alias("_far"))
    turns = (path.join(far, "root_id").filter(F.col("depth") <= F.col("_far"))
             .join(m.select("message_id", "role", "text"), "message_id")
             .join(upto.select("node_id", "root_id", "depth"), ["root_id", "depth"], "left")
             .select("root_id", "depth", "node_id", tx.render_turn("role", "text").alias("turn")))
    turns = ranged(turns, ["root_id", "depth"]).select("root_id", "node_id", "turn", "_pid")

    def ends(batches):
        pid, first, last, whole, held = None, None, None, True, []
        for b in batches:
            for r, t, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if pid is None:
                    pid, first = p, r
                elif r != last:
                    whole, held = False, []
                last = r
                held.append(t or "")
        if pid is not None:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "first": pa.array([first], pa.string()),
                                              "last": pa.array([last], pa.string()), "whole": [whole], "tail": pa.array(["".join(held)])})

    # a row per partition; its text is that of one path
    carry, text, open_root = {}, "", None
    for e in sorted(turns.select(F.col("root_id").cast("string"), "node_id", "turn", "_pid").mapInArrow(
            ends, "pid int, first string, last string, whole boolean, tail string").collect(), key=lambda e: e["pid"]):
        if e["first"] == open_root:
            carry[e["pid"]] = text
        text = (text if e["whole"] and e["first"] == open_root else "") + e["tail"]
        open_root = e["last"]

    def scan(batches):
        root, held = None, None
        for b in batches:
            nodes, out = [], []
            for r, node, t, p in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held is None:
                    root, held = r, [carry.get(p, "")]
                elif r != root:
                    root, held = r, []
                held.append(t or "")
                if node is not None:
                    held = ["".join(held)]
                    nodes.append(node)
                    out.append(held[0] + tx.MODEL_OPEN)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, b.column(1).type), pa.array(out, pa.string())], ["node_id", "prompts"])

    kind = T.StructType([turns.schema["node_id"], T.StructField("prompts", T.StringType())])
    return turns.mapInArrow(scan, kind)


def preference_pairs(m: DataFrame, assistant_only: bool = False) -> DataFrame:
    """At each node on the best path with >= 2 children, every pair of
    children (i < j in sibling order): accepted = i, rejected = j.

    Output (node_id, accepted_id, rejected_id, prompts, accepted, rejected).
    The partner of child i is found by an equi-join on the unique key
    (parent_id, rn) of the ranks i+1..n; the output itself is the pair list."""
    rc = reliable_checkpoint(rank_children(m))
    path = best_path(m, rc)
    branching = (path.join(rc.select(F.col("parent_id").alias("message_id"), "n_children").distinct(),
                           "message_id")
                 .filter(F.col("n_children") >= 2))
    branching = reliable_checkpoint(branching)      # keys only, read several times
    prompts = render_context(path, m, branching.select(F.col("message_id").alias("node_id"),
                                                       "root_id", "depth"))
    kids = rc.join(m.select("message_id", "text", "role"), "message_id")
    if assistant_only:
        kids = kids.filter(F.col("role") == "assistant")
    a = (kids.join(branching.select(F.col("message_id").alias("parent_id")), "parent_id", "left_semi")
         .filter(F.col("rn") < F.col("n_children")))
    partners = a.select("parent_id", F.col("message_id").alias("accepted_id"),
                        F.col("text").alias("a_text"),
                        F.explode(F.sequence(F.col("rn") + 1, F.col("n_children")))
                        .alias("rn"))
    r = kids.select("parent_id", "rn", F.col("message_id").alias("rejected_id"), F.col("text").alias("r_text"))
    pairs = partners.join(r, ["parent_id", "rn"])
    return (pairs.join(prompts, pairs["parent_id"] == prompts["node_id"])
            .select("node_id", "accepted_id", "rejected_id", "prompts",
                    tx.close_model("a_text").alias("accepted"), tx.close_model("r_text").alias("rejected")))


def split_by_root(m: DataFrame, n_test_roots: int, seed: int = 42) -> DataFrame:
    """The first ``n_test_roots`` roots in hash order and all their
    descendants are 'test'; every other message (orphans too) is 'train'."""
    r = roots(m).select("message_id")
    test_roots = r.orderBy(hash_order(seed, "message_id"), "message_id").limit(int(n_test_roots))
    members = descendants(m, test_roots).select("message_id").distinct()
    members = reliable_checkpoint(members)
    side = F.broadcast(members) if members.count() <= BROADCAST_ROW_LIMIT else members
    tagged = m.join(side.withColumn("split", F.lit("test")), "message_id", "left")
    return tagged.withColumn("split", F.coalesce("split", F.lit("train")))


def edges_with_rank(m: DataFrame) -> DataFrame:
    """O1 input: non-root messages with the sort key ``_r`` = coalesce(rank, 0)."""
    return m.filter(~is_root()).select("message_id", F.coalesce(F.col("rank"), F.lit(0)).alias("_r"))


def with_parent(m: DataFrame) -> DataFrame:
    """Every message joined to its parent row (equi-join on the parent key;
    orphans drop out). Adds parent_role and parent_text."""
    p = m.select(F.col("message_id").alias("parent_id"), F.col("role").alias("parent_role"),
                 F.col("text").alias("parent_text"))
    return m.filter(~is_root()).join(p, "parent_id")


def inner_and_leaves(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages that have children (left semi) and leaves (left anti)."""
    par = edges(m).select(F.col("parent_id").alias("message_id"))
    return m.join(par, "message_id", "left_semi"), m.join(par, "message_id", "left_anti")


def sibling_pair_counts(m: DataFrame) -> DataFrame:
    """J3 sizes: per parent the fan-out n and the n*(n-1)/2 sibling pairs,
    computed from the count alone (no pair is materialised)."""
    n = edges(m).groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"))
    return n.withColumn("pairs", (F.col("n_children") * (F.col("n_children") - 1) / 2).cast("long"))
