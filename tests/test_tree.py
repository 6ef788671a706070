"""Conversation forest on literal messages: ranks, nulls, orphans, bad roles."""

import pytest

from corpusprep.operators import tree

SCHEMA = "message_id string, parent_id string, role string, text string, rank int"
ROWS = [
    ("r", None, "prompter", "hi", None),
    ("a1", "r", "assistant", "A1", 1),
    ("a2", "r", "assistant", "A2", None),   # null rank counts as 0 -> best
    ("a3", "r", "assistant", "A3", 0),      # tie with a2 -> message_id order
    ("u", "a2", "prompter", "more", None),
    ("b1", "u", "assistant", "B1", 2),
    ("b2", "u", "assistant", "B2", 1),
    ("x", "missing", "prompter", "orphan", None),
    ("e", "", "prompter", "empty parent is a root", None),
]


def test_pairs_follow_best_path(spark):
    m = spark.createDataFrame(ROWS, SCHEMA)
    pairs = {(r["node_id"], r["accepted_id"], r["rejected_id"]): r["prompts"]
             for r in tree.preference_pairs(m).collect()}
    assert set(pairs) == {("r", "a2", "a3"), ("r", "a2", "a1"), ("r", "a3", "a1"), ("u", "b2", "b1")}
    assert pairs[("r", "a2", "a3")] == "<USER>hi</USER><MODEL>"
    assert pairs[("u", "b2", "b1")] == "<USER>hi</USER><MODEL>A2</MODEL><USER>more</USER><MODEL>"


def test_roots_and_orphans(spark):
    m = spark.createDataFrame(ROWS, SCHEMA)
    assert {r["message_id"] for r in tree.roots(m).collect()} == {"r", "e"}
    d = tree.descendants(m, tree.roots(m))
    assert "x" not in {r["message_id"] for r in d.collect()}
    s = {r["message_id"]: r["split"] for r in tree.split_by_root(m, 1, 42).collect()}
    assert s["x"] == "train"
    assert len(s) == len(ROWS)


def test_unknown_role_raises(spark):
    rows = [("r", None, "prompter", "hi", None), ("a", "r", "system", "s", None),
            ("b1", "a", "assistant", "x", 0), ("b2", "a", "assistant", "y", 1)]
    m = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(Exception, match="Unknown role"):
        tree.preference_pairs(m).collect()


def test_a_chain_of_any_depth_returns_whole(spark):
    from corpusprep.operators import tree
    rows = [(f"m{i}", None if i == 0 else f"m{i - 1}", "prompter", "t", None) for i in range(40)]
    m = spark.createDataFrame(rows, "message_id string, parent_id string, role string, text string, rank int")
    assert tree.best_path(m).count() == 40 and not hasattr(tree, "MAX_DEPTH")


def chain(spark, n, extra=()):
    m = spark.range(n).selectExpr("concat('m', lpad(id, 7, '0')) as message_id",
                                  "case when id > 0 then concat('m', lpad(id - 1, 7, '0')) end as parent_id",
                                  "case when id % 2 = 0 then 'prompter' else 'assistant' end as role",
                                  "concat('t', id) as text", "cast(null as int) as rank")
    return m.unionByName(spark.createDataFrame(list(extra), SCHEMA)) if extra else m


def test_deep_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    plain = tree.reliable_checkpoint
    monkeypatch.setattr(tree, "reliable_checkpoint", lambda df: (rounds.append(1), plain(df))[1])
    m = chain(spark, 100_000)
    d = tree.descendants(m, tree.roots(m))
    assert len(rounds) < 25
    r = d.selectExpr("count(*) as n", "max(depth) as top", "count(distinct depth) as each", "min(root_id) as root").first()
    assert tuple(r) == (100_000, 99_999, 100_000, "m0000000")


def test_closure_against_walking_up(spark):
    import random
    rnd = random.Random(3)
    up = {i: (None if i < 5 else rnd.randrange(max(0, i - 4), i)) for i in range(400)}
    rows = [(f"n{i}", None if p is None else f"n{p}", "prompter", "t", None) for i, p in up.items()]
    rows += [("c1", "c3", "prompter", "t", None), ("c2", "c1", "prompter", "t", None), ("c3", "c2", "prompter", "t", None),
             ("c4", "c2", "prompter", "t", None), ("o1", "nowhere", "prompter", "t", None), ("o2", "o1", "prompter", "t", None)]
    m = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for i in up:
        depth, x = 0, i
        while up[x] is not None:
            depth, x = depth + 1, up[x]
        want.add((f"n{x}", f"n{i}", depth))
    assert {tuple(r) for r in tree.descendants(m, tree.roots(m)).collect()} == want     # no cycles, no orphans
    some = tree.roots(m).filter("message_id in ('n0', 'n3')")
    assert {tuple(r) for r in tree.descendants(m, some).collect()} == {w for w in want if w[0] in ("n0", "n3")}
    assert tree.descendants(m, some.limit(0)).count() == 0


def test_contexts_of_a_long_path(spark):
    """5,000 turns with a side branch here and there, over many partitions; the
    turns are one row each."""
    n = 5000
    side = [(f"s{i}", f"m{i:07d}", "assistant" if i % 2 == 0 else "prompter", f"side {i}", 1) for i in range(10, n, 500)]
    m = chain(spark, n, side)
    pairs = {r["node_id"]: r["prompts"] for r in tree.preference_pairs(m).collect()}
    assert set(pairs) == {f"m{i:07d}" for i in range(10, n, 500)}
    turn = lambda i: f"<USER>t{i}</USER>" if i % 2 == 0 else f"<MODEL>t{i}</MODEL>"
    for node, text in pairs.items():
        assert text == "".join(turn(i) for i in range(int(node[1:]) + 1)) + "<MODEL>"
    path = tree.best_path(m)
    upto = path.filter("depth in (3, 4998)").selectExpr("message_id as node_id", "root_id", "depth")
    out = tree.render_context(path, m, upto)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 2
