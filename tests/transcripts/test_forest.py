"""Delegation forests by hand and by brute force: chains, cycles, hot roots, repeated and missing ids."""

import random

from sessionlake.operators import forest
from sessionlake.sources import logs


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def walked(pairs):
    """Root and depth of each session, one step at a time."""
    real = [(c, p) for c, p in pairs if c is not None and p is not None and c != p]
    up = {}
    for c, p in real:
        up[c] = min(p, up.get(c, p))
    out = {}
    for s in {x for pair in real for x in pair}:
        at, steps, seen = s, 0, {s}
        while at in up:
            at, steps = up[at], steps + 1
            if at in seen:
                at = None
                break
            seen.add(at)
        out[s] = (at, steps if at is not None else None)
    return out


def placed(spark, pairs):
    return {r.session: (r.root, r.depth) for r in forest.forest(edges(spark, pairs)).collect()}


def test_chains_cycles_and_odd_edges(spark):
    chain = [(f"c{i}", f"c{i - 1}") for i in range(1, 51)]
    cycle = [("x", "y"), ("y", "z"), ("z", "x"), ("below", "x"), ("further", "below")]
    odd = [("self", "self"), (None, "c0"), ("c9", None), ("two", "c4"), ("two", "c2"), ("two", "c2"), ("", "c1")]
    star = [(f"s{i}", "hub") for i in range(300)] + [("hub", "c50")]
    pairs = chain + cycle + odd + star
    found = placed(spark, pairs)
    assert found == walked(pairs)
    assert found["c50"] == ("c0", 50) and found["s7"] == ("c0", 52) and found["further"] == (None, None) and "self" not in found and found["two"] == ("c0", 3)
    assert placed(spark, [("x", "y"), ("y", "x")]) == {"x": (None, None), "y": (None, None)}
    assert forest.forest(edges(spark, pairs).limit(0)).collect() == []


def test_random_forests_by_brute_force(spark):
    r = random.Random(5)
    pairs = [(str(r.randrange(200)), str(r.randrange(200))) for _ in range(120)]
    assert placed(spark, pairs) == walked(pairs)


def test_sums_reach_the_root_once(spark):
    pairs = [("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x")]
    measures = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("d", None), ("x", 5), ("lone", 7), (None, 9)], "session string, tokens bigint")
    found = {r.root: (r.n_sessions, r.max_depth, r.tokens) for r in forest.rolled_up(forest.forest(edges(spark, pairs)), measures, ["tokens"]).collect()}
    assert found == {"a": (4, 2, 6), None: (2, None, 5), "lone": (1, 0, 7)}


def test_edges_of_logs_and_of_directories(spark):
    paths = spark.createDataFrame([("/g/p1/subagents/k1/updates.jsonl",), ("/g/p1/subagents/k1/summary.json",), ("/g/k1/subagents/k2/updates.jsonl",), ("/g/p1/updates.jsonl",)], "file_path string")
    found = forest.forest(forest.directory_edges(logs.child_sessions(paths))).collect()
    assert {(r.session, r.root, r.depth) for r in found} == {("p1", "p1", 0), ("k1", "p1", 1), ("k2", "p1", 2)}
    launched = spark.createDataFrame([("s", "a1"), ("s", "a1"), ("s", None), ("s/a1", "a2")], "session_id string, agent_id string")
    found = forest.forest(forest.delegation_edges(launched)).collect()
    assert {(r.session, r.root, r.depth) for r in found} == {("s", "s", 0), ("s/a1", "s", 1), ("s/a1/a2", "s", 2)}


def test_measures_of_parsed_sessions(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, "format string, session_id string, " + schema)
    m = forest.session_measures(
        one([("main", "s", "running"), ("main", "s", "completed")], "status string"), one([("main", "s/a", 10, 0.5), ("main", "s", 1, None)], "total bigint, cost_usd double"), one([("main", "s", True), ("main", "s/a", False)], "open boolean")
    )
    r = forest.rolled_up(forest.forest(edges(spark, [("s/a", "s")])), m, ["launched", "open", "total", "cost_usd"]).first()
    assert (r.root, r.n_sessions, r["launched"], r["open"], r["total"], r["cost_usd"]) == ("s", 2, 2, 2, 11, 0.5)
