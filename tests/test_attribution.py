"""Attribution against brute force on small trails with one hot resource and one hot agent."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from spoor.operators import attribution as G

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id string, session_id string, chain_id string, sequence long, agent_id string, resource string, target_system string, action_type string, ts timestamp_ntz"


@pytest.fixture(scope="module")
def events():
    rng = random.Random(3)
    out = []
    for i in range(400):
        resource = "/hot" if rng.random() < 0.34 else rng.choice(["/a", "/b", "/c", None])
        agent = "x" if rng.random() < 0.34 else rng.choice("yzw")
        kind = rng.choice(["filesystem.file.read", "filesystem.file.modify", "filesystem.file.delete"])
        at = START + datetime.timedelta(seconds=rng.randint(0, 40_000), microseconds=rng.choice([0, 1]))
        out.append((f"{i:03}", rng.choice(["s1", "s2"]), f"c-{agent}", i, agent, resource, "fs", kind, at))
    return out


@pytest.fixture(scope="module")
def trail(spark, events):
    return spark.createDataFrame(events, SCHEMA).cache()


SLICES = pytest.mark.parametrize("slice_rows", [10**9, 20], ids=["whole", "sliced"])


def turns_of(events, gap):
    turn, last, number = {}, {}, {}
    for e in sorted(events, key=lambda e: (e[1], e[4], e[8], e[0])):
        key = (e[1], e[4])
        if key not in last or (e[8] - last[key]).total_seconds() > gap:
            number[key] = number.get(key, 0) + 1
        last[key] = e[8]
        turn[e[0]] = number[key]
    return turn


@SLICES
def test_turns(trail, events, slice_rows):
    got = {r.id: r.turn for r in G.assign_turns(trail, 300, slice_rows).collect()}
    assert got == turns_of(events, 300)


@SLICES
def test_blast_radius(trail, events, slice_rows):
    got = {r.id: (r.later_touches, r.later_by_others) for r in G.blast_radius(trail, slice_rows).collect()}
    want = {}
    for e in events:
        if e[5] is None:
            continue
        later = [o for o in events if (o[1], o[5]) == (e[1], e[5]) and (o[8], o[0]) > (e[8], e[0])]
        want[e[0]] = (len(later), sum(o[4] != e[4] for o in later))
    assert got == want


@pytest.mark.parametrize("gap", [60, 300, 3600])
def test_turn_overlaps(trail, events, gap):
    turn = turns_of(events, gap)
    spans = {}
    for e in events:
        if e[5] is not None:
            spans.setdefault((e[1], e[5], e[4], turn[e[0]]), []).append(e[8])
    spans = {k: (min(v), max(v)) for k, v in spans.items()}
    want = {}
    for (s, r, a, _), (lo, hi) in spans.items():
        for (s2, r2, b, _), (lo2, hi2) in spans.items():
            if (s, r) == (s2, r2) and a < b and lo <= hi2 and lo2 <= hi:
                want[s, r, a, b] = want.get((s, r, a, b), 0) + 1
    got = {tuple(r)[:4]: r.overlaps for r in G.turn_overlaps(G.assign_turns(trail, gap), gap).collect()}
    assert got == want
    counted = {k: sum(k[:2] == o[:2] and k[2] != o[2] and v[0] <= w[1] and w[0] <= v[1] for o, w in spans.items()) for k, v in spans.items()}
    for slice_rows in (None, 60):
        out = G.overlap_counts(G.assign_turns(trail, gap), slice_rows)
        assert {tuple(r)[:4]: r.overlaps for r in out.collect()} == counted


def test_overlaps_of_a_crowded_resource_cost_its_rows(spark):
    """10,000 agents at once on one resource: a row each, where pairs would be fifty million."""
    turns = spark.range(10_000).selectExpr(
        "concat('t', id) AS id", "'s' AS session_id", "'r' AS resource", "concat('a', id) AS agent_id", "1L AS turn", "'c' AS chain_id",
        "id AS sequence", "'x' AS action_type", "timestamp_ntz '2024-01-01' AS ts",
    )
    got = G.overlap_counts(turns).groupBy("overlaps").count().collect()
    assert [tuple(r) for r in got] == [(9_999, 10_000)]



def test_co_turn(trail, events):
    turn = turns_of(events, 300)
    got = {r.id: r.co_turn_receipts for r in G.co_turn(G.assign_turns(trail, 300)).collect()}
    touching = [e for e in events if e[5] is not None]
    for e in touching:
        same = [o for o in touching if (o[1], o[4], turn[o[0]]) == (e[1], e[4], turn[e[0]]) and o[5] != e[5]]
        assert got[e[0]] == len(same)


@SLICES
def test_undo_scope(trail, events, slice_rows):
    by_resource = {}
    for e in sorted((e for e in events if e[5] is not None), key=lambda e: (e[8], e[0])):
        by_resource.setdefault(e[5], []).append(e)
    got = {r.id: (r.tip, r.barred, r.undo_touches) for r in G.undo_scope(trail, slice_rows).collect()}
    for touches in by_resource.values():
        for i, e in enumerate(touches):
            barrier = next((j for j in range(i + 1, len(touches)) if touches[j][7] == "filesystem.file.delete"), None)
            reach = (len(touches) - 1 if barrier is None else barrier) - i
            assert got[e[0]] == (i == len(touches) - 1, barrier is not None, reach)


def test_dependency_edges_and_contention(trail, events):
    order = {}
    want = {}
    for e in sorted((e for e in events if e[5] is not None), key=lambda e: (e[8], e[0])):
        before = order.get((e[1], e[5]))
        if before is not None and before != e[4]:
            key = (e[1], before, e[4])
            want[key] = want.get(key, 0) + 1
        order[e[1], e[5]] = e[4]
    got = {(r.session_id, r.source_agent, r.target_agent): r.n for r in G.dependency_edges(trail).collect()}
    assert got == want
    assert G.contended_resources(trail, 1).first().resource == "/hot"


def test_drift(spark):
    rows = [("a", 1, None, "v1"), ("b", 2, "v1", "v2"), ("c", 3, "v9", "v3"), ("d", 4, "v3", None), ("e", 5, "v3", "v4")]
    df = spark.createDataFrame(rows, "id string, n int, before_hash string, after_hash string").selectExpr(
        "*", "'r' AS resource", "'fs' AS target_system", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, n) AS ts"
    )
    assert [(r.id, r.expected_hash) for r in G.drift_gaps(df).collect()] == [("c", "v2")]


def test_delegation_checks(spark):
    trail = spark.createDataFrame(
        [("p1", "P", "agent:p", "u1"), ("p2", "P", "agent:p", "u1"), ("q1", "Q", "agent:q", "u2")],
        "id string, chain_id string, issuer_id string, principal_id string",
    )
    rows = [
        ("ok", "u1", "P", "p2", "agent:p"), ("no_parent_chain", "u1", "X", "p1", "agent:p"), ("no_parent_receipt", "u1", "P", "q1", "agent:p"),
        ("wrong_delegator", "u1", "P", "p1", "agent:q"), ("principal_changed", "u1", "Q", "q1", "agent:q"),
    ]
    links = spark.createDataFrame(rows, "chain_id string, principal_id string, parent_chain_id string, parent_receipt_id string, delegator_id string")
    got = G.verify_delegations(links, trail).collect()
    assert len(got) == len(rows) and all(r.chain_id == r.delegation_outcome for r in got)


def test_tree_with_a_long_path_and_a_cycle(spark):
    edges = [(f"n{i + 1}", f"n{i}") for i in range(20)] + [("x", "y"), ("y", "z"), ("z", "x"), ("below", "x"), ("s", "s")]
    edges = spark.createDataFrame(edges, "chain_id string, parent_chain_id string")
    chains = edges.select("chain_id").union(spark.createDataFrame([("alone",)], "chain_id string"))
    got = {r.chain_id: (r.root_chain_id, r.depth, r.cyclic) for r in G.delegation_tree(edges, chains).collect()}
    for i in range(21):
        assert got[f"n{i}"] == ("n0", i, False)
    for name in ("x", "y", "z", "below", "s"):
        assert got[name] == (None, None, True)
    assert got["alone"] == ("alone", 0, False)
    assert len(got) == 27


def test_reachable_through_diamond_and_cycle(spark):
    edges = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d"), ("z", "q")]
    edges = spark.createDataFrame(edges, "src string, dst string")
    roots = spark.createDataFrame([("r",), ("lonely",)], "name string")
    got = {r.name: r.distance for r in G.reachable(edges, roots).collect()}
    assert got == {"r": 0, "lonely": 0, "a": 1, "b": 1, "c": 2, "d": 3}


def test_grounded_authority(spark):
    rows = [
        ("low", "low", None, "u"), ("none", "high", None, "u"), ("empty", "critical", "", "u"), ("unknown", "high", "g9", "u"),
        ("other", "high", "g2", "u"), ("fine", "critical", "g1", "u"), ("medium", "medium", "g2", "u"),
    ]
    df = spark.createDataFrame(rows, "id string, risk_level string, grant_ref string, principal_id string").withColumns({"chain_id": F.lit("c"), "sequence": F.lit(1)})
    grants = spark.createDataFrame([("g1", "u"), ("g2", "v")], "grant_ref string, subject string")
    got = {r.id: r.grant_outcome for r in G.ungrounded(df, grants).collect()}
    assert got == {
        "none": "UNGROUNDED_PRINCIPAL", "empty": "UNGROUNDED_PRINCIPAL", "unknown": "UNGROUNDED_PRINCIPAL", "other": "PRINCIPAL_GRANT_MISMATCH",
    }


def test_reversals(spark):
    rows = [
        ("o", "c", "t", "success", None, True, 60), ("ok", "c", "t", "success", "o", False, None), ("none", "c", "t", "success", "zz", False, None),
        ("chain", "d", "t", "success", "o", False, None), ("kind", "c", "u", "success", "o", False, None), ("failed", "c", "t", "failure", "o2", False, None),
        ("o2", "c", "t", "success", None, True, 60), ("o3", "c", "t", "success", None, True, 10), ("o4", "c", "t", "success", None, None, 60),
    ]
    df = spark.createDataFrame(rows, "id string, chain_id string, action_type string, status string, reversal_of string, reversible boolean, reversal_window_seconds long")
    df = df.selectExpr("*", "timestamp_ntz '2024-01-01 00:00:00' AS ts", "'r' AS resource")
    got = {r.id: r.reversal_outcome for r in G.reversals(df).collect()}
    assert got == {"ok": "ok", "none": "no_original", "chain": "other_chain", "kind": "other_action", "failed": "not_successful"}
    assert [r.id for r in G.open_reversals(df, "2024-01-01 00:00:30").collect()] == ["o2"]
