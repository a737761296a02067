"""Attribution, delegation, authorization and reversal."""

from __future__ import annotations

from spoor.operators import attribution as G
from spoor.plans import demo
from spoor.plans.demo import chain_of, parent_user, with_views
from spoor.plans.registry import query

GAP = 7200

_TOUCH = "FROM trail WHERE coalesce(resource, '') <> ''"


@query(
    "G1",
    with_views(
        "trail",
        "SELECT session_id, resource, row_number() OVER (PARTITION BY session_id, resource ORDER BY ts, id) AS touch_no, id, chain_id, sequence, agent_id, action_type, ts " + _TOUCH,
    ),
)
def resource_index(spark, sf):
    return G.resource_index(demo.trail(spark, sf))


_TURNS = (
    f"SELECT *, cast(sum(CASE WHEN before IS NULL OR epoch_us(ts) - before > {GAP}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, agent_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) as bigint) AS turn "
    "FROM (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY session_id, agent_id ORDER BY ts, id) AS before FROM trail) b"
)


@query("G2", with_views("trail", "SELECT id, session_id, agent_id, turn FROM turns", turns=_TURNS))
def assign_turns(spark, sf):
    return G.assign_turns(demo.trail(spark, sf), GAP).select("id", "session_id", "agent_id", "turn")


@query(
    "G3",
    with_views(
        "trail",
        "SELECT session_id, source_agent, agent_id AS target_agent, count(*) AS n, count(DISTINCT resource) AS resources FROM "
        f"(SELECT *, lag(agent_id) OVER (PARTITION BY session_id, resource ORDER BY ts, id) AS source_agent {_TOUCH}) x WHERE source_agent <> agent_id GROUP BY 1, 2, 3",
    ),
)
def dependency_edges(spark, sf):
    return G.dependency_edges(demo.trail(spark, sf))


_BLAST = with_views(
    "trail",
    "SELECT a.id, a.session_id, a.resource, a.agent_id, count(b.id) AS later_touches, count(b.id) FILTER (WHERE b.agent_id <> a.agent_id) AS later_by_others "
    f"FROM (SELECT * {_TOUCH}) a LEFT JOIN trail b ON b.session_id = a.session_id AND b.resource = a.resource AND (b.ts, b.id) > (a.ts, a.id) GROUP BY 1, 2, 3, 4",
)


@query("G4", _BLAST)
def blast_radius(spark, sf):
    return G.blast_radius(demo.trail(spark, sf))


@query("G4", _BLAST)
def blast_radius_sliced(spark, sf):
    """The plan a large trail gets: resources cut into slices, here of 500 touches."""
    return G.blast_radius(demo.trail(spark, sf), slice_rows=500)


@query(
    "G5",
    with_views(
        "trail",
        "SELECT a.id, a.session_id, a.agent_id, a.turn, a.resource, count(b.id) AS co_turn_receipts FROM (SELECT * FROM turns WHERE resource <> '') a LEFT JOIN turns b "
        "ON b.session_id = a.session_id AND b.agent_id = a.agent_id AND b.turn = a.turn AND b.resource <> a.resource GROUP BY 1, 2, 3, 4, 5",
        turns=_TURNS,
    ),
)
def co_turn(spark, sf):
    return G.co_turn(G.assign_turns(demo.trail(spark, sf), GAP))


@query(
    "G6",
    with_views(
        "trail",
        "SELECT a.session_id, a.resource, a.agent_id AS agent_a, b.agent_id AS agent_b, count(*) AS overlaps FROM spans a JOIN spans b ON a.session_id = b.session_id "
        "AND a.resource = b.resource AND a.agent_id < b.agent_id AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY 1, 2, 3, 4",
        turns=_TURNS.replace(f"{GAP}000000", "43200000000"),
        spans="SELECT session_id, resource, agent_id, turn, min(ts) AS lo, max(ts) AS hi FROM turns WHERE resource <> '' GROUP BY 1, 2, 3, 4",
    ),
)
def turn_overlaps(spark, sf):
    return G.turn_overlaps(G.assign_turns(demo.trail(spark, sf), 43200), 43200)


@query(
    "G6",
    with_views(
        "trail",
        "SELECT a.session_id, a.resource, a.agent_id, a.turn, a.lo AS first_ts, a.hi AS last_ts, count(b.agent_id) AS overlaps FROM spans a LEFT JOIN spans b ON a.session_id = b.session_id "
        "AND a.resource = b.resource AND a.agent_id <> b.agent_id AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY ALL",
        turns=_TURNS.replace(f"{GAP}000000", "43200000000"),
        spans="SELECT session_id, resource, agent_id, turn, min(ts) AS lo, max(ts) AS hi FROM turns WHERE resource <> '' GROUP BY 1, 2, 3, 4",
    ),
)
def overlap_counts(spark, sf):
    return G.overlap_counts(G.assign_turns(demo.trail(spark, sf), 43200))


@query(
    "G7",
    with_views(
        "trail",
        f"SELECT resource, count(DISTINCT agent_id) AS agents, count(*) AS touches {_TOUCH} GROUP BY 1 HAVING count(DISTINCT agent_id) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10",
    ),
)
def contended_resources(spark, sf):
    return G.contended_resources(demo.trail(spark, sf), 10)


@query("G8", with_views("trail", "SELECT session_id, count(*) FILTER (WHERE resource <> '') AS indexed, count(*) AS receipts FROM trail GROUP BY 1"))
def identity_coverage(spark, sf):
    return G.identity_coverage(demo.trail(spark, sf))


_RANK = "CASE risk_level WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"


@query("G9", with_views("trail", f"SELECT session_id, agent_id, arg_max(risk_level, {_RANK}) AS max_risk, count(*) AS receipts FROM trail GROUP BY 1, 2"))
def agent_risk(spark, sf):
    return G.agent_risk(demo.trail(spark, sf))


# Every chain whose user leaves 2 or 3 at division by 4 was opened by the chain of half the number.
_DELEGATIONS = (
    f"SELECT chain_id, principal_id, {chain_of(parent_user('user_id'))} AS parent_chain_id, "
    "CASE WHEN user_id % 16 = 6 THEN 'urn:receipt:none' ELSE p.first_id END AS parent_receipt_id, "
    "CASE WHEN user_id % 16 = 10 THEN 'did:agent:nobody' ELSE 'did:agent:' || cast({p} % 8 as string) END AS delegator_id "
    "FROM (SELECT * FROM {t} WHERE sequence = 1 AND user_id % 4 > 1) c LEFT JOIN "
    "(SELECT chain_id AS pc, id AS first_id FROM {t} WHERE sequence = 1 AND user_id % 11 <> 4) p ON p.pc = {pc}"
)


def _delegations(table: str) -> str:
    return (
        _DELEGATIONS.replace("{p}", parent_user("user_id")).replace("{pc}", "(" + chain_of(parent_user("user_id")) + ")").replace("{t}", table)
    )


def delegations(spark, sf):
    return spark.sql(_delegations("{trail}"), trail=demo.trail(spark, sf))


@query(
    "G10",
    with_views(
        "trail",
        "SELECT d.chain_id, d.parent_chain_id, d.parent_receipt_id, CASE WHEN p.i0 IS NULL THEN 'no_parent_chain' WHEN r.id IS NULL THEN 'no_parent_receipt' "
        "WHEN p.i0 <> d.delegator_id OR p.i1 <> d.delegator_id THEN 'wrong_delegator' WHEN p.p0 <> d.principal_id OR p.p1 <> d.principal_id THEN 'principal_changed' ELSE 'ok' END AS delegation_outcome "
        "FROM d LEFT JOIN (SELECT chain_id, min(issuer_id) AS i0, max(issuer_id) AS i1, min(principal_id) AS p0, max(principal_id) AS p1 FROM trail GROUP BY 1) p ON p.chain_id = d.parent_chain_id "
        "LEFT JOIN trail r ON r.chain_id = d.parent_chain_id AND r.id = d.parent_receipt_id",
        d=_delegations("trail"),
    ),
)
def verify_delegations(spark, sf):
    return G.verify_delegations(delegations(spark, sf), demo.trail(spark, sf))


# A few links that close circles: 5 → 7 → 5 and what hangs below them.
_EDGES = (
    "SELECT DISTINCT chain_id, parent_chain_id FROM (" + "{d}" + ") d0 UNION "
    f"SELECT DISTINCT {chain_of('user_id')} AS chain_id, {chain_of('user_id + 2')} AS parent_chain_id FROM " + "{t} WHERE user_id % 40 = 5 UNION "
    f"SELECT DISTINCT {chain_of('user_id + 2')} AS chain_id, {chain_of('user_id')} AS parent_chain_id FROM " + "{t} WHERE user_id % 40 = 5"
)


def _edges(table: str) -> str:
    raw = _EDGES.replace("{d}", _delegations(table)).replace("{t}", table)
    return f"SELECT chain_id, min(parent_chain_id) AS parent_chain_id FROM ({raw}) e GROUP BY chain_id"


@query(
    "G11",
    with_views(
        "trail",
        "SELECT n.chain_id, t.root_chain_id, t.depth, t.chain_id IS NULL AS cyclic FROM names n LEFT JOIN tree t USING (chain_id)",
        e=_edges("trail"),
        names="SELECT chain_id FROM trail UNION SELECT parent_chain_id FROM e",
        **{
            "tree(chain_id, root_chain_id, depth)": "SELECT chain_id, chain_id, cast(0 as bigint) FROM names WHERE chain_id NOT IN (SELECT chain_id FROM e) "
            "UNION ALL SELECT e.chain_id, t.root_chain_id, t.depth + 1 FROM tree t JOIN e ON e.parent_chain_id = t.chain_id"
        },
    ),
)
def delegation_tree(spark, sf):
    trail = demo.trail(spark, sf)
    return G.delegation_tree(spark.sql(_edges("{trail}"), trail=trail), trail)


_DEPENDS = (
    "SELECT 'order-' || cast(l_orderkey as string) AS src, 'part-' || cast(l_partkey as string) AS dst FROM {l} UNION "
    "SELECT 'part-' || cast(p_partkey as string), 'part-' || cast(cast(floor(p_partkey / 12) as bigint) as string) FROM {p} UNION "
    "SELECT 'part-' || cast(l_partkey as string), 'supplier-' || cast(l_suppkey as string) FROM {l}"
)
_ROOTS = "SELECT 'order-' || cast(o_orderkey as string) AS name FROM {o} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"


@query(
    "G12",
    "WITH RECURSIVE edges AS (" + _DEPENDS.format(l="lineitem", p="part") + "), reach(name, distance) AS (" + _ROOTS.format(o="orders").replace(" AS name", " AS name, cast(0 as bigint)")
    + " UNION SELECT e.dst, r.distance + 1 FROM reach r JOIN edges e ON e.src = r.name WHERE r.distance < 12) SELECT name, min(distance) AS distance FROM reach GROUP BY 1",
)
def reachable(spark, sf):
    lines, part, orders = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "part", "orders"))
    return G.reachable(spark.sql(_DEPENDS, l=lines, p=part), spark.sql(_ROOTS, o=orders))


# One or two grants per customer; every seventh belongs to somebody else.
_GRANTS = (
    "SELECT 'grant-' || cast(c_custkey as string) AS grant_ref, CASE WHEN c_custkey % 7 = 3 THEN 'did:user:other' ELSE 'did:user:' || cast(c_custkey % 2 as string) END AS subject FROM {c}"
)


@query(
    "G13",
    with_views(
        "trail",
        "SELECT * FROM (SELECT t.chain_id, t.sequence, t.id, t.principal_id, t.grant_ref, CASE WHEN t.grant_ref IS NULL OR g.subject IS NULL THEN 'UNGROUNDED_PRINCIPAL' "
        "WHEN g.subject <> t.principal_id THEN 'PRINCIPAL_GRANT_MISMATCH' END AS grant_outcome FROM trail t LEFT JOIN grants g ON g.grant_ref = t.grant_ref "
        "WHERE t.risk_level IN ('high', 'critical')) x WHERE grant_outcome IS NOT NULL",
        grants=_GRANTS.format(c="customer"),
    ),
)
def ungrounded(spark, sf):
    return G.ungrounded(demo.trail(spark, sf), spark.sql(_GRANTS, c=spark.read.parquet(f"{sf}/customer.parquet")))


@query(
    "G14",
    with_views(
        "trail",
        "SELECT grant_ref, count(*) AS receipts, count(DISTINCT chain_id) AS chains, count(DISTINCT resource) AS resources, min(ts) AS first_ts, max(ts) AS last_ts "
        "FROM trail WHERE grant_ref <> '' GROUP BY 1",
    ),
)
def grant_activity(spark, sf):
    return G.grant_activity(demo.trail(spark, sf))


@query(
    "G15",
    with_views(
        "trail",
        "SELECT r.id, r.chain_id, r.reversal_of, CASE WHEN o.id IS NULL THEN 'no_original' WHEN o.chain_id <> r.chain_id THEN 'other_chain' "
        "WHEN o.action_type <> r.action_type THEN 'other_action' WHEN r.status <> 'success' THEN 'not_successful' ELSE 'ok' END AS reversal_outcome "
        "FROM trail r LEFT JOIN trail o ON o.id = r.reversal_of WHERE r.reversal_of IS NOT NULL",
    ),
)
def reversals(spark, sf):
    return G.reversals(demo.trail(spark, sf))


@query(
    "G16",
    with_views(
        "trail",
        "SELECT id, chain_id, resource, ts + to_seconds(reversal_window_seconds) AS open_until FROM trail WHERE reversible AND ts + to_seconds(reversal_window_seconds) > timestamp '2024-01-15 00:00:00' "
        "AND id NOT IN (SELECT reversal_of FROM trail WHERE status = 'success' AND reversal_of IS NOT NULL)",
    ),
)
def open_reversals(spark, sf):
    return G.open_reversals(demo.trail(spark, sf), "2024-01-15 00:00:00")


@query(
    "G17",
    with_views(
        "trail",
        f"SELECT resource, id, expected_hash, before_hash FROM (SELECT *, lag(after_hash) OVER (PARTITION BY target_system, resource ORDER BY ts, id) AS expected_hash {_TOUCH}) x "
        "WHERE before_hash <> expected_hash",
    ),
)
def drift_gaps(spark, sf):
    return G.drift_gaps(demo.trail(spark, sf))


_BARRIERS = ", ".join(f"'{b}'" for b in G.BARRIERS)


@query(
    "G18",
    with_views(
        "trail",
        "SELECT id, resource, p = n2 AS tip, b IS NOT NULL AS barred, coalesce(b, n2) - p AS undo_touches FROM (SELECT *, min(CASE WHEN action_type IN (" + _BARRIERS + ") THEN p END) "
        "OVER (PARTITION BY resource ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM (SELECT id, resource, action_type, "
        f"row_number() OVER (PARTITION BY resource ORDER BY ts, id) AS p, count(*) OVER (PARTITION BY resource) AS n2 {_TOUCH}) x) y",
    ),
)
def undo_scope(spark, sf):
    return G.undo_scope(demo.trail(spark, sf))
