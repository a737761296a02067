"""Chain construction, integrity and witness queries."""

from __future__ import annotations

from spoor.operators import integrity as I
from spoor.operators import witness as W
from spoor.operators.query import chain_tails
from spoor.plans import demo
from spoor.plans.demo import DUCK, SPARK, with_views
from spoor.plans.registry import query

SIG = "signature_valid"


@query("V1", with_views("tampered", f"SELECT id, {demo.duck_hash(demo.duck_content(), 'previous_receipt_hash')} AS computed_hash FROM tampered"))
def content_hash(spark, sf):
    return I.content_hash(demo.tampered(spark, sf)).select("id", "computed_hash")


@query("V2", with_views("sealed", "SELECT chain_id, sequence, id, previous_receipt_hash, receipt_hash FROM sealed"))
def seal_chains(spark, sf):
    sealed = I.seal_chains(demo.build_trail(spark, sf), order=("ts", "event_id"))
    return sealed.select("chain_id", "sequence", "id", "previous_receipt_hash", "receipt_hash")


_CHECKS = "chain_id, sequence, id, index, signature_ok, hash_link_ok, sequence_ok"


@query("V3", with_views("checked", f"SELECT {_CHECKS} FROM checked"))
def check_links(spark, sf):
    return I.check_links(demo.tampered(spark, sf), SIG).select(*_CHECKS.split(", "))


_VERDICT = (
    "chain_id, valid, length, chain_state, broken_at, cause, head_sequence, head_hash, "
    "incomplete_roundtrip, unbalanced_session"
)


@query("V4", with_views("verdicts", f"SELECT {_VERDICT} FROM verdicts"))
def verify_chains(spark, sf):
    return I.verify_chains(demo.tampered(spark, sf), SIG)


@query("V3 V4", with_views("verdicts", f"SELECT {_VERDICT} FROM verdicts"))
def verify_chains_sliced(spark, sf):
    """The plan a large trail gets: chains cut into slices, here of 500 receipts."""
    return I.verify_chains(demo.tampered(spark, sf), SIG, slice_rows=500)


@query("V5", with_views("checked", "SELECT chain_id, sequence, id, index FROM checked WHERE follows_terminal"))
def after_terminal(spark, sf):
    return I.after_terminal(demo.tampered(spark, sf))


@query("V6", with_views("checked", "SELECT chain_id, sequence, id, chain_status, status_problem AS problem FROM checked WHERE status_problem IS NOT NULL"))
def status_violations(spark, sf):
    return I.status_violations(demo.tampered(spark, sf))


@query(
    "V7",
    with_views(
        "tampered",
        "SELECT t.chain_id, t.sequence, t.id, t.previous_receipt_hash, "
        "CASE WHEN o.lo <> t.chain_id THEN o.lo ELSE o.hi END AS other_chain_id FROM tampered t JOIN "
        "(SELECT receipt_hash, min(chain_id) AS lo, max(chain_id) AS hi FROM tampered GROUP BY 1) o "
        "ON o.receipt_hash = t.previous_receipt_hash WHERE o.lo <> t.chain_id OR o.hi <> t.chain_id",
    ),
)
def cross_chain_splices(spark, sf):
    return I.cross_chain_splices(demo.tampered(spark, sf))


@query(
    "V8",
    with_views(
        "trail",
        "SELECT chain_id, idempotency_key, index, id, occurrences FROM (SELECT *, count(*) OVER (PARTITION BY chain_id, idempotency_key) AS occurrences "
        "FROM (SELECT chain_id, idempotency_key, id, row_number() OVER (PARTITION BY chain_id ORDER BY sequence, id) - 1 AS index FROM trail) p "
        "WHERE idempotency_key <> '') q WHERE occurrences > 1",
    ),
)
def duplicate_operations(spark, sf):
    return I.duplicate_operations(demo.trail(spark, sf))


@query(
    "V9",
    with_views(
        "trail",
        "SELECT chain_id, sequence, id FROM trail QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY sequence DESC, id DESC) = 1 "
        "AND status = 'pending' AND NOT coalesce(terminal, false)",
    ),
)
def incomplete_roundtrips(spark, sf):
    return I.incomplete_roundtrips(demo.trail(spark, sf))


@query(
    "V10",
    with_views(
        "trail",
        "SELECT * FROM (SELECT chain_id, count(*) FILTER (WHERE action_type = 'system.pty.open') AS opens, "
        "count(*) FILTER (WHERE action_type = 'system.pty.close') AS closes FROM trail GROUP BY 1) g WHERE opens <> closes",
    ),
)
def unbalanced_sessions(spark, sf):
    return I.unbalanced_sessions(demo.trail(spark, sf))


_EXPECTED = (
    "SELECT chain_id, n + CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS expected_length, "
    "CASE WHEN user_id % 5 = 0 THEN 'sha256:none' ELSE receipt_hash END AS expected_final_hash, "
    "user_id % 3 = 1 AND user_id % 4 = 0 AS require_terminal FROM sealed WHERE sequence = n "
    "UNION ALL SELECT 'absent-' || chain_id, sequence - 1, '', false FROM sealed WHERE sequence < 3 AND user_id % 10 = 0"
)


@query(
    "V11",
    with_views(
        "verdicts",
        "SELECT chain_id, coalesce(length, 0) AS length, outcome, CASE WHEN outcome = 'ok' THEN -1 WHEN length IS NULL THEN 0 "
        "WHEN outcome = 'already_broken' THEN broken_at ELSE length - 1 END AS broken_at FROM (SELECT e.chain_id, v.length, v.broken_at, "
        "CASE WHEN v.length IS NULL THEN CASE WHEN coalesce(e.expected_length, 0) = 0 THEN 'ok' ELSE 'length_mismatch' END "
        "WHEN NOT v.valid THEN 'already_broken' WHEN e.expected_length <> v.length THEN 'length_mismatch' "
        "WHEN e.expected_final_hash <> '' AND e.expected_final_hash <> v.head_hash THEN 'final_hash_mismatch' "
        "WHEN e.require_terminal AND v.chain_state = 'unknown' THEN 'not_terminal' ELSE 'ok' END AS outcome "
        "FROM expected e LEFT JOIN verdicts v USING (chain_id)) x",
        expected=_EXPECTED,
    ),
)
def verify_against_expected(spark, sf):
    expected = spark.sql(_EXPECTED.replace("FROM sealed", "FROM {sealed}"), sealed=demo.sealed(spark, sf))
    return I.verify_against_expected(I.verify_chains(demo.tampered(spark, sf), SIG), expected)


@query(
    "V12",
    with_views(
        "trail",
        "SELECT chain_id, sequence, id, CASE WHEN event_id % 4 = 1 THEN 'body_absent' WHEN event_id % 10 = 0 THEN 'mismatch' ELSE 'match' END "
        "AS response_check FROM trail WHERE response_hash IS NOT NULL",
    ),
)
def verify_responses(spark, sf):
    trail = demo.trail(spark, sf)
    bodies = trail.filter("event_id % 4 <> 1").selectExpr("id", "'body-' || cast(event_id as string) AS body")
    return I.verify_responses(trail, bodies)


# Checkpoints: every tenth receipt and the last; some beyond a cut head, some altered.
_CHECKPOINTS = (
    "SELECT chain_id, CASE WHEN user_id % 9 = 4 AND sequence = n THEN sequence + 2 ELSE sequence END AS sequence, "
    "CASE WHEN user_id % 9 = 5 AND sequence = n THEN 'sha256:other' ELSE receipt_hash END AS receipt_hash, event_id AS log_no "
    "FROM sealed WHERE user_id % 9 <> 6 AND (sequence % 10 = 0 OR (sequence = n AND user_id % 9 <> 7)) "
    "UNION ALL SELECT 'gone-' || chain_id, sequence, receipt_hash, event_id FROM sealed WHERE sequence = 1 AND user_id % 9 = 8"
)


def checkpoints(spark, sf):
    return spark.sql(_CHECKPOINTS.replace("FROM sealed", "FROM {sealed}"), sealed=demo.sealed(spark, sf))


_WITNESS = (
    "SELECT coalesce(t.chain_id, c.chain_id) AS chain_id, t.sequence AS head_sequence, c.sequence AS witness_sequence, "
    "CASE WHEN c.sequence IS NULL THEN 'no_checkpoint' WHEN t.sequence IS NULL THEN 'no_receipts' WHEN c.sequence > t.sequence THEN 'truncated' "
    "WHEN c.sequence < t.sequence THEN 'store_ahead' WHEN c.receipt_hash <> t.receipt_hash THEN 'hash_mismatch' ELSE 'pass' END AS witness_outcome "
    "FROM (SELECT chain_id, sequence, receipt_hash FROM tampered QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY sequence DESC, id DESC) = 1) t "
    "FULL JOIN (SELECT chain_id, sequence, receipt_hash FROM checkpoints QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY sequence DESC, receipt_hash DESC) = 1) c "
    "USING (chain_id)"
)


@query("V13 F5", with_views("tampered", _WITNESS, checkpoints=_CHECKPOINTS))
def reconcile_witness(spark, sf):
    return W.reconcile_witness(chain_tails(demo.tampered(spark, sf)), checkpoints(spark, sf))


@query(
    "V14",
    with_views(
        "sealed",
        "SELECT chain_id, log_no, sequence, previous_sequence FROM (SELECT *, lag(sequence) OVER (PARTITION BY chain_id ORDER BY log_no) AS previous_sequence FROM log) l "
        "WHERE sequence <= previous_sequence",
        log="SELECT chain_id, sequence, event_id + CASE WHEN event_id % 31 = 0 THEN 100000000 ELSE 0 END AS log_no FROM sealed",
    ),
)
def checkpoint_regressions(spark, sf):
    log = demo.sealed(spark, sf).selectExpr(
        "chain_id", "sequence", "event_id + CASE WHEN event_id % 31 = 0 THEN 100000000 ELSE 0 END AS log_no"
    )
    return W.checkpoint_regressions(log)


@query(
    "V15",
    with_views(
        "sealed",
        "SELECT chain_id, sequence, receipt_hash, CASE WHEN p % 25 = 0 THEN 'cadence' ELSE 'final' END AS reason FROM "
        "(SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY sequence, id) AS p, count(*) OVER (PARTITION BY chain_id) AS m FROM sealed) s "
        "WHERE p % 25 = 0 OR p = m",
    ),
)
def plan_checkpoints(spark, sf):
    return W.plan_checkpoints(demo.sealed(spark, sf), 25)


def _rotations(d):
    key = lambda e: f"'key-' || cast({e} as string)"
    return (
        "SELECT chain_id, sequence, 'key_rotated' AS event_type, 'old' AS signed_with, 'ed25519' AS old_algorithm, "
        "CASE WHEN event_id % 5 = 0 THEN 'rsa' ELSE 'ed25519' END AS new_algorithm, "
        f"CASE WHEN event_id % 4 = 0 THEN {key('lag(event_id, 2) OVER w')} ELSE {key('lag(event_id) OVER w')} END AS named, "
        f"{key('event_id')} AS new_fp, {key('event_id')} AS new_key_fp, event_id % 7 <> 0 AS signature_valid, 'key-' || chain_id AS genesis "
        "FROM {trail} WHERE event_id % 11 = 4 WINDOW w AS (PARTITION BY chain_id ORDER BY sequence)"
    )


_ROTATIONS = (
    "SELECT chain_id, sequence, event_type, signed_with, old_algorithm, new_algorithm, coalesce(named, genesis) AS old_fp, "
    "new_fp, new_key_fp, signature_valid FROM (" + _rotations(SPARK) + ") r"
)


def rotations(spark, sf):
    return spark.sql(_ROTATIONS, trail=demo.trail(spark, sf))


def genesis(spark, sf):
    return demo.trail(spark, sf).select("chain_id").distinct().selectExpr("chain_id", "'key-' || chain_id AS genesis_fp")


_FOLD = (
    "SELECT r.*, row_number() OVER (PARTITION BY chain_id ORDER BY sequence) AS rn FROM (" + _ROTATIONS.replace("{trail}", "trail") + ") r"
)
_PROBLEM = (
    "CASE WHEN r.new_algorithm <> 'ed25519' THEN 'new_algorithm' WHEN r.old_fp <> {active} THEN 'old_fingerprint' END"
)


def _fold_sql() -> str:
    def step(active: str) -> str:
        problem = _PROBLEM.format(active=active)
        return (
            f"{problem} AS rotation_problem, CASE WHEN ({problem}) IS NULL AND r.signature_valid THEN r.new_fp ELSE {active} END AS key_after"
        )

    start = "'key-' || r.chain_id"
    return (
        f"SELECT r.chain_id, r.sequence, r.rn, {step('(' + start + ')')} FROM numbered r WHERE rn = 1 UNION ALL "
        f"SELECT r.chain_id, r.sequence, r.rn, {step('f.key_after')} FROM folded f JOIN numbered r ON r.chain_id = f.chain_id AND r.rn = f.rn + 1"
    )


@query(
    "V16",
    with_views(
        "trail",
        "SELECT t.chain_id, t.sequence, t.id, coalesce(last_value(f.key_after IGNORE NULLS) OVER (PARTITION BY t.chain_id ORDER BY t.sequence "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'key-' || t.chain_id) AS active_key, "
        "CASE WHEN f.sequence IS NOT NULL THEN f.rotation_problem IS NULL END AS rotation_ok, f.rotation_problem "
        "FROM trail t LEFT JOIN folded f USING (chain_id, sequence)",
        numbered=_FOLD,
        folded=_fold_sql(),
    ),
)
def key_epochs(spark, sf):
    return W.key_epochs(demo.trail(spark, sf), rotations(spark, sf), genesis(spark, sf))


_PUBLISHED = (
    "SELECT chain_id, CASE WHEN user_id % 4 = 0 THEN 'key-lost' ELSE coalesce("
    "'key-' || cast(max(event_id) FILTER (WHERE event_id % 11 = 4) as string), 'key-none') END AS published_fp, "
    "user_id % 3 <> 0 AS from_archive FROM {trail} GROUP BY chain_id, user_id"
)


@query(
    "V17",
    with_views(
        "verdicts",
        "SELECT p.chain_id, r.current_fp, p.published_fp, CASE WHEN r.current_fp IS NULL THEN 'no_rotation' WHEN r.current_fp <> p.published_fp THEN 'other_key' "
        "ELSE 'terminates' END AS rotation_outcome FROM published p JOIN verdicts v ON v.chain_id = p.chain_id AND v.valid LEFT JOIN "
        "(SELECT chain_id, arg_max(new_fp, sequence) AS current_fp FROM (" + _ROTATIONS.replace("{trail}", "trail") + ") q GROUP BY 1) r ON r.chain_id = p.chain_id "
        "WHERE p.from_archive",
        published=_PUBLISHED.replace("{trail}", "trail"),
    ),
)
def rotation_terminates(spark, sf):
    published = spark.sql(_PUBLISHED, trail=demo.trail(spark, sf))
    verdicts = I.verify_chains(demo.tampered(spark, sf), SIG)
    return W.rotation_terminates(verdicts, rotations(spark, sf), published)


@query(
    "V18 Q7",
    with_views(
        "checked",
        "SELECT chain_id, sequence, id, check_signature, check_linkage, check_peer, check_emitter, check_version, check_context, "
        "CASE WHEN 'fail' IN (check_signature, check_linkage, check_peer, check_emitter, check_version, check_context) THEN 'failed' "
        "WHEN check_peer = 'n/a' THEN 'no_provenance' ELSE 'confirmed' END AS provenance FROM (SELECT chain_id, sequence, id, "
        "CASE WHEN signature_ok THEN 'pass' ELSE 'fail' END AS check_signature, "
        "CASE WHEN bool_and(hash_link_ok) OVER c THEN 'pass' ELSE 'fail' END AS check_linkage, "
        "CASE WHEN NOT has_peer THEN 'n/a' WHEN coalesce(peer_platform, '') = '' THEN 'fail' WHEN peer_platform NOT IN ('linux', 'darwin') THEN 'n/a' "
        "WHEN peer_uid IS NULL OR peer_gid IS NULL THEN 'fail' ELSE 'pass' END AS check_peer, "
        "CASE WHEN NOT has_peer OR coalesce(exe_path, '') = '' THEN 'n/a' WHEN exe_path = '/usr/bin/agent' THEN 'pass' ELSE 'warn' END AS check_emitter, "
        "CASE WHEN version LIKE '0.%' THEN 'pass' ELSE 'fail' END AS check_version, "
        "CASE WHEN NOT sequence_ok OR NOT coalesce(lead(sequence_ok) OVER o, true) "
        "OR (bool_and(signature_ok AND hash_link_ok AND sequence_ok) OVER c AND bool_or(status_problem IS NOT NULL OR follows_terminal) OVER c) "
        "THEN 'fail' ELSE 'pass' END AS check_context FROM checked "
        "WINDOW c AS (PARTITION BY chain_id), o AS (PARTITION BY chain_id ORDER BY index)) x",
    ),
)
def provenance_verdicts(spark, sf):
    tampered = demo.tampered(spark, sf)
    allow = tampered.filter("exe_path LIKE '/usr/bin/%'").select("exe_path").distinct()
    return W.provenance_verdicts(tampered, allow, SIG)


@query(
    "V19",
    with_views(
        "verdicts",
        "SELECT v.chain_id, v.valid, coalesce(w.witness_outcome, 'no_checkpoint') AS witness_outcome, "
        "CASE WHEN NOT v.valid THEN 'fail' WHEN w.witness_outcome = 'pass' THEN 'full' ELSE 'qualified' END AS trust "
        f"FROM verdicts v LEFT JOIN ({_WITNESS}) w ON w.chain_id = v.chain_id",
        checkpoints=_CHECKPOINTS,
    ),
)
def trust_verdict(spark, sf):
    tampered = demo.tampered(spark, sf)
    witness = W.reconcile_witness(chain_tails(tampered), checkpoints(spark, sf))
    return W.trust_verdict(I.verify_chains(tampered, SIG), witness)


@query(
    "V20",
    with_views(
        "verdicts",
        "SELECT CASE WHEN length IS NULL THEN 'empty' WHEN NOT valid THEN 'broken' WHEN chain_state = 'unknown' THEN 'open' ELSE 'ok' END AS health, "
        "count(*) AS chains, cast(coalesce(sum(length), 0) as bigint) AS receipts, count(*) FILTER (WHERE incomplete_roundtrip) AS incomplete_roundtrips, "
        "count(*) FILTER (WHERE unbalanced_session) AS unbalanced_sessions FROM "
        "(SELECT DISTINCT chain_id FROM checkpoints UNION SELECT chain_id FROM tampered) n LEFT JOIN verdicts v USING (chain_id) GROUP BY 1",
        checkpoints=_CHECKPOINTS,
    ),
)
def health_summary(spark, sf):
    tampered = demo.tampered(spark, sf)
    names = checkpoints(spark, sf).select("chain_id").union(tampered.select("chain_id"))
    return I.health_summary(I.verify_chains(tampered, SIG), names)


@query(
    "V21",
    with_views(
        "checked",
        "SELECT id, CASE WHEN NOT signature_ok THEN 'bad_signature' WHEN NOT hash_link_ok THEN 'bad_hash_link' "
        "WHEN NOT sequence_ok THEN 'bad_sequence' ELSE 'ok' END AS receipt_status FROM checked",
    ),
)
def receipt_status(spark, sf):
    return I.receipt_status(I.check_links(demo.tampered(spark, sf), SIG)).select("id", "receipt_status")


@query(
    "V22",
    with_views(
        "sealed",
        "SELECT chain_id, max(ts) AS last_ts, max(sequence) + 1 AS closing_sequence, arg_max(receipt_hash, sequence) AS closing_previous_hash "
        f"FROM sealed GROUP BY chain_id HAVING NOT bool_or(coalesce(terminal, false)) AND max(ts) <= timestamp '{demo.AS_OF}' - interval 36000 second",
    ),
)
def open_chains(spark, sf):
    return I.open_chains(demo.sealed(spark, sf), demo.AS_OF, 36000)
