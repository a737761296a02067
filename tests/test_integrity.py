"""Chain verdicts: valid and broken chains, and what tampering does to them."""

import datetime

import pytest
from pyspark.sql import functions as F
from chains import SCHEMA, chain, digest, reseal, table

from spoor.operators import integrity as I
from spoor.operators import witness as W
from spoor.operators.query import chain_tails


def modify(rows):
    rows[3]["status"] = "failure"
    return rows


def insert(rows):
    extra = dict(rows[3], id="extra")
    rows.insert(4, extra)
    for i, row in enumerate(rows, start=1):
        row["sequence"] = i
    return rows


def delete(rows):
    del rows[4]
    return rows


def reorder(rows):
    rows[3]["sequence"], rows[4]["sequence"] = rows[4]["sequence"], rows[3]["sequence"]
    return rows


def wrong_previous(rows):
    rows[5]["previous_receipt_hash"] = "sha256:" + "0" * 64
    return rows


def missing_previous(rows):
    rows[5]["previous_receipt_hash"] = None
    return rows


def not_null_at_start(rows):
    rows[0]["previous_receipt_hash"] = "sha256:" + "0" * 64
    return rows


def gap_with_good_links(rows):
    for row in rows[5:]:
        row["sequence"] += 1
    return reseal(rows)


def starts_at_zero(rows):
    for row in rows:
        row["sequence"] -= 1
    return reseal(rows)


def append_after_terminal(rows):
    rows[7]["terminal"] = True
    return reseal(rows)


def bad_signature(rows):
    rows[2]["signature_valid"] = False
    return rows


def status_without_terminal(rows):
    rows[6]["chain_status"] = "complete"
    return reseal(rows)


def unknown_status(rows):
    rows[9].update(chain_status="unknown", terminal=True)
    return reseal(rows)


def terminal_false_with_status(rows):
    rows[9].update(chain_status="complete", terminal=False)
    return reseal(rows)


def signature_outranks_link(rows):
    rows[5].update(previous_receipt_hash=None, signature_valid=False)
    return rows


def terminal_before_later_break(rows):
    rows[4]["terminal"] = True
    reseal(rows)
    rows[8]["previous_receipt_hash"] = None
    return rows


CASES = [
    (modify, 4, "hash_link"),
    (insert, 4, "hash_link"),
    (delete, 4, "hash_link"),
    (reorder, 3, "hash_link"),
    (wrong_previous, 5, "hash_link"),
    (missing_previous, 5, "hash_link"),
    (not_null_at_start, 0, "hash_link"),
    (gap_with_good_links, 5, "sequence"),
    (starts_at_zero, 0, "sequence"),
    (append_after_terminal, 8, "after_terminal"),
    (bad_signature, 2, "signature"),
    (status_without_terminal, 6, "schema"),
    (unknown_status, 9, "schema"),
    (terminal_false_with_status, 9, "schema"),
    (signature_outranks_link, 5, "signature"),
    (terminal_before_later_break, 5, "after_terminal"),
]


@pytest.fixture(scope="module", params=[None, 3], ids=["plain", "sliced"])
def tampered_verdicts(spark, request):
    chains_ = [tamper(chain(tamper.__name__, 10)) for tamper, _, _ in CASES]
    verdicts = I.verify_chains(table(spark, *chains_), "signature_valid", slice_rows=request.param)
    return {r.chain_id: r for r in verdicts.collect()}


@pytest.mark.parametrize("tamper, at, cause", CASES, ids=[c[0].__name__ for c in CASES])
def test_tampering_is_found_at_its_index(tampered_verdicts, tamper, at, cause):
    got = tampered_verdicts[tamper.__name__]
    assert (got.valid, got.broken_at, got.cause) == (False, at, cause)


LAST = [
    ({}, "unknown", False),
    ({"terminal": True}, "complete", False),
    ({"terminal": True, "chain_status": "complete"}, "complete", False),
    ({"terminal": True, "chain_status": "interrupted"}, "interrupted", False),
    ({"status": "pending"}, "unknown", True),
    ({"status": "pending", "terminal": True}, "complete", False),
    ({"terminal": False}, "unknown", False),
]


def test_valid_chains_and_their_state(spark):
    chains_ = [chain(f"{i}-{n}", n, **last) for i, (last, _, _) in enumerate(LAST) for n in (1, 6)]
    for got in I.verify_chains(table(spark, *chains_)).collect():
        i, n = map(int, got.chain_id.split("-"))
        assert (got.valid, got.length, got.broken_at, got.cause) == (True, n, -1, None)
        assert (got.chain_state, got.incomplete_roundtrip) == LAST[i][1:]


def test_truncated_tail_is_missed_by_the_chain_and_caught_by_the_witness(spark):
    whole = chain("c", 10)
    cut = table(spark, whole[:7])
    verdicts = I.verify_chains(cut)
    assert verdicts.first().valid
    schema = "chain_id string, sequence long, receipt_hash string"
    anchored = spark.createDataFrame([("c", 5, whole[4]["receipt_hash"]), ("c", 10, whole[9]["receipt_hash"])], schema)
    witness = W.reconcile_witness(chain_tails(cut), anchored)
    assert witness.first().witness_outcome == "truncated"
    assert W.trust_verdict(verdicts, witness).first().trust == "qualified"
    expected = spark.createDataFrame([("c", 10, "", False)], "chain_id string, expected_length long, expected_final_hash string, require_terminal boolean")
    assert I.verify_against_expected(verdicts, expected).first().outcome == "length_mismatch"


@pytest.mark.parametrize(
    "checkpoint, outcome",
    [
        (("c", 3, None), "pass"),
        (("c", 3, "sha256:x"), "hash_mismatch"),
        (("c", 2, "sha256:x"), "store_ahead"),
        (("c", 4, "sha256:x"), "truncated"),
        (("d", 1, "sha256:x"), "no_receipts"),
    ],
)
def test_witness_outcomes(spark, checkpoint, outcome):
    rows = chain("c", 3)
    row = (checkpoint[0], checkpoint[1], checkpoint[2] or rows[-1]["receipt_hash"])
    cp = spark.createDataFrame([row], "chain_id string, sequence long, receipt_hash string")
    got = {r.chain_id: r.witness_outcome for r in W.reconcile_witness(chain_tails(table(spark, rows)), cp).collect()}
    assert got[checkpoint[0]] == outcome
    if checkpoint[0] != "c":
        assert got["c"] == "no_checkpoint"


def test_splice_from_another_chain(spark):
    a, b = chain("a", 4), chain("b", 4)
    b[2]["previous_receipt_hash"] = a[1]["receipt_hash"]
    got = I.cross_chain_splices(table(spark, a, b)).collect()
    assert [(r.chain_id, r.sequence, r.other_chain_id) for r in got] == [("b", 3, "a")]


def test_copies_of_a_receipt_do_not_multiply_splices(spark):
    a, b = chain("a", 3), chain("b", 3)
    b[2]["previous_receipt_hash"] = a[1]["receipt_hash"]
    copies = [dict(a[1]) for _ in range(50)]
    assert I.cross_chain_splices(table(spark, a, b, copies)).count() == 1


def test_sealing_equals_plain_python(spark):
    rows = chain("a", 25) + chain("b", 3) + chain("c", 11)
    shuffled = table(spark, rows).drop("previous_receipt_hash", "receipt_hash").orderBy("receipt_hash")
    want = {r["id"]: (r["previous_receipt_hash"], r["receipt_hash"]) for r in rows}
    for slice_rows in (1000, 4):
        sealed = I.seal_chains(shuffled, order=("ts", "id"), slice_rows=slice_rows)
        assert {r.id: (r.previous_receipt_hash, r.receipt_hash) for r in sealed.collect()} == want


def test_fields_with_separators_hash_apart():
    row = chain("c", 1)[0]
    assert digest(dict(row, issuer_id="a:1", principal_id="b")) != digest(dict(row, issuer_id="a", principal_id="1:b"))


def test_duplicate_operations_are_reported_with_places(spark):
    rows = chain("c", 6)
    for i, key in enumerate(["k", None, "k", "", "other", "k"]):
        rows[i]["idempotency_key"] = key
    got = sorted((r.idempotency_key, r["index"], r.occurrences) for r in I.duplicate_operations(table(spark, rows)).collect())
    assert got == [("k", 0, 3), ("k", 2, 3), ("k", 5, 3)]


def test_unbalanced_sessions(spark):
    rows = chain("a", 2) + chain("b", 2) + chain("c", 2)
    kinds = ["system.pty.open", "system.pty.close", "system.pty.open", "x", "system.pty.close", "x"]
    for row, kind in zip(rows, kinds):
        row["action_type"] = kind
    got = {r.chain_id: (r.opens, r.closes) for r in I.unbalanced_sessions(table(spark, rows)).collect()}
    assert got == {"b": (1, 0), "c": (0, 1)}


ROTATION = (
    "chain_id string, sequence long, event_type string, signed_with string, old_algorithm string, new_algorithm string, "
    "old_fp string, new_fp string, new_key_fp string, signature_valid boolean"
)


def rotation(sequence, old, new, **changed):
    row = dict(
        chain_id="c", sequence=sequence, event_type="key_rotated", signed_with="old", old_algorithm="ed25519",
        new_algorithm="ed25519", old_fp=old, new_fp=new, new_key_fp=new, signature_valid=True,
    )
    row.update(changed)
    return tuple(row.values())


ROTATED = [
    ([rotation(2, "g", "k1"), rotation(4, "k1", "k2")], ["g", "g", "k1", "k1", "k2", "k2"], [None, None]),
    ([rotation(2, "bad", "k1"), rotation(4, "g", "k2")], ["g", "g", "g", "g", "k2", "k2"], ["old_fingerprint", None]),
    ([rotation(2, "g", "k1", signature_valid=False), rotation(4, "k1", "k2")], ["g"] * 6, [None, "old_fingerprint"]),
    ([rotation(2, "g", "k1", new_algorithm="rsa")], ["g"] * 6, ["new_algorithm"]),
    ([rotation(2, "g", "k1", new_key_fp="other")], ["g"] * 6, ["new_fingerprint"]),
    ([rotation(2, "g", "k1", event_type="x")], ["g"] * 6, ["event_type"]),
    ([rotation(2, "g", "k1", signed_with="new")], ["g"] * 6, ["signed_with"]),
]


@pytest.mark.parametrize("slice_rows", [None, 2])
def test_key_epochs(spark, slice_rows):
    rows = [(f"c{i}", *r[1:]) for i, (given, _, _) in enumerate(ROTATED) for r in given]
    chains_ = [chain(f"c{i}", 6) for i in range(len(ROTATED))]
    genesis = spark.createDataFrame([(f"c{i}", "g") for i in range(len(ROTATED))], "chain_id string, genesis_fp string")
    out = W.key_epochs(table(spark, *chains_), spark.createDataFrame(rows, ROTATION), genesis, slice_rows)
    got = out.orderBy("chain_id", "sequence").collect()
    for i, (_, keys, problems) in enumerate(ROTATED):
        mine = [r for r in got if r.chain_id == f"c{i}"]
        assert [r.active_key for r in mine] == keys
        assert [r.rotation_problem for r in mine if r.rotation_ok is not None] == problems


def test_responses(spark):
    import hashlib

    rows = chain("c", 4)
    for row, body in zip(rows, ["one", "two", "three", None]):
        row["response_hash"] = body and "sha256:" + hashlib.sha256(body.encode()).hexdigest()
    bodies = spark.createDataFrame([("c-1", "one"), ("c-2", "changed")], "id string, body string")
    got = {r.id: r.response_check for r in I.verify_responses(table(spark, rows), bodies).collect()}
    assert got == {"c-1": "match", "c-2": "mismatch", "c-3": "body_absent"}


def test_open_chains_propose_the_closing_row(spark):
    closed, idle = chain("a", 3, terminal=True), chain("b", 3)
    busy = chain("d", 3)
    busy[2]["ts"] = datetime.datetime(2024, 1, 2)
    got = I.open_chains(table(spark, closed, idle, busy), "2024-01-02 00:00:00", 3600).collect()
    assert [(r.chain_id, r.closing_sequence, r.closing_previous_hash) for r in got] == [("b", 4, idle[-1]["receipt_hash"])]


def test_checkpoint_plan_and_regressions(spark):
    plan = W.plan_checkpoints(table(spark, chain("c", 7)), 3, slice_rows=2).orderBy("sequence").collect()
    assert [(r.sequence, r.reason) for r in plan] == [(3, "cadence"), (6, "cadence"), (7, "final")]
    log = spark.createDataFrame([("c", 3, 1), ("c", 6, 2), ("c", 6, 3), ("c", 9, 4), ("c", 7, 5)], "chain_id string, sequence long, log_no long")
    assert sorted(r.log_no for r in W.checkpoint_regressions(log, slice_rows=2).collect()) == [3, 5]


def test_health(spark):
    broken = chain("x", 3)
    broken[1]["previous_receipt_hash"] = None
    names = spark.createDataFrame([(n,) for n in ("ok", "open", "x", "none")], "chain_id string")
    verdicts = I.verify_chains(table(spark, chain("ok", 2, terminal=True), chain("open", 2), broken))
    got = {r.health: (r.chains, r.receipts) for r in I.health_summary(verdicts, names).collect()}
    assert got == {"ok": (1, 2), "open": (1, 2), "broken": (1, 3), "empty": (1, 0)}


def test_schema_of_fixture(spark):
    assert table(spark, chain("c", 1)).schema == spark.createDataFrame([], SCHEMA).schema


@pytest.mark.parametrize("column", ["response_hash", "idempotency_key", "resource", "tool_name"])
def test_a_change_of_any_content_column_breaks_the_chain(spark, column):
    forged = table(spark, chain("a", 4), chain("b", 4)).withColumn(
        column, F.when((F.col("chain_id") == "a") & (F.col("sequence") == 2), F.lit("forged")).otherwise(F.col(column))
    )
    got = {r.chain_id: (r.valid, r.broken_at, r.cause) for r in I.verify_chains(forged).collect()}
    assert got == {"a": (False, 2, "hash_link"), "b": (True, -1, None)}


def test_chains_sealed_with_own_columns(spark):
    columns = ["id", "chain_id", "sequence", "ts", "signature_valid"]
    bare = table(spark, chain("a", 5), chain("b", 3)).drop("previous_receipt_hash", "receipt_hash")
    sealed = I.seal_chains(bare, columns=columns)
    assert all(r.valid for r in I.verify_chains(sealed, columns=columns).collect())
    assert not any(r.valid for r in I.verify_chains(sealed).collect())
    changed = sealed.withColumn("signature_valid", F.col("sequence") == 2)
    assert not any(r.valid for r in I.verify_chains(changed, columns=columns).collect())
