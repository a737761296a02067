"""Every rule of the document's fields, each broken by a document of its own."""

import json

import pytest

from spoor.functions import document_fields as known
from spoor.operators import conformance as C

HASH, URN = "sha256:" + "0a" * 32, "urn:receipt:00000000-0000-4000-8000-000000000001"
AT = "2024-05-01T10:00:00Z"
SEALED = {"v": "1", "alg": "hpke-x25519-hkdf-sha256-aes-256-gcm", "recipients": [{"kid": "k", "enc": "A" * 43}], "ct": "A" * 24}
WHOLE = {
    "@context": ["https://www.w3.org/ns/credentials/v2", "https://example.org/context/v3", "https://example.com/more"],
    "id": URN,
    "type": ["VerifiableCredential", "SampleReceipt"],
    "version": "0.6.0",
    "issuer": {"id": "did:a", "type": "AIAgent", "name": "n", "operator": {"id": "did:o", "name": "o"}, "model": "m",
               "session_id": "s", "runtime": {"agent_id": "a", "agent_type": "t", "free": {"x": 1}}},
    "issuanceDate": AT,
    "credentialSubject": {
        "principal": {"id": "did:p", "type": "HumanPrincipal"},
        "action": {"id": "act_00000000-0000-4000-8000-000000000001", "type": "data.api.read", "risk_level": "low",
                   "target": {"system": "s", "resource": "r"}, "parameters_hash": HASH, "parameters_disclosure": SEALED,
                   "peer_credential": {"platform": "linux", "pid": 1, "uid": 0, "gid": 0, "exe_path": "/x"},
                   "emitter_metadata": {"drop_count": 0}, "timestamp": AT, "trusted_timestamp": "AA==", "idempotency_key": "k"},
        "intent": {"conversation_hash": HASH, "prompt_preview": "p", "prompt_preview_truncated": False, "reasoning_hash": HASH},
        "outcome": {"status": "success", "error": "", "reversible": True, "reversal_method": "m", "reversal_window_seconds": 5.0,
                    "reversal_of": URN, "state_change": {"before_hash": HASH, "after_hash": HASH}, "response_hash": HASH,
                    "response_disclosure": SEALED},
        "authorization": {"scopes": ["a"], "granted_at": AT, "expires_at": "2024-05-01T10:00:00.5+02:00", "grant_ref": "g"},
        "delegation": {"parent_chain_id": "c", "parent_receipt_id": URN, "delegator": {"id": "did:d"}},
        "chain": {"sequence": 2, "previous_receipt_hash": HASH, "chain_id": "c", "terminal": True, "status": "complete"},
        "keyRotation": {"event_type": "key_rotated", "new_public_key": "uA", "old_key_fingerprint": HASH, "new_key_fingerprint": HASH,
                        "old_algorithm": "e", "new_algorithm": "e", "signed_with": "old"},
        "correlation_id": "c", "free": 1,
    },
    "proof": {"type": "Ed25519Signature2020", "created": AT, "verificationMethod": "did:a#1", "proofPurpose": "assertionMethod",
              "proofValue": "u" + "A" * 86},
}


def holder(document, path):
    for part in filter(None, path.replace("[0]", ".0").split(".")):
        document = document[int(part) if part.isdigit() else part]
    return document


def changed(path, change):
    document = json.loads(json.dumps(WHOLE))
    change(holder(document, path))
    return json.dumps(document)


def spoilt():
    """(document, the findings expected of it)"""
    wrong = {"string": 17, "integer": 1.5, "boolean": "true", "true": False, "object": "x", "array": "x", "string or null": 5}
    for parent, fields in known.OBJECTS.items():
        full = lambda f, p=parent: f"{p}.{f}" if p else f
        for field in known.NEEDED.get(parent, ()):
            # Sealed parameters without their list of recipients are a map of texts, which is allowed too.
            texts = full(field) == f"{known.PARAMETERS}.recipients"
            yield changed(parent, lambda o, f=field: o.pop(f)), [] if texts else [(full(field), "required")]
        extra = [] if parent in known.OPEN_OBJECTS else [(full("extra"), "additional")]
        yield changed(parent, lambda o: o.update(extra=1)), extra
        for field, (kind, rules) in fields.items():
            put = lambda v, p=parent, f=field: changed(p, lambda o: o.update({f: v}))
            texts = full(field) == f"{known.PARAMETERS}.recipients"
            yield put(wrong[kind]), [] if texts else [(full(field), "type")]
            if kind != "string or null":
                yield put(None), [(full(field), "type")]
            for rule, value, name in (("pattern", "no such" * 9, "pattern"), ("one_of", "no such", "one_of"), ("min_length", "", "min_length"),
                                      ("time", "yesterday", "date_time"), ("time", "2024-13-01T00:00:00Z", "date_time")):
                if rule in rules and not (rule == "min_length" and "pattern" in rules):
                    yield put(value), [(full(field), name)]
            if "minimum" in rules and field != "sequence":
                yield put(rules["minimum"] - 1), [(full(field), "minimum")]
            if rules.get("min_items") == 1 and field != "recipients":
                yield put([]), [(full(field), "min_items")]
    subject = "credentialSubject"
    chain, action = f"{subject}.chain", f"{subject}.action"
    yield changed("", lambda o: o["type"].append("More")), [("type", "max_items")]
    yield changed("", lambda o: o.update(type=["SampleReceipt", "VerifiableCredential"])), [("type[0]", "one_of"), ("type[1]", "pattern")]
    yield changed("", lambda o: o["@context"].__setitem__(2, 5)), [("@context[*]", "type")]
    yield changed("", lambda o: o["@context"].__setitem__(1, "https://example.org/context/v1")), [("@context", "version_binding")]
    yield changed("", lambda o: o.update(version="0.4.0")), [("@context", "version_binding")]
    yield changed(f"{subject}.authorization", lambda o: o.update(scopes=["a", 1])), [(f"{subject}.authorization.scopes[*]", "type")]
    yield changed(action, lambda o: o.update(parameters_disclosure={"to": "a@b", "n": "1"})), []
    yield changed(action, lambda o: o["parameters_disclosure"].update(recipients=[])), [
        (f"{known.PARAMETERS}.recipients", "min_items"),
    ]
    yield changed(action, lambda o: o["parameters_disclosure"].update(ct="AAAA")), [(f"{known.PARAMETERS}.ct", "min_length")]
    yield changed(action, lambda o: (o.update(type="unknown"), o.pop("target"))), [(f"{action}.target", "required")]
    yield changed(action, lambda o: (o.update(type="unknown"), o["target"].pop("system"))), [(f"{action}.target.system", "required")]
    yield changed(chain, lambda o: o.update(sequence=1)), [(f"{chain}.previous_receipt_hash", "null_at_start")]
    yield changed(chain, lambda o: o.update(sequence=1, previous_receipt_hash=None)), []
    yield changed(chain, lambda o: o.update(previous_receipt_hash=None)), [(f"{chain}.previous_receipt_hash", "hash_behind_start")]
    yield changed(chain, lambda o: o.update(sequence=0)), [(f"{chain}.sequence", "minimum")]
    yield changed(chain, lambda o: o.pop("terminal")), [(f"{chain}.terminal", "required")]
    for text in ("", "{", "[]", "17", "null", None):
        yield text, [("", "json")]
    yield json.dumps(WHOLE), []


def test_every_rule_has_a_document_that_breaks_it(spark):
    cases = list(spoilt())
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "n int, receipt_json string").repartition(8)
    found = [set() for _ in cases]
    for row in C.document_violations(df).collect():
        found[row.n].add((row.path, row.rule))
    for (text, want), got in zip(cases, found):
        assert got == set(want), (text, got, want)
    rules = {r for _, want in cases for _, r in want}
    assert rules == {"json", "required", "additional", "type", "pattern", "one_of", "minimum", "min_length", "date_time", "min_items",
                     "max_items", "version_binding", "null_at_start", "hash_behind_start"}


def test_counts(spark):
    rows = [(changed("", lambda o: o.update(extra=1)),)] * 3 + [("{",), (json.dumps(WHOLE),)]
    got = C.conformance_of_documents(spark.createDataFrame(rows, "receipt_json string"))
    assert sorted(map(tuple, got.collect())) == [("", "json", 1), ("extra", "additional", 3)]


@pytest.mark.parametrize("text", ['{"a": ' + '{"a": ' * 400 + "1" + "}" * 401, json.dumps({**WHOLE, "id": "x" * 1_000_000})])
def test_deep_and_long_documents(spark, text):
    got = C.document_violations(spark.createDataFrame([(text,)], "receipt_json string"))
    assert ("id", "required" if text.startswith('{"a"') else "pattern") in {(r.path, r.rule) for r in got.collect()}


def test_values_and_objects_are_read_once(spark):
    found = C.document_violations(spark.createDataFrame([("{}",)], "receipt_json string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schemaOfVariant(value") == 1
    assert plan.count("$.credentialSubject.action, MapType") == 1


def test_fields_of_empty_objects_are_missing_and_arrays_may_be_empty(spark):
    text = '{"issuer": {}, "proof": [], "type": [], "@context": [1, "x", 2], "credentialSubject": {"principal": null}}'
    found = C.document_violations(spark.createDataFrame([(7, text)], "n long, receipt_json string")).collect()
    got = sorted((r.path, r.rule) for r in found)
    missing = [(p, "required") for p in ("credentialSubject.action", "credentialSubject.chain", "credentialSubject.outcome", "id", "issuanceDate", "issuer.id", "version")]
    wrong = [("@context[*]", "type"), ("@context[0]", "type"), ("@context[1]", "pattern"), ("credentialSubject.principal", "type"), ("proof", "type"), ("type", "min_items")]
    assert got == sorted(missing + wrong) and {r.n for r in found} == {7}
