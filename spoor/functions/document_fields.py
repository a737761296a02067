"""What a receipt document may hold: its objects, their fields, and what holds of each value.

Paths name objects; ``[]`` behind one names the elements of an array. A field is (kind, rules).
"""

from __future__ import annotations

UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
RECEIPT_URN = f"^urn:receipt:{UUID}$"
HASH = "^sha256:[0-9a-f]{64}$"

_text, _whole, _flag, _object = ("string", {}), ("integer", {}), ("boolean", {}), ("object", {})
_time, _hash, _some = ("string", {"time": True}), ("string", {"pattern": HASH}), ("string", {"min_length": 1})
_count = ("integer", {"minimum": 0})


def _one_of(*values: str) -> tuple[str, dict]:
    return "string", {"one_of": values}


def _like(pattern: str, **more) -> tuple[str, dict]:
    return "string", {"pattern": pattern, **more}


def _list(least: int | None = None, most: int | None = None) -> tuple[str, dict]:
    return "array", {"min_items": least, "max_items": most}


# The fields of a sealed disclosure and of its recipient.
_SEALED = {
    "v": _one_of("1"),
    "alg": _one_of("hpke-x25519-hkdf-sha256-aes-256-gcm"),
    "recipients": _list(1, 1),
    "ct": _like("^([A-Za-z0-9_-]{4})*([A-Za-z0-9_-]{2,3})?$", min_length=24),
}
_RECIPIENT = {"kid": _some, "enc": _like("^[A-Za-z0-9_-]{43}$")}
_SEALED_NEEDS, _RECIPIENT_NEEDS = ("v", "alg", "recipients", "ct"), ("kid", "enc")
_SUBJECT = "credentialSubject"
PARAMETERS = f"{_SUBJECT}.action.parameters_disclosure"
_RESPONSE = f"{_SUBJECT}.outcome.response_disclosure"

# The fields of every object.
OBJECTS = {
    "": {
        "@context": _list(2), "id": _like(RECEIPT_URN), "type": _list(2, 2),
        "version": _one_of("0.1.0", "0.2.0", "0.2.1", "0.3.0", "0.4.0", "0.5.0", "0.6.0"),
        "issuer": _object, "issuanceDate": _time, "credentialSubject": _object, "proof": _object,
    },
    "issuer": {
        "id": _text, "type": _text, "name": _text, "operator": _object, "model": _text, "session_id": _text, "runtime": _object,
    },
    "issuer.operator": {"id": _text, "name": _text},
    "issuer.runtime": {"agent_id": _text, "agent_type": _text},
    _SUBJECT: {
        "principal": _object, "action": _object, "intent": _object, "outcome": _object, "authorization": _object,
        "delegation": _object, "chain": _object, "keyRotation": _object, "correlation_id": _some,
    },
    f"{_SUBJECT}.principal": {"id": _text, "type": _one_of("HumanPrincipal", "OrganizationPrincipal")},
    f"{_SUBJECT}.action": {
        "id": _like(f"^act_{UUID}$"), "type": _text, "risk_level": _one_of("low", "medium", "high", "critical"),
        "target": _object, "parameters_hash": _hash, "parameters_disclosure": _object, "peer_credential": _object,
        "emitter_metadata": _object, "timestamp": _time, "trusted_timestamp": _text, "idempotency_key": _some,
    },
    f"{_SUBJECT}.action.target": {"system": _text, "resource": _text},
    f"{_SUBJECT}.action.peer_credential": {"platform": _text, "pid": _whole, "uid": _count, "gid": _count, "exe_path": _text},
    f"{_SUBJECT}.action.emitter_metadata": {"drop_count": _count},
    PARAMETERS: _SEALED,
    f"{PARAMETERS}.recipients[0]": _RECIPIENT,
    f"{_SUBJECT}.intent": {
        "conversation_hash": _hash, "prompt_preview": _text, "prompt_preview_truncated": _flag, "reasoning_hash": _hash,
    },
    f"{_SUBJECT}.outcome": {
        "status": _one_of("success", "failure", "pending"), "error": _text, "reversible": _flag, "reversal_method": _text,
        "reversal_window_seconds": _count, "reversal_of": _like(RECEIPT_URN), "state_change": _object,
        "response_hash": _hash, "response_disclosure": _object,
    },
    f"{_SUBJECT}.outcome.state_change": {"before_hash": _hash, "after_hash": _hash},
    _RESPONSE: _SEALED,
    f"{_RESPONSE}.recipients[0]": _RECIPIENT,
    f"{_SUBJECT}.authorization": {"scopes": _list(1), "granted_at": _time, "expires_at": _time, "grant_ref": _text},
    f"{_SUBJECT}.delegation": {"parent_chain_id": _text, "parent_receipt_id": _like(RECEIPT_URN), "delegator": _object},
    f"{_SUBJECT}.delegation.delegator": {"id": _text},
    f"{_SUBJECT}.chain": {
        "sequence": ("integer", {"minimum": 1}), "previous_receipt_hash": ("string or null", {"pattern": HASH}),
        "chain_id": _text, "terminal": ("true", {}), "status": _one_of("complete", "interrupted"),
    },
    f"{_SUBJECT}.keyRotation": {
        "event_type": _one_of("key_rotated"), "new_public_key": _like("^u[A-Za-z0-9_-]+$"), "old_key_fingerprint": _hash,
        "new_key_fingerprint": _hash, "old_algorithm": _some, "new_algorithm": _some, "signed_with": _one_of("old"),
    },
    "proof": {
        "type": _one_of("Ed25519Signature2020"), "created": _time, "verificationMethod": _text,
        "proofPurpose": _one_of("assertionMethod"), "proofValue": _like("^u[A-Za-z0-9_-]{86}$"),
    },
}

# The fields an object must have. Objects that may have others too.
NEEDED = {
    "": ("@context", "id", "type", "version", "issuer", "issuanceDate", "credentialSubject", "proof"),
    "issuer": ("id",),
    "issuer.operator": ("id", "name"),
    _SUBJECT: ("principal", "action", "outcome", "chain"),
    f"{_SUBJECT}.principal": ("id",),
    f"{_SUBJECT}.action": ("id", "type", "risk_level", "timestamp"),
    f"{_SUBJECT}.action.peer_credential": ("platform", "pid"),
    PARAMETERS: _SEALED_NEEDS,
    f"{PARAMETERS}.recipients[0]": _RECIPIENT_NEEDS,
    f"{_SUBJECT}.outcome": ("status",),
    f"{_SUBJECT}.outcome.state_change": ("before_hash", "after_hash"),
    _RESPONSE: _SEALED_NEEDS,
    f"{_RESPONSE}.recipients[0]": _RECIPIENT_NEEDS,
    f"{_SUBJECT}.authorization": ("scopes", "granted_at"),
    f"{_SUBJECT}.delegation": ("parent_chain_id", "parent_receipt_id", "delegator"),
    f"{_SUBJECT}.delegation.delegator": ("id",),
    f"{_SUBJECT}.chain": ("sequence", "previous_receipt_hash", "chain_id"),
    f"{_SUBJECT}.keyRotation": tuple(OBJECTS[f"{_SUBJECT}.keyRotation"]),
    "proof": ("type", "created", "verificationMethod", "proofPurpose", "proofValue"),
}
OPEN_OBJECTS = ("issuer.runtime", _SUBJECT)

# Elements of arrays, the first ones by number, all others under ``*``. The host of a
# context and what stands before ``Receipt`` are the publisher's own.
ELEMENTS = {
    "@context": {"0": _one_of("https://www.w3.org/ns/credentials/v2"), "1": _like("^https://[^/]+/context/v[123]$"), "*": _text},
    "type": {"0": _one_of("VerifiableCredential"), "1": _like("^[A-Za-z]*Receipt$"), "*": ("any", {})},
    f"{_SUBJECT}.authorization.scopes": {"*": _text},
}
