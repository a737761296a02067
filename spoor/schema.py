"""Schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()

# One receipt document. Unknown fields stay in the verbatim text beside it.
RECEIPT = _struct(
    id=_S,
    version=_S,
    issuanceDate=_S,
    issuer=_struct(id=_S, type=_S, name=_S, model=_S, session_id=_S, agent_id=_S, runtime=_S),
    credentialSubject=_struct(
        principal=_struct(id=_S, type=_S),
        action=_struct(
            id=_S,
            type=_S,
            tool_name=_S,
            risk_level=_S,
            timestamp=_S,
            target=_struct(system=_S, resource=_S),
            idempotency_key=_S,
            emitter_metadata=_struct(drop_count=_L),
            peer_credential=_struct(platform=_S, pid=_L, uid=_L, gid=_L, exe_path=_S),
            before_hash=_S,
            after_hash=_S,
        ),
        outcome=_struct(
            status=_S,
            error=_S,
            reversible=_B,
            reversal_window_seconds=_L,
            reversal_of=_S,
            response_hash=_S,
        ),
        authorization=_struct(scopes=T.ArrayType(_S), grant_ref=_S),
        delegation=_struct(
            parent_chain_id=_S, parent_receipt_id=_S, delegator=_struct(id=_S)
        ),
        chain=_struct(
            chain_id=_S, sequence=_L, previous_receipt_hash=_S, terminal=_B, status=_S
        ),
        correlation_id=_S,
    ),
    proof=_struct(type=_S, proofValue=_S),
)

CHECKPOINT_LINE = _struct(
    anchored_at=_S,
    event_type=_S,
    payload=_struct(chain_id=_S, sequence=_L, receipt_hash=_S, timestamp=_S),
)

TRANSCRIPT_LINE = _struct(
    type=_S,
    message=_struct(model=_S, usage=_S, content=T.ArrayType(_struct(type=_S, id=_S))),
)

# Columns of the trail table that the integrity operators need.
TRAIL_CORE = _struct(
    id=_S,
    chain_id=_S,
    sequence=_L,
    ts=T.TimestampNTZType(),
    issuer_id=_S,
    principal_id=_S,
    action_type=_S,
    tool_name=_S,
    risk_level=_S,
    status=_S,
    resource=_S,
    terminal=_B,
    chain_status=_S,
    previous_receipt_hash=_S,
    receipt_hash=_S,
)
