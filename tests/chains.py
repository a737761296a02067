"""Small chains for tests, sealed with the same hash rule as the library, in plain Python."""

from __future__ import annotations

import datetime
import hashlib

from spoor.functions.exprs import HASH_COLUMNS

SCHEMA = (
    "id string, chain_id string, sequence long, ts timestamp_ntz, issuer_id string, principal_id string, "
    "action_type string, tool_name string, risk_level string, status string, resource string, terminal boolean, "
    "chain_status string, previous_receipt_hash string, receipt_hash string, signature_valid boolean, "
    "idempotency_key string, response_hash string"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def _field(value) -> str:
    if value is None:
        return "-"
    if isinstance(value, bool):
        value = str(value).lower()
    if isinstance(value, datetime.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    value = str(value)
    return f"{len(value)}:{value}"


def digest(row: dict) -> str:
    text = "".join(_field(row[c]) for c in sorted(set(HASH_COLUMNS) & set(NAMES))) + _field(row["previous_receipt_hash"])
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def chain(name: str, n: int, **last) -> list[dict]:
    """A valid chain of ``n`` receipts; ``last`` changes the final one before it is sealed."""
    rows, previous = [], None
    for i in range(1, n + 1):
        row = dict.fromkeys(NAMES)
        row.update(
            id=f"{name}-{i}",
            chain_id=name,
            sequence=i,
            ts=datetime.datetime(2024, 1, 1, 0, i),
            issuer_id="did:agent:1",
            principal_id="did:user:1",
            action_type="filesystem.file.read",
            tool_name="read",
            risk_level="low",
            status="success",
            resource="/a",
            previous_receipt_hash=previous,
        )
        if i == n:
            row.update(last)
        previous = row["receipt_hash"] = digest(row)
        rows.append(row)
    return rows


def reseal(rows: list[dict]) -> list[dict]:
    previous = None
    for row in rows:
        row["previous_receipt_hash"] = previous
        previous = row["receipt_hash"] = digest(row)
    return rows


def table(spark, *chains_):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for c in chains_ for r in c], SCHEMA)
