"""Ingest gates, data quality and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.operators import classify as C
from spoor.operators import conformance
from spoor.operators import quality as Q
from spoor.operators import redact as R
from spoor.plans import demo
from spoor.plans.demo import with_views
from spoor.plans.registry import query
from spoor.sources.receipts import parse_receipts


@query(
    "S1 Q1",
    with_views(
        "trail",
        "SELECT event_id, CASE event_id % 11 WHEN 1 THEN 'missing_id' WHEN 2 THEN 'missing_chain_id' WHEN 3 THEN 'missing_action_type' "
        "WHEN 4 THEN 'missing_proof' WHEN 5 THEN 'malformed_json' WHEN 6 THEN 'malformed_json' WHEN 7 THEN 'empty_body' WHEN 8 THEN 'malformed_json' "
        "END AS reject_reason FROM trail",
    ),
)
def gate_structure(spark, sf):
    text = F.col("receipt_json")
    broken = [
        F.regexp_replace(text, r'^\{"id":"[^"]*",', "{"),
        F.regexp_replace(text, r'"chain_id":"[^"]*"', '"chain_id":""'),
        F.regexp_replace(text, r'"action":\{"type":"[^"]*",', '"action":{'),
        F.regexp_replace(text, '"u-signature"', '""'),
        F.substring(text, 1, 40),
        F.concat(text, F.lit(" {}")),
        F.lit(""),
        F.regexp_replace(text, r'"sequence":\d+', '"sequence":"seven"'),
    ]
    edited = text
    for n, edit in enumerate(broken, start=1):
        edited = F.when(F.col("event_id") % 11 == n, edit).otherwise(edited)
    parsed = parse_receipts(demo.receipts(spark, sf).select("event_id", edited.alias("receipt_json")))
    return Q.gate_structure(parsed).select("event_id", "reject_reason")


_REPEATED = "'id-' || cast(event_id % 3001 as string) AS id, event_id AS ingest_seq, chain_id"


@query(
    "Q2",
    with_views(
        "trail",
        f"SELECT * FROM (SELECT {_REPEATED} FROM trail) t QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq) = 1",
    ),
)
def dedupe_ids(spark, sf):
    return Q.dedupe_ids(demo.trail(spark, sf).selectExpr(*_REPEATED.split(", ")))


@query(
    "Q2",
    with_views(
        "trail",
        f"SELECT * FROM (SELECT {_REPEATED} FROM trail) t WHERE id NOT IN (SELECT 'id-' || cast(event_id as string) FROM trail WHERE event_id % 2 = 0) "
        "QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq) = 1",
    ),
)
def merge_new(spark, sf):
    trail = demo.trail(spark, sf)
    existing = trail.filter("event_id % 2 = 0").selectExpr("'id-' || cast(event_id as string) AS id")
    return Q.merge_new(existing, trail.selectExpr(*_REPEATED.split(", ")))


@query(
    "Q3",
    with_views(
        "trail",
        "SELECT CASE WHEN event_id % 8 = 0 THEN id || '-x' ELSE id END AS id, chain_id, sequence, CASE WHEN event_id % 8 = 0 THEN 'fork' ELSE 'retry' END AS conflict, "
        "CASE WHEN event_id % 8 = 0 THEN id END AS holder_id FROM trail WHERE event_id % 4 = 0",
    ),
)
def ingest_conflicts(spark, sf):
    trail = demo.trail(spark, sf)
    incoming = trail.filter("event_id % 4 IN (0, 1)").selectExpr(
        "CASE WHEN event_id % 8 = 0 THEN id || '-x' ELSE id END AS id", "chain_id", "sequence"
    )
    return Q.ingest_conflicts(trail.filter("event_id % 2 = 0"), incoming)


@query(
    "Q3",
    with_views("tampered", "SELECT chain_id, sequence, count(DISTINCT id) AS ids FROM tampered GROUP BY 1, 2 HAVING count(DISTINCT id) > 1"),
)
def forked_slots(spark, sf):
    return Q.forked_slots(demo.tampered(spark, sf))


@query(
    "Q4",
    with_views(
        "trail",
        "SELECT CASE WHEN event_id % 9 = 1 THEN id || '-x' ELSE id END AS id, CASE WHEN event_id % 9 = 2 THEN 'other' ELSE chain_id END AS chain_id, "
        "CASE WHEN event_id % 9 = 3 THEN sequence + 1 ELSE sequence END AS sequence, CASE event_id % 9 WHEN 1 THEN 'id' WHEN 2 THEN 'chain_id' ELSE 'sequence' END AS mismatch "
        "FROM trail WHERE event_id % 9 IN (1, 2, 3)",
    ),
)
def key_parity(spark, sf):
    # Lifted columns changed against the document; a document without an id and one without a
    # sequence pass.
    nine = F.col("event_id") % 9
    given = demo.receipts(spark, sf).select(
        F.when(nine == 1, F.concat("id", F.lit("-x"))).otherwise(F.col("id")).alias("id"),
        F.when(nine == 2, F.lit("other")).otherwise(F.col("chain_id")).alias("chain_id"),
        F.when(nine == 3, F.col("sequence") + 1).otherwise(F.col("sequence")).alias("sequence"),
        F.when(nine == 4, F.regexp_replace("receipt_json", r'^\{"id":"[^"]*",', "{"))
        .when(nine == 5, F.regexp_replace("receipt_json", r'"sequence":\d+,?', ""))
        .otherwise(F.col("receipt_json"))
        .alias("receipt_json"),
    )
    return Q.key_parity(given)


_LONG = "repeat('é', 129)"
_FRAME = {
    "v": "CASE event_id % 40 WHEN 1 THEN '' WHEN 2 THEN '2' ELSE '1' END",
    "session_id": "CASE event_id % 40 WHEN 3 THEN '' ELSE session_id END",
    "ts_emit": "CASE event_id % 40 WHEN 4 THEN '' WHEN 5 THEN 'yesterday' WHEN 6 THEN '2024-01-01 00:00:00Z' WHEN 7 THEN '2024-02-30T00:00:00Z' "
    "ELSE '2024-01-01T00:00:00.5+02:00' END",
    "channel": "CASE event_id % 40 WHEN 8 THEN '' ELSE channel END",
    "tool_name": "CASE event_id % 40 WHEN 9 THEN '' ELSE tool_name END",
    "decision": "CASE event_id % 40 WHEN 10 THEN '' WHEN 11 THEN 'maybe' ELSE 'allowed' END",
    "drop_count": "CASE event_id % 40 WHEN 12 THEN cast(-1 as bigint) ELSE drop_count END",
    "issuer_name": f"CASE event_id % 40 WHEN 13 THEN {_LONG} ELSE '' END",
    "issuer_model": f"CASE event_id % 40 WHEN 14 THEN {_LONG} ELSE cast(null as string) END",
    "operator_id": f"CASE event_id % 40 WHEN 15 THEN {_LONG} ELSE '' END",
    "operator_name": f"CASE event_id % 40 WHEN 16 THEN {_LONG} WHEN 17 THEN 'operator' ELSE '' END",
    "idempotency_key": f"CASE event_id % 40 WHEN 18 THEN {_LONG} ELSE '' END",
    "correlation_id": f"CASE event_id % 40 WHEN 19 THEN {_LONG} ELSE '' END",
    "agent_id": f"CASE event_id % 40 WHEN 20 THEN {_LONG} WHEN 21 THEN 'a/b' ELSE agent_id END",
    "agent_type": f"CASE event_id % 40 WHEN 22 THEN {_LONG} ELSE '' END",
    "model": f"CASE event_id % 40 WHEN 23 THEN {_LONG} ELSE '' END",
    "capture_method": f"CASE event_id % 40 WHEN 24 THEN {_LONG} ELSE '' END",
    "target_system": f"CASE event_id % 40 WHEN 25 THEN {_LONG} WHEN 27 THEN 'filesystem' ELSE '' END",
    "target_resource": "CASE event_id % 40 WHEN 26 THEN repeat('é', 2049) WHEN 28 THEN '/x' ELSE '' END",
}
_FRAMES = "event_id, " + ", ".join(f"{expr} AS {name}" for name, expr in _FRAME.items())


def _frame_oracle() -> str:
    def blank(c):
        return f"coalesce({c}, '') = ''"

    rules = [
        (blank("v"), "missing_v"),
        ("v <> '1'", "unsupported_v"),
        (blank("session_id"), "missing_session_id"),
        (blank("ts_emit"), "missing_ts_emit"),
        (
            r"NOT regexp_matches(ts_emit, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$') OR try_cast(left(ts_emit, 10) as date) IS NULL",
            "bad_ts_emit",
        ),
        (blank("channel"), "missing_channel"),
        (blank("tool_name"), "missing_tool_name"),
        (blank("decision"), "missing_decision"),
        ("decision NOT IN ('allowed', 'denied', 'pending')", "unknown_decision"),
        ("drop_count < 0", "negative_drop_count"),
    ]
    rules += [(f"strlen({c}) > 256", f"{c}_too_long") for c in ("issuer_name", "issuer_model", "operator_id", "operator_name")]
    rules.append((f"NOT ({blank('operator_name')}) AND {blank('operator_id')}", "operator_name_without_id"))
    rules += [(f"strlen({c}) > 256", f"{c}_too_long") for c in ("idempotency_key", "correlation_id", "agent_id")]
    rules.append(("contains(agent_id, '/')", "bad_agent_id"))
    rules += [(f"strlen({c}) > 256", f"{c}_too_long") for c in ("agent_type", "model", "capture_method", "target_system")]
    rules.append(("strlen(target_resource) > 4096", "target_resource_too_long"))
    rules.append((f"({blank('target_system')}) <> ({blank('target_resource')})", "half_target"))
    case = " ".join(f"WHEN {cond} THEN '{name}'" for cond, name in rules)
    return with_views("trail", f"SELECT event_id, CASE {case} END AS frame_problem FROM frames", frames=f"SELECT {_FRAMES} FROM trail")


@query("Q5", _frame_oracle())
def validate_frames(spark, sf):
    frames = demo.trail(spark, sf).selectExpr("event_id", *[f"{e} AS {n}" for n, e in _FRAME.items()])
    return Q.validate_frames(frames).select("event_id", "frame_problem")


_CONTEXT = "CASE WHEN event_id % 23 = 0 THEN 'v2' WHEN version = '0.4.0' THEN 'v1' WHEN version = '0.6.0' THEN 'v3' ELSE 'v9' END AS context"


def _conformance_oracle() -> str:
    uuid = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    versions = ", ".join(f"'{v}'" for v in fixed.VERSION_CONTEXT)
    sha = "^sha256:[0-9a-f]{64}$"
    rules = [(p, "required", f"{c} IS NULL") for p, c in (
        ("id", "id"), ("version", "version"), ("issuer.id", "issuer_id"), ("principal.id", "principal_id"), ("action.type", "action_type"),
        ("action.risk_level", "risk_level"), ("action.timestamp", "ts"), ("outcome.status", "status"), ("chain.chain_id", "chain_id"), ("chain.sequence", "sequence"))]
    rules += [
        ("id", "pattern", f"NOT regexp_matches(id, '^urn:receipt:{uuid}$')"),
        ("version", "enum", f"version NOT IN ({versions})"),
        ("@context", "version_binding", "context <> CASE WHEN version IN ('0.1.0', '0.2.0', '0.2.1', '0.3.0', '0.4.0') THEN 'v1' WHEN version = '0.5.0' THEN 'v2' WHEN version = '0.6.0' THEN 'v3' END"),
        ("action.risk_level", "enum", "risk_level NOT IN ('low', 'medium', 'high', 'critical')"),
        ("outcome.status", "enum", "status NOT IN ('success', 'failure', 'pending')"),
        ("outcome.response_hash", "pattern", f"NOT regexp_matches(response_hash, '{sha}')"),
        ("outcome.reversal_of", "pattern", f"NOT regexp_matches(reversal_of, '^urn:receipt:{uuid}$')"),
        ("outcome.reversal_window_seconds", "minimum", "reversal_window_seconds < 0"),
        ("chain.sequence", "minimum", "sequence < 1"),
        ("chain.previous_receipt_hash", "pattern", f"NOT regexp_matches(previous_receipt_hash, '{sha}')"),
        ("chain.previous_receipt_hash", "null_at_start", "sequence = 1 AND previous_receipt_hash IS NOT NULL"),
        ("chain.terminal", "const", "NOT terminal"),
        ("chain.status", "enum", "chain_status NOT IN ('complete', 'interrupted')"),
        ("correlation_id", "min_length", "length(correlation_id) < 1"),
    ]
    body = " UNION ALL ".join(
        f"SELECT '{p}' AS path, '{r}' AS rule, count(*) FILTER (WHERE {cond}) AS violations, count(*) AS rows FROM given" for p, r, cond in rules
    )
    return with_views("tampered", body, given=f"SELECT *, {_CONTEXT} FROM tampered")


@query("Q6", _conformance_oracle())
def conformance_report(spark, sf):
    return Q.conformance_report(demo.tampered(spark, sf).selectExpr("*", _CONTEXT))


# What the derived documents lack or have beyond the published fields; all of them, or those where this holds.
_IN_SUBJECT = "credentialSubject."
_DOCUMENT_RULES = (
    *((path, "required", "true") for path in ("@context", "type", f"{_IN_SUBJECT}action.id", f"{_IN_SUBJECT}chain.previous_receipt_hash")),
    *((f"proof.{field}", "required", "true") for field in ("type", "created", "verificationMethod", "proofPurpose")),
    *((f"{_IN_SUBJECT}authorization.{field}", "required", "true") for field in ("scopes", "granted_at")),
    ("proof.proofValue", "pattern", "true"),
    ("futureField", "additional", "true"),
    ("issuer.agent_id", "additional", "agent_id IS NOT NULL"),
    (f"{_IN_SUBJECT}action.tool_name", "additional", "tool_name IS NOT NULL"),
    (f"{_IN_SUBJECT}action.idempotency_key", "min_length", "idempotency_key = ''"),
    (f"{_IN_SUBJECT}action.target.system", "required", "action_type = 'unknown' AND target_system IS NULL"),
    (f"{_IN_SUBJECT}chain.status", "one_of", "chain_status NOT IN ('complete', 'interrupted')"),
    (f"{_IN_SUBJECT}chain.terminal", "required", "chain_status IS NOT NULL AND terminal IS NULL"),
    (f"{_IN_SUBJECT}correlation_id", "min_length", "correlation_id = ''"),
    (f"{_IN_SUBJECT}outcome.reversal_window_seconds", "minimum", "reversal_window_seconds < 0"),
    ("version", "required", "version IS NULL"),
    ("version", "one_of", "version NOT IN (" + ", ".join(f"'{v}'" for v in fixed.VERSION_CONTEXT) + ")"),
)


@query(
    "Q6",
    with_views(
        "trail",
        "SELECT path, rule, violations FROM ("
        + " UNION ALL ".join(f"SELECT '{p}' AS path, '{r}' AS rule, count(*) FILTER (WHERE {broken}) AS violations FROM trail" for p, r, broken in _DOCUMENT_RULES)
        + ") c WHERE violations > 0",
    ),
)
def conformance_of_documents(spark, sf):
    return conformance.conformance_of_documents(demo.receipts(spark, sf))


@query(
    "Q7",
    with_views(
        "trail",
        "SELECT version, CASE WHEN version = '' THEN 'missing' WHEN NOT contains(version, '.') THEN 'unparseable' WHEN split_part(version, '.', 1) <> '0' THEN 'unknown' "
        "ELSE 'known' END AS version_state, count(*) AS n FROM trail GROUP BY 1, 2",
    ),
)
def version_check(spark, sf):
    return Q.version_check(demo.trail(spark, sf)).groupBy("version", "version_state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "Q8",
    with_views(
        "tampered",
        "SELECT id, CASE WHEN t.sequence IS NULL THEN 'missing' WHEN d IS NOT NULL THEN 'differs' ELSE 'match' END AS result, d AS column FROM "
        "(SELECT s.id, t.sequence, CASE WHEN t.id IS NULL THEN NULL WHEN s.status <> t.status THEN 'status' WHEN s.sequence <> t.sequence THEN 'sequence' "
        "WHEN s.previous_receipt_hash IS DISTINCT FROM t.previous_receipt_hash THEN 'previous_receipt_hash' END AS d FROM sealed s LEFT JOIN tampered t ON s.id = t.id) t",
    ),
)
def compare_expected(spark, sf):
    return Q.compare_expected(
        demo.sealed(spark, sf), demo.tampered(spark, sf), ["id"], ["status", "sequence", "previous_receipt_hash"]
    )


_REFERENCES = (
    "id AS name, CASE WHEN event_id % 5 = 0 THEN 'COMPUTE_LATER' WHEN event_id % 5 = 1 THEN cast(null as string) "
    "WHEN event_id % 5 = 2 AND prev_event_id IS NOT NULL THEN 'SAME_AS_' || " + demo.receipt_id("prev_event_id") + " ELSE receipt_hash END AS expected"
)


@query(
    "Q8",
    with_views(
        "sealed",
        "SELECT name, expected FROM refs WHERE expected NOT LIKE 'SAME_AS_%' AND expected <> 'COMPUTE_LATER' UNION ALL "
        "SELECT r.name, l.expected FROM refs r JOIN refs l ON l.name = substr(r.expected, 9) AND l.expected NOT LIKE 'SAME_AS_%' AND l.expected <> 'COMPUTE_LATER' "
        "WHERE r.expected LIKE 'SAME_AS_%'",
        refs=f"SELECT {_REFERENCES} FROM sealed",
    ),
)
def resolve_references(spark, sf):
    expected = spark.sql(f"SELECT {_REFERENCES} FROM {{sealed}}", sealed=demo.sealed(spark, sf))
    return Q.resolve_references(expected)


def _names(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    part = spark.read.parquet(f"{sf}/part.parquet")
    installed = lines.selectExpr("'part-' || cast(l_partkey as string) AS name")
    declared = part.filter("p_size < 40").selectExpr("'part-' || cast(p_partkey as string) AS name")
    allowed = part.filter("p_size BETWEEN 38 AND 44").selectExpr("'part-' || cast(p_partkey as string) AS name")
    return installed, declared, allowed


@query(
    "Q9",
    "WITH i AS (SELECT DISTINCT 'part-' || cast(l_partkey as string) AS name FROM lineitem), "
    "d AS (SELECT 'part-' || cast(p_partkey as string) AS name FROM part WHERE p_size < 40), "
    "a AS (SELECT 'part-' || cast(p_partkey as string) AS name FROM part WHERE p_size BETWEEN 38 AND 44) "
    "SELECT name, 'unexplained' AS finding FROM (SELECT * FROM i EXCEPT SELECT * FROM d EXCEPT SELECT * FROM a) u UNION ALL "
    "SELECT name, 'stale_allowance' FROM (SELECT * FROM a EXCEPT SELECT * FROM i EXCEPT SELECT * FROM d) s",
)
def set_compare(spark, sf):
    return Q.set_compare(*_names(spark, sf))


@query(
    "Q10",
    with_views(
        "trail",
        'SELECT action_type AS "set", status AS kind, cast(grouping(action_type, status) as bigint) AS level, count(*) AS n FROM trail GROUP BY ROLLUP (action_type, status)',
    ),
)
def coverage_matrix(spark, sf):
    return Q.coverage_matrix(demo.trail(spark, sf), "action_type", "status")


_TYPES = ", ".join(f"('{t}')" for t, _ in fixed.TAXONOMY)


@query(
    "Q10",
    with_views(
        "trail",
        'SELECT coalesce(h.a, w.type) AS "set", CASE WHEN h.a IS NULL THEN \'not_covered\' ELSE \'not_in_dimension\' END AS finding '
        f"FROM (SELECT DISTINCT action_type AS a FROM trail) h FULL JOIN (VALUES {_TYPES}) w(type) ON h.a = w.type WHERE h.a IS NULL OR w.type IS NULL",
    ),
)
def uncovered(spark, sf):
    return Q.uncovered(demo.trail(spark, sf), "action_type", C.taxonomy_table(spark), "type")


SCAN_RULES = (
    ("hex-token", r'token\s*=\s*"[0-9a-f]{40}"'),
    ("mail-address", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("license-line", r"(?i)\b(licen[cs]e|copyright)\b"),
)


@query(
    "Q11",
    r"WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\n|\r')) AS line, generate_subscripts(string_split_regex(text, '\r\n|\n|\r'), 1) AS line_number FROM documents) "
    + " UNION ALL ".join(f"SELECT doc_id, line_number, '{n}' AS rule FROM l WHERE regexp_matches(line, '{p}')" for n, p in SCAN_RULES),
)
def scan_patterns(spark, sf):
    return Q.scan_patterns(demo.read(spark, sf, "documents"), SCAN_RULES)


_RANKS = "CASE {0} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"
_TAXONOMY = ", ".join(f"('{t}', '{r}')" for t, r in fixed.TAXONOMY)


@query(
    "Q12",
    with_views(
        "trail",
        "SELECT chain_id, sequence, id, action_type, risk_level, default_risk FROM (SELECT t.*, coalesce(x.risk, 'medium') AS default_risk FROM trail t "
        f"LEFT JOIN (VALUES {_TAXONOMY}) x(type, risk) ON x.type = t.action_type) j WHERE {_RANKS.format('risk_level')} < {_RANKS.format('default_risk')}",
    ),
)
def risk_downgrades(spark, sf):
    return Q.risk_downgrades(demo.trail(spark, sf), C.taxonomy_table(spark))


@query(
    "Q13",
    with_views("trail", "SELECT chain_id, count(DISTINCT issuer_id) AS issuers FROM trail GROUP BY 1 HAVING count(DISTINCT issuer_id) > 1"),
)
def mixed_issuer_chains(spark, sf):
    return Q.mixed_issuer_chains(demo.trail(spark, sf))


# ---------------------------------------------------------------------------------------------
# Redaction

EXTRA = (("hex-token", r'token\s*=\s*"[0-9a-f]{40}"'), ("mail-address", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"))
# The documents hold few secrets of the built-in kinds, so some are planted.
_PLANTED = (
    "CASE doc_id % 7 WHEN 1 THEN text || ' ghp_' || repeat('a1', 20) WHEN 2 THEN 'AKIA' || repeat('B2', 8) || ' ' || text "
    "WHEN 3 THEN text || ' see https://h.example.com/p?token=abc123&x=1 Bearer ' || repeat('q', 24) "
    "WHEN 4 THEN text || ' -----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'AAAA' || chr(10) || '-----END RSA PRIVATE KEY-----' "
    "WHEN 5 THEN text || ' eyJhbGci.eyJzdWIi.c2ln and xoxb-12-ab and sk-' || repeat('z', 22) ELSE text END AS text"
)


def _quote(pattern: str) -> str:
    return pattern.replace(chr(39), chr(39) * 2).replace('\\"', '"')


def _duck_redacted(column: str, extra=EXTRA) -> str:
    out = column
    for _, pattern, keeps in fixed.SECRET_PATTERNS:
        kept = "\\1" if keeps else ""
        out = f"regexp_replace({out}, '{_quote(pattern)}', '{kept}[REDACTED]', 'g')"
    for _, pattern in extra:
        out = f"regexp_replace({out}, '{_quote(pattern)}', '[REDACTED]', 'g')"
    return out


def planted(spark, sf):
    return demo.read(spark, sf, "documents").selectExpr("doc_id", _PLANTED)


_GIVEN = f"WITH given AS (SELECT doc_id, {_PLANTED} FROM documents) "


@query("R1 R2", _GIVEN + f"SELECT doc_id, {_duck_redacted('text')} AS text FROM given")
def redact_text(spark, sf):
    return R.redact_text(planted(spark, sf), "text", EXTRA)


_SECRET_JSON = (
    "'{\"doc\": ' || cast(doc_id as string) || ', \"Token\" : \"' || lang || '\", \"n\": 1.50, \"in\": {\"PIN\": ' || cast(n_chars as string) || "
    "', \"tokens\": [\"password\", {\"dsn\":null}]}, \"note\": \"x\"}'"
)
_REDACTED_JSON = (
    "'{\"doc\": ' || cast(doc_id as string) || ', \"Token\" : \"[REDACTED]\", \"n\": 1.50, \"in\": {\"PIN\": \"[REDACTED]\", "
    "\"tokens\": [\"password\", {\"dsn\":\"[REDACTED]\"}]}, \"note\": \"x\"}'"
)
_NESTED_JSON = "'{\"a\": {\"secret\": {\"x\": [1, 2, {\"y\": \"}\"}]}, \"k\": ' || cast(doc_id as string) || '}}'"
_NESTED_DONE = "'{\"a\": {\"secret\": \"[REDACTED]\", \"k\": ' || cast(doc_id as string) || '}}'"
_NOT_JSON = "'password: \"' || lang || '\" {\"password\": 1'"


@query(
    "R3",
    f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {_REDACTED_JSON} WHEN 1 THEN {_NESTED_DONE} ELSE {_NOT_JSON} END AS body FROM documents",
)
def redact_json_keys(spark, sf):
    docs = demo.read(spark, sf, "documents").selectExpr(
        "doc_id", f"CASE doc_id % 3 WHEN 0 THEN {_SECRET_JSON} WHEN 1 THEN {_NESTED_JSON} ELSE {_NOT_JSON} END AS body"
    )
    return R.redact_json_keys(docs, "body")


def _report_oracle() -> str:
    rules = [(n, p) for n, p, _ in fixed.SECRET_PATTERNS] + list(EXTRA)
    # The last pattern has a group; count whole matches.
    return _GIVEN + " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (WHERE len(m) > 0) AS rows, cast(sum(len(m)) as bigint) AS hits FROM "
        f"(SELECT regexp_extract_all(text, '{_quote(p)}', 0) AS m FROM given) x"
        for n, p in rules
    )


@query("R4", _report_oracle())
def redaction_report(spark, sf):
    return R.redaction_report(planted(spark, sf), "text", EXTRA)


@query(
    "R5",
    _GIVEN + f"SELECT doc_id FROM (SELECT doc_id, {_duck_redacted('text')} AS once FROM given) o WHERE {_duck_redacted('once')} <> once",
)
def redaction_stable(spark, sf):
    return R.redaction_stable(planted(spark, sf), "text", "doc_id", EXTRA)
