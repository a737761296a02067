"""Trail tables derived from the driver tables, in Spark and as oracle SQL.

The driver tables hold no receipts. The expressions below turn ``events`` into a trail; both
engines use the same text, and only the placing in order and the sealing are written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions.carry import along, spread
from spoor.functions.exprs import HASH_COLUMNS
from spoor.operators.integrity import seal_chains
from spoor.plans.dialect import DUCK, SPARK, Dialect
from spoor.session import scratch_path

AS_OF = "2024-01-31 00:00:00"


def _text(expr: str) -> str:
    return f"cast({expr} as string)"


def receipt_id(event: str) -> str:
    return f"'urn:receipt:00000000-0000-4000-8000-' || lpad({_text(event)}, 12, '0')"


def parent_user(user: str) -> str:
    return f"cast(floor({user} / 2) as bigint)"


def chain_of(user: str) -> str:
    return (
        f"CASE WHEN {user} % 4 = 3 THEN 'chain-' || {_text(parent_user(user))} || '/agent/' || {_text(user)} "
        f"ELSE 'chain-' || {_text(user)} END"
    )


def _base_columns() -> list[tuple[str, str]]:
    """Columns from event_id, ts, user_id, event_type, value, k, sequence, n, prev_event_id."""
    return [
        ("id", receipt_id("event_id")),
        ("chain_id", chain_of("user_id")),
        ("session_id", f"'sess-' || {_text('cast(floor(user_id / 10) as bigint)')}"),
        ("agent_id", f"'agent-' || {_text('user_id % 8')}"),
        (
            "issuer_id",
            f"CASE WHEN event_id % 997 = 5 THEN 'did:agent:rogue' ELSE 'did:agent:' || {_text('user_id % 8')} END",
        ),
        ("principal_id", f"'did:user:' || {_text('user_id % 2')}"),
        ("channel", "CASE WHEN k % 3 = 0 THEN 'mcp' WHEN k % 3 = 1 THEN 'hook' ELSE 'sdk' END"),
        (
            "tool_name",
            "CASE event_type "
            "WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'get_file_contents' ELSE 'mcp__fs__read_file' END "
            "WHEN 'view' THEN 'mcp__github__list_issues' "
            "WHEN 'purchase' THEN CASE WHEN k % 4 = 0 THEN 'send_auth_token' ELSE 'create_or_update_file' END "
            "WHEN 'signup' THEN CASE WHEN k % 3 = 0 THEN 'run_query' WHEN k % 3 = 1 THEN 'update_config' "
            "ELSE 'mcp__postgres-main__delete_secret' END "
            "ELSE 'delete_file' END",
        ),
        (
            "action_type",
            "CASE WHEN event_id % 211 = 9 THEN 'audit.events_dropped' "
            "WHEN event_id % 17 = 3 THEN 'unknown' "
            "ELSE CASE event_type WHEN 'click' THEN 'filesystem.file.read' WHEN 'view' THEN 'data.api.read' "
            "WHEN 'purchase' THEN 'data.api.write' "
            "WHEN 'signup' THEN CASE WHEN k % 5 = 0 THEN 'system.pty.open' WHEN k % 5 = 1 THEN 'system.pty.close' "
            "ELSE 'system.settings.modify' END "
            "ELSE 'filesystem.file.delete' END END",
        ),
        (
            "status",
            "CASE WHEN event_type = 'error' THEN 'failure' WHEN value < 2 THEN 'pending' ELSE 'success' END",
        ),
        (
            "idempotency_key",
            f"CASE WHEN k % 4 = 0 THEN 'op-' || {_text('user_id')} || '-' || {_text('k')} "
            "WHEN k % 4 = 1 THEN '' ELSE cast(null as string) END",
        ),
        ("correlation_id", f"CASE WHEN k % 2 = 0 THEN 'call-' || {_text('event_id')} ELSE cast(null as string) END"),
        (
            "grant_ref",
            f"CASE WHEN k % 5 = 0 THEN cast(null as string) ELSE 'grant-' || {_text('user_id * 7 + k % 2')} END",
        ),
        (
            "version",
            "CASE WHEN event_id % 50 = 0 THEN '0.4.0' WHEN event_id % 50 = 1 THEN '1.0.0' "
            "WHEN event_id % 50 = 2 THEN '' WHEN event_id % 50 = 3 THEN 'garbage' ELSE '0.6.0' END",
        ),
        (
            "terminal",
            "CASE WHEN user_id % 3 = 0 AND sequence = n THEN true "
            "WHEN user_id % 30 = 6 AND sequence = n - 2 THEN true ELSE cast(null as boolean) END",
        ),
        (
            "chain_status",
            "CASE WHEN event_id % 1499 = 7 THEN 'unknown' WHEN event_id % 1499 = 8 THEN 'complete' "
            "WHEN user_id % 3 = 0 AND sequence = n THEN CASE WHEN user_id % 2 = 0 THEN 'complete' ELSE 'interrupted' END "
            "ELSE cast(null as string) END",
        ),
        ("drop_count", "CASE WHEN event_id % 211 = 9 THEN k + 1 ELSE cast(null as bigint) END"),
        ("target_system", "CASE WHEN k % 10 = 9 THEN cast(null as string) ELSE 'filesystem' END"),
        (
            "resource",
            f"CASE WHEN k % 10 = 9 THEN cast(null as string) ELSE '/repo/file-' || {_text('k % 40')} END",
        ),
        ("before_hash", f"'state-' || {_text('k % 40')} || '-' || {_text('event_id % 3')}"),
        ("after_hash", f"'state-' || {_text('k % 40')} || '-' || {_text('(event_id + 1) % 3')}"),
        ("reversible", "event_id % 2 = 0"),
        ("reversal_window_seconds", "(k + 1) * 3600"),
        (
            "reversal_of",
            f"CASE WHEN event_id % 13 = 5 AND prev_event_id IS NOT NULL THEN {receipt_id('prev_event_id')} "
            f"WHEN event_id % 13 = 6 THEN {receipt_id('event_id + 100000000')} "
            f"WHEN event_id % 13 = 7 THEN {receipt_id('event_id - 7')} ELSE cast(null as string) END",
        ),
        ("has_peer", "k % 7 <> 0"),
        (
            "peer_platform",
            "CASE WHEN k % 7 = 0 THEN cast(null as string) WHEN k % 7 = 1 THEN 'windows' WHEN k = 9 THEN '' "
            "WHEN k % 2 = 0 THEN 'linux' ELSE 'darwin' END",
        ),
        ("peer_uid", "CASE WHEN k % 7 = 0 OR k = 2 THEN cast(null as bigint) ELSE user_id % 5 END"),
        ("peer_gid", "CASE WHEN k % 7 = 0 THEN cast(null as bigint) ELSE 0 END"),
        (
            "exe_path",
            "CASE WHEN k % 7 = 0 OR k % 11 = 4 THEN cast(null as string) WHEN k % 2 = 0 THEN '/usr/bin/agent' "
            "ELSE '/opt/other/agent' END",
        ),
        ("model", "CASE WHEN k % 3 = 0 THEN 'model-large' WHEN k % 3 = 1 THEN 'model-small' ELSE cast(null as string) END"),
        (
            "usage",
            "CASE WHEN k % 3 = 2 THEN cast(null as string) ELSE '{\"input_tokens\": ' "
            f"|| {_text('k * 10')} || ', \"output_tokens\": ' || {_text('k + 1')} || '}}' END",
        ),
    ]


def _late_columns(d: Dialect) -> list[tuple[str, str]]:
    return [
        (
            "risk_level",
            "CASE WHEN event_id % 101 = 0 THEN 'low' "
            "WHEN action_type IN ('filesystem.file.read', 'data.api.read', 'audit.events_dropped') THEN 'low' "
            "WHEN action_type = 'system.pty.open' THEN 'critical' "
            "WHEN action_type IN ('system.pty.close', 'system.settings.modify', 'filesystem.file.delete') THEN 'high' "
            "ELSE 'medium' END",
        ),
        (
            "error",
            f"CASE WHEN status = 'failure' THEN 'failed at ' || {_text('event_id')} ELSE cast(null as string) END",
        ),
        (
            "response_hash",
            f"CASE WHEN k % 6 = 1 THEN 'sha256:' || {d.sha256(f'''CASE WHEN event_id % 10 = 0 THEN 'forged' ELSE 'body-' || {_text('event_id')} END''')} "
            "ELSE cast(null as string) END",
        ),
    ]


EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "k", "sequence", "n", "prev_event_id")


def _select(columns: list[tuple[str, str]]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns]


# ---------------------------------------------------------------------------------------------
# Spark


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").withColumn(
        "k", F.get_json_object("props", "$.k").cast("long")
    ).drop("props")


def build_trail(spark: SparkSession, sf: str, slice_rows: int | None = None) -> DataFrame:
    """The trail as a plan over ``events``; nothing is written."""
    return _widened(_placed(spark, sf, slice_rows))


def _placed(spark: SparkSession, sf: str, slice_rows: int | None = None) -> DataFrame:
    """The events of every user, so of every chain, in order and in the same task."""
    source = events(spark, sf)
    cores = spark.sparkContext.defaultParallelism
    return along(
        source.repartition(cores, "user_id"),
        ("user_id",),
        ("ts", "event_id"),
        position="sequence",
        total="n",
        lag={"prev_event_id": "event_id"},
        slice_rows=slice_rows,
    ).select(*EVENT_COLUMNS)


def _widened(placed: DataFrame) -> DataFrame:
    return placed.selectExpr(*EVENT_COLUMNS, *_select(_base_columns())).selectExpr(
        "*", *_select(_late_columns(SPARK))
    )


def build_sealed(trail: DataFrame, **options) -> DataFrame:
    return seal_chains(trail, **options)


def build_tampered(sealed: DataFrame) -> DataFrame:
    """Deterministic edits on odd users: content, deletion, reorder, forged link, splice.

    Only the receipts that are spliced look up another chain's hash; no other row is shuffled.
    """
    kept = sealed.filter(f"NOT ({EDIT} AND event_id % 97 = 11)")
    spliced = f"coalesce({EDIT} AND {SPLICE}, false)"
    heads = sealed.filter("sequence = 1").selectExpr("user_id + 1 AS user_id", "receipt_hash AS splice_hash")
    looked_up = kept.filter(spliced).join(heads.filter(SPLICED_USER), "user_id", "left")
    others = kept.filter(f"NOT {spliced}").withColumn("splice_hash", F.lit(None).cast("string"))
    return others.unionByName(looked_up).selectExpr(*tampered_columns(SPARK, sealed.columns))


EDIT = "user_id % 2 = 1"
SPLICED_USER = "user_id % 20 = 5"
SPLICE = f"{SPLICED_USER} AND sequence = 3"


def tampered_columns(d: Dialect, columns: list[str]) -> list[str]:
    changed = {
        "status": f"CASE WHEN {EDIT} AND event_id % 61 = 7 THEN CASE WHEN status = 'success' THEN 'failure' "
        "ELSE 'success' END ELSE status END",
        "grant_ref": f"CASE WHEN {EDIT} AND event_id % 67 = 19 THEN 'grant-forged' ELSE grant_ref END",
        "sequence": f"CASE WHEN {EDIT} AND event_id % 89 = 13 THEN sequence + 1 ELSE sequence END",
        "previous_receipt_hash": f"CASE WHEN {EDIT} AND event_id % 83 = 17 THEN 'sha256:' || {d.sha256(chr(39) + 'forged' + chr(39))} "
        f"WHEN {EDIT} AND {SPLICE} THEN splice_hash ELSE previous_receipt_hash END",
    }
    out = [f"{changed[c]} AS {c}" if c in changed else c for c in columns]
    out.append(f"NOT ({EDIT} AND event_id % 61 = 7) AS signature_valid")
    return out


_TABLES: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def _table(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Write a derived table once per session to the shared folder and read it back.

    A chain's rows lie together, in order of their first sequence, so that row-group statistics prune.
    """
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), name)
    if key not in _TABLES:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _TABLES[key] = (path, spark.read.parquet(path))
    return _TABLES[key][1]


def table_path(spark: SparkSession, sf: str, name: str) -> str:
    """Where the derived table lies; builds it when needed."""
    globals()[name](spark, sf)
    return _TABLES[(spark.sparkContext.applicationId, sf.rstrip("/"), name)][0]


def trail(spark: SparkSession, sf: str) -> DataFrame:
    # Sorted while the rows are narrow.
    order = (F.expr(chain_of("user_id")), "sequence")
    return _table(spark, sf, "trail", lambda: _widened(_placed(spark, sf).sortWithinPartitions(*order)))


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    """The trail with each row's document as text."""
    return _table(spark, sf, "receipts", lambda: documents_of(trail(spark, sf)))


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A driver table for costly per-row work; its single file is one split."""
    return spread(spark.read.parquet(f"{sf}/{table}.parquet"))


def sealed(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "sealed", lambda: build_sealed(trail(spark, sf)))


def tampered(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "tampered", lambda: build_tampered(sealed(spark, sf)))


# ---------------------------------------------------------------------------------------------
# Oracle SQL


def _hash_field(expr: str) -> str:
    return f"coalesce(cast(length({expr}) as string) || ':' || ({expr}), '-')"


def duck_content(prefix: str = "") -> str:
    parts = []
    for c in sorted(set(HASH_COLUMNS) & set(_names())):
        expr = DUCK.instant_text(f"{prefix}{c}") if c == "ts" else f"cast({prefix}{c} as string)"
        parts.append(_hash_field(expr))
    return " || ".join(parts)


def duck_hash(content: str, previous: str) -> str:
    return f"'sha256:' || sha256({content} || {_hash_field(previous)})"


def _names() -> list[str]:
    return [*EVENT_COLUMNS, *[n for n, _ in _base_columns()], *[n for n, _ in _late_columns(DUCK)]]


def _views() -> dict[str, str]:
    base = (
        "SELECT event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) AS k, "
        "row_number() OVER w AS sequence, count(*) OVER (PARTITION BY user_id) AS n, lag(event_id) OVER w AS prev_event_id "
        "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
    )
    trail_sql = (
        f"SELECT *, {', '.join(_select(_late_columns(DUCK)))} FROM "
        f"(SELECT {', '.join(EVENT_COLUMNS)}, {', '.join(_select(_base_columns()))} FROM ({base}) b) t"
    )
    columns = [*_names(), "previous_receipt_hash", "receipt_hash"]
    return {
        "trail": trail_sql,
        "trail_text": f"SELECT chain_id, sequence, {duck_content()} AS content FROM trail",
        "links(chain_id, sequence, previous_receipt_hash, receipt_hash)": (
            f"SELECT chain_id, sequence, cast(null as string), {duck_hash('content', 'cast(null as string)')} "
            "FROM trail_text WHERE sequence = 1 UNION ALL "
            f"SELECT t.chain_id, t.sequence, l.receipt_hash, {duck_hash('t.content', 'l.receipt_hash')} "
            "FROM links l JOIN trail_text t ON t.chain_id = l.chain_id AND t.sequence = l.sequence + 1"
        ),
        "sealed": "SELECT t.*, l.previous_receipt_hash, l.receipt_hash FROM trail t JOIN links l USING (chain_id, sequence)",
        "tampered": (
            f"SELECT {', '.join(tampered_columns(DUCK, columns))} FROM (SELECT s.*, h.receipt_hash AS splice_hash "
            "FROM sealed s LEFT JOIN sealed h ON h.sequence = 1 AND h.user_id + 1 = s.user_id) j "
            f"WHERE NOT ({EDIT} AND event_id % 97 = 11)"
        ),
        "checked": (
            "SELECT *, p - 1 AS index, coalesce(signature_valid, true) AS signature_ok, "
            "CASE WHEN p = 1 THEN previous_receipt_hash IS NULL ELSE coalesce(previous_receipt_hash = prev_hash, false) END AS hash_link_ok, "
            "CASE WHEN p = 1 THEN sequence >= 1 ELSE sequence = prev_seq + 1 END AS sequence_ok, "
            "CASE WHEN coalesce(chain_status, '') = '' THEN NULL WHEN chain_status NOT IN ('complete', 'interrupted') THEN 'invalid_status' "
            "WHEN NOT coalesce(terminal, false) THEN 'status_without_terminal' END AS status_problem "
            "FROM (SELECT *, row_number() OVER w AS p, lag(computed_hash) OVER w AS prev_hash, lag(sequence) OVER w AS prev_seq, "
            "coalesce(lag(terminal) OVER w, false) AS follows_terminal FROM "
            f"(SELECT *, {duck_hash(duck_content(), 'previous_receipt_hash')} AS computed_hash FROM tampered) c "
            "WINDOW w AS (PARTITION BY chain_id ORDER BY sequence, id)) x"
        ),
        "verdicts": (
            "SELECT chain_id, low IS NULL AND aft IS NULL AS valid, length, "
            "CASE WHEN NOT closed THEN 'unknown' WHEN last_status = 'interrupted' THEN 'interrupted' ELSE 'complete' END AS chain_state, "
            "coalesce(CASE WHEN aft IS NOT NULL AND (low IS NULL OR aft < low) THEN aft ELSE low END, -1) AS broken_at, "
            "CASE WHEN aft IS NOT NULL AND (low IS NULL OR aft < low) THEN 'after_terminal' WHEN sig = low THEN 'signature' "
            "WHEN lnk = low THEN 'hash_link' WHEN sq = low THEN 'sequence' WHEN sch = low THEN 'schema' END AS cause, "
            "head_sequence, head_hash, NOT closed AND last_outcome = 'pending' AS incomplete_roundtrip, opens <> closes AS unbalanced_session "
            "FROM (SELECT *, least(sig, lnk, sq, sch) AS low, CASE WHEN term < length - 1 THEN term + 1 END AS aft FROM "
            "(SELECT chain_id, count(*) AS length, min(index) FILTER (WHERE NOT signature_ok) AS sig, "
            "min(index) FILTER (WHERE NOT hash_link_ok) AS lnk, min(index) FILTER (WHERE NOT sequence_ok) AS sq, "
            "min(index) FILTER (WHERE status_problem IS NOT NULL) AS sch, min(index) FILTER (WHERE terminal) AS term, "
            "arg_max(coalesce(terminal, false), index) AS closed, arg_max(coalesce(chain_status, ''), index) AS last_status, "
            "arg_max(status, index) AS last_outcome, arg_max(computed_hash, index) AS head_hash, max(sequence) AS head_sequence, "
            "count(*) FILTER (WHERE action_type = 'system.pty.open') AS opens, count(*) FILTER (WHERE action_type = 'system.pty.close') AS closes "
            "FROM checked GROUP BY chain_id) g) h"
        ),
    }


_NEEDS = {
    "trail": [],
    "sealed": ["trail", "trail_text", "links"],
    "tampered": ["trail", "trail_text", "links", "sealed"],
    "checked": ["trail", "trail_text", "links", "sealed", "tampered"],
    "verdicts": ["trail", "trail_text", "links", "sealed", "tampered", "checked"],
}


def with_views(last: str, body: str, **extra: str) -> str:
    """``body`` behind the CTEs up to ``last``, plus ``extra`` ones."""
    views = {name.split("(")[0]: (name, sql) for name, sql in _views().items()}
    parts = [f"{views[n][0]} AS ({views[n][1]})" for n in [*_NEEDS[last], last]]
    parts += [f"{name} AS ({sql})" for name, sql in extra.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


# ---------------------------------------------------------------------------------------------
# Receipt documents of a trail


def documents_of(trail: DataFrame) -> DataFrame:
    """The trail's rows with their receipt document as ``receipt_json``."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    document = F.struct(
        "id",
        "version",
        stamp.alias("issuanceDate"),
        F.struct(
            F.col("issuer_id").alias("id"),
            "session_id",
            "agent_id",
            "model",
            F.struct(F.parse_json("usage").alias("usage")).alias("runtime"),
        ).alias("issuer"),
        F.struct(
            F.struct(F.col("principal_id").alias("id")).alias("principal"),
            F.struct(
                F.col("action_type").alias("type"),
                "tool_name",
                "risk_level",
                stamp.alias("timestamp"),
                F.struct(F.col("target_system").alias("system"), "resource").alias("target"),
                "idempotency_key",
                F.struct("drop_count").alias("emitter_metadata"),
            ).alias("action"),
            F.struct("status", "error", "reversible", "reversal_window_seconds", "reversal_of", "response_hash").alias(
                "outcome"
            ),
            F.struct("grant_ref").alias("authorization"),
            F.struct(
                "chain_id",
                "sequence",
                "terminal",
                F.col("chain_status").alias("status"),
            ).alias("chain"),
            "correlation_id",
        ).alias("credentialSubject"),
        F.struct(F.lit("u-signature").alias("proofValue")).alias("proof"),
        F.lit("kept").alias("futureField"),
    )
    return trail.withColumn("receipt_json", F.to_json(document))
