"""Sources, listings and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.operators import query as Q
from spoor.operators import stats as A
from spoor.plans import demo
from spoor.plans.demo import with_views
from spoor.plans.registry import query
from spoor.sources import receipts as R

_LIFTED = (
    "id, chain_id, sequence, ts, issuer_id, session_id, agent_id, model, principal_id, action_type, tool_name, risk_level, "
    "status, target_system, resource, idempotency_key, drop_count, correlation_id, grant_ref, reversal_of, response_hash, "
    "chain_status, version, terminal, usage"
)


@query(
    "S1 S2",
    with_views("trail", f"SELECT * REPLACE (replace(replace(usage, ': ', ':'), ', ', ',') AS usage) FROM (SELECT {_LIFTED} FROM trail) t"),
)
def lift_columns(spark, sf):
    raw = R.parse_receipts(demo.receipts(spark, sf).select("receipt_json"))
    return R.lift_columns(raw).select(*_LIFTED.split(", "))


_KEYS = "id, chain_id, sequence, ts"


@query(
    "F1",
    with_views(
        "trail",
        f"SELECT {_KEYS} FROM trail WHERE action_type = 'filesystem.file.delete' AND risk_level = 'high' AND status = 'failure' "
        "AND ts >= timestamp '2024-01-05 00:00:00' AND ts <= timestamp '2024-01-25 12:00:00' ORDER BY ts DESC, sequence DESC, event_id DESC LIMIT 200",
    ),
)
def query_receipts(spark, sf):
    trail = demo.trail(spark, sf).withColumnRenamed("event_id", "ingest_seq")
    return Q.query_receipts(
        trail,
        action_type="filesystem.file.delete",
        risk_level="high",
        status="failure",
        after="2024-01-05 00:00:00",
        before="2024-01-25 12:00:00",
        newest_first=True,
        limit=200,
    ).select(*_KEYS.split(", "))


@query("F2", with_views("trail", f"SELECT {_KEYS} FROM trail WHERE id = (SELECT max(id) FROM trail)"))
def get_by_id(spark, sf):
    last = demo.trail(spark, sf).agg(F.max("id")).first()[0]
    return Q.get_by_id(demo.trail(spark, sf), last).select(*_KEYS.split(", "))


@query(
    "F2",
    with_views("trail", "SELECT DISTINCT reversal_of AS id FROM trail WHERE reversal_of IN (SELECT id FROM trail)"),
)
def exists(spark, sf):
    trail = demo.trail(spark, sf)
    wanted = trail.filter("reversal_of IS NOT NULL").select(F.col("reversal_of").alias("id")).distinct()
    return Q.exists(trail, wanted)


@query("F2", with_views("trail", f"SELECT {_KEYS} FROM trail WHERE chain_id = 'chain-1' AND sequence = 7"))
def get_at(spark, sf):
    return Q.get_at(demo.trail(spark, sf), "chain-1", 7).select(*_KEYS.split(", "))


@query("F3", with_views("trail", f"SELECT {_KEYS} FROM trail WHERE chain_id = 'chain-1/agent/3' ORDER BY sequence"))
def get_chain(spark, sf):
    return Q.get_chain(demo.trail(spark, sf), "chain-1/agent/3").select(*_KEYS.split(", "))


@query("F4", with_views("trail", "SELECT DISTINCT chain_id FROM trail ORDER BY 1"))
def distinct_chains(spark, sf):
    return Q.distinct_chains(demo.trail(spark, sf))


@query(
    "F5",
    with_views(
        "sealed",
        "SELECT chain_id, sequence, id, receipt_hash FROM sealed QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY sequence DESC, id DESC) = 1",
    ),
)
def chain_tails(spark, sf):
    return Q.chain_tails(demo.sealed(spark, sf))


@query("F6", with_views("trail", "SELECT arg_max(chain_id, event_id) AS chain_id FROM trail WHERE chain_id NOT LIKE '%/agent/%'"))
def latest_root_chain(spark, sf):
    return Q.latest_root_chain(demo.trail(spark, sf), ("event_id",))


@query(
    "F7",
    with_views(
        "trail",
        "SELECT ts, sequence, id, chain_id, coalesce(nullif(tool_name, ''), action_type) AS label, risk_level, status FROM trail "
        "ORDER BY ts DESC, sequence DESC, id DESC LIMIT 50",
    ),
)
def recent(spark, sf):
    return Q.recent(demo.trail(spark, sf))


@query("F8", with_views("trail", f"SELECT id, chain_id, ts FROM trail WHERE ts >= timestamp '{demo.AS_OF}' - interval 259200 second"))
def since(spark, sf):
    return Q.since(demo.trail(spark, sf), 259200, demo.AS_OF)


@query(
    "F9",
    with_views("trail", "SELECT id, tool_name FROM trail WHERE tool_name IN ('delete_file', 'run_query', 'update_config') AND tool_name <> 'run_query'"),
)
def allow_deny(spark, sf):
    kept = Q.allow_deny(demo.trail(spark, sf), ["delete_file", "run_query", "update_config"], ["run_query"])
    return kept.select("id", "tool_name")


@query(
    "F10",
    with_views(
        "trail",
        "SELECT id FROM trail WHERE " + " OR ".join(f"contains(lower({c}), 'file-7')" for c in ("id", "chain_id", "action_type", "tool_name", "resource", "issuer_id", "principal_id", "error")),
    ),
)
def search(spark, sf):
    return Q.search(demo.trail(spark, sf), "File-7").select("id")


_STATS = (
    "SELECT 'total' AS dimension, cast(null as string) AS label, count(*) AS n FROM {t} UNION ALL "
    "SELECT 'risk_level', risk_level, count(*) FROM {t} GROUP BY 2 UNION ALL "
    "SELECT 'status', status, count(*) FROM {t} GROUP BY 2 UNION ALL "
    "SELECT 'action_type', action_type, count(*) FROM {t} GROUP BY 2"
)


@query("F11", with_views("trail", _STATS.format(t="s"), s="SELECT * FROM trail WHERE session_id = 'sess-3' AND status = 'success'"))
def session_summary(spark, sf):
    return Q.session_summary(demo.trail(spark, sf), session_id="sess-3", status="success")


@query("F12", with_views("trail", "SELECT id, risk_level FROM trail WHERE risk_level IN ('high', 'critical')"))
def select_disclosable(spark, sf):
    return Q.select_disclosable(demo.trail(spark, sf), "high").select("id", "risk_level")


@query("F12", with_views("trail", "SELECT id, action_type FROM trail WHERE action_type IN ('data.api.write', 'unknown')"))
def select_disclosable_list(spark, sf):
    return Q.select_disclosable(demo.trail(spark, sf), "data.api.write, unknown").select("id", "action_type")


@query("A1", with_views("trail", "SELECT count(*) AS receipts, count(DISTINCT chain_id) AS chains FROM trail"))
def trail_totals(spark, sf):
    return A.trail_totals(demo.trail(spark, sf))


@query("A2", with_views("trail", "SELECT action_type AS label, count(*) AS n FROM trail GROUP BY 1 ORDER BY 2 DESC, 1"))
def count_by(spark, sf):
    return A.count_by(demo.trail(spark, sf), "action_type")


@query("A3", with_views("trail", _STATS.format(t="trail")))
def trail_stats(spark, sf):
    return A.trail_stats(demo.trail(spark, sf))


@query(
    "A4",
    with_views("trail", f"SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM trail WHERE ts >= timestamp '{demo.AS_OF}' - interval 604800 second GROUP BY 1"),
)
def activity_timeline(spark, sf):
    return A.activity_timeline(demo.trail(spark, sf), "1 hour", "7d", demo.AS_OF)


@query(
    "A5",
    with_views(
        "trail",
        "SELECT date_trunc('day', ts) AS bucket, count(*) AS n, count(*) FILTER (WHERE status = 'failure') AS failures, "
        "round(count(*) FILTER (WHERE status = 'failure') / count(*), 6) AS error_rate FROM trail GROUP BY 1",
    ),
)
def error_rate_trend(spark, sf):
    return A.error_rate_trend(demo.trail(spark, sf), "1 day")


@query(
    "A6",
    with_views(
        "trail",
        "SELECT action_type, count(*) AS n, count(*) FILTER (WHERE status = 'failure') AS failures, "
        "round(count(*) FILTER (WHERE status = 'failure') / count(*), 6) AS failure_rate FROM trail GROUP BY 1 ORDER BY 4 DESC, 2 DESC, 1 LIMIT 5",
    ),
)
def actions_by_failure(spark, sf):
    return A.actions_by_failure(demo.trail(spark, sf), 5)


@query(
    "A7",
    with_views(
        "trail",
        "SELECT server, tool, count(*) AS n, count(*) FILTER (WHERE status = 'failure') AS failures, cast(grouping(server, tool) as bigint) AS level FROM "
        "(SELECT coalesce(nullif(regexp_extract(tool_name, '^mcp__(.*?)__.+$', 1), ''), channel) AS server, "
        "coalesce(nullif(regexp_extract(tool_name, '^mcp__.*?__(.+)$', 1), ''), tool_name) AS tool, status FROM trail) s "
        "GROUP BY GROUPING SETS ((server, tool), (server))",
    ),
)
def server_breakdown(spark, sf):
    return A.server_breakdown(demo.trail(spark, sf))


_RANK = "CASE risk_level WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"


@query(
    "A8",
    with_views(
        "trail",
        "SELECT session_id, count(DISTINCT agent_id) AS agents, count(DISTINCT chain_id) AS chains, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, "
        f"arg_max(risk_level, {_RANK}) AS max_risk FROM trail GROUP BY 1",
    ),
)
def session_list(spark, sf):
    return A.session_list(demo.trail(spark, sf))


@query(
    "A9",
    with_views(
        "trail",
        "SELECT chain_id, count(*) AS length, min(ts) AS first_ts, max(ts) AS last_ts, CASE WHEN NOT arg_max(coalesce(terminal, false), sequence) THEN 'unknown' "
        "WHEN arg_max(coalesce(chain_status, ''), sequence) = 'interrupted' THEN 'interrupted' ELSE 'complete' END AS chain_state FROM trail GROUP BY 1",
    ),
)
def chain_list(spark, sf):
    return A.chain_list(demo.trail(spark, sf))


@query(
    "A10",
    with_views(
        "trail",
        "SELECT session_id, agent_id, model, count(*) AS calls, cast(sum(cast(json_extract_string(usage, '$.input_tokens') as bigint)) as bigint) AS input_tokens, "
        "cast(sum(cast(json_extract_string(usage, '$.output_tokens') as bigint)) as bigint) AS output_tokens, "
        "cast(grouping(session_id, agent_id, model) as bigint) AS level FROM trail WHERE usage IS NOT NULL GROUP BY ROLLUP (session_id, agent_id, model)",
    ),
)
def usage_rollup(spark, sf):
    return A.usage_rollup(demo.trail(spark, sf))


@query(
    "A11",
    with_views(
        "trail",
        "SELECT session_id, chain_id, count(*) AS gaps, cast(sum(drop_count) as bigint) AS dropped, cast(grouping(session_id, chain_id) as bigint) AS level "
        "FROM trail WHERE action_type = 'audit.events_dropped' GROUP BY ROLLUP (session_id, chain_id)",
    ),
)
def drop_accounting(spark, sf):
    return A.drop_accounting(demo.trail(spark, sf))


_INGEST = (
    "CASE WHEN event_id % 50 = 1 THEN 'error' WHEN event_id % 20 = 3 THEN 'rejected' WHEN event_id % 10 = 7 THEN 'conflict' ELSE 'accepted' END AS outcome"
)


@query(
    "A12",
    with_views(
        "trail",
        "SELECT date_trunc('hour', ts) AS bucket, "
        + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in A.OUTCOMES)
        + f" FROM (SELECT ts, {_INGEST} FROM trail) l GROUP BY 1",
    ),
)
def ingest_rates(spark, sf):
    return A.ingest_rates(demo.trail(spark, sf).selectExpr("ts", _INGEST), "1 hour")


_RULE = "CASE WHEN k % 3 = 0 THEN 'pause_high_risk' WHEN k % 3 = 1 THEN 'rule with = sign' ELSE 'say ' || chr(92) || '\"hi' || chr(92) || '\"' END"
_ACTION = "CASE WHEN k % 2 = 0 THEN 'pause' ELSE 'block' END"
_OUTCOME = "CASE WHEN event_id % 3 = 0 THEN 'approved' ELSE 'denied' END"
_LINE = (
    "'proxy: ' || CASE WHEN event_id % 5 = 4 THEN 'other' ELSE 'policy_event' END || ' tool=\"' || tool_name || '\" rule=\"' || "
    f"{_RULE} || '\" risk=' || cast(k as string) || ' action=\"' || {_ACTION} || '\" approver=\"NONE\" outcome=\"' || {_OUTCOME} || "
    "'\" duration_ms=' || cast(event_id % 977 as string) AS line"
)


@query(
    "A13",
    with_views(
        "trail",
        f"SELECT replace({_RULE}, chr(92), '') AS rule, {_ACTION} AS action, {_OUTCOME} AS outcome, count(*) AS n, max(k) AS max_risk, "
        "cast(sum(event_id % 977) as bigint) AS total_ms, max(event_id % 977) AS max_ms, quantile_disc(event_id % 977, 0.5) AS median_ms "
        "FROM trail WHERE event_id % 5 <> 4 GROUP BY 1, 2, 3",
    ),
)
def policy_outcomes(spark, sf):
    return A.policy_outcomes(demo.trail(spark, sf).selectExpr(_LINE))


@query(
    "A14",
    with_views(
        "trail",
        "SELECT count(*) AS receipts, count(*) FILTER (WHERE action_type = 'unknown') AS unknown, "
        "round(count(*) FILTER (WHERE action_type = 'unknown') / count(*), 6) AS unknown_share FROM trail",
    ),
)
def unknown_share(spark, sf):
    return A.unknown_share(demo.trail(spark, sf))
