"""Classification and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.functions.exprs import fixed_table
from spoor.operators import classify as C
from spoor.operators.policy_index import evaluate_by_index
from spoor.plans import demo
from spoor.plans.demo import with_views
from spoor.plans.registry import query
from spoor.sources.receipts import parse_transcripts

_TAXONOMY = ", ".join(f"('{t}', '{r}')" for t, r in fixed.TAXONOMY)
MAPPING = (
    ("get_file_contents", "data.api.read"),
    ("mcp__fs__read_file", "filesystem.file.read"),
    ("create_or_update_file", "data.api.write"),
    ("delete_file", "data.api.delete"),
    ("run_query", "warehouse.query.run"),
    ("delete_file", "filesystem.file.delete"),
)


def mapping(spark):
    rows = [(i, tool, action) for i, (tool, action) in enumerate(MAPPING)]
    return fixed_table(spark, rows, "rule_order long, tool_name string, action_type string")


@query(
    "C1",
    with_views(
        "trail",
        "SELECT t.id, coalesce(x.type, 'unknown') AS classified_type, coalesce(x.risk, 'medium') AS classified_risk FROM trail t "
        "LEFT JOIN (VALUES ('get_file_contents', 'data.api.read'), ('mcp__fs__read_file', 'filesystem.file.read'), ('create_or_update_file', 'data.api.write'), "
        "('delete_file', 'data.api.delete'), ('run_query', 'warehouse.query.run')) m(tool, type) ON m.tool = t.tool_name "
        f"LEFT JOIN (VALUES {_TAXONOMY}) x(type, risk) ON x.type = m.type",
    ),
)
def classify_actions(spark, sf):
    out = C.classify_actions(demo.trail(spark, sf), mapping(spark), C.taxonomy_table(spark))
    return out.select("id", "classified_type", "classified_risk")


@query(
    "C2",
    with_views(
        "trail",
        "SELECT tool_name, count(*) AS entries, CASE WHEN tool_name = '' OR bool_or(action_type = '') THEN 'blank' ELSE 'duplicate' END AS problem FROM pairs "
        "GROUP BY 1 HAVING tool_name = '' OR bool_or(action_type = '') OR count(*) > 1",
        pairs="SELECT DISTINCT CASE WHEN k % 9 = 0 THEN '' ELSE tool_name END AS tool_name, "
        "CASE WHEN tool_name = 'run_query' AND k % 7 = 0 THEN '' ELSE action_type END AS action_type FROM trail WHERE action_type <> 'unknown'",
    ),
)
def validate_mapping(spark, sf):
    pairs = demo.trail(spark, sf).filter("action_type <> 'unknown'").selectExpr(
        "CASE WHEN k % 9 = 0 THEN '' ELSE tool_name END AS tool_name",
        "CASE WHEN tool_name = 'run_query' AND k % 7 = 0 THEN '' ELSE action_type END AS action_type",
    )
    return C.validate_mapping(pairs.distinct())


_PARTS = (
    "'purge_'", "'Remove_'", "'invoke_'", "'trigger_'", "'assign_'", "'set_'", "'show_'", "'describe_'", "'send_'", "'post_auth_'", "'x_'", "'get_'",
)
_ENDS = ("''", "'_remove'", "'_exec'", "'_update'", "'_read'", "'_config'", "'_setting_key'", "'_token'")
_TOOL = (
    "CASE k % 12 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_PARTS)) + " END || event_type || "
    "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_ENDS)) + " END"
)
_OPERATION = (
    "CASE WHEN regexp_matches(lower({0}), '^(delete_|remove_|drop_|destroy_|purge_)') THEN 'delete' "
    "WHEN regexp_matches(lower({0}), '^(run_|exec_|invoke_|call_|trigger_)') THEN 'execute' "
    "WHEN regexp_matches(lower({0}), '^(create_|update_|set_|add_|put_|edit_|modify_|write_|request_|assign_)') THEN 'write' "
    "WHEN regexp_matches(lower({0}), '^(get_|read_|list_|search_|describe_|show_)') THEN 'read' "
    "WHEN regexp_matches(lower({0}), '(_delete|_remove)$') THEN 'delete' WHEN regexp_matches(lower({0}), '(_run|_exec)$') THEN 'execute' "
    "WHEN regexp_matches(lower({0}), '(_create|_update|_write)$') THEN 'write' WHEN regexp_matches(lower({0}), '_read$') THEN 'read' ELSE 'unknown' END"
)


@query("C3", with_views("trail", f"SELECT id, tool, {_OPERATION.format('tool')} AS operation_type FROM (SELECT id, {_TOOL} AS tool FROM trail) t"))
def operation_type(spark, sf):
    return C.operation_type(demo.trail(spark, sf).selectExpr("id", f"{_TOOL} AS tool"), "tool")


# (arguments, is a mutation without WHERE); {k} is the row's number, {bs} one backslash.
_ARGUMENTS = (
    ('{"query": "DROP table t{k}"}', True),
    ('{"batch": [{"n": {k}}, [{"SQL": "update x{bs}nset y = 1"}]]}', True),
    ('{"title": "please update the docs", "n": {k}}', False),
    ('{"query": "delete from t where id = {k}"}', False),
    ('{"statement": "alter table somewhere{k}"}', True),
    ('{"command": "update t set a = 1{bs}nWHERE id = {k}"}', False),
    ('{"note": "the {bs}"query{bs}": {bs}"drop x{k}{bs}""}', False),
    ('{"sql": "truncate {bs}"t{k}{bs}""}', True),
    ('{"query": "select {k}", "deep": {"Statement": "delete from t"}}', True),
    ('{"queries": "drop t{k}"}', False),
    ('{"k": {k}}', False),
)


def _template(text: str) -> str:
    quoted = "'" + text.replace("'", "''") + "'"
    return quoted.replace("{k}", "' || cast(k as string) || '").replace("{bs}", "' || chr(92) || '")


def _cases(values, by: str) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_ARGS = _cases([_template(a) for a, _ in _ARGUMENTS], "event_id")
_MUTATES = _cases([str(m).lower() for _, m in _ARGUMENTS], "event_id")


@query("C5", with_views("trail", f"SELECT id, {_MUTATES} AS sql_mutation FROM trail"))
def sql_mutation_flag(spark, sf):
    calls = demo.trail(spark, sf).selectExpr("id", f"{_ARGS} AS arguments_json")
    return C.sql_mutation_flag(calls).select("id", "sql_mutation")


_WORD = "CASE " + " ".join(f"WHEN contains(lower(tool), '{w}') THEN '{w}'" for w in fixed.SENSITIVE_WORDS) + " END"
_SCORED = (
    "SELECT id, tool, server, op, least(100, CASE op WHEN 'write' THEN 20 WHEN 'delete' THEN 40 WHEN 'execute' THEN 30 WHEN 'read' THEN 0 ELSE 10 END "
    "+ CASE WHEN word IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN mutates THEN 30 ELSE 0 END + CASE WHEN config THEN 20 ELSE 0 END + CASE WHEN message THEN 15 ELSE 0 END) AS risk_score, "
    "concat_ws('; ', CASE op WHEN 'write' THEN 'write operation' WHEN 'delete' THEN 'delete operation' WHEN 'execute' THEN 'execute operation' WHEN 'read' THEN NULL ELSE 'unknown operation type' END, "
    "'touches sensitive data (' || word || ')', CASE WHEN mutates THEN 'SQL mutation without WHERE clause' END, CASE WHEN config THEN 'modifies configuration' END, "
    "CASE WHEN message THEN 'sends external message' END) AS reasons FROM "
    f"(SELECT id, tool, server, {_OPERATION.format('tool')} AS op, {_WORD} AS word, mutates, regexp_matches(lower(tool), 'config|setting') AS config, "
    f"regexp_matches(lower(tool), '^(send_|post_)') AS message FROM (SELECT id, {_TOOL} AS tool, CASE WHEN k % 4 = 0 THEN 'Postgres-' || channel ELSE channel END AS server, {_MUTATES} AS mutates FROM trail) c) s"
)


def calls(spark, sf):
    return demo.trail(spark, sf).selectExpr(
        "id", f"{_TOOL} AS tool_name", f"{_ARGS} AS arguments_json", "CASE WHEN k % 4 = 0 THEN 'Postgres-' || channel ELSE channel END AS server"
    )


@query("C4", with_views("trail", "SELECT id, risk_score, reasons FROM scored", scored=_SCORED))
def score_risk(spark, sf):
    return C.score_risk(calls(spark, sf)).select("id", "risk_score", F.array_join("risk_reasons", "; ").alias("reasons"))


_POLICY = (
    "CASE WHEN regexp_matches(lower(tool), '^delete_[^/]*$') AND op = 'delete' AND risk_score >= 70 THEN 'block_destructive_ops' WHEN risk_score >= 50 THEN 'pause_high_risk' "
    "WHEN regexp_matches(lower(server), '^postgres[^/]*$') AND op IN ('write', 'delete', 'execute') THEN 'flag_sql_mutations' "
    "WHEN regexp_matches(lower(tool), '^[^/]*auth[^/]*$') THEN 'flag_auth_tools' "
    "WHEN regexp_matches(lower(tool), '^[^/]*config[^/]*$') AND op IN ('write', 'delete') THEN 'flag_config_changes' "
    "WHEN regexp_matches(lower(tool), '^send_[^/]*$') THEN 'flag_external_messages' END"
)


_POLICY_ORACLE = with_views(
    "trail",
    "SELECT id, risk_score, policy_rule, CASE split_part(policy_rule, '_', 1) WHEN 'block' THEN 'block' WHEN 'pause' THEN 'pause' WHEN 'flag' THEN 'flag' ELSE 'pass' END AS policy_action "
    f"FROM (SELECT id, risk_score, {_POLICY} AS policy_rule FROM scored) p",
    scored=_SCORED.replace(f"{_TOOL} AS tool", f"CASE WHEN k % 10 = 3 THEN 'delete_auth_key' ELSE {_TOOL} END AS tool"),
)


def scored_calls(spark, sf):
    scored = C.score_risk(
        demo.trail(spark, sf).selectExpr(
            "id",
            f"CASE WHEN k % 10 = 3 THEN 'delete_auth_key' ELSE {_TOOL} END AS tool_name",
            f"{_ARGS} AS arguments_json",
            "CASE WHEN k % 4 = 0 THEN 'Postgres-' || channel ELSE channel END AS server",
        )
    )
    return C.operation_type(scored)


@query("C6", _POLICY_ORACLE)
def evaluate_policy(spark, sf):
    return C.evaluate_policy(scored_calls(spark, sf)).select("id", "risk_score", "policy_rule", "policy_action")


@query("C6", _POLICY_ORACLE)
def evaluate_policy_by_index(spark, sf):
    """The plan that very many rules get."""
    rules = C.rule_table(spark, fixed.DEFAULT_RULES)
    return evaluate_by_index(scored_calls(spark, sf), rules).select("id", "risk_score", "policy_rule", "policy_action")


HYGIENE_RULES = (
    *fixed.DEFAULT_RULES,
    {"name": "typo", "enabled": True, "tool_pattern": "*", "action": "stop"},
    {"name": "open_class", "enabled": True, "tool_pattern": "get_[a", "action": "block"},
    {"name": "off", "enabled": False, "tool_pattern": "*", "action": "block"},
)


_RULES_MADE = (
    "SELECT tool_name, risk_level, cast(min(event_id) as bigint) AS o, count(*) % 3 <> 0 AS enabled, "
    "CASE risk_level WHEN 'low' THEN 'pass' WHEN 'medium' THEN 'flag' WHEN 'high' THEN 'pause' WHEN 'critical' THEN 'block' ELSE 'stop' END AS action "
    "FROM {trail} WHERE tool_name IS NOT NULL AND risk_level IS NOT NULL GROUP BY tool_name, risk_level"
)


@query(
    "C7",
    with_views(
        "trail",
        "SELECT r.name, r.problem, count(p.id) AS hits FROM (VALUES ('block_destructive_ops', NULL), ('pause_high_risk', NULL), ('flag_sql_mutations', NULL), "
        "('flag_auth_tools', NULL), ('flag_config_changes', NULL), ('flag_external_messages', NULL), ('typo', 'unknown_action'), ('open_class', 'malformed_pattern'), "
        f"('off', 'disabled')) r(name, problem) LEFT JOIN (SELECT id, {_POLICY} AS policy_rule FROM scored) p ON p.policy_rule = r.name GROUP BY 1, 2",
        scored=_SCORED,
    ),
)
def rule_hygiene(spark, sf):
    judged = C.evaluate_policy(C.operation_type(C.score_risk(calls(spark, sf))), HYGIENE_RULES)
    return C.rule_hits(C.validate_rules(spark, HYGIENE_RULES), judged).select("name", "problem", "hits")


@query(
    "C7",
    with_views(
        "trail",
        "SELECT grp AS \"group\", count(*) AS n, string_agg(name, ',' ORDER BY o, name) AS names FROM "
        "(SELECT tool_name || '-' || risk_level AS name, o, CASE WHEN NOT enabled THEN 'off' WHEN action NOT IN ('pass', 'flag', 'pause', 'block') THEN 'off' ELSE action END AS grp "
        "FROM rules) r GROUP BY 1",
        rules=_RULES_MADE.format(trail="trail"),
    ),
)
def describe_rules(spark, sf):
    """A rule for every tool and risk that the trail knows, some off and some with an unknown action."""
    made = spark.sql(_RULES_MADE, trail=demo.trail(spark, sf)).selectExpr(
        "o AS rule_order", "tool_name || '-' || risk_level AS name", "'' AS description", "enabled", "tool_name AS tool_pattern",
        "CAST(NULL AS string) AS server_pattern", "CAST(NULL AS array<string>) AS operation_types", "CAST(NULL AS int) AS min_risk_score", "action",
    )
    return C.describe_rules(C.validate_rules(spark, made))


# (arguments, the resource expected of them)
_TARGETS = (
    ('{"URL": "HTTPS://Api.Example.com/V1/{k}/?token=x#f", "table": "t"}', "https://api.example.com/V1/{k}"),
    ('{"endpoint": " /relative/{k}?q=1 "}', "/relative/{k}"),
    ('{"table": "events{k}", "Schema": "analytics"}', "analytics.events{k}"),
    ('{"collection": "c{k}"}', "c{k}"),
    ('{"owner": "o", "repo": "r{k}", "path": "p"}', "o/r{k}"),
    ('{"owner": "o", "repo": 5, "Path": "/p/{k}"}', "/p/{k}"),
    ('{"id": "x", "name": "y{k}"}', None),
    ('{"url": "", "key": "  k{k}  "}', "k{k}"),
    ('{"nested": {"url": "http://a/b"}, "resource_id": "rid{k}"}', "rid{k}"),
    ('{"url": {k}, "bucket": "b"}', "b"),
)
_TARGET_ARGS = _cases([_template(a) for a, _ in _TARGETS], "event_id")
_TARGET_DONE = _cases(["cast(null as string)" if r is None else _template(r) for _, r in _TARGETS], "event_id")
_SERVER = "CASE WHEN k % 9 = 0 THEN '' WHEN k % 9 = 1 THEN repeat('s', 257) ELSE channel END"


@query(
    "C8",
    with_views(
        "trail",
        f"SELECT id, CASE WHEN r IS NOT NULL THEN server END AS target_system, r AS target_resource FROM (SELECT id, {_SERVER} AS server, "
        f"CASE WHEN k % 9 > 1 THEN {_TARGET_DONE} END AS r FROM trail) t",
    ),
)
def extract_target(spark, sf):
    given = demo.trail(spark, sf).selectExpr("id", f"{_SERVER} AS server", f"{_TARGET_ARGS} AS arguments_json")
    return C.extract_target(given).select("id", "target_system", "target_resource")


_URI = "'^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#\\s]+)([^?#\\s]*)(?:[?#].*)?$'"
_ODD = "CASE page_id % 5 WHEN 1 THEN upper(url) WHEN 2 THEN replace(url, '://', '//') WHEN 3 THEN url || '//' ELSE url END"


@query(
    "C9",
    f"SELECT page_id, url, CASE WHEN regexp_matches(url, {_URI}) THEN lower(regexp_extract(url, {_URI}, 1)) || '://' || lower(regexp_extract(url, {_URI}, 2)) "
    f"|| regexp_replace(regexp_extract(url, {_URI}, 3), '/+$', '') ELSE trim(regexp_replace(url, '[?#].*$', '')) END AS canonical_uri "
    f"FROM (SELECT page_id, {_ODD} AS url FROM pages) p",
)
def canonical_uri(spark, sf):
    return C.canonical_uri(spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", f"{_ODD} AS url"), "url")


# (command, action, resource); {k} is the row's number.
_COMMANDS = (
    ("rm -rf /tmp/f{k}", "delete", "/tmp/f{k}"),
    ("rm a{k} b", None, None),
    ("mv a 'my file {k}'", "move", "my file {k}"),
    ("cp -a x{k} y{k}", "create", "y{k}"),
    ("cp only{k}", None, None),
    ("echo hi{k} > out{k}", "create", "out{k}"),
    ('echo "a > b; c" >> log{k}', "create", "log{k}"),
    ("rm f{k} > log", "delete", "f{k}"),
    ("rm f{k} | cat", None, None),
    ('rm "$HOME/{k}"', None, None),
    ("rm *.{k}", None, None),
    ("make 2>err{k}", None, None),
    ("rm -- -f{k}", "delete", "-f{k}"),
    ("a{k} > b > c", None, None),
    ("ls {k}", None, None),
    ("rm 'open{k}", None, None),
    ("mv ~/a{k} ~/b", None, None),
    ("echo x >", None, None),
    ("> new{k}", "create", "new{k}"),
    ("rm '-f' \"q{k}\"", "delete", "q{k}"),
)


def _shell(text: str | None) -> str:
    return "cast(null as string)" if text is None else "'" + text.replace("'", "' || chr(39) || '").replace("{k}", "' || cast(k as string) || '") + "'"


_COMMAND = _cases([_shell(c) for c, _, _ in _COMMANDS], "event_id")


@query(
    "C10",
    with_views(
        "trail",
        f"SELECT id, {_cases([_shell(r) for _, _, r in _COMMANDS], 'event_id')} AS shell_resource, "
        f"'filesystem.file.' || {_cases([_shell(a) for _, a, _ in _COMMANDS], 'event_id')} AS shell_action FROM trail",
    ),
)
def classify_shell(spark, sf):
    return C.classify_shell(demo.trail(spark, sf).selectExpr("id", f"{_COMMAND} AS command")).select("id", "shell_resource", "shell_action")


_DECIDED = (
    "id, channel, CASE k % 3 WHEN 0 THEN 'allowed' WHEN 1 THEN 'denied' ELSE 'pending' END AS decision, "
    "CASE WHEN event_id % 6 = 0 THEN 'boom' WHEN event_id % 6 = 1 THEN '' ELSE cast(null as string) END AS error, "
    "CASE event_id % 5 WHEN 0 THEN '{\"isError\": true}' WHEN 1 THEN '{\"isError\": false}' WHEN 2 THEN '[1]' WHEN 3 THEN 'not json' ELSE cast(null as string) END AS output"
)


@query(
    "C11",
    with_views(
        "trail",
        "SELECT id, CASE WHEN decision = 'allowed' THEN CASE WHEN coalesce(error, '') <> '' OR (channel = 'mcp' AND coalesce(output, '') = '{\"isError\": true}') THEN 'failure' ELSE 'success' END "
        "WHEN decision = 'denied' THEN 'failure' ELSE 'pending' END AS outcome_status FROM d",
        d=f"SELECT {_DECIDED} FROM trail",
    ),
)
def derive_status(spark, sf):
    given = spark.sql(f"SELECT {_DECIDED} FROM {{trail}}".replace('{"isError"', '{{"isError"').replace("true}", "true}}").replace("false}", "false}}"), trail=demo.trail(spark, sf))
    return C.derive_status(given).select("id", "outcome_status")


_FALLBACK = "id, channel, tool_name, CASE WHEN k % 2 = 0 THEN '' ELSE 'github' END AS server, CASE WHEN k % 3 = 0 THEN action_type ELSE '' END AS action_type"


@query(
    "C12",
    with_views(
        "trail",
        "SELECT id, CASE WHEN action_type <> '' THEN action_type WHEN server <> '' THEN channel || '.' || server || '.' || tool_name ELSE channel || '.' || tool_name END AS derived_type FROM f",
        f=f"SELECT {_FALLBACK} FROM trail",
    ),
)
def derive_action_type(spark, sf):
    given = spark.sql(f"SELECT {_FALLBACK} FROM {{trail}}", trail=demo.trail(spark, sf))
    return C.derive_action_type(given).select("id", "derived_type")


_HOOK = {
    "id": "id",
    "hook_event_name": "CASE event_id % 4 WHEN 0 THEN 'PostToolUse' WHEN 1 THEN 'PostToolUseFailure' WHEN 2 THEN 'PreToolUse' ELSE cast(null as string) END",
    "error": "CASE k % 5 WHEN 0 THEN '\" no such file \"' WHEN 1 THEN 'null' WHEN 2 THEN '{\"code\": 7}' WHEN 3 THEN '\"' || repeat('é', 3000) || '\"' ELSE cast(null as string) END",
    "is_interrupt": "k % 2 = 0",
}


@query(
    "C13",
    with_views(
        "trail",
        "SELECT id, CASE WHEN event_id % 4 = 2 THEN 'pending' ELSE 'allowed' END AS decision, CASE WHEN event_id % 4 <> 1 THEN '' "
        "ELSE CASE k % 5 WHEN 0 THEN 'no such file' WHEN 2 THEN '{\"code\": 7}' WHEN 3 THEN repeat('é', 2048) || '…(truncated)' "
        "ELSE CASE WHEN k % 2 = 0 THEN 'tool call interrupted' ELSE 'tool call failed' END END END AS failure_text FROM trail",
    ),
)
def normalize_hook_events(spark, sf):
    given = demo.trail(spark, sf).selectExpr(*[f"{e} AS {n}" for n, e in _HOOK.items()])
    return C.normalize_hook_events(given).select("id", "decision", "failure_text")


@query(
    "C14",
    with_views(
        "trail",
        "SELECT t.id, CASE WHEN coalesce(t.peer_platform, '') NOT IN ('linux', 'darwin') OR t.peer_uid IS NULL THEN 'did:user:unknown' "
        "WHEN s.s_suppkey IS NOT NULL THEN 'did:user:' || s.s_name ELSE 'did:user:' || t.peer_platform || ':' || cast(t.peer_uid as string) END AS resolved_principal "
        "FROM trail t LEFT JOIN supplier s ON s.s_suppkey = t.peer_uid AND s.s_suppkey % 2 = 0",
    ),
)
def resolve_principal(spark, sf):
    users = spark.read.parquet(f"{sf}/supplier.parquet").filter("s_suppkey % 2 = 0").selectExpr("s_suppkey AS uid", "s_name AS name")
    return C.resolve_principal(demo.trail(spark, sf), users).select("id", "resolved_principal")


def transcript_lines(trail):
    """Two lines per correlated call: the turn that made it and a later echo by another model."""
    block = F.struct(F.lit("tool_use").alias("type"), F.col("correlation_id").alias("id"))
    text = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("id"))
    calls_ = trail.filter("correlation_id IS NOT NULL").withColumn("echo", F.explode(F.array(F.lit(0), F.lit(1))))
    entry = F.struct(
        F.when(F.col("event_id") % 5 == 0, "user").otherwise("assistant").alias("type"),
        F.struct(
            F.concat(F.lit("model-"), (F.col("k") + F.col("echo")).cast("string")).alias("model"),
            F.struct((F.col("k") * 2).alias("input_tokens")).alias("usage"),
            F.array(text, block).alias("content"),
        ).alias("message"),
    )
    return calls_.select(
        F.to_json(entry).alias("value"), F.col("session_id").alias("file"), F.lit(0).alias("block"), (F.col("event_id") * 2 + F.col("echo")).alias("row")
    )


@query(
    "S5 C15",
    with_views(
        "trail",
        "SELECT id, CASE WHEN f THEN 'model-' || cast(k as string) END AS turn_model, CASE WHEN f THEN '{\"input_tokens\":' || cast(k * 2 as string) || '}' END AS turn_usage, f AS turn_found "
        "FROM (SELECT id, k, correlation_id IS NOT NULL AND event_id % 5 <> 0 AS f FROM trail) t",
    ),
)
def enrich_usage(spark, sf):
    trail = demo.trail(spark, sf)
    events = trail.selectExpr("id", "session_id AS file", "correlation_id AS tool_use_id")
    return C.enrich_usage(events, parse_transcripts(transcript_lines(trail))).select("id", "turn_model", "turn_usage", "turn_found")


_INTENT = "SELECT cast(conv_id as string) || '-' || cast(turn as string) AS call_id, text AS args, turn AS at FROM {c} WHERE role = 'user'"
_RESULT = (
    "SELECT cast(conv_id as string) || '-' || cast(turn - 1 as string) AS call_id, CASE WHEN turn % 4 = 1 THEN text ELSE cast(null as string) END AS args, "
    "CASE WHEN length(text) % 2 = 0 THEN 'success' ELSE 'failure' END AS status, turn AS at FROM {c} WHERE role = 'assistant'"
)


@query(
    "C16",
    f"WITH i AS ({_INTENT.format(c='conversations')}), r AS ({_RESULT.format(c='conversations')}) "
    "SELECT coalesce(i.call_id, r.call_id) AS call_id, coalesce(r.args, i.args) AS args, r.status, "
    "CASE WHEN r.call_id IS NULL THEN 'unanswered' WHEN i.call_id IS NULL THEN 'unannounced' ELSE 'paired' END AS pairing FROM i FULL JOIN r ON i.call_id = r.call_id",
)
def pair_calls(spark, sf):
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    return C.pair_calls(spark.sql(_INTENT, c=talk), spark.sql(_RESULT, c=talk))


@query("C17", "SELECT doc_id, substr(text, 1, 256) AS preview, length(text) > 256 AS preview_truncated FROM documents")
def truncate_preview(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return C.truncate_preview(docs, "text").select("doc_id", "preview", "preview_truncated")


@query(
    "C17",
    "SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || ' […error truncated]' ELSE text END AS error_text FROM documents",
)
def truncate_error(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text AS error")
    return C.truncate_error(docs, n=300).select("doc_id", "error_text")
