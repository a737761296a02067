"""Row rules by literal cases: classification, redaction, gates, queries."""

import pytest
from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.functions.exprs import glob_to_regex, is_one_json
from spoor.operators import classify as C
from spoor.operators import quality as Q
from spoor.operators import query as L
from spoor.operators import redact as R


def column(spark, values, name="x", kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"i long, {name} {kind}").coalesce(1)


def results(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


OPERATIONS = {
    "delete_file": "delete", "REMOVE_x": "delete", "drop_t": "delete", "destroy_": "delete", "purge_a": "delete",
    "run_q": "execute", "exec_": "execute", "invoke_a": "execute", "call_a": "execute", "trigger_a": "execute",
    "create_a": "write", "assign_a": "write", "request_review": "write", "get_a": "read", "show_a": "read",
    "issue_delete": "delete", "job_run": "execute", "issue_write": "write", "pull_request_read": "read",
    "get_run": "read", "create_delete": "write", "fetch": "unknown", "": "unknown", "deleted": "unknown",
}


def test_operation_types(spark):
    df = column(spark, list(OPERATIONS), "tool_name")
    assert results(C.operation_type(df), "operation_type") == list(OPERATIONS.values())


SCORES = [
    ("get_file", None, 0, ""),
    ("create_issue", None, 20, "write operation"),
    ("delete_secret_token", None, 70, "delete operation; touches sensitive data (token)"),
    ("delete_key", '{"sql": "drop table x"}', 100, "delete operation; touches sensitive data (key); SQL mutation without WHERE clause"),
    ("send_message", None, 25, "unknown operation type; sends external message"),
    ("update_config", None, 40, "write operation; modifies configuration"),
    ("update_auth_settings", '{"query": "update a set b"}', 100, "write operation; touches sensitive data (auth); SQL mutation without WHERE clause; modifies configuration"),
    ("run_query", '{"query": "UPDATE a SET b=1 WHERE c"}', 30, "execute operation"),
]


def test_risk_scores(spark):
    df = spark.createDataFrame([(i, t, a) for i, (t, a, _, _) in enumerate(SCORES)], "i long, tool_name string, arguments_json string")
    got = C.score_risk(df)
    assert results(got, "risk_score") == [s for _, _, s, _ in SCORES]
    assert results(got.withColumn("why", F.array_join("risk_reasons", "; ")), "why") == [w for _, _, _, w in SCORES]


MUTATIONS = {
    '{"query": "delete from t"}': True,
    '{"query": "delete from t where x"}': False,
    '{"query": "delete from somewhere "}': True,
    '{"query": "alter t whereabouts"}': True,
    '{"query": "drop t (where)"}': False,
    '{"query": "delete t\\nwhere x"}': False,
    '{"title": "update the docs"}': False,
    '{"a": {"b": [[{"STATEMENT": "truncate t"}]]}}': True,
    '{"query": "dropping"}': False,
    '{"query": 5}': False,
    '{"note": "\\"query\\": \\"drop t\\""}': False,
    '{"query": "say \\"x\\" and update t"}': True,
    "{}": False,
    None: False,
}


def test_sql_mutations(spark):
    df = column(spark, list(MUTATIONS), "arguments_json")
    assert results(C.sql_mutation_flag(df), "sql_mutation") == list(MUTATIONS.values())


GLOBS = [
    ("delete_*", "delete_file", True), ("delete_*", "delete_a/b", False), ("*auth*", "get_auth", True), ("?et", "get", True),
    ("?et", "/et", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[^a-c]x", "dx", True), ("a.c", "abc", False),
    ("a\\*", "a*", True), ("a\\*", "ab", False), ("*", "", True), ("x", "xx", False), ("a+b", "a+b", True),
]


@pytest.mark.parametrize("glob, text, hit", GLOBS)
def test_globs(glob, text, hit):
    import re

    assert bool(re.search(glob_to_regex(glob), text)) == hit


@pytest.mark.parametrize("glob", ["[a", "a\\", "[]", "[z-"])
def test_malformed_globs(glob):
    assert glob_to_regex(glob) is None


def rule(name, action, **more):
    return {"name": name, "enabled": True, "action": action, **more}


@pytest.mark.parametrize(
    "rules, call, action, name",
    [
        ([], ("t", "s", "read", 0), "pass", None),
        ([rule("a", "flag"), rule("b", "flag")], ("t", "s", "read", 0), "flag", "a"),
        ([rule("a", "flag"), rule("b", "block"), rule("c", "pause")], ("t", "s", "read", 0), "block", "b"),
        ([rule("a", "block", min_risk_score=50)], ("t", "s", "read", 49), "pass", None),
        ([rule("a", "block", min_risk_score=50)], ("t", "s", "read", 50), "block", "a"),
        ([rule("a", "block", tool_pattern="DEL*")], ("delete", "s", "read", 0), "block", "a"),
        ([rule("a", "block", server_pattern="pg*")], ("delete", "s", "read", 0), "pass", None),
        ([rule("a", "block", operation_types=["write"])], ("t", "s", "read", 0), "pass", None),
        ([rule("a", "block", tool_pattern="[x")], ("[x", "s", "read", 0), "pass", None),
        ([rule("a", "stop")], ("t", "s", "read", 0), "pass", None),
        ([{**rule("a", "block"), "enabled": False}], ("t", "s", "read", 0), "pass", None),
        ([rule("a", "pass")], ("t", "s", "read", 0), "pass", None),
    ],
)
def test_policy(spark, rules, call, action, name):
    df = spark.sql("SELECT '{}' AS tool_name, '{}' AS server, '{}' AS operation_type, {} AS risk_score".format(*call))
    got = C.evaluate_policy(df, rules).first()
    assert (got.policy_action, got.policy_rule) == (action, name)


def test_policy_rules_from_a_table_and_their_summary(spark):
    rows = [(2, "late", None, True, None, None, None, None, "flag"), (1, "early", "why", True, "d*", None, None, 10, "flag"), (3, "bad", None, True, "[", None, None, None, "block")]
    schema = "rule_order long, name string, description string, enabled boolean, tool_pattern string, server_pattern string, operation_types array<string>, min_risk_score int, action string"
    rules = spark.createDataFrame(rows, schema)
    df = spark.sql("SELECT 'delete' AS tool_name, 's' AS server, 'read' AS operation_type, 10 AS risk_score")
    assert C.evaluate_policy(df, rules).first().policy_reason == "why"
    got = {r.group: (r.n, r.names) for r in C.describe_rules(C.validate_rules(spark, rules)).collect()}
    assert got == {"flag": (2, "early,late"), "off": (1, "bad")}


TARGETS = [
    ("s", '{"url": "https://H.example.com/a/?q=1"}', "https://h.example.com/a"),
    ("s", '{"URI": "//host/path?secret=1"}', "//host/path"),
    ("s", '{"url": "not a url #frag"}', "not a url"),
    ("s", '{"table": "t", "keyspace": "k"}', "k.t"),
    ("s", '{"owner": "o", "repo": ""}', None),
    ("s", '{"bucket": "b", "object": "o"}', "b"),
    ("s", '{"path": 7}', None),
    ("", '{"path": "p"}', None),
    ("s", "{}", None),
    ("s", "not json", None),
    ("s", '{"path": "' + "é" * 2049 + '"}', None),
]


def test_targets(spark):
    df = spark.createDataFrame([(i, s, a) for i, (s, a, _) in enumerate(TARGETS)], "i long, server string, arguments_json string")
    got = C.extract_target(df)
    assert results(got, "target_resource") == [r for _, _, r in TARGETS]
    assert results(got, "target_system") == [s if r else None for s, _, r in TARGETS]


SHELL = {
    "rm f": ("delete", "f"), "rm -r -f d": ("delete", "d"), "rm a b": None, "rm": None, "rm -rf": None, "rm -- -x": ("delete", "-x"),
    "mv a b": ("move", "b"), "mv a b c": ("move", "c"), "mv a": None, "cp a b": ("create", "b"), "cp 'a b' \"c d\"": ("create", "c d"),
    "echo x > f": ("create", "f"), "echo x >> f": ("create", "f"), "echo x>f": ("create", "f"), "echo x 2> f": None, "echo x 2>f": None,
    "echo x >& f": None, "echo x >>> f": None, "echo > a > b": None, "echo x >": None, "rm f > log": ("delete", "f"), "rm a b > log": None,
    "rm f | x": None, "rm f; x": None, "rm f && x": None, "rm $F": None, "rm `x`": None, "rm \"$F\"": None, "rm '$F'": ("delete", "$F"),
    "rm {a,b}": None, "rm *.o": None, "rm '*.o'": None, "rm ~/x": None, "rm a?": None, "rm [a]": None, "rm 'a": None, "cat < f": None,
    "ls": None, "": None, "  rm f  ": ("delete", "f"), "rm\tf": ("delete", "f"), "rm f\nrm g": None, "/bin/rm f": None, "rm ''": None,
    "echo '>' f": None, "echo \"a > b\" > c": ("create", "c"), "r'm' f": ("delete", "f"), "rm -": None,
}


def test_shell_commands(spark):
    got = C.classify_shell(column(spark, list(SHELL), "command")).orderBy("i").collect()
    want = [(f"filesystem.file.{v[0]}", v[1]) if v else (None, None) for v in SHELL.values()]
    assert [(r.shell_action, r.shell_resource) for r in got] == want


def test_classification_takes_the_first_mapping(spark):
    mapping = spark.createDataFrame([(2, "a", "data.api.delete"), (1, "a", "data.api.read"), (3, "b", "no.such.type")], "rule_order long, tool_name string, action_type string")
    got = C.classify_actions(column(spark, ["a", "b", "c"], "tool_name"), mapping, C.taxonomy_table(spark))
    assert results(got, "classified_type") == ["data.api.read", "unknown", "unknown"]
    assert results(got, "classified_risk") == ["low", "medium", "medium"]


def test_previews_count_characters(spark):
    df = column(spark, ["é" * 5, "é" * 4, "", None], "t")
    got = C.truncate_preview(df, "t", 4)
    assert results(got, "preview") == ["é" * 4, "é" * 4, "", None]
    assert results(got, "preview_truncated") == [True, False, False, None]
    assert results(C.truncate_preview(df, "t", 0), "preview_truncated") == [True, True, False, None]
    assert results(C.truncate_error(df, "t", 4), "error_text")[:2] == ["é" * 4 + fixed.ERROR_SUFFIX, "é" * 4]


def test_pairing_keeps_copies_apart(spark):
    intents = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 1)] + [("hot", "h", i) for i in range(50)], "call_id string, args string, at long")
    results_ = spark.createDataFrame([("a", None, "success", 3), ("a", None, "failure", 4), ("x", "9", "success", 1)] + [("hot", None, "success", 100 + i) for i in range(50)], "call_id string, args string, status string, at long")
    got = C.pair_calls(intents, results_).collect()
    assert len(got) == 2 + 1 + 1 + 50
    assert sorted((r.call_id, r.args, r.pairing) for r in got if r.call_id != "hot" and r.args) == [("a", "2", "paired"), ("b", "3", "unanswered"), ("x", "9", "unannounced")]


# --- redaction ---------------------------------------------------------------------------------

SECRETS = [
    ("ghp_" + "a" * 36, "[REDACTED]"),
    ("ghp_" + "a" * 35, None),
    ("github_pat_" + "a" * 82, "[REDACTED]"),
    ("gho_" + "A" * 36, "[REDACTED]"),
    ("ghs_" + "0" * 40, "[REDACTED]"),
    ("ghu_" + "0" * 36, "[REDACTED]"),
    ("v1." + "a" * 40, "[REDACTED]"),
    ("sk-" + "a" * 20, "[REDACTED]"),
    ("AKIA" + "A" * 16, "[REDACTED]"),
    ("x Bearer  " + "t" * 20 + " y", "x [REDACTED] y"),
    ("eyJh.eyJz.", "[REDACTED]"),
    ("xoxp-1-a", "[REDACTED]"),
    ("a -----BEGIN EC PRIVATE KEY-----\nx\n-----END EC PRIVATE KEY----- b", "a [REDACTED] b"),
    ("https://h/p?API_KEY=abc&x=1", "https://h/p?API_KEY=[REDACTED]&x=1"),
    ("https://h/p?token=[REDACTED]", None),
    ("nothing here = 1", None),
]


def test_secret_patterns(spark):
    df = column(spark, [s for s, _ in SECRETS])
    assert results(R.redact_text(df, "x"), "x") == [s if want is None else want for s, want in SECRETS]
    assert R.redaction_stable(df, "x", "i").count() == 0


def test_every_builtin_pattern_contains_its_mark():
    assert set(R._MARKS) == {name for name, _, _ in fixed.SECRET_PATTERNS}
    for name, pattern, _ in fixed.SECRET_PATTERNS:
        plain = pattern.replace("\\", "")
        assert R._MARKS[name] in plain


@pytest.mark.parametrize("extra", [[("", "x")], [("n", " ")], [("n", "(")]])
def test_bad_custom_patterns_are_refused(extra):
    with pytest.raises(Exception):
        R.check_patterns(extra)


JSON_KEYS = {
    '{"password":"x","n":1.50}': '{"password":"[REDACTED]","n":1.50}',
    '{ "a" : [ {"Token" : 12345678901234567890} ] }': '{ "a" : [ {"Token" : "[REDACTED]"} ] }',
    '{"secret":{"a":[1,"}"]},"b":2}': '{"secret":"[REDACTED]","b":2}',
    '{"credentials":[{"pin":1}],"b":null}': '{"credentials":"[REDACTED]","b":null}',
    '{"pass\\u0077ord":"x"}': '{"pass\\u0077ord":"[REDACTED]"}',
    '{"a":"\\"password\\": 1"}': '{"a":"\\"password\\": 1"}',
    '{"tokens":1,"a":"token"}': '{"tokens":1,"a":"token"}',
    '["password","x"]': '["password","x"]',
    '{"password":1} x': '{"password":1} x',
    'password: "x"': 'password: "x"',
    "": "",
}


def test_json_keys(spark):
    got = R.redact_json_keys(column(spark, [*JSON_KEYS, None]), "x")
    assert results(got, "x") == [*JSON_KEYS.values(), None]


def test_is_one_json(spark):
    df = column(spark, ['{"a":1}', '{"a":1} {}', '{"a":1},{}', "{", "", None, "null"])
    assert results(df.withColumn("ok", is_one_json(F.col("x"))), "ok") == [True, False, False, False, False, False, True]


# --- gates and queries -------------------------------------------------------------------------


def test_dedupe_and_conflicts_with_a_hot_id(spark):
    rows = [("hot", i, "c", 1) for i in range(300)] + [("b", 1, "c", 2), ("x", 2, "c", 2)]
    df = spark.createDataFrame(rows, "id string, ingest_seq long, chain_id string, sequence long")
    assert sorted(map(tuple, Q.dedupe_ids(df).collect())) == [("b", 1, "c", 2), ("hot", 0, "c", 1), ("x", 2, "c", 2)]
    stored = df.filter("id = 'hot'")
    assert sorted(r.id for r in Q.merge_new(stored, df).collect()) == ["b", "x"]
    incoming = spark.createDataFrame([("hot", "c", 1), ("new", "c", 1), ("y", "c", 9)], "id string, chain_id string, sequence long")
    got = {r.id: (r.conflict, r.holder_id) for r in Q.ingest_conflicts(stored, incoming).collect()}
    assert got == {"hot": ("retry", None), "new": ("fork", "hot")}


def test_set_compare_and_references(spark):
    def names(*values):
        return spark.createDataFrame([(v,) for v in values], "name string")

    got = Q.set_compare(names("a", "b", "c"), names("a"), names("b", "z"))
    assert sorted(map(tuple, got.collect())) == [("c", "unexplained"), ("z", "stale_allowance")]
    refs = spark.createDataFrame([("a", "h1"), ("b", "SAME_AS_a"), ("c", "SAME_AS_b"), ("d", "COMPUTE_LATER"), ("e", None)], "name string, expected string")
    assert sorted(map(tuple, Q.resolve_references(refs).collect())) == [("a", "h1"), ("b", "h1")]


def test_scan_counts_lines_of_whole_texts(spark):
    text = "clean\r\nbad one\n\nx bad\rbad" + "\nfill" * 5000 + "\nbad last"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = Q.scan_patterns(df, [("bad", r"\bbad\b"), ("start", "^bad")])
    assert sorted((r.line_number, r.rule) for r in got.collect()) == [(2, "bad"), (2, "start"), (4, "bad"), (5, "bad"), (5, "start"), (5006, "bad"), (5006, "start")]


@pytest.fixture(scope="module")
def small_trail(spark):
    rows = [
        ("a", "c1", 1, "2024-01-01 00:00:00", 1), ("b", "c1", 2, "2024-01-01 00:00:00", 2), ("c", "c2", 2, "2024-01-01 00:00:00", 3),
        ("d", "c2", 3, "2024-01-02 00:00:00", 4), ("e", "r/agent/1", 1, "2024-01-03 00:00:00", 5),
    ]
    df = spark.createDataFrame(rows, "id string, chain_id string, sequence long, t string, ingest_seq long")
    return df.withColumn("ts", F.expr("cast(t as timestamp_ntz)"))


def ids(df):
    return [r.id for r in df.collect()]


def test_query_bounds_count_in_and_ties_break_by_sequence_then_ingest(small_trail):
    assert ids(L.query_receipts(small_trail)) == list("abcde")
    assert ids(L.query_receipts(small_trail, newest_first=True, limit=4)) == list("edcb")
    assert ids(L.query_receipts(small_trail, after="2024-01-02 00:00:00", before="2024-01-03 00:00:00")) == ["d", "e"]
    assert ids(L.query_receipts(small_trail, chain_id="c1", limit=1)) == ["a"]
    with pytest.raises(TypeError):
        L.query_receipts(small_trail, colour="red")


def test_latest_root_chain_skips_agent_chains(small_trail):
    assert L.latest_root_chain(small_trail).first().chain_id == "c2"


@pytest.mark.parametrize(
    "policy, kept", [("off", ""), (" FALSE ", ""), ("1", "ab"), ("high", "a"), ("data.api.read", "b"), ("x, data.api.read", "b")]
)
def test_disclosure(spark, policy, kept):
    df = spark.createDataFrame([("a", "unknown", "critical"), ("b", "data.api.read", "low")], "id string, action_type string, risk_level string")
    assert "".join(sorted(ids(L.select_disclosable(df, policy)))) == kept


@pytest.mark.parametrize("policy", ["a,,b", "a,all", "high,x", ","])
def test_bad_disclosure_policies(policy):
    with pytest.raises(ValueError):
        L.disclosure_filter(policy)


def test_allow_deny(spark):
    df = column(spark, ["a", "b", None], "tool_name")
    assert results(L.allow_deny(df, ["a", "b"], ["b"]), "tool_name") == ["a"]
    assert results(L.allow_deny(df, [], ["b"]), "tool_name") == ["a", None]
