"""Texts of a megabyte in every operator that takes text: plain, all escapes, deeply nested."""

import pytest
from pyspark.sql import functions as F

from spoor.operators import classify as C
from spoor.operators import redact as R
from spoor.operators import stats as S

MIB = 1 << 20
PLAIN = "x" * MIB
ESCAPES = '\\"' * (MIB // 2)
UNICODE = "\\u0041" * (MIB // 6)
NESTED = '{"a":' * 5000 + "1" + "}" * 5000


@pytest.mark.parametrize("body", [PLAIN, ESCAPES, UNICODE], ids=["plain", "escapes", "unicode"])
def test_sql_flag_on_long_values(spark, body):
    rows = [('{"sql": "delete from t %s"}' % body,), ('{"sql": "delete from t where %s"}' % body,), ('{"x": "%s"}' % body,)]
    calls = spark.createDataFrame([("run_query", "s", a[0]) for a in rows], "tool_name string, server string, arguments_json string")
    assert [r.sql_mutation for r in C.sql_mutation_flag(calls).collect()] == [True, False, False]
    judged = C.evaluate_policy(C.operation_type(C.score_risk(calls)))
    assert judged.select("policy_action").count() == 3
    assert len(judged._jdf.queryExecution().optimizedPlan().toString()) < 20_000


@pytest.mark.parametrize(
    ("command", "resource"),
    [
        ("rm " + PLAIN, PLAIN),
        ("rm '" + PLAIN + "'", PLAIN),
        ('rm "' + "a b " * (MIB // 4) + '"', "a b " * (MIB // 4)),
        ("rm " + "'a'b" * (MIB // 4), "ab" * (MIB // 4)),
        ("rm " + "a " * (MIB // 2), None),
        ("echo x > f; " + PLAIN, None),
    ],
)
def test_shell_on_long_commands(spark, command, resource):
    got = C.classify_shell(spark.createDataFrame([(command,)], "command string")).first()
    assert got.shell_resource == resource


@pytest.mark.parametrize("body", [PLAIN, ESCAPES, UNICODE], ids=["plain", "escapes", "unicode"])
def test_json_keys_on_long_values(spark, body):
    text = '{"password": "%s", "b": "%s"}' % (body, body)
    got = R.redact_json_keys(spark.createDataFrame([(text,)], "t string"), "t").first().t
    assert got == '{"password": "[REDACTED]", "b": "%s"}' % body


def test_json_keys_on_deep_nesting(spark):
    got = R.redact_json_keys(spark.createDataFrame([(NESTED,)], "t string"), "t").first().t
    assert got == NESTED  # deeper than the parser goes, so it counts as no JSON


@pytest.mark.parametrize("body", [PLAIN, ESCAPES], ids=["plain", "escapes"])
def test_log_lines_with_long_values(spark, body):
    line = f'policy_event rule="{body}" action="block" outcome="denied" risk=3 duration_ms=7'
    got = S.policy_outcomes(spark.createDataFrame([(line,)], "line string")).first()
    assert (len(got.rule), got.action, got.n) == (len(body.replace('\\"', '"')), "block", 1)
