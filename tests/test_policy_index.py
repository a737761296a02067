"""Many policy rules, looked up by an index, against the CASE over each row."""

import random
import re

import pytest

from spoor.functions.exprs import glob_to_regex
from spoor.operators import classify as C
from spoor.operators.policy_index import longest_literal

SCHEMA = C._RULE_TABLE


def rules(n, seed):
    rng = random.Random(seed)
    words = ["get_", "delete", "auth", "file", "é", "x/y", "conf", "pay"]
    out = []
    for i in range(n):
        made = lambda: "".join(rng.choice([*words, "*", "?", "[a-f]", "[^x]", "\\*", "[a\\]b]", "["]) for _ in range(rng.randrange(1, 4)))
        tool = rng.choice([None, "", "*"]) if i % 25 == 0 else rng.choice(words[:3]) + made() if i % 3 else made()
        server = made() if i % 7 == 0 else rng.choice([None, "", "*"])
        operations = rng.choice([None, [], ["read"], ["read", "write"], ["delete", "delete"], ["write"]])
        out.append((rng.randrange(1000) * 1000 + i, f"r{i}", f"why {i}", rng.choice([True, True, True, False, None]), tool, server,
                    operations, 100 if (tool or "*").startswith(("*", "[")) else rng.choice([None, 0, 30, 70]),
                    rng.choice(["pass", "flag", "flag", "flag", "pause", "block", "stop", None])))
    return out


def calls(spark, n, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice([None, "", "a", "get_file", "GET_auth", "delete_conf", "x/y", "auth*", "éa", "filebpay", "payx/y", "get_]", "conf"])
    rows = [(i, name(), name(), rng.choice([None, "read", "write", "delete", "unknown"]), rng.choice([None, 0, 29, 30, 71, 100])) for i in range(n)]
    return spark.createDataFrame(rows, "n int, tool_name string, server string, operation_type string, risk_score int")


def judged(df, table):
    out = C.evaluate_policy(df, table)
    assert out.columns == [*df.columns, "policy_action", "policy_rule", "policy_reason"]
    return sorted((r.n, r.policy_action, r.policy_rule, r.policy_reason) for r in out.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_case_form(spark, monkeypatch, seed):
    table, df = spark.createDataFrame(rules(150, seed), SCHEMA), calls(spark, 600, seed)
    want = judged(df, table)
    problems = {(r.name, r.problem) for r in C.validate_rules(spark, table).collect()}
    monkeypatch.setattr(C, "MOST_RULES", 3)
    assert judged(df, table) == want
    assert len({r for _, _, r, _ in want}) > 7
    assert {(r.name, r.problem) for r in C.validate_rules(spark, table).collect()} == problems
    listed = [dict(zip([p.split()[0] for p in SCHEMA.split(", ")], row)) for row in sorted(rules(150, seed))]
    assert judged(df, listed) == want


def test_fifty_thousand_rules(spark):
    rows = [(i, f"r{i}", None, True, f"*tool_{i}_*" if i % 2 else f"tool_{i}", None, None, None, "flag") for i in range(50_000)]
    rows.append((60_000, "all", None, True, "*", "*", None, 90, "block"))
    df = spark.range(200).selectExpr(
        "CAST(id AS int) AS n", "concat('tool_', id * 7, IF(id * 7 % 2 = 1, '_x', '')) AS tool_name", "'s' AS server", "'read' AS operation_type", "CAST(id AS int) AS risk_score"
    )
    got = judged(df, spark.createDataFrame(rows, SCHEMA))
    assert got == [(n, "block" if n >= 90 else "flag", "all" if n >= 90 else f"r{n * 7}", None) for n in range(200)]
    assert C.validate_rules(spark, spark.createDataFrame(rows, SCHEMA)).filter("problem IS NOT NULL").count() == 0


def test_a_literal_stands_in_every_name_that_matches():
    assert longest_literal("a*bcd?[x-z]ef") == "bcd" and longest_literal(r"\*ab*") == "*ab" and longest_literal(r"[a\]b]cd") == "cd"
    rng = random.Random(3)
    for _ in range(3000):
        glob = "".join(rng.choice(["a", "b", "*", "?", "[ab]", "\\*", "[a\\]]"]) for _ in range(5))
        name = "".join(rng.choice("ab*]") for _ in range(rng.randrange(1, 6)))
        if re.fullmatch(glob_to_regex(glob)[1:-1], name):
            assert longest_literal(glob) in name, (glob, name)
