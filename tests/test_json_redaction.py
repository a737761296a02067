"""JSON redaction inside the JVM against the token-wise one."""

import json
import random

from spoor.operators import redact as R


def documents(n):
    rng = random.Random(8)
    keys = ["password", "Token", "note", "secret", "a", "api_key", "pass\\u0077ord", 'q\\"uo', "password "]

    def value(depth):
        kind = rng.randrange(6 if depth < 7 else 3)
        if kind < 3:
            return rng.choice(["1", "-2.5e3", "null", "true", '"x"', '"password"', '"\\"password\\": 1"', '"}]{"', '"\\\\"', '""'])
        gap = lambda: rng.choice(["", " ", "\n"])
        if kind == 3:
            return "[" + ",".join(gap() + value(depth + 1) for _ in range(rng.randrange(4))) + "]"
        pairs = (f'{gap()}"{rng.choice(keys)}"{gap()}:{gap()}{value(depth + 1)}' for _ in range(rng.randrange(1, 4)))
        return "{" + ",".join(pairs) + gap() + "}"

    return [value(0) for _ in range(n)]


def test_equals_the_tokenwise_form(spark, monkeypatch):
    texts = documents(400) + ['{"password": ' + "[" * 30 + "]" * 30 + ', "b": 1}', "no json", "", None]
    want = []
    for text in texts:
        try:
            json.loads(text)
            want.append(R.redact_keys(text))
        except (ValueError, TypeError):
            want.append(text)
    df = spark.createDataFrame(list(enumerate(texts)), "n int, x string")
    got = {r.n: r.x for r in R.redact_json_keys(df, "x").collect()}
    for i, text in enumerate(texts):
        assert got[i] == want[i], text
    assert sum(a != b for a, b in zip(texts, want)) > 100


def test_one_pass_and_python_for_deep_values_only(spark, tmp_path):
    spark.createDataFrame([('{"password": {"a": [1]}}',)], "x string").write.parquet(str(tmp_path / "t"))
    plan = R.redact_json_keys(spark.read.parquet(str(tmp_path / "t")), "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
