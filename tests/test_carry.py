"""Sliced windows against plain ones, with a key that holds a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.functions import carry
from spoor.functions.carry import along, fold_along


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    out = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", None])
        value = rng.choice([None, 1, 2, 3])
        out.append((key, rng.randint(0, 500), i, value, rng.choice([None, "x", "y"])))
    return spark.createDataFrame(out, "key string, at long, id long, v long, s string").repartition(5).cache()


def everything(df, **how):
    return along(
        df,
        ["key"],
        ["at", "id"],
        position="p",
        total="n",
        lag={"lag_v": "v", "lag_s": "s"},
        lead={"lead_v": "v"},
        running={"sum_v": F.col("v"), "ones": F.lit(1)},
        last_seen={"last_s": F.col("s")},
        next_seen={"next_s": F.col("s")},
        lowest={"low": F.col("v")},
        **how,
    )


@pytest.mark.parametrize("how", [{"slice_rows": 50}, {"slice_rows": 7}, {"slice_rows": 10**9}])
def test_sliced_equals_plain(rows, how):
    plain = everything(rows)
    sliced = everything(rows, **how)
    assert sorted(plain.columns) == sorted(sliced.columns)
    columns = sorted(plain.columns)
    assert sorted(map(repr, plain.select(columns).collect())) == sorted(map(repr, sliced.select(columns).collect()))


ORDERS = {
    "nulls": "CASE WHEN at % 5 = 0 THEN NULL ELSE at END",
    "all_null": "CAST(NULL AS bigint)",
    "repeated": "at % 3",
    "one_value": "7L",
    "burst": "CASE WHEN at < 480 THEN 100000 ELSE at END",
    "negative": "-at",
    "strings": "CASE WHEN at % 7 = 0 THEN NULL ELSE concat('e\u0301', char(65 + at % 50), at) END",
    "doubles": "CASE WHEN at % 9 = 0 THEN double('NaN') WHEN at % 9 = 1 THEN double('-Infinity') ELSE at / 7 END",
    "dates": "date_add(date'2024-01-01', CAST(at AS int))",
    "structs": "struct(at % 4 AS a)",
}


@pytest.mark.parametrize("order", ORDERS)
def test_any_order_column_gives_the_plain_result(rows, order):
    odd = rows.withColumn("at", F.expr(ORDERS[order]))
    plain, sliced = everything(odd), everything(odd, slice_rows=40)
    columns = sorted(plain.columns)
    assert sorted(map(repr, plain.select(columns).collect())) == sorted(map(repr, sliced.select(columns).collect()))


HOT = {
    "a burst": "CASE WHEN id < 4 THEN id * 1000000000 ELSE 1000000000000 + id END",
    "no sequence": "CAST(NULL AS bigint)",
    "one forged sequence": "7L",
    "strings that begin alike": "concat('0000000000000000', lpad(id, 8, '0'))",
}


@pytest.mark.parametrize("order", HOT)
def test_a_hot_key_is_cut_evenly(spark, order):
    """However alike its order values are, 20,000 rows of one key make 200 slices of about 100."""
    from spoor.functions.carry import _ranged

    df = spark.range(20_000).select(F.lit("k").alias("key"), F.expr(HOT[order]).alias("at"), "id")
    sizes = [r["count"] for r in _ranged(df, ["key"], ["at", "id"], 100).groupBy("_al_slice").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) > 150 and max(sizes) < 400


def test_only_keys_that_go_on_are_carried(spark):
    from spoor.functions.carry import _going_on, _ranged

    df = spark.range(3000).selectExpr("CASE WHEN id < 1000 THEN 'hot' ELSE concat('k', id) END AS key", "id")
    ranged = _ranged(df, ["key"], ["id"], 100)
    assert [r.key for r in _going_on(ranged, ["key"]).collect()] == ["hot"]


def test_a_sliced_plan_reads_and_shuffles_once(rows):
    plan = everything(rows, slice_rows=50)._jdf.queryExecution().executedPlan().toString()
    # The slices and what is carried into them; only the slices are dealt out again.
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_only_large_keys_of_a_large_input_are_sliced(rows, monkeypatch):
    """Others take the plain window; nothing of theirs is written."""
    plain = everything(rows)
    columns = sorted(plain.columns)
    want = sorted(map(repr, plain.select(columns).collect()))
    monkeypatch.setattr(carry, "SMALL_INPUT_BYTES", 0)
    sliced, ranged = [], carry._ranged

    def counted(df, *args):
        sliced.append(df.select("key").distinct().collect())
        return ranged(df, *args)

    monkeypatch.setattr(carry, "_ranged", counted)
    for slice_rows, large in ((700, {"hot"}), (400, {"hot", "a", "b", "c", None}), (5000, None)):
        monkeypatch.setattr(carry, "SLICE_ROWS", slice_rows)
        sliced.clear()
        got = sorted(map(repr, everything(rows).select(columns).collect()))
        assert got == want
        assert [{r.key for r in keys} for keys in sliced] == ([large] if large else [])


def test_a_second_scan_along_the_same_keys_needs_no_shuffle(spark, monkeypatch):
    monkeypatch.setattr(carry, "SMALL_INPUT_BYTES", 0)
    once = along(spark.range(500).selectExpr("id % 7 AS key", "id"), ["key"], ["id"], position="p")
    twice = along(once, ["key"], ["p"], total="n", dealt=True)
    plan = twice.select("id", "p", "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and twice.filter("n = 72 AND p <= 72").count() == 3 * 72


def test_times_are_cut_like_numbers(spark):
    df = spark.range(400).select(
        F.lit("k").alias("key"),
        F.expr("timestamp_ntz '2024-03-31 00:00:00' + make_dt_interval(0, 0, cast(id * 7 as int), 0)").alias("at"),
        "id",
    )
    got = along(df, ["key"], ["at", "id"], position="p", slice_rows=13).filter("p <> id + 1").count()
    assert got == 0


def test_fold_along_keeps_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.range(100).select((F.col("id") % 3).cast("string").alias("key"), F.col("id").alias("n"))
        schema = T.StructType([T.StructField("total", T.LongType())])

        def step(state, n):
            total = (state or 0) + n
            return total, total

        out = {(r.key, r.n): r.total for r in fold_along(df, ["key"], ["n"], ["n"], schema, step).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in "012":
        total = 0
        for n in range(int(key), 100, 3):
            total += n
            assert out[(key, n)] == total
