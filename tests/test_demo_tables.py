"""The derived tables are built with one shuffle of whole rows."""

import datetime
import json

import pytest

from spoor.plans import demo


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Events of 50 users, some without one."""
    start = datetime.datetime(2024, 1, 1)
    kinds = ("click", "view", "purchase", "signup", "error")
    rows = [
        (i, start + datetime.timedelta(minutes=7 * (i * 37 % 500)), None if i % 200 == 0 else i % 50, kinds[i % 5], i % 9 / 2.0, json.dumps({"k": i % 100}))
        for i in range(3000)
    ]
    path = tmp_path_factory.mktemp("sf")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/events.parquet")
    return str(path)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_chains_are_dealt_out_once_for_sealing(spark, sf):
    sealed = demo.build_sealed(demo.trail(spark, sf))
    assert shuffles(sealed) == 1
    chains = sealed.groupBy("chain_id").agg({"sequence": "max", "*": "count"}).collect()
    assert len(chains) == 51 and all(r["max(sequence)"] == r["count(1)"] for r in chains)


def test_only_spliced_receipts_are_looked_up(spark, sf):
    sealed = demo.sealed(spark, sf)
    tampered = demo.build_tampered(sealed)
    heads = {r.user_id: r.receipt_hash for r in sealed.filter("sequence = 1").collect()}
    got = {r.event_id: r for r in tampered.collect()}
    edited = lambda r: (r.user_id or 0) % 2 == 1
    want = {r.event_id: r for r in sealed.collect() if r.user_id is not None and not (edited(r) and r.event_id % 97 == 11)}
    assert {e for e, r in got.items() if r.user_id is not None} == set(want)
    spliced = {e for e, r in want.items() if r.user_id % 20 == 5 and r.sequence == 3 and r.event_id % 83 != 17}
    assert spliced and all(got[e].previous_receipt_hash == heads[got[e].user_id - 1] for e in spliced)
    forged = {e for e, r in want.items() if edited(r) and e % 83 == 17}
    untouched = set(want) - spliced - forged
    assert all(got[e].previous_receipt_hash == want[e].previous_receipt_hash for e in untouched)


def test_building_tampered_shuffles_no_other_rows(spark, sf):
    tampered = demo.build_tampered(demo.sealed(spark, sf))
    path = demo.scratch_path(spark, "built")
    tampered.write.parquet(path)
    # One branch of the union is a scan.
    plan = tampered._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Join") == 1
