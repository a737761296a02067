"""Receipts without a sequence or a time on the stream."""

import datetime as dt

import pytest

from spoor.streaming import streams as X

SCHEMA = "chain_id string, sequence long, id string, previous_receipt_hash string, receipt_hash string, ts timestamp_ntz"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def state_store(spark):
    X.keep_state_in_rocksdb(spark)


def row(chain, n, hours, key=None):
    at = None if hours is None else START + dt.timedelta(hours=hours)
    return (chain, n, key or f"{chain}-{n}", f"{chain}{n - 1}" if n and n > 1 else None, f"{chain}{n}", at)


def run(spark, tmp_path, batches, build):
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    source = X.follow(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    return X.run_to_table(build(source), str(tmp_path / "out"), str(tmp_path / "state"))


@pytest.mark.parametrize("late", ["10 minutes"])
def test_chain_head_names_rows_without_a_sequence(spark, tmp_path, late):
    batches = [
        [row("c", 1, 0), row("c", None, 0, "lost-1"), row("n", None, None, "lost-2")],
        [row("c", 2, None), row("c", None, None, "lost-3")],  # no time in the whole batch
        [row("c", 3, 1), row(None, 1, 1, "null-1"), row(None, 2, 1, "null-2")],
        [row("d", 1, 50)],
        [row("d", 2, 60)],
    ]
    out = run(spark, tmp_path, batches, lambda s: X.stream_chain_head(s, 3_600_000, late=late))
    got = {r.id: (r.verdict, r.sequence, r.head_sequence) for r in out.collect()}
    assert {k: v[0] for k, v in got.items() if v[0] != "ok"} == {
        "lost-1": "no_sequence", "lost-2": "no_sequence", "lost-3": "no_sequence",
    }
    assert got["lost-2"] == ("no_sequence", None, 0) and got["lost-3"][1] is None and len(got) == 10


def test_checkpoints_count_rows_without_sequence_or_time(spark, tmp_path):
    batches = [
        [row("c", None, None, "x"), row("c", 1, None), row("c", 2, None)],
        [row("c", 3, 1), row("c", 4, 1), row("c", None, 1, "y"), row("n", None, None, "z")],
        [row("d", 1, 50)],
        [row("d", 2, 60)],
    ]
    out = run(spark, tmp_path, batches, lambda s: X.stream_checkpoints(s, 3, 3_600_000 * 1000, late="10 minutes"))
    assert sorted((r.chain_id, r.sequence, r.receipt_hash, r.reason) for r in out.collect()) == [
        ("c", 2, "c2", "cadence"), ("c", 4, "c4", "cadence"),
    ]


def test_early_rows_in_many_blocks_and_any_order(spark, tmp_path, monkeypatch):
    """Every row but the first of each batch is early; each is taken once the hole before it closes."""
    monkeypatch.setattr(X, "EARLY_BLOCK", 4)
    rows = [row("c", n, n / 100) for n in range(1, 41)]
    rows[20] = (*rows[20][:3], "forged", *rows[20][4:])
    batches = [rows[k::4][::-1] for k in (3, 1, 2)] + [rows[0::4] + rows[5:9], [row("d", 1, 50)], [row("d", 2, 60)]]
    out = run(spark, tmp_path, batches, lambda s: X.stream_chain_head(s, 3_600_000 * 24, late="10 minutes"))
    got = sorted((r.sequence, r.verdict) for r in out.filter("chain_id = 'c'").collect())
    repeated = [n for n in range(6, 10) if (n - 1) % 4]
    want = [(n, "bad_link" if n == 21 else "ok") for n in range(1, 41)]
    assert got == sorted(want + [(n, "repeated") for n in repeated] + [(9, "repeated")])
