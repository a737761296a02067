"""Receipts behind the watermark, in streams of several batches."""

import datetime as dt

import pytest

from spoor.streaming import streams as X

START = dt.datetime(2024, 1, 1)
SCHEMA = "chain_id string, sequence long, id string, previous_receipt_hash string, receipt_hash string, ts timestamp_ntz"


@pytest.fixture(autouse=True)
def state_store(spark):
    X.keep_state_in_rocksdb(spark)


def row(chain, n, hours):
    before = f"{chain}{n - 1}" if n > 1 else None
    return (chain, n, f"{chain}-{n}", before, f"{chain}{n}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours))


@pytest.fixture
def backlog(spark, tmp_path):
    """A day after c's first receipts its backlog comes; d and e move the watermark on."""
    path = str(tmp_path / "in")
    batches = [
        [row("c", 1, 0), row("c", 2, 0.01), row("d", 1, 0)],
        [row("d", 2, 24)],
        [row("d", 3, 25)],
        [row("c", 3, 0.02), row("c", 4, 0.03), row("d", 4, 25.1)],
        [row("d", 5, 48)],
        [row("d", 6, 72)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return X.follow(spark, path, spark.read.parquet(path).schema, files_per_trigger=1), batches


def test_a_backlog_is_judged(tmp_path, backlog):
    source, batches = backlog
    out = X.run_to_table(X.stream_chain_head(source, 3_600_000, late="10 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.id, r.verdict) for r in out.collect())
    assert got == sorted((r[2], "ok") for rows in batches for r in rows)


def test_a_backlog_counts_for_checkpoints(tmp_path, backlog):
    source, _ = backlog
    out = X.run_to_table(X.stream_checkpoints(source, 4, 1_000 * 3_600_000, late="10 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r.chain_id, r.sequence, r.reason) for r in out.collect()) == [("c", 4, "cadence"), ("d", 4, "cadence")]


def test_an_older_receipt_does_not_shorten_the_wait(spark, tmp_path):
    path = str(tmp_path / "in")
    # c waits for its second receipt until 25:30; the fourth is older and comes behind the watermark.
    batches = [[row("c", 1, 24), row("c", 3, 24.5)], [row("c", 4, 1)], [row("d", 1, 25.5)], [row("d", 2, 25.6)], [row("c", 2, 25.2)], [row("d", 3, 25.61)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    source = X.follow(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    out = X.run_to_table(X.stream_chain_head(source, 3_600_000, late="10 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r.id: r.verdict for r in out.collect()} == {r[2]: "ok" for rows in batches for r in rows}


def test_rows_left_out_as_too_late_are_counted(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    for hours in ((0, 0.1), (48,), (49,), (1, 2, 49.5)):
        rows = [(START + dt.timedelta(hours=h), "accepted") for h in hours]
        spark.createDataFrame(rows, "ts timestamp_ntz, outcome string").coalesce(1).write.mode("append").parquet(path)
    source = X.follow(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    query = X.stream_rates(source).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect()))
    query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert X.rows_behind_watermark(query) == 2 and sum(r.accepted for r in seen) == 3
