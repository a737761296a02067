"""Ingest as a table: new checkpoints, repeated batches, lost writers, two writers, bounded reads."""

import os
from pathlib import Path

import pytest

from spoor.streaming import streams as X
from spoor.streaming.ledger import IngestTable


def rows_of(spark, path):
    return sorted((r.id, r.n) for r in spark.read.parquet(str(path)).collect())


def frame(spark, ids, n=0):
    return spark.createDataFrame([(i, n) for i in ids], "id string, n long")


def test_a_new_checkpoint_adds_to_the_table(spark, tmp_path):
    schema = "id string, ts timestamp_ntz"
    empty = spark.createDataFrame([], schema)
    for name, ids in (("a", ["a1", "a2"]), ("b", ["b1", "a2"])):
        source = spark.createDataFrame([(i, None) for i in ids], schema)
        source.coalesce(1).write.parquet(str(tmp_path / name))
        X.stream_ingest(X.follow(spark, str(tmp_path / name), empty.schema), str(tmp_path / "out"), str(tmp_path / f"state-{name}")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a1", "a2", "b1"]
    # The first query's checkpoint is lost: all its rows come again under batch number 0.
    X.stream_ingest(X.follow(spark, str(tmp_path / "a"), empty.schema), str(tmp_path / "out"), str(tmp_path / "state-new")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a1", "a2", "b1"]


def test_batches_are_taken_once_per_stream(spark, tmp_path):
    table = IngestTable(spark, str(tmp_path / "t"))
    table.append(frame(spark, ["a", "b", "a"], 1), "one", 0, ("n",))
    table.append(frame(spark, ["x"], 2), "one", 0, ("n",))  # repeated number: not looked at
    table.append(frame(spark, ["b", "c"], 3), "two", 0, ("n",))
    table.append(frame(spark, [None, None], 4), "two", 1, ("n",))
    table.append(frame(spark, [None, "c"], 5), "one", 1, ("n",))
    got = {(r.id, r.n) for r in spark.read.parquet(table.path).collect()}
    assert got == {("a", 1), ("b", 1), ("c", 3), (None, 4)}
    assert table.latest().streams == {"one": 1, "two": 1} and table.latest().ids == 4


def test_a_writer_lost_at_any_point_leaves_no_trace_or_a_whole_commit(spark, tmp_path, monkeypatch):
    table = IngestTable(spark, str(tmp_path / "t"))
    table.append(frame(spark, ["a"]), "one", 0, ("n",))
    lost = RuntimeError("lost")

    def fail(*_):
        raise lost

    # Before the commit: the attempt is never seen, and its ids are not held to be stored.
    with monkeypatch.context() as m:
        m.setattr(IngestTable, "_commit", fail)
        with pytest.raises(RuntimeError):
            table.append(frame(spark, ["b"]), "one", 1, ("n",))
    assert rows_of(spark, table.path) == [("a", 0)]
    # Behind it: whoever comes next moves the rows in place.
    with monkeypatch.context() as m:
        m.setattr(IngestTable, "_publish", fail)
        with pytest.raises(RuntimeError):
            table.append(frame(spark, ["b"], 7), "one", 1, ("n",))
    other = IngestTable(spark, table.path)
    other.append(frame(spark, ["b", "c"], 8), "two", 0, ("n",))
    assert rows_of(spark, table.path) == [("a", 0), ("b", 7), ("c", 8)]
    table.append(frame(spark, ["b"], 9), "one", 1, ("n",))  # Spark repeats the batch it saw fail
    assert rows_of(spark, table.path) == [("a", 0), ("b", 7), ("c", 8)]


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """The second commits while the first has staged its rows; the first starts again and sees them."""
    table, other = (IngestTable(spark, str(tmp_path / "t")) for _ in range(2))
    table.append(frame(spark, ["a"]), "one", 0, ("n",))
    stage, turns = IngestTable._stage, []

    def staged(self, batch, *more):
        out = stage(self, batch, *more)
        if not turns:
            turns.append("second")
            other.append(frame(spark, ["b", "c"], 2), "two", 0, ("n",))
        return out

    monkeypatch.setattr(IngestTable, "_stage", staged)
    table.append(frame(spark, ["b", "d"], 1), "one", 1, ("n",))
    assert rows_of(spark, table.path) == [("a", 0), ("b", 2), ("c", 2), ("d", 1)]
    assert not os.listdir(tmp_path / "t" / "_pending")


def test_reads_do_not_grow_with_the_trail(spark, tmp_path):
    table = IngestTable(spark, str(tmp_path / "t"), bucket_ids=64)
    size = lambda paths: sum(f.stat().st_size for p in paths for f in Path(p).rglob("*.parquet"))
    read, buckets = [], []
    for batch in range(6):
        table.append(frame(spark, [f"id-{batch}-{i}" for i in range(100 << batch)]), "one", batch, ("n",))
        # Ids that come again, from the first batch on, and new ones.
        entry = table.latest()
        paths = table.bucket_paths(entry, frame(spark, [f"id-{b}-7" for b in range(3)] + ["new-1", "new-2"]))
        assert len(paths) <= 5
        read.append((size(paths), spark.read.parquet(*paths).count()))
        buckets.append(entry.buckets)
    assert entry.ids == 6300 and buckets[-1] >= 8 * buckets[0]
    # The trail grew 63-fold; five ids cost five buckets of 64 ids at most.
    assert all(ids <= 5 * 64 for _, ids in read)
    assert size([f"{table.path}/_ids/{entry.index}"]) > 20 * read[-1][0]
    table.append(frame(spark, [f"id-{b}-{i}" for b in range(6) for i in range(100)] + ["late"]), "two", 0, ("n",))
    assert spark.read.parquet(table.path).count() == 6301
    assert len(os.listdir(tmp_path / "t" / "_ids")) <= 2


def test_a_table_without_ledger_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, ["a", "b"], 1).write.parquet(f"{path}/batch=0")
    frame(spark, ["c"], 1).write.parquet(f"{path}/batch=3")
    IngestTable(spark, path).append(frame(spark, ["c", "d"], 2), "one", 0, ("n",))
    assert rows_of(spark, path) == [("a", 1), ("b", 1), ("c", 1), ("d", 2)]
