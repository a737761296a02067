"""Scratch tables lie in one folder per application and can be cleared."""

import os

from spoor.session import checkpoint_dir, clear_scratch, scratch_path


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    import spoor.session as session

    monkeypatch.setattr(session, "checkpoint_dir", lambda spark: f"file://{tmp_path}")
    one, two = scratch_path(spark, "a"), scratch_path(spark, "a")
    assert one != two and checkpoint_dir(spark) and spark.sparkContext.applicationId in one
    spark.range(3).write.parquet(one)
    assert spark.read.parquet(one).count() == 3
    clear_scratch(spark)
    assert os.listdir(tmp_path) == []
    clear_scratch(spark)  # nothing left is fine
