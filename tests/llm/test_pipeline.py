"""The pipeline's stages, each on its own input, and as a whole."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from spoor.llm.common import store

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, n = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES:
        docs = store(stage(spark, docs, SF), name)
        n.append(docs.count())
        assert docs.columns[: len(names)] == names
        if name == "near":
            assert docs.count() == docs.select("doc_id").distinct().count() == docs.select("text").distinct().count()
        if name == "decontaminate":
            assert 0 < n[-1] < n[-2]
    assert docs.columns == [*names, "shard", "slot"]
    sizes = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n[-1]


def test_run_twice_gives_the_same(spark, tmp_path):
    one, two = (pipeline.run(spark, SF).select(F.xxhash64("doc_id", "shard", "slot").alias("h")) for _ in range(2))
    assert sorted(r.h for r in one.collect()) == sorted(r.h for r in two.collect())


def test_odd_rows_pass_all_stages(spark, odd_docs):
    docs = odd_docs
    for name, stage in pipeline.STAGES:
        docs = store(stage(spark, docs, SF), name)
        if name == "near":  # the repeated row is gone, texts without letters are gone
            assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 1, 4, 5, 7]
    assert docs.columns == [*odd_docs.columns, "shard", "slot"]
    empty = odd_docs.limit(0)
    for name, stage in pipeline.STAGES:
        empty = store(stage(spark, empty, SF), name)
    assert empty.count() == 0
