"""Language ID where labels are missing or many."""

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spoor.llm import language_id


def test_stage_keeps_documents_when_no_language_can_be_learned(spark, odd_docs):
    kept = [1, 1, 1, 4, 5, 7, None]
    by_id = lambda df: sorted((r.doc_id for r in df.collect()), key=lambda i: (i is None, i or 0))
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert by_id(pipeline.language(spark, unlabelled, "")) == kept
    # All labelled rows are held out.
    all_held = odd_docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.col("lang")))
    assert by_id(pipeline.language(spark, all_held, "")) == kept
    # A label of the name that stands for none is a label.
    named_und = odd_docs.withColumn("lang", F.when(F.col("lang").isNotNull(), language_id.UNKNOWN))
    out = pipeline.language(spark, named_und, "")
    assert by_id(out) == kept and out.columns == odd_docs.columns


def alphabet(i):
    """Four letters of its own for each of many made-up languages."""
    return [chr(0x4E00 + 4 * i + k) for k in range(4)]


def made_up(i, words):
    a = alphabet(i)
    return " ".join(a[w % 4] + a[(w // 4) % 4] + a[(w * 7 + i) % 4] for w in range(words))


def test_every_language_is_learned(spark, monkeypatch):
    # 150 languages; the rarer half has one document each.
    rows = [(1000 * c + i, made_up(i, 40 + c), f"l{i:03d}") for i in range(150) for c in range(3 if i < 75 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert model.languages == [f"l{i:03d}" for i in range(150)]
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(rows) and all(r.lang == r.lang_pred and r.langs == [r.lang] for r in got)
    both = spark.createDataFrame([(1, made_up(140, 60) + " " + made_up(3, 40))], "doc_id long, text string")
    assert language_id.identify(both, model).first().langs == ["l140", "l003"]
    # Counts passed on early add up to the same, and the sparse model says what the dense one says.
    monkeypatch.setattr(language_id, "HELD_COUNTS", 50)
    early = language_id.learn(docs)
    monkeypatch.setattr(language_id, "DENSE_LANGUAGES", 1_000)
    dense = language_id.learn(docs)
    for text in (rows[0][1], both.first().text, "plain words"):
        slot, number = next(language_id.features(pa.array([text])))
        want, shares = language_id.mixture(dense, slot, number)
        for other in (model, early):
            chosen, own = language_id.mixture(other, slot, number)
            assert chosen == want and np.allclose(own, shares)
