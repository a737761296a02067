"""Array files: documents verbatim, however the file is cut."""

import json
import random

import pytest

from spoor.sources import array_files
from spoor.sources.array_files import read_array_files
from spoor.sources.receipts import read_receipts


def documents(n, seed):
    """JSON objects whose strings hold braces, brackets, quotes and backslashes, spaced at random."""
    rng = random.Random(seed)

    def value(depth):
        kind = rng.randrange(7 if depth < 4 else 4)
        if kind == 0:
            return json.dumps("".join(rng.choice('ab{}[],:"\\ü\n') for _ in range(rng.randrange(12))), ensure_ascii=rng.random() < 0.5)
        if kind in (1, 2):
            return rng.choice(["1", "-2.50e3", "true", "null", '"\\\\"', '"}"', '"\\"{"', '"\\u007b\\\\"'])
        if kind == 3:
            return rng.choice(["{}", "[ ]", "{ }"])
        gap = lambda: rng.choice(["", " ", "\n\t"])
        if kind < 6:
            inner = ",".join(f'{gap()}"k{i}"{gap()}:{gap()}{value(depth + 1)}' for i in range(rng.randrange(1, 4)))
            return "{" + inner + gap() + "}"
        return "[" + ",".join(value(depth + 1) for _ in range(rng.randrange(1, 4))) + "]"

    for i in range(n):
        yield '{"id":' + f'"r{i}", "v":' + value(0) + rng.choice(["", "\n", " "]) + "}"


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("slice_rows", [None, 40])
def test_documents_are_verbatim(spark, tmp_path, small_splits, slice_rows):
    want = []
    for i, (between, ends) in enumerate([(",", ("[", "]")), (" ,\n  ", ("\ufeff [\n", "\n]\n"))]):
        docs = list(documents(120, i))
        want += docs
        (tmp_path / f"{i}.json").write_text(ends[0] + between.join(docs) + ends[1], encoding="utf-8")
    single = '\n{"id": "one", "t": "a }] b", "x": [{}, {"y": "{"}]}'
    for name, text, found in (("single", single, [single.strip()]), ("empty", "[ ]", []), ("nothing", "", [])):
        (tmp_path / f"{name}.json").write_text(text)
        want += found
    assert all(json.loads(d) for d in want)
    raw = read_array_files(spark, str(tmp_path), slice_rows)
    assert sorted(r.receipt_json for r in raw.collect()) == sorted(want)


def test_a_file_cut_short_or_spoilt_is_left_to_the_gate(spark, tmp_path):
    whole = '{"id": "a", "x": {"y": 1}}'
    (tmp_path / "short.json").write_text(f'[{whole}, {{"id": "b", "x": {{"y": 2}}')
    (tmp_path / "brace.json").write_text(f'[{whole}, {{"id": "c", "x": {{"y": 3')
    (tmp_path / "junk.json").write_text(f"[17, {whole}]")
    got = sorted(r.receipt_json for r in read_array_files(spark, str(tmp_path)).collect())
    assert got == sorted([whole, whole, '{"id": "b", "x": {"y": 2}', '{"id": "c", "x": {"y": 3', "17, " + whole])


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    docs = [f'{{"id":"{i}","pad":"{"x" * 3000}}}"}}' for i in range(400)]
    (tmp_path / "large.json").write_text("[" + ",".join(docs) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 30
    assert sorted(r.receipt_json for r in read_receipts(spark, str(tmp_path), "array").select("receipt_json").collect()) == sorted(docs)


def test_only_a_row_or_two_a_range_are_scanned_in_order(spark, tmp_path, small_splits, monkeypatch):
    docs = [f'{{"id":"{i}","x":[{"{}," * 20}{{}}]}}' for i in range(200)]
    (tmp_path / "many.json").write_text("[" + ",".join(docs) + "]")
    ranges = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    scanned, along = [], array_files.along

    def counted(df, *args, **how):
        scanned.append(df.count())
        return along(df, *args, **how)

    monkeypatch.setattr(array_files, "along", counted)
    assert sorted(r.receipt_json for r in read_array_files(spark, str(tmp_path)).collect()) == sorted(docs)
    assert scanned and max(scanned) <= 2 * ranges < 200 * 22


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_any_batch_size_gives_the_same_documents(spark, tmp_path, small_splits, batch):
    docs = list(documents(60, 9))
    (tmp_path / "a.json").write_text("[" + ", ".join(docs) + "]", encoding="utf-8")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(r.receipt_json for r in read_array_files(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(docs)
