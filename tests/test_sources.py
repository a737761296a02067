"""Readers and writers on literal files."""

import json

import pytest
import logging

from pyspark.sql import functions as F

from spoor.operators.quality import gate_structure
from spoor.sources import receipts as R
from spoor.sources import sinks as S


def document(i, **subject):
    return {
        "id": f"urn:receipt:{i}",
        "version": "0.6.0",
        "issuer": {"id": "did:agent:1", "session_id": "s"},
        "credentialSubject": {
            "principal": {"id": "did:user:1"},
            "action": {"type": "data.api.read", "risk_level": "low", "timestamp": "2024-01-01T02:00:00+02:00"},
            "outcome": {"status": "success"},
            "chain": {"chain_id": "c", "sequence": i},
            **subject,
        },
        "proof": {"proofValue": "u1"},
        "extra": {"kept": [1.50, "x"]},
    }


def test_lines_keep_the_text_and_compare_instants(spark, tmp_path):
    lines = [json.dumps(document(i), indent=None) for i in (1, 2)] + ["", "{broken"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    raw = R.read_receipts(spark, str(tmp_path))
    assert sorted(r.receipt_json for r in raw.collect()) == sorted(line for line in lines if line)
    assert {r.reject_reason for r in gate_structure(raw).collect()} == {None, "malformed_json"}
    good = R.lift_columns(gate_structure(raw).filter("reject_reason IS NULL"))
    assert {str(r.ts) for r in good.collect()} == {"2024-01-01 00:00:00"}


def test_array_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([document(i) for i in range(5)], indent=2))
    out = R.lift_columns(R.read_receipts(spark, str(tmp_path), layout="array"))
    assert sorted(r.sequence for r in out.collect()) == list(range(5))
    assert json.loads(out.first().receipt_json)["extra"] == {"kept": [1.5, "x"]}


def test_terminal_false_reads_as_absent(spark, tmp_path):
    docs = [document(1), document(2), document(3)]
    docs[1]["credentialSubject"]["chain"]["terminal"] = False
    docs[2]["credentialSubject"]["chain"]["terminal"] = True
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, docs)))
    got = {r.sequence: r.terminal for r in R.lift_columns(R.read_receipts(spark, str(tmp_path))).collect()}
    assert got == {1: None, 2: None, 3: True}


def test_witness_log_selects_a_chain(spark, tmp_path):
    rows = [("checkpoint", "a", 1), ("heartbeat", "a", 2), ("checkpoint", "b", 3)]
    lines = [
        json.dumps({"anchored_at": "2024-01-01T00:00:00Z", "event_type": e, "payload": {"chain_id": c, "sequence": n, "receipt_hash": "h", "timestamp": "2024-01-01T00:00:00Z"}})
        for e, c, n in rows
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    assert [(r.chain_id, r.sequence) for r in R.read_checkpoints(spark, str(tmp_path), "a").collect()] == [("a", 1)]


def test_transcripts_skip_long_and_broken_lines(spark, tmp_path):
    good = {"type": "assistant", "message": {"model": "m", "usage": {"input_tokens": 1}, "content": [{"type": "tool_use", "id": "t1"}]}}
    lines = [json.dumps(good), json.dumps({**good, "pad": "x" * 500}), "{tool_use", json.dumps({"type": "user", "message": {"content": "text with \"tool_use\""}})]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    got = R.read_transcripts(spark, str(tmp_path), 300).filter("type = 'assistant'").collect()
    assert [(r.model, r.usage, [b.id for b in r.content]) for r in got] == [("m", '{"input_tokens":1}', ["t1"])]


def test_trail_table_is_sorted_in_every_file(spark, tmp_path):
    df = spark.range(200).select(
        (F.col("id") % 7).cast("string").alias("chain_id"), F.col("id").alias("sequence"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(id % 3 as int)) AS ts")
    )
    path = str(tmp_path / "trail")
    S.write_trail(df, path, files=4)
    S.write_trail(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 400 and back.select("chain_date").distinct().count() == 3
    by_file = {}
    for r in back.select("chain_id", "sequence", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).orderBy("n").collect():
        by_file.setdefault(r.f, []).append((r.chain_id, r.sequence))
    assert all(rows == sorted(rows) for rows in by_file.values())


def test_fan_out_goes_on_after_a_failure(spark, caplog):
    seen = []

    def refuse(_):
        raise OSError("full")

    writers = {"bad": refuse, "good": lambda df: seen.append(df.count())}
    assert S.fan_out(spark.range(3), writers, keep=True) == {"bad": "OSError: full", "good": None}
    with caplog.at_level(logging.WARNING):
        S.fan_out_batches(writers)(spark.range(4), 0)
    assert seen == [3, 4] and "bad" in caplog.text


def test_presentations_split_long_chains(spark, tmp_path):
    df = spark.createDataFrame([("c", i, f"x{i}", json.dumps({"id": i})) for i in range(1, 8)], "chain_id string, sequence long, id string, receipt_json string")
    S.presentations(df, documents_per_part=3).select("presentation").write.text(str(tmp_path / "vp"))
    parts = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "vp")).collect()), key=lambda p: p["verifiableCredential"][0]["id"])
    assert [[d["id"] for d in p["verifiableCredential"]] for p in parts] == [[1, 2, 3], [4, 5, 6], [7]]


def test_a_long_chain_is_one_presentation(spark, tmp_path):
    rows = [("c", n, f"c-{n}", json.dumps({"id": f"c-{n}", "text": "é}]," * (n % 3)})) for n in range(1, 2001)]
    rows += [("d", 1, "d-1", '{"id": "d-1"}'), ("e", 1, "e-1", None)]
    df = spark.createDataFrame(rows, "chain_id string, sequence long, id string, receipt_json string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        S.export_presentations(df, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) > 1
    text, found = "".join(f.read_text() for f in files), []
    decoder = json.JSONDecoder()
    while text.strip():
        document, end = decoder.raw_decode(text)
        found.append([d and d["id"] for d in document["verifiableCredential"]])
        text = text[end:].lstrip()
    assert found == [[f"c-{n}" for n in range(1, 2001)], ["d-1"], [None]]
    plain = sorted(map(tuple, S.presentation_lines(df).collect()))
    assert sorted(map(tuple, S.presentation_lines(df, slice_rows=150).collect())) == plain
