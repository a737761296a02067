"""Sources and sinks: write, read back, compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.plans import demo
from spoor.plans.classify_queries import transcript_lines
from spoor.plans.demo import with_views
from spoor.plans.integrity_queries import _CHECKPOINTS, checkpoints
from spoor.plans.registry import query
from spoor.session import scratch_path
from spoor.sources import receipts as R
from spoor.sources import sinks as S


@query("S1 S7", with_views("trail", "SELECT id, chain_id, sequence, ts FROM trail"))
def read_receipts(spark, sf):
    path = scratch_path(spark, "export")
    S.export_jsonl(demo.receipts(spark, sf), path)
    return R.lift_columns(R.read_receipts(spark, path)).select("id", "chain_id", "sequence", "ts")


@query("S3", with_views("trail", "SELECT id, chain_id, sequence, cast(ts as date) AS chain_date FROM trail"))
def write_trail(spark, sf):
    path = scratch_path(spark, "trail-by-day")
    S.write_trail(demo.trail(spark, sf), path)
    return spark.read.parquet(path).select("id", "chain_id", "sequence", "chain_date")


@query(
    "S4",
    with_views(
        "sealed",
        "SELECT chain_id, sequence, receipt_hash, make_timestamp(1704067200000000 + log_no * 1000000) AS ts FROM checkpoints WHERE log_no % 10 <> 3",
        checkpoints=_CHECKPOINTS,
    ),
)
def read_checkpoints(spark, sf):
    path = scratch_path(spark, "witness")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("log_no")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    lines = checkpoints(spark, sf).select(
        stamp.alias("anchored_at"),
        F.when(F.col("log_no") % 10 == 3, "heartbeat").otherwise("checkpoint").alias("event_type"),
        F.struct("chain_id", "sequence", "receipt_hash", stamp.alias("timestamp")).alias("payload"),
    )
    lines.write.json(path)
    return R.read_checkpoints(spark, path).select("chain_id", "sequence", "receipt_hash", "ts")


@query(
    "S5",
    with_views(
        "trail",
        "SELECT type, model, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'user' ELSE 'assistant' END AS type, 'model-' || cast(k + e as string) AS model "
        "FROM trail, (VALUES (0), (1)) v(e) WHERE correlation_id IS NOT NULL AND event_id % 9 <> 4) l GROUP BY 1, 2",
    ),
)
def read_transcripts(spark, sf):
    """Every ninth event's lines are blown up beyond the limit and must be skipped."""
    path = scratch_path(spark, "transcripts")
    lines = transcript_lines(demo.trail(spark, sf))
    long = F.floor(F.col("row") / 2) % 9 == 4
    padded = F.when(long, F.concat("value", F.repeat(F.lit(" "), F.lit(4096)))).otherwise(F.col("value"))
    lines.select(padded.alias("value")).write.text(path)
    return R.read_transcripts(spark, path, 2048).groupBy("type", "model").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S6",
    with_views("trail", "SELECT 'a' AS sink, count(*) AS n, cast(null as string) AS error FROM trail UNION ALL SELECT 'b', 0, 'OSError' UNION ALL SELECT 'c', count(*), NULL FROM trail"),
)
def fan_out(spark, sf):
    paths = {name: scratch_path(spark, f"fan-{name}") for name in ("a", "c")}

    def refuse(df):
        raise OSError("disk full")

    writers = {
        "a": lambda df: df.write.parquet(paths["a"]),
        "b": refuse,
        "c": lambda df: df.write.json(paths["c"]),
    }
    trail = demo.trail(spark, sf).select("id", "chain_id", "sequence")
    errors = S.fan_out(trail, writers)
    counts = None
    for name in writers:
        stored = None
        if name == "a":
            stored = spark.read.parquet(paths[name])
        elif name == "c":
            stored = spark.read.schema(trail.schema).json(paths[name])
        rows = stored.agg(F.count("id").alias("n")) if stored else spark.range(1).select(F.lit(0).cast("long").alias("n"))
        error = errors[name].split(":")[0] if errors[name] else None
        part = rows.select(F.lit(name).alias("sink"), "n", F.lit(error).cast("string").alias("error"))
        counts = part if counts is None else counts.unionByName(part)
    return counts


@query(
    "S7",
    with_views(
        "trail",
        "SELECT chain_id, cast(floor((sequence - 1) / 40) as bigint) AS part, string_agg(id, ',' ORDER BY sequence) AS ids FROM trail GROUP BY 1, 2",
    ),
)
def presentations(spark, sf):
    documents = S.presentations(demo.receipts(spark, sf), 40)
    listed = F.from_json("presentation", "struct<verifiableCredential: array<struct<id: string>>>")["verifiableCredential"]["id"]
    return documents.select("chain_id", "part", F.array_join(listed, ",").alias("ids"))


@query("S1 S7", with_views("trail", "SELECT id, chain_id, sequence, ts FROM trail"))
def read_array_receipts(spark, sf):
    """Array files, read by byte ranges."""
    path = scratch_path(spark, "arrays")
    S.export_arrays(demo.receipts(spark, sf), path)
    return R.lift_columns(R.read_receipts(spark, path, "array")).select("id", "chain_id", "sequence", "ts")


@query("S7", with_views("trail", "SELECT chain_id, count(*) AS documents, count(*) - 1 AS commas FROM trail GROUP BY 1 UNION ALL SELECT 'opened', count(DISTINCT chain_id), NULL FROM trail UNION ALL SELECT 'closed', count(DISTINCT chain_id), NULL FROM trail"))
def export_presentations(spark, sf):
    """One document per chain, written as lines and read back."""
    path = scratch_path(spark, "presentations")
    S.export_presentations(demo.receipts(spark, sf), path)
    line = F.col("value")
    chain = F.get_json_object(F.rtrim(line, F.lit(",")), "$.credentialSubject.chain.chain_id")
    kind = F.when(line.startswith('{"type":["VerifiablePresentation"]'), "opened").when(line == "]}", "closed").otherwise(chain)
    commas = F.when(~kind.isin("opened", "closed"), line.endswith(",").cast("long"))
    lines = spark.read.text(path).select(kind.alias("chain_id"), commas.alias("comma"))
    return lines.groupBy("chain_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("comma").alias("commas"))


@query(
    "S6",
    with_views("trail", "SELECT 'a' AS sink, count(*) AS n FROM trail UNION ALL SELECT 'c', count(*) FROM trail"),
)
def fan_out_batches(spark, sf):
    """A stream to three sinks, one of which refuses every batch."""
    paths = {name: scratch_path(spark, f"batches-{name}") for name in ("a", "c")}

    def refuse(df):
        raise OSError("disk full")

    writers = {name: (lambda df, path=path: df.write.mode("append").parquet(path)) for name, path in paths.items()}
    schema = demo.trail(spark, sf).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(demo.table_path(spark, sf, "trail"))
    started = stream.select("id", "chain_id").writeStream.foreachBatch(S.fan_out_batches({"b": refuse, **writers}))
    started.option("checkpointLocation", scratch_path(spark, "batches-state")).trigger(availableNow=True).start().awaitTermination()
    counts = [spark.read.parquet(path).agg(F.lit(name).alias("sink"), F.count("id").alias("n")) for name, path in paths.items()]
    return counts[0].unionByName(counts[1])
