"""Readers: receipt documents, witness logs, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor import schema
from spoor.functions.exprs import is_one_json
from spoor.sources.array_files import read_array_files

CORRUPT = "_corrupt"
_CORRUPTIBLE = T.StructType([*schema.RECEIPT.fields, T.StructField(CORRUPT, T.StringType())])


def read_receipts(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """S1. Receipt documents with their text: one per line, or array files (``layout="array"``).

    Either kind is read by byte ranges, and every document's text is the file's own.
    """
    if layout == "lines":
        raw = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("receipt_json"))
    elif layout == "array":
        raw = read_array_files(spark, path)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return parse_receipts(raw)


def parse_receipts(raw: DataFrame, column: str = "receipt_json") -> DataFrame:
    """Add the parsed document as ``r``; text that does not fit the schema leaves ``r._corrupt`` set."""
    options = {"columnNameOfCorruptRecord": CORRUPT}
    return raw.withColumn("r", F.from_json(column, _CORRUPTIBLE, options))


def instant(text: Column) -> Column:
    """RFC 3339 text as a zone-less UTC time; mixed offsets compare as instants."""
    return F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()).cast("timestamp_ntz")


def lift_columns(raw: DataFrame) -> DataFrame:
    """S2. The trail columns lifted out of parsed documents; the text stays beside them."""
    s = "r.credentialSubject"
    fields = {
        "id": "r.id",
        "chain_id": f"{s}.chain.chain_id",
        "sequence": f"{s}.chain.sequence",
        "issuer_id": "r.issuer.id",
        "session_id": "r.issuer.session_id",
        "agent_id": "r.issuer.agent_id",
        "model": "r.issuer.model",
        "principal_id": f"{s}.principal.id",
        "action_type": f"{s}.action.type",
        "tool_name": f"{s}.action.tool_name",
        "risk_level": f"{s}.action.risk_level",
        "status": f"{s}.outcome.status",
        "target_system": f"{s}.action.target.system",
        "resource": f"{s}.action.target.resource",
        "idempotency_key": f"{s}.action.idempotency_key",
        "drop_count": f"{s}.action.emitter_metadata.drop_count",
        "correlation_id": f"{s}.correlation_id",
        "grant_ref": f"{s}.authorization.grant_ref",
        "parent_chain_id": f"{s}.delegation.parent_chain_id",
        "parent_receipt_id": f"{s}.delegation.parent_receipt_id",
        "delegator_id": f"{s}.delegation.delegator.id",
        "reversal_of": f"{s}.outcome.reversal_of",
        "response_hash": f"{s}.outcome.response_hash",
        "chain_status": f"{s}.chain.status",
        "previous_receipt_hash": f"{s}.chain.previous_receipt_hash",
        "version": "r.version",
    }
    terminal = F.when(F.col(f"{s}.chain.terminal"), F.lit(True))
    usage = F.get_json_object("r.issuer.runtime", "$.usage")
    return raw.select(
        *[F.col(path).alias(name) for name, path in fields.items()],
        instant(F.col(f"{s}.action.timestamp")).alias("ts"),
        terminal.alias("terminal"),
        usage.alias("usage"),
        "receipt_json",
    )


def read_checkpoints(spark: SparkSession, path: str, chain_id: str | None = None) -> DataFrame:
    """S4. Checkpoints of a witness log, other event types left out."""
    lines = spark.read.schema(schema.CHECKPOINT_LINE).json(path)
    out = lines.filter("event_type = 'checkpoint'").select(
        "payload.chain_id",
        "payload.sequence",
        "payload.receipt_hash",
        instant(F.col("payload.timestamp")).alias("ts"),
        instant(F.col("anchored_at")).alias("anchored_at"),
    )
    return out if chain_id is None else out.filter(F.col("chain_id") == chain_id)


def read_transcripts(spark: SparkSession, path: str, max_len: int = 1 << 20) -> DataFrame:
    """S5. Transcript lines with their file and place in it; lines longer than ``max_len`` bytes
    are skipped, and so are lines that are no JSON."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return parse_transcripts(lines.filter(F.octet_length("value") <= max_len)).filter("entry_ok").drop("entry_ok")


def parse_transcripts(lines: DataFrame) -> DataFrame:
    """Transcript entries from text lines (file, block, row, value); ``entry_ok``: the line is JSON."""
    entry = F.from_json("value", schema.TRANSCRIPT_LINE)
    return lines.withColumn("e", entry).select(
        is_one_json(F.col("value")).alias("entry_ok"),
        "file",
        "block",
        "row",
        F.col("e.type").alias("type"),
        F.col("e.message.model").alias("model"),
        F.col("e.message.usage").alias("usage"),
        F.col("e.message.content").alias("content"),
    )
