"""Writers: trail table, fan-out, exports."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions.carry import along, estimated_bytes

FILE_BYTES, FILE_ROWS = 256 << 20, 5_000_000
MOST_ESTIMATE = 1 << 60


def write_trail(df: DataFrame, path: str, mode: str = "append", files: int | None = None) -> None:
    """S3. Append to the trail table: a folder per day, rows sorted by chain and sequence.

    Rows are range-partitioned by day, chain and sequence, so files are even even when one chain
    or one day dominates, and row-group statistics prune chain and sequence filters.
    """
    dated = df.withColumn("chain_date", F.to_date("ts"))
    order = ("chain_date", "chain_id", "sequence")
    if not files:
        size = estimated_bytes(df) or MOST_ESTIMATE
        # Catalyst knows nothing of some inputs and says so with an enormous number.
        files = -(-size // FILE_BYTES) if size < MOST_ESTIMATE else 0
        files = max(files, df.sparkSession.sparkContext.defaultParallelism)
    writer = dated.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode(mode)
    writer = writer.option("parquet.bloom.filter.enabled#id", "true").option("maxRecordsPerFile", FILE_ROWS)
    writer.partitionBy("chain_date").parquet(path)


Writers = Mapping[str, Callable[[DataFrame], None]]


def fan_out(df: DataFrame, writers: Writers, keep: bool = False) -> dict[str, str | None]:
    """S6. Hand one trail to several writers; a failing one does not stop the others.

    Returns each writer's error, or None. ``keep`` holds the rows between the writers, which pays
    when they are costly to compute and fit the executors.
    """
    outcome: dict[str, str | None] = {}
    kept = df.persist(StorageLevel.MEMORY_AND_DISK) if keep else df
    try:
        for name, write in writers.items():
            try:
                write(kept)
                outcome[name] = None
            except Exception as error:  # the outcome is reported, the next sink still runs
                outcome[name] = f"{type(error).__name__}: {error}"
    finally:
        if keep:
            kept.unpersist()
    return outcome


def fan_out_batches(writers: Writers) -> Callable[[DataFrame, int], None]:
    """S6 for a stream: a ``foreachBatch`` function; failures are logged, the stream goes on."""

    def write(batch: DataFrame, batch_id: int) -> None:
        for name, error in fan_out(batch, writers, keep=True).items():
            if error:
                logging.getLogger(__name__).warning("sink %s, batch %s: %s", name, batch_id, error)

    return write


def export_jsonl(df: DataFrame, path: str) -> None:
    """S7. The verbatim documents of a selection, one per line."""
    df.select("receipt_json").write.text(path)


_OPENING, _CLOSING = '{"type":["VerifiablePresentation"],"verifiableCredential":[', "]}"


def presentations(df: DataFrame, documents_per_part: int = 10_000) -> DataFrame:
    """Presentation documents of each chain as JSON text, chain order kept.

    A chain longer than ``documents_per_part`` is split into numbered parts of that many receipts,
    so no chain has to fit one row; ``export_presentations`` writes each chain as one document.
    """
    placed = along(df, ("chain_id",), ("sequence", "id"), position="__pos")
    part = F.floor((F.col("__pos") - 1) / documents_per_part).cast("long")
    grouped = placed.withColumn("part", part).groupBy("chain_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("__pos", "receipt_json"))).alias("docs")
    )
    body = F.array_join(F.transform("docs", lambda d: d["receipt_json"]), ",")
    return grouped.select(
        "chain_id", "part", F.concat(F.lit(_OPENING), body, F.lit(_CLOSING)).alias("presentation")
    )


def presentation_lines(df: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """One presentation per chain, of any length, as numbered lines: an opening one, a document each, a closing one.

    A null document is written as JSON's null. No row holds more than one document.
    """
    placed = along(df, ("chain_id",), ("sequence", "id"), position="__pos", total="__n", slice_rows=slice_rows)
    comma = F.when(F.col("__pos") < F.col("__n"), F.lit(",")).otherwise(F.lit(""))
    line = lambda number, text: F.struct(number.cast("long").alias("line_no"), text.alias("line"))
    lines = F.array(
        F.when(F.col("__pos") == 1, line(F.lit(0), F.lit(_OPENING))),
        line(F.col("__pos"), F.concat(F.coalesce("receipt_json", F.lit("null")), comma)),
        F.when(F.col("__pos") == F.col("__n"), line(F.col("__n") + 1, F.lit(_CLOSING))),
    )
    return placed.select("chain_id", F.inline(F.array_compact(lines)))


def export_presentations(df: DataFrame, path: str) -> None:
    """S7. The lines of all chains' presentations, sorted; a long chain goes on in the next file.

    The files one behind the other, in order of their names, are one JSON document for each chain.
    """
    lines = presentation_lines(df)
    order = ("chain_id", "line_no")
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def export_arrays(df: DataFrame, path: str) -> None:
    """S7. Files that hold one JSON array of verbatim documents each, a file per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if batch.num_rows:
                heads = pa.array(["," if begun else "[", *[","] * (batch.num_rows - 1)])
                begun = True
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(heads, batch.column(0), "")], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if begun else "[]"])], names=["value"])

    df.select("receipt_json").filter("receipt_json IS NOT NULL").mapInArrow(run, "value string").write.text(path)
