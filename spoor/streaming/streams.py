"""Structured Streaming forms of the trail operators.

Watermarks and time bounds limit the state; they are parameters, and rows they cut off can be
found again by running the batch operator over the stored trail.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from spoor.functions import fixed
from spoor.operators.stats import OUTCOMES
from spoor.streaming.ledger import BUCKET_IDS, IngestTable


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a time with zone; zone-less trail times are UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """X3 and X4 keep several states per chain, which only this store can; for the caller's session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _needs_rocksdb(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError("this stream needs the RocksDB state store: call keep_state_in_rocksdb(spark) first")


def follow(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    files_per_trigger: int | None = None,
    after: str | None = None,
    before: str | None = None,
    **equal: str | None,
) -> DataFrame:
    """X1. The trail as a stream: what is stored, then whatever is added, each row once.

    Filters are those of the listing: ``after`` and ``before`` bound ``ts``, both ends included.

    The query's checkpoint takes the place of a row watermark, so nothing falls between the
    snapshot and the tail.
    """
    reader = spark.readStream.schema(schema).option("ignoreMissingFiles", False)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    out = reader.parquet(path)
    for name, value in equal.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    if after is not None:
        out = out.filter(F.col("ts") >= F.lit(after).cast(schema["ts"].dataType))
    if before is not None:
        out = out.filter(F.col("ts") <= F.lit(before).cast(schema["ts"].dataType))
    return out


def append_new(path: str, order: tuple[str, ...] = ("ts",), bucket_ids: int = BUCKET_IDS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that appends rows whose id the table does not hold yet.

    A batch is known by its query, which Spark names by the checkpoint, and its number, so a batch
    repeated after a failure is taken once, and a new checkpoint, whose numbers begin again, finds the
    stored ids and adds to them. A batch reads the part of the id index that its own ids lie in.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        IngestTable(spark, path, bucket_ids).append(batch, query, batch_id, order)

    return write


def stream_ingest(source: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """X2. Ingest a stream into a table, each id once; re-deliveries are dropped.

    The stored ids alone decide, so a receipt of any age is taken, a backlog delivered after an
    outage as well. ``every`` sets the batch interval; without it the query takes what is there
    and stops.
    """
    writer = event_time(source).writeStream.foreachBatch(append_new(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


HEAD_OUTPUT = T.StructType(
    [
        T.StructField("chain_id", T.StringType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("head_sequence", T.LongType()),
    ]
)
_HEAD_STATE = "sequence long, receipt_hash string, waiting long, news_ms long"
# Rows that came early, by blocks of places, so that state is read and written a block at a time.
EARLY_BLOCK = 256
_EARLY_KEY = "block long"
_EARLY_VALUE = "sequence array<bigint>, id array<string>, previous array<string>, own array<string>"


class _Early:
    """A chain's early rows in one call: blocks are read when asked for and written back at the end."""

    def __init__(self, state):
        self.state, self.blocks, self.changed = state, {}, set()

    def _block(self, sequence: int) -> dict[int, tuple]:
        number = sequence // EARLY_BLOCK
        if number not in self.blocks:
            held = self.state.getValue((number,)) if self.state.containsKey((number,)) else None
            self.blocks[number] = {s: row for s, *row in zip(*held)} if held else {}
        return self.blocks[number]

    def add(self, sequence: int, row: tuple) -> bool:
        """False if the place is taken."""
        block = self._block(sequence)
        if sequence in block:
            return False
        block[sequence] = row
        self.changed.add(sequence // EARLY_BLOCK)
        return True

    def pop(self, sequence: int) -> tuple | None:
        row = self._block(sequence).pop(sequence, None)
        if row is not None:
            self.changed.add(sequence // EARLY_BLOCK)
        return row

    def places(self) -> list[int]:
        return sorted(s for key in list(self.state.keys()) for s in self._block(key[0] * EARLY_BLOCK))

    def write(self) -> None:
        for number in self.changed:
            block = self.blocks[number]
            if block:
                places = sorted(block)
                columns = zip(*(block[s] for s in places))
                self.state.updateValue((number,), (places, *[list(c) for c in columns]))
            elif self.state.containsKey((number,)):
                self.state.removeKey((number,))


def _texts(column: pd.Series) -> np.ndarray:
    """An array of strings and None."""
    return column.astype(object).where(column.notna(), None).to_numpy()


class _ChainHead(StatefulProcessor):
    """Expected place and hash of one chain. Rows that come early wait in keyed state and are given up
    as a gap when nothing arrived for ``wait_ms``, on the clock or in event time. Rows that come in
    order are compared as arrays."""

    def __init__(self, wait_ms: int | None, event_time: bool):
        self.wait_ms, self.event_time = wait_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("head", _HEAD_STATE)
        self.early = handle.getMapState("early", _EARLY_KEY, _EARLY_VALUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sequence, digest, waited, news = self.state.get() or (0, None, 0, None)
        head, waiting, early = (sequence, digest), waited, _Early(self.early)
        for batch in rows:
            if self.event_time:
                # A backlog brings older times than the chain's last news; rows without time bring none.
                latest = batch["at_ms"].max()
                news = news if pd.isna(latest) else max(int(latest), news or 0)
            numbered = batch["sequence"].notna()
            if not numbered.all():
                lost = _texts(batch.loc[~numbered, "id"])
                yield self._frame(key, [None] * len(lost), lost, ["no_sequence"] * len(lost), [head[0]] * len(lost))
                batch = batch[numbered]
            batch = batch.sort_values("sequence", kind="stable")
            places = batch["sequence"].to_numpy().astype(np.int64)
            ids, before, own = (_texts(batch[c]) for c in ("id", "previous_receipt_hash", "receipt_hash"))
            first = np.append(True, places[1:] != places[:-1])[: len(places)]
            ahead = np.flatnonzero(first & (places > head[0]))
            straight = 0 if waiting else int(np.argmin(np.append(places[ahead] == head[0] + 1 + np.arange(len(ahead)), False)))
            taken = ahead[:straight]
            out = []
            if straight:
                linked = before[taken] == np.append(np.array([head[1]], object), own[taken[:-1]])
                yield self._frame(key, places[taken], ids[taken], np.where(linked, "ok", "bad_link"), places[taken])
                head = (int(places[taken[-1]]), own[taken[-1]])
            for i in np.setdiff1d(np.arange(len(places)), taken, assume_unique=True).tolist():
                place, row = int(places[i]), (ids[i], before[i], own[i])
                if place <= head[0]:
                    out.append((place, ids[i], "repeated", head[0]))
                elif place == head[0] + 1:
                    head = self._take(head, place, row, out)
                    head, waiting = self._drain(head, early, waiting, out)
                elif early.add(place, row):
                    waiting += 1
                else:
                    out.append((place, ids[i], "repeated", head[0]))
            if out:
                yield self._frame(key, *zip(*out))
        early.write()
        self.state.update((*head, waiting, news))
        if self.wait_ms is None or not (waited or waiting):
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting:
            clock = timerValues.getCurrentProcessingTimeInMs()
            due = (clock if news is None else news) + self.wait_ms
            # A chain whose news are older than the watermark is due as soon as it moves.
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1) if self.event_time else due)

    @staticmethod
    def _take(head, place, row, out, gap=False):
        """Add the verdict on one row; returns the head behind it."""
        rid, before, own = row
        out.append((place, rid, "gap" if gap else "ok" if before == head[1] else "bad_link", place))
        return place, own

    def _drain(self, head, early, waiting, out):
        while waiting and (row := early.pop(head[0] + 1)) is not None:
            head = self._take(head, head[0] + 1, row, out)
            waiting -= 1
        return head, waiting

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sequence, digest, waiting, news = self.state.get()
        head, early, out = (sequence, digest), _Early(self.early), []
        for place in early.places():
            row = early.pop(place)
            if row is None:
                continue  # drained behind an earlier gap
            head = self._take(head, place, row, out, gap=True)
            head, waiting = self._drain(head, early, waiting - 1, out)
        early.write()
        self.state.update((*head, 0, news))
        if out:
            yield self._frame(key, *zip(*out))

    @staticmethod
    def _frame(key, *columns) -> pd.DataFrame:
        frame = pd.DataFrame(dict(zip(["sequence", "id", "verdict", "head_sequence"], columns)))
        frame["sequence"] = frame["sequence"].astype("Int64")
        frame.insert(0, "chain_id", key[0])
        return frame

    def close(self) -> None:
        pass


def stream_chain_head(source: DataFrame, wait_ms: int = 60_000, late: str | None = None) -> DataFrame:
    """X3. Verdict on every receipt as it arrives: ok, bad_link, gap, repeated or no_sequence.

    ``source``: chain_id, sequence, id, previous_receipt_hash, receipt_hash and, with ``late``, ts.
    A receipt without a sequence has no place in its chain and is reported at once; one without a time
    is judged like any other, but is no news for the wait, which then counts from the clock if there are none.
    A receipt behind a missing one waits; after ``wait_ms`` without news of its chain it is
    reported as ``gap``, and the receipts that follow it are judged by their links. With ``late``
    the wait is over when the watermark (the latest ts less ``late``) is ``wait_ms`` past the
    chain's last news, which suits runs over what is stored; otherwise the clock counts, and the
    query never runs out of batches.
    """
    _needs_rocksdb(source.sparkSession)
    columns = ["chain_id", "sequence", "id", "previous_receipt_hash", "receipt_hash"]
    if late is None:
        keyed, mode = source.select(*columns), "ProcessingTime"
    else:
        timed = event_time(source).withWatermark("ts", late)
        # Without the watermark's own column: it would take away rows older than the watermark.
        keyed, mode = timed.select(*columns, F.unix_millis("ts").alias("at_ms")), "EventTime"
    return keyed.groupBy("chain_id").transformWithStateInPandas(
        _ChainHead(wait_ms, late is not None), HEAD_OUTPUT, "Append", mode
    )


WITNESS_OUTPUT = T.StructType(
    [
        T.StructField("chain_id", T.StringType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("receipt_hash", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)


class _Witness(StatefulProcessor):
    """Counts a chain's receipts since its last checkpoint; a timer covers slow chains."""

    def __init__(self, every: int, after_ms: int, event_time: bool):
        self.every, self.after_ms, self.event_time = every, after_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", "since long, sequence long, receipt_hash string, anchored long, timed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since, last, digest, anchored, timed = self.state.get() or (0, 0, None, 0, False)
        out, news = [], None
        for batch in rows:
            if self.event_time and not pd.isna(batch["at_ms"].max()):
                news = max(news or 0, int(batch["at_ms"].max()))
            ordered = batch.sort_values("sequence", kind="stable", na_position="first")
            places = ordered["sequence"].fillna(0).to_numpy().astype(np.int64)
            digests = _texts(ordered["receipt_hash"])
            # Every so many rows a checkpoint, at the highest place so far.
            for end in [*range(self.every - since, len(places) + 1, self.every), None]:
                upto = len(places) if end is None else end
                if upto and places[upto - 1] > last:
                    last = int(places[upto - 1])
                    digest = digests[np.searchsorted(places, last)]
                if end is not None and last > anchored:
                    anchored = last
                    out.append((key[0], last, digest, "cadence"))
            since = (since + len(places)) % self.every
        if last > anchored and not timed:
            timed = True
            clock = timerValues.getCurrentProcessingTimeInMs()
            due = (clock if news is None else news) + self.after_ms
            # News older than the watermark are due as soon as it moves.
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1) if self.event_time else due)
        self.state.update((since, last, digest, anchored, timed))
        if out:
            yield pd.DataFrame(out, columns=WITNESS_OUTPUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since, last, digest, anchored, _ = self.state.get()
        if last > anchored:
            self.state.update((0, last, digest, last, False))
            yield pd.DataFrame([(key[0], last, digest, "elapsed")], columns=WITNESS_OUTPUT.names)
        else:
            self.state.update((since, last, digest, anchored, False))

    def close(self) -> None:
        pass


def stream_checkpoints(source: DataFrame, every: int = 1000, after_ms: int = 300_000, late: str | None = None) -> DataFrame:
    """X4. A checkpoint after every ``every`` receipts of a chain, or ``after_ms`` after activity.

    ``source``: chain_id, sequence, receipt_hash and, with ``late``, ts: then the time is that of
    the watermark, the latest ts less ``late``; otherwise it is the clock's. Receipts without a
    sequence count, but a checkpoint names the highest sequence seen, and is not made before there is
    one; receipts without a time count as coming by the clock.
    """
    _needs_rocksdb(source.sparkSession)
    columns = ["chain_id", "sequence", "receipt_hash"]
    if late is None:
        keyed, mode = source.select(*columns), "ProcessingTime"
    else:
        timed = event_time(source).withWatermark("ts", late)
        # Without the watermark's own column: it would take away rows older than the watermark.
        keyed, mode = timed.select(*columns, F.unix_millis("ts").alias("at_ms")), "EventTime"
    return keyed.groupBy("chain_id").transformWithStateInPandas(
        _Witness(every, after_ms, late is not None), WITNESS_OUTPUT, "Append", mode
    )


def stream_unanswered(
    intents: DataFrame, results: DataFrame, bound: str = "10 minutes", late: str = "5 minutes"
) -> DataFrame:
    """X5. Calls with no result within ``bound``; intents and results: call_id, ts."""
    asked = event_time(intents).select("call_id", F.col("ts").alias("asked_at")).withWatermark("asked_at", late)
    answered = (
        event_time(results)
        .select(F.col("call_id").alias("answered_id"), F.col("ts").alias("answered_at"))
        .withWatermark("answered_at", late)
    )
    within = F.expr(f"answered_at >= asked_at AND answered_at <= asked_at + interval {bound}")
    joined = asked.join(answered, (F.col("call_id") == F.col("answered_id")) & within, "left_outer")
    return joined.filter("answered_id IS NULL").select("call_id", "asked_at")


def stream_rates(source: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """X6. Ingest outcomes per tumbling window; source: ts, outcome."""
    return (
        event_time(source)
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width))
        .agg(*[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in OUTCOMES])
        .select(F.col("window.start").alias("bucket"), *OUTCOMES)
    )


def stream_sessions(source: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """X7. Runs of activity per session and agent that no pause longer than ``gap`` interrupts."""
    return (
        event_time(source)
        .withWatermark("ts", late)
        .groupBy("session_id", "agent_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
        .select("session_id", "agent_id", F.col("session_window.start").alias("first_ts"), "last_ts", "n")
    )


def stream_drops(source: DataFrame, width: str = "1 day", late: str = "10 minutes", drop_action: str = fixed.DROP_ACTION) -> DataFrame:
    """X8. Lost events per session and time window."""
    return (
        event_time(source)
        .filter(F.col("action_type") == drop_action)
        .withWatermark("ts", late)
        .groupBy("session_id", F.window("ts", width))
        .agg(F.count(F.lit(1)).alias("gaps"), F.sum("drop_count").alias("dropped"))
        .select("session_id", F.col("window.start").alias("bucket"), "gaps", "dropped")
    )


def rows_behind_watermark(query: StreamingQuery) -> int:
    """Rows that X5 to X8 left out as too late, over the batches the query still remembers.

    They are in the stored trail; the batch operators over it count them.
    """
    operators = [op for progress in query.recentProgress for op in progress["stateOperators"]]
    return sum(op["numRowsDroppedByWatermark"] for op in operators)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over all that is available and read what it wrote."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(path)
