"""Hash chains: sealing, link checks and chain verdicts for all chains in one job."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.functions import fixed
from spoor.functions.carry import along, fold_along, tasks_for
from spoor.functions.exprs import first_of, hash_content, receipt_hash
from spoor.session import scratch_path

CHAIN = ("chain_id",)
IN_CHAIN = ("sequence", "id")
SEAL_SLICE_ROWS = 20_000_000


def content_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """V1. Recompute every receipt's hash from its own columns and its stored previous hash.

    ``columns`` are those it was sealed with; by default all content columns of the table.
    """
    return df.withColumn("computed_hash", receipt_hash(df, columns))


def _seal_step(state, content, first_previous):
    previous = first_previous if state is None else state
    tail = "-" if previous is None else f"{len(previous)}:{previous}"
    sealed = "sha256:" + hashlib.sha256((content + tail).encode()).hexdigest()
    return sealed, previous, sealed


_SEAL_OUTPUT = T.StructType(
    [
        T.StructField("previous_receipt_hash", T.StringType()),
        T.StructField("receipt_hash", T.StringType()),
    ]
)


def seal_chains(
    df: DataFrame,
    order: Sequence[str] = ("sequence",),
    columns: Sequence[str] | None = None,
    slice_rows: int = SEAL_SLICE_ROWS,
) -> DataFrame:
    """V2. Number each chain 1..n along ``order`` and link every row to its predecessor's hash.

    Each hash needs the one before, so a chain is serial; chains run in parallel. Chains longer
    than ``slice_rows`` are sealed slice by slice: a round seals one slice of every chain that
    long, writes it to the shared folder and hands its last hashes to the next round, so no task
    sees more than a slice of a chain and a lost executor repeats one slice only.
    """
    spark = df.sparkSession
    counted, longest = df.groupBy(*CHAIN).count().agg(F.sum("count"), F.max("count")).first()
    rounds = -(-(longest or 0) // slice_rows)

    def with_content(numbered: DataFrame) -> DataFrame:
        numbered = numbered.withColumn("sequence", F.col("__seq")).drop("__seq")
        return numbered.withColumn("__content", hash_content(numbered, columns))

    if rounds <= 1:
        # Chains are dealt out once; numbering and sealing run in the same tasks.
        place = F.row_number().over(Window.partitionBy(*CHAIN).orderBy(*order)).cast("long")
        dealt = df.repartition(tasks_for(spark, counted or 0), *CHAIN)
        rows = with_content(dealt.withColumn("__seq", place)).withColumn("__from", F.lit(None).cast("string"))
        return _seal_rows(rows, dealt=True)
    numbered = with_content(along(df, CHAIN, order, position="__seq"))
    # Numbered once; each round then reads its own folder only.
    path = scratch_path(spark, "sealed")
    turn_of = F.floor((F.col("sequence") - 1) / slice_rows)
    numbered.withColumn("turn", turn_of).write.partitionBy("turn").parquet(f"{path}/numbered")
    heads = None
    for turn in range(rounds):
        rows = spark.read.schema(numbered.schema).parquet(f"{path}/numbered/turn={turn}")
        if heads is None:
            rows = rows.withColumn("__from", F.lit(None).cast("string"))
        else:
            rows = rows.join(heads, "chain_id")
        _seal_rows(rows).write.parquet(f"{path}/done/turn={turn}")
        done = spark.read.parquet(f"{path}/done/turn={turn}")
        heads = done.groupBy(*CHAIN).agg(F.max_by("receipt_hash", "sequence").alias("__from"))
    return spark.read.parquet(f"{path}/done").drop("turn")


def _seal_rows(rows: DataFrame, dealt: bool = False) -> DataFrame:
    sealed = fold_along(rows, CHAIN, ("sequence",), ("__content", "__from"), _SEAL_OUTPUT, _seal_step, dealt)
    return sealed.drop("__content", "__from")


def status_problem() -> Column:
    """Why ``chain_status`` is not allowed here, or null."""
    value = F.coalesce(F.col("chain_status"), F.lit(""))
    return first_of(
        [
            (value == "", F.lit(None).cast("string")),
            (~value.isin(*fixed.CHAIN_STATUSES), "invalid_status"),
            (~F.coalesce(F.col("terminal"), F.lit(False)), "status_without_terminal"),
        ]
    )


def check_links(
    df: DataFrame,
    signature_col: str | None = None,
    slice_rows: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """V3. Per-receipt checks along every chain; ``columns`` are those the chains were sealed with.

    ``index`` is the 0-based place in the chain. A receipt's link holds when its stored previous
    hash equals the hash recomputed from its neighbour, or is absent at the start; its sequence
    holds when it is one above the neighbour's, or at least 1 at the start.
    """
    rows = content_hash(df, columns)
    placed = along(
        rows,
        CHAIN,
        IN_CHAIN,
        position="__pos",
        lag={"__prev_hash": "computed_hash", "__prev_seq": "sequence", "__prev_terminal": "terminal"},
        slice_rows=slice_rows,
    )
    start = F.col("__pos") == 1
    link = F.when(start, F.col("previous_receipt_hash").isNull()).otherwise(
        F.coalesce(F.col("previous_receipt_hash") == F.col("__prev_hash"), F.lit(False))
    )
    contiguous = F.when(start, F.col("sequence") >= 1).otherwise(
        F.col("sequence") == F.col("__prev_seq") + 1
    )
    signed = F.coalesce(F.col(signature_col), F.lit(True)) if signature_col else F.lit(True)
    return (
        placed.withColumn("index", F.col("__pos") - 1)
        .withColumn("signature_ok", signed)
        .withColumn("hash_link_ok", link)
        .withColumn("sequence_ok", F.coalesce(contiguous, F.lit(False)))
        .withColumn("status_problem", status_problem())
        .withColumn("follows_terminal", F.coalesce(F.col("__prev_terminal"), F.lit(False)))
        .drop("__pos", "__prev_hash", "__prev_seq", "__prev_terminal")
    )


def receipt_status(checked: DataFrame) -> DataFrame:
    """V21. The first failing check of each receipt as a code; takes ``check_links`` output."""
    code = first_of(
        [
            (~F.col("signature_ok"), "bad_signature"),
            (~F.col("hash_link_ok"), "bad_hash_link"),
            (~F.col("sequence_ok"), "bad_sequence"),
        ],
        "ok",
    )
    return checked.withColumn("receipt_status", code)


def _is_terminal() -> Column:
    return F.coalesce(F.col("terminal"), F.lit(False))


def verify_chains(
    df: DataFrame,
    signature_col: str | None = None,
    rotation_ok_col: str | None = None,
    slice_rows: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """V4. One verdict per chain: valid, length, status, where and why it breaks first.

    At one index signature outranks rotation, hash link, sequence and schema. A receipt after a
    terminal one breaks the chain at its index when that is the lowest.
    """
    return chain_verdicts(check_links(df, signature_col, slice_rows, columns), rotation_ok_col)


def chain_verdicts(checked: DataFrame, rotation_ok_col: str | None = None) -> DataFrame:
    """The chain-level half of V4; takes ``check_links`` output."""
    rotation_bad = (
        ~F.coalesce(F.col(rotation_ok_col), F.lit(True)) if rotation_ok_col else F.lit(False)
    )
    index = F.col("index")
    at = {
        "signature": F.min(F.when(~F.col("signature_ok"), index)),
        "rotation": F.min(F.when(rotation_bad, index)),
        "hash_link": F.min(F.when(~F.col("hash_link_ok"), index)),
        "sequence": F.min(F.when(~F.col("sequence_ok"), index)),
        "schema": F.min(F.when(F.col("status_problem").isNotNull(), index)),
    }
    grouped = checked.groupBy(*CHAIN).agg(
        F.count(F.lit(1)).alias("length"),
        *[expr.alias(f"__{cause}") for cause, expr in at.items()],
        F.min(F.when(_is_terminal(), index)).alias("__terminal"),
        F.max_by(_is_terminal(), "index").alias("__closed"),
        F.max_by("chain_status", "index").alias("__status"),
        F.max_by("status", "index").alias("__last_outcome"),
        F.max_by("computed_hash", "index").alias("head_hash"),
        F.max("sequence").alias("head_sequence"),
        F.sum((F.col("action_type") == fixed.PTY_OPEN).cast("long")).alias("__opens"),
        F.sum((F.col("action_type") == fixed.PTY_CLOSE).cast("long")).alias("__closes"),
    )
    lowest = F.least(*[F.col(f"__{cause}") for cause in at])
    after = F.when(F.col("__terminal") < F.col("length") - 1, F.col("__terminal") + 1)
    grouped = grouped.withColumn("__after", after).withColumn("__low", lowest)
    cause = first_of([(F.col(f"__{c}") == F.col("__low"), c) for c in at])
    by_after = F.col("__after").isNotNull() & (
        F.col("__low").isNull() | (F.col("__after") < F.col("__low"))
    )
    broken_at = F.when(by_after, F.col("__after")).otherwise(F.col("__low"))
    return grouped.select(
        *CHAIN,
        (F.col("__low").isNull() & F.col("__after").isNull()).alias("valid"),
        "length",
        first_of(
            [(~F.col("__closed"), "unknown"), (F.col("__status") == "interrupted", "interrupted")],
            "complete",
        ).alias("chain_state"),
        F.coalesce(broken_at, F.lit(-1)).cast("long").alias("broken_at"),
        F.when(by_after, F.lit("after_terminal")).otherwise(cause).alias("cause"),
        "head_sequence",
        "head_hash",
        (~F.col("__closed") & (F.col("__last_outcome") == "pending")).alias("incomplete_roundtrip"),
        (F.col("__opens") != F.col("__closes")).alias("unbalanced_session"),
    )


def after_terminal(df: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """V5. Receipts placed right behind a terminal receipt."""
    placed = along(df, CHAIN, IN_CHAIN, position="__pos", lag={"__t": "terminal"}, slice_rows=slice_rows)
    return placed.filter("__t").select("chain_id", "sequence", "id", (F.col("__pos") - 1).alias("index"))


def status_violations(df: DataFrame) -> DataFrame:
    """V6. Receipts whose chain status has no allowed value or comes without a terminal mark."""
    return (
        df.withColumn("problem", status_problem())
        .filter(F.col("problem").isNotNull())
        .select("chain_id", "sequence", "id", "chain_status", "problem")
    )


def cross_chain_splices(df: DataFrame) -> DataFrame:
    """V7. Links whose predecessor hash belongs to another chain.

    The hash side is reduced to one row per hash first, so copies of a receipt cannot multiply.
    """
    owners = df.groupBy(F.col("receipt_hash").alias("previous_receipt_hash")).agg(
        F.min("chain_id").alias("__first"), F.max("chain_id").alias("__last")
    )
    other = F.when(F.col("__first") != F.col("chain_id"), F.col("__first")).when(
        F.col("__last") != F.col("chain_id"), F.col("__last")
    )
    return (
        df.filter(F.col("previous_receipt_hash").isNotNull())
        .join(owners, "previous_receipt_hash")
        .withColumn("other_chain_id", other)
        .filter(F.col("other_chain_id").isNotNull())
        .select("chain_id", "sequence", "id", "previous_receipt_hash", "other_chain_id")
    )


def duplicate_operations(df: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """V8. Receipts sharing a non-empty idempotency key inside their chain; advisory.

    One row per receipt with its index and the number of sharers, so a hot key makes rows, not
    one long array.
    """
    placed = along(df, CHAIN, IN_CHAIN, position="__pos", slice_rows=slice_rows)
    keyed = placed.filter(F.coalesce(F.col("idempotency_key"), F.lit("")) != "")
    shared = (
        df.filter(F.coalesce(F.col("idempotency_key"), F.lit("")) != "")
        .groupBy("chain_id", "idempotency_key")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter(F.col("occurrences") > 1)
    )
    return keyed.join(shared, ["chain_id", "idempotency_key"]).select(
        "chain_id", "idempotency_key", (F.col("__pos") - 1).alias("index"), "id", "occurrences"
    )


def incomplete_roundtrips(df: DataFrame) -> DataFrame:
    """V9. Chains whose last receipt is open and pending."""
    last = df.groupBy(*CHAIN).agg(
        F.max_by(F.struct("id", "status", "terminal"), F.struct(*IN_CHAIN)).alias("last"),
        F.max("sequence").alias("sequence"),
    )
    return last.filter(
        (F.col("last.status") == "pending") & ~F.coalesce(F.col("last.terminal"), F.lit(False))
    ).select("chain_id", "sequence", F.col("last.id").alias("id"))


def unbalanced_sessions(df: DataFrame) -> DataFrame:
    """V10. Chains whose interactive sessions are not opened as often as closed."""
    return (
        df.filter(F.col("action_type").isin(fixed.PTY_OPEN, fixed.PTY_CLOSE))
        .groupBy(*CHAIN)
        .agg(
            F.sum((F.col("action_type") == fixed.PTY_OPEN).cast("long")).alias("opens"),
            F.sum((F.col("action_type") == fixed.PTY_CLOSE).cast("long")).alias("closes"),
        )
        .filter("opens <> closes")
    )


def verify_against_expected(verdicts: DataFrame, expected: DataFrame) -> DataFrame:
    """V11. Out-of-band expectations on otherwise valid chains.

    ``expected``: chain_id, expected_length, expected_final_hash, require_terminal. A chain that
    is expected but absent counts as empty.
    """
    joined = expected.join(verdicts, "chain_id", "left")
    length = F.coalesce(F.col("length"), F.lit(0))
    empty = F.col("length").isNull()
    outcome = first_of(
        [
            (empty & (F.coalesce(F.col("expected_length"), F.lit(0)) == 0), "ok"),
            (empty, "length_mismatch"),
            (~F.col("valid"), "already_broken"),
            (F.col("expected_length").isNotNull() & (F.col("expected_length") != length), "length_mismatch"),
            (
                (F.coalesce(F.col("expected_final_hash"), F.lit("")) != "")
                & (F.col("expected_final_hash") != F.col("head_hash")),
                "final_hash_mismatch",
            ),
            (
                F.coalesce(F.col("require_terminal"), F.lit(False)) & (F.col("chain_state") == "unknown"),
                "not_terminal",
            ),
        ],
        "ok",
    )
    broken_at = first_of(
        [
            (outcome == "ok", F.lit(-1)),
            (empty, F.lit(0)),
            (outcome == "already_broken", F.col("broken_at")),
        ],
        F.col("length") - 1,
    )
    return joined.select(
        "chain_id",
        length.alias("length"),
        outcome.alias("outcome"),
        broken_at.cast("long").alias("broken_at"),
    )


def verify_responses(df: DataFrame, bodies: DataFrame) -> DataFrame:
    """V12. Compare each recorded response hash with the body's; ``bodies``: id, body.

    A missing body is a note, not a failure.
    """
    recorded = df.filter(F.coalesce(F.col("response_hash"), F.lit("")) != "")
    # Hashed before the shuffle, so bodies do not travel.
    hashed = bodies.select("id", F.concat(F.lit("sha256:"), F.sha2("body", 256)).alias("computed"))
    hashed = hashed.groupBy("id").agg(F.max("computed").alias("computed"))
    result = first_of(
        [(F.col("computed").isNull(), "body_absent"), (F.col("computed") == F.col("response_hash"), "match")],
        "mismatch",
    )
    return recorded.join(hashed, "id", "left").select(
        "chain_id", "sequence", "id", result.alias("response_check")
    )


def health_summary(verdicts: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """V20. Chains OK, broken, open and empty; ``chains`` names all chains that should exist."""
    if chains is not None:
        verdicts = chains.select("chain_id").distinct().join(verdicts, "chain_id", "left")
    state = first_of(
        [
            (F.col("length").isNull(), "empty"),
            (~F.col("valid"), "broken"),
            (F.col("chain_state") == "unknown", "open"),
        ],
        "ok",
    )
    return (
        verdicts.withColumn("health", state)
        .groupBy("health")
        .agg(
            F.count(F.lit(1)).alias("chains"),
            F.coalesce(F.sum("length"), F.lit(0)).alias("receipts"),
            F.sum(F.coalesce(F.col("incomplete_roundtrip"), F.lit(False)).cast("long")).alias(
                "incomplete_roundtrips"
            ),
            F.sum(F.coalesce(F.col("unbalanced_session"), F.lit(False)).cast("long")).alias(
                "unbalanced_sessions"
            ),
        )
    )


def open_chains(df: DataFrame, as_of: str, idle_seconds: int) -> DataFrame:
    """V22. Chains without a terminal row and idle since ``as_of - idle``, with the closing row's
    sequence and previous hash."""
    tails = df.groupBy(*CHAIN).agg(
        F.max_by(F.struct("sequence", "receipt_hash"), F.struct(*IN_CHAIN)).alias("tail"),
        F.max("ts").alias("last_ts"),
        F.max(_is_terminal()).alias("closed"),
    )
    limit = F.expr(f"cast(timestamp_ntz '{as_of}' - interval '{int(idle_seconds)}' second as timestamp_ntz)")
    return tails.filter(~F.col("closed") & (F.col("last_ts") <= limit)).select(
        "chain_id",
        "last_ts",
        (F.col("tail.sequence") + 1).alias("closing_sequence"),
        F.col("tail.receipt_hash").alias("closing_previous_hash"),
    )
