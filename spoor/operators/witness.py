"""External checkpoints, key rotation and provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.functions import fixed
from spoor.functions.carry import along, fold_along
from spoor.functions.exprs import first_of
from spoor.operators.integrity import CHAIN, IN_CHAIN, check_links


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("chain_id").agg(
        F.max_by(F.struct("sequence", "receipt_hash"), F.struct("sequence", "receipt_hash")).alias("w")
    ).select(
        "chain_id",
        F.col("w.sequence").alias("witness_sequence"),
        F.col("w.receipt_hash").alias("witness_hash"),
    )


def reconcile_witness(tails: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """V13. Compare each chain's head (chain_id, sequence, receipt_hash) with its latest checkpoint."""
    joined = tails.select(
        "chain_id",
        F.col("sequence").alias("head_sequence"),
        F.col("receipt_hash").alias("head_hash"),
    ).join(latest_checkpoints(checkpoints), "chain_id", "full")
    outcome = first_of(
        [
            (F.col("witness_sequence").isNull(), "no_checkpoint"),
            (F.col("head_sequence").isNull(), "no_receipts"),
            (F.col("witness_sequence") > F.col("head_sequence"), "truncated"),
            (F.col("witness_sequence") < F.col("head_sequence"), "store_ahead"),
            (~F.col("witness_hash").eqNullSafe(F.col("head_hash")), "hash_mismatch"),
        ],
        "pass",
    )
    return joined.select(
        "chain_id", "head_sequence", "witness_sequence", outcome.alias("witness_outcome")
    )


def checkpoint_regressions(checkpoints: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """V14. Checkpoints (chain_id, sequence, log_no) that do not rise strictly in log order."""
    placed = along(checkpoints, CHAIN, ("log_no",), lag={"previous_sequence": "sequence"}, slice_rows=slice_rows)
    return placed.filter(F.col("sequence") <= F.col("previous_sequence")).select(
        "chain_id", "log_no", "sequence", "previous_sequence"
    )


def plan_checkpoints(df: DataFrame, every: int, slice_rows: int | None = None) -> DataFrame:
    """V15. Every ``every``-th receipt of a chain and its last one."""
    placed = along(df, CHAIN, IN_CHAIN, position="__pos", total="__n", slice_rows=slice_rows)
    last = F.col("__pos") == F.col("__n")
    return placed.filter((F.col("__pos") % every == 0) | last).select(
        "chain_id",
        "sequence",
        "receipt_hash",
        F.when(F.col("__pos") % every == 0, F.lit("cadence")).otherwise(F.lit("final")).alias("reason"),
    )


def _rotation_step(
    state, genesis, event_type, signed_with, old_alg, new_alg, old_fp, new_fp, inline_fp, signed
):
    active = genesis if state is None else state
    wanted = (
        ("event_type", event_type, "key_rotated"),
        ("signed_with", signed_with, "old"),
        ("old_algorithm", old_alg, "ed25519"),
        ("new_algorithm", new_alg, "ed25519"),
        ("old_fingerprint", old_fp, active),
        ("new_fingerprint", inline_fp, new_fp),
    )
    problem = next((name for name, got, want in wanted if got != want), None)
    after = new_fp if problem is None and signed is not False else active
    return after, problem is None, problem, after


_ROTATION_OUTPUT = T.StructType(
    [
        T.StructField("rotation_ok", T.BooleanType()),
        T.StructField("rotation_problem", T.StringType()),
        T.StructField("key_after", T.StringType()),
    ]
)
_ROTATION_INPUT = (
    "genesis_fp",
    "event_type",
    "signed_with",
    "old_algorithm",
    "new_algorithm",
    "old_fp",
    "new_fp",
    "new_key_fp",
    "signature_valid",
)


def fold_rotations(rotations: DataFrame, genesis: DataFrame) -> DataFrame:
    """Judge rotations in order: each must name the key that is active when it comes.

    ``rotations``: chain_id, sequence, event_type, signed_with, old/new_algorithm, old_fp, new_fp,
    new_key_fp (fingerprint of the inline key), signature_valid. ``genesis``: chain_id,
    genesis_fp. An invalid rotation leaves the old key active.
    """
    rows = rotations.join(genesis.select("chain_id", "genesis_fp"), "chain_id", "left")
    return fold_along(rows, CHAIN, ("sequence",), _ROTATION_INPUT, _ROTATION_OUTPUT, _rotation_step)


def key_epochs(df: DataFrame, rotations: DataFrame, genesis: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """V16. The key under which each receipt must verify. Only rotation rows are folded in Python."""
    folded = fold_rotations(rotations, genesis).select(
        "chain_id", "sequence", "rotation_ok", "rotation_problem", "key_after"
    )
    rows = df.select("chain_id", "sequence", "id").join(folded, ["chain_id", "sequence"], "left")
    placed = along(
        rows, CHAIN, IN_CHAIN, last_seen={"__key": F.col("key_after")}, slice_rows=slice_rows
    )
    return placed.join(genesis.select("chain_id", "genesis_fp"), "chain_id", "left").select(
        "chain_id",
        "sequence",
        "id",
        F.coalesce("__key", "genesis_fp").alias("active_key"),
        "rotation_ok",
        "rotation_problem",
    )


def rotation_terminates(verdicts: DataFrame, rotations: DataFrame, published: DataFrame) -> DataFrame:
    """V17. Does each valid chain's last rotation install the published key?

    ``published``: chain_id, published_fp, from_archive. Only chains verified from an archived
    genesis key are asked.
    """
    last = rotations.groupBy("chain_id").agg(F.max_by("new_fp", "sequence").alias("current_fp"))
    asked = (
        published.join(verdicts.filter("valid").select("chain_id"), "chain_id")
        .join(last, "chain_id", "left")
        .filter("from_archive")
    )
    outcome = first_of(
        [
            (F.col("current_fp").isNull(), "no_rotation"),
            (F.col("current_fp") != F.col("published_fp"), "other_key"),
        ],
        "terminates",
    )
    return asked.select("chain_id", "current_fp", "published_fp", outcome.alias("rotation_outcome"))


def version_check_expr(column: str = "version", current: str = fixed.CURRENT_VERSION):
    """known / unknown / unparseable / missing, by the part before the first dot."""
    version = F.coalesce(F.col(column), F.lit(""))
    major = F.when(version.contains("."), F.split_part(version, F.lit("."), F.lit(1))).otherwise(F.lit(""))
    return first_of(
        [
            (version == "", "missing"),
            (major == "", "unparseable"),
            (major != current.split(".")[0], "unknown"),
        ],
        "known",
    )


def provenance_verdicts(
    df: DataFrame,
    allowlist: DataFrame | None = None,
    signature_col: str | None = None,
    slice_rows: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """V18. Six checks per receipt and the provenance verdict they give.

    ``allowlist``: exe_path. A path outside it warns; it never lowers the verdict.
    """
    checked = check_links(df, signature_col, slice_rows, columns)
    plain_ok = F.col("signature_ok") & F.col("hash_link_ok") & F.col("sequence_ok")
    rows = along(
        checked,
        CHAIN,
        ("index",),
        lead={"__next_ok": "sequence_ok"},
        lowest={
            "__break": F.when(~F.col("hash_link_ok"), F.col("index")),
            "__plain_ok": plain_ok,
            "__whole": F.col("status_problem").isNull() & ~F.col("follows_terminal"),
        },
        slice_rows=slice_rows,
        dealt=True,
    )
    platform = F.coalesce(F.col("peer_platform"), F.lit(""))
    peer = first_of(
        [
            (~F.col("has_peer"), "n/a"),
            (platform == "", "fail"),
            (~platform.isin("linux", "darwin"), "n/a"),
            (F.col("peer_uid").isNull() | F.col("peer_gid").isNull(), "fail"),
        ],
        "pass",
    )
    path = F.coalesce(F.col("exe_path"), F.lit(""))
    if allowlist is None:
        emitter = F.lit("n/a")
    else:
        allowed = allowlist.select(F.col("exe_path"), F.lit(True).alias("__allowed")).distinct()
        rows = rows.join(allowed, "exe_path", "left")
        emitter = first_of(
            [
                (~F.col("has_peer") | (path == ""), "n/a"),
                (F.col("__allowed"), "pass"),
            ],
            "warn",
        )
    version = F.when(version_check_expr() == "known", F.lit("pass")).otherwise(F.lit("fail"))
    context_bad = (
        ~F.col("sequence_ok")
        | ~F.coalesce(F.col("__next_ok"), F.lit(True))
        | (F.col("__plain_ok") & ~F.col("__whole"))
    )

    def passed(ok):
        return F.when(ok, F.lit("pass")).otherwise(F.lit("fail"))

    rows = (
        rows.withColumn("check_signature", passed(F.col("signature_ok")))
        .withColumn("check_linkage", passed(F.col("__break").isNull()))
        .withColumn("check_peer", peer)
        .withColumn("check_emitter", emitter)
        .withColumn("check_version", version)
        .withColumn("check_context", passed(~context_bad))
    )
    failed = F.lit(False)
    for name in ("signature", "linkage", "peer", "emitter", "version", "context"):
        failed = failed | (F.col(f"check_{name}") == "fail")
    verdict = first_of(
        [(failed, "failed"), (F.col("check_peer") == "n/a", "no_provenance")], "confirmed"
    )
    return rows.select(
        "chain_id",
        "sequence",
        "id",
        "check_signature",
        "check_linkage",
        "check_peer",
        "check_emitter",
        "check_version",
        "check_context",
        verdict.alias("provenance"),
    )


def trust_verdict(verdicts: DataFrame, witness: DataFrame) -> DataFrame:
    """V19. Internal consistency and external anchoring folded into full / qualified / fail.

    ``qualified`` includes chains whose tail may be cut: only a witness can tell.
    """
    anchored = F.coalesce(F.col("witness_outcome") == "pass", F.lit(False))
    trust = first_of([(~F.col("valid"), "fail"), (anchored, "full")], "qualified")
    return verdicts.join(witness.select("chain_id", "witness_outcome"), "chain_id", "left").select(
        "chain_id",
        "valid",
        F.coalesce("witness_outcome", F.lit("no_checkpoint")).alias("witness_outcome"),
        trust.alias("trust"),
    )
