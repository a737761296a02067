"""Ingest gates and data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.functions.exprs import first_of, is_one_json, risk_rank
from spoor.operators.query import exists
from spoor.operators.witness import version_check_expr


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def gate_structure(parsed: DataFrame) -> DataFrame:
    """Q1. Name the first reason to reject a document, null when it is accepted.

    Takes ``parse_receipts`` output.
    """
    text = F.trim("receipt_json")
    malformed = (
        ~text.startswith("{")
        | ~is_one_json(F.col("receipt_json"))
        | F.col("r._corrupt").isNotNull()
    )
    subject = "r.credentialSubject"
    reason = first_of(
        [
            (_blank("receipt_json"), "empty_body"),
            (malformed, "malformed_json"),
            (_blank("r.id"), "missing_id"),
            (_blank(f"{subject}.chain.chain_id"), "missing_chain_id"),
            (_blank(f"{subject}.action.type"), "missing_action_type"),
            (_blank("r.proof.proofValue"), "missing_proof"),
        ]
    )
    return parsed.withColumn("reject_reason", reason)


def dedupe_ids(df: DataFrame, order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """Q2. The first row of every id.

    Copies are reduced before the shuffle, so an id that repeats without end costs one row per
    task.
    """
    rest = [c for c in df.columns if c != "id"]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy("id").agg(first).select("id", *[F.col(f"row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def merge_new(existing: DataFrame, incoming: DataFrame, order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """Q2. The incoming rows to append: first per id, ids already stored left out.

    The stored ids are first cut down to the incoming ones, which Spark can broadcast when the
    delivery is small; the stored trail is then not shuffled.
    """
    fresh = dedupe_ids(incoming, order)
    return fresh.join(exists(existing, incoming), "id", "left_anti")


def ingest_conflicts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Q3. Tell a safe retry (same id) from a fork (same chain and sequence, another id).

    One row per incoming row that is either. A slot is described by its smallest and largest
    stored id, so a crowded slot cannot multiply rows.
    """
    slot = ["chain_id", "sequence"]
    slots = (
        existing.select("id", *slot)
        .join(incoming.select(*slot).distinct(), slot, "left_semi")
        .groupBy(*slot)
        .agg(F.min("id").alias("__low"), F.max("id").alias("__high"))
    )
    stored = exists(existing, incoming).withColumn("__stored", F.lit(True))
    other = F.when(F.col("__low") != F.col("id"), F.col("__low")).when(F.col("__high") != F.col("id"), F.col("__high"))
    kind = first_of([(F.col("__stored"), "retry"), (other.isNotNull(), "fork")])
    return (
        incoming.select("id", "chain_id", "sequence")
        .join(stored, "id", "left")
        .join(slots, slot, "left")
        .withColumn("conflict", kind)
        .filter(F.col("conflict").isNotNull())
        .select("id", "chain_id", "sequence", "conflict", F.when(F.col("conflict") == "fork", other).alias("holder_id"))
    )


def forked_slots(df: DataFrame) -> DataFrame:
    """Q3. Chain places held by more than one id."""
    return (
        df.groupBy("chain_id", "sequence")
        .agg(F.countDistinct("id").alias("ids"))
        .filter(F.col("ids") > 1)
    )


_KEYS_ONLY = "id string, credentialSubject struct<chain: struct<chain_id: string, sequence: string>>"


def key_parity(df: DataFrame) -> DataFrame:
    """Q4. Lifted id, chain and sequence that disagree with the document; absent fields pass.

    The document is parsed once, for these fields only.
    """
    keys = df.select("id", "chain_id", "sequence", F.from_json("receipt_json", _KEYS_ONLY).alias("k"))
    chain = "k.credentialSubject.chain"
    pairs = [
        ("id", "k.id", F.col("id")),
        ("chain_id", f"{chain}.chain_id", F.col("chain_id")),
        ("sequence", f"{chain}.sequence", F.col("sequence").cast("string")),
    ]
    checks = [(F.col(raw).isNotNull() & ~F.col(raw).eqNullSafe(lifted), name) for name, raw, lifted in pairs]
    # An array of none or one instead of a filter: a filter would be pushed below and parse again.
    found = F.explode(F.array_compact(F.array(first_of(checks))))
    return keys.select("id", "chain_id", "sequence", found.alias("mismatch"))


_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"

# Frame fields with a byte cap, in the order they are checked.
_CAPPED_BEFORE_OPERATOR = ("issuer_name", "issuer_model", "operator_id", "operator_name")
_CAPPED_AFTER_OPERATOR = ("idempotency_key", "correlation_id", "agent_id")
_CAPPED_AFTER_AGENT = ("agent_type", "model", "capture_method", "target_system")


def frame_problem(version: str = "1") -> Column:
    """The first rule a raw event breaks, or null."""

    def capped(names: Sequence[str], limit: int = fixed.MAX_IDENTITY_BYTES) -> list:
        return [(F.octet_length(n) > limit, f"{n}_too_long") for n in names]

    rules = [
        (_blank("v"), "missing_v"),
        (F.col("v") != version, "unsupported_v"),
        (_blank("session_id"), "missing_session_id"),
        (_blank("ts_emit"), "missing_ts_emit"),
        (
            ~F.col("ts_emit").rlike(_INSTANT) | F.try_to_timestamp("ts_emit").isNull(),
            "bad_ts_emit",
        ),
        (_blank("channel"), "missing_channel"),
        (_blank("tool_name"), "missing_tool_name"),
        (_blank("decision"), "missing_decision"),
        (~F.col("decision").isin("allowed", "denied", "pending"), "unknown_decision"),
        (F.col("drop_count") < 0, "negative_drop_count"),
        *capped(_CAPPED_BEFORE_OPERATOR),
        (~_blank("operator_name") & _blank("operator_id"), "operator_name_without_id"),
        *capped(_CAPPED_AFTER_OPERATOR),
        (F.col("agent_id").rlike(r"[/\x00]"), "bad_agent_id"),
        *capped(_CAPPED_AFTER_AGENT),
        *capped(("target_resource",), fixed.MAX_RESOURCE_BYTES),
        (_blank("target_system") != _blank("target_resource"), "half_target"),
    ]
    return first_of(rules)


def validate_frames(df: DataFrame, version: str = "1") -> DataFrame:
    """Q5. Add ``frame_problem``: the first rule each raw event breaks."""
    return df.withColumn("frame_problem", frame_problem(version))


_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_HASH = "^sha256:[0-9a-f]{64}$"


def conformance_rules() -> list[tuple[str, str, Column]]:
    """(path, rule, fails) for the schema rules the lifted columns show."""

    def required(path: str, column: str):
        return (path, "required", F.col(column).isNull())

    def pattern(path: str, column: str, regex: str):
        return (path, "pattern", ~F.col(column).rlike(regex))

    def enum(path: str, column: str, values: Sequence[str]):
        return (path, "enum", ~F.col(column).isin(*values))

    bound = F.lit(None).cast("string")
    for version, context in fixed.VERSION_CONTEXT.items():
        bound = F.when(F.col("version") == version, F.lit(context)).otherwise(bound)
    return [
        required("id", "id"),
        pattern("id", "id", f"^urn:receipt:{_UUID}$"),
        required("version", "version"),
        enum("version", "version", list(fixed.VERSION_CONTEXT)),
        ("@context", "version_binding", F.col("context") != bound),
        required("issuer.id", "issuer_id"),
        required("principal.id", "principal_id"),
        required("action.type", "action_type"),
        required("action.risk_level", "risk_level"),
        enum("action.risk_level", "risk_level", fixed.RISK_LEVELS),
        required("action.timestamp", "ts"),
        required("outcome.status", "status"),
        enum("outcome.status", "status", fixed.OUTCOMES),
        pattern("outcome.response_hash", "response_hash", _HASH),
        pattern("outcome.reversal_of", "reversal_of", f"^urn:receipt:{_UUID}$"),
        ("outcome.reversal_window_seconds", "minimum", F.col("reversal_window_seconds") < 0),
        required("chain.chain_id", "chain_id"),
        required("chain.sequence", "sequence"),
        ("chain.sequence", "minimum", F.col("sequence") < 1),
        pattern("chain.previous_receipt_hash", "previous_receipt_hash", _HASH),
        ("chain.previous_receipt_hash", "null_at_start", (F.col("sequence") == 1) & F.col("previous_receipt_hash").isNotNull()),
        ("chain.terminal", "const", ~F.col("terminal")),
        enum("chain.status", "chain_status", fixed.CHAIN_STATUSES),
        ("correlation_id", "min_length", F.length("correlation_id") < 1),
    ]


def conformance_report(df: DataFrame) -> DataFrame:
    """Q6. Rows breaking each schema rule, rules nobody breaks included.

    All rules are counted in one aggregate; only its single row is turned into one row per rule.
    """
    rules = conformance_rules()
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.when(fails, 1)).alias(f"c{i}") for i, (_, _, fails) in enumerate(rules)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"), F.col(f"c{i}").alias("violations"))
            for i, (path, rule, _) in enumerate(rules)
        ]
    )
    return counts.select("rows", F.explode(entries).alias("e")).select("e.path", "e.rule", "e.violations", "rows")


def version_check(df: DataFrame, current: str = fixed.CURRENT_VERSION) -> DataFrame:
    """Q7. Is each receipt's major version known, unknown, unparseable or missing?"""
    return df.withColumn("version_state", version_check_expr(current=current))


def compare_expected(expected: DataFrame, actual: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Q8. Keyed comparison: missing, unexpected, differing (with the first such column), matching."""
    left = expected.select(*keys, F.struct(*cols).alias("e"))
    right = actual.select(*keys, F.struct(*cols).alias("a"))
    differing = first_of([(~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")), c) for c in cols])
    result = first_of(
        [
            (F.col("a").isNull(), "missing"),
            (F.col("e").isNull(), "unexpected"),
            (differing.isNotNull(), "differs"),
        ],
        "match",
    )
    return left.join(right, list(keys), "full").select(
        *keys, result.alias("result"), F.when(result == "differs", differing).alias("column")
    )


def resolve_references(expected: DataFrame, prefix: str = "SAME_AS_", open_mark: str = "COMPUTE_LATER") -> DataFrame:
    """Q8. Replace ``<prefix><name>`` values by the named row's literal value.

    Rows without a value, marked open, or naming a row that has no literal are left out.
    """
    value = F.coalesce(F.col("expected"), F.lit(open_mark))
    rows = expected.select("name", value.alias("expected")).filter(F.col("expected") != open_mark)
    is_reference = F.col("expected").startswith(prefix)
    literal = rows.filter(~is_reference)
    named = literal.select(F.col("name").alias("ref"), F.col("expected").alias("resolved"))
    followed = (
        rows.filter(is_reference)
        .withColumn("ref", F.expr(f"substring(expected, {len(prefix) + 1})"))
        .join(named, "ref")
        .select("name", F.col("resolved").alias("expected"))
    )
    return literal.unionByName(followed)


def set_compare(installed: DataFrame, declared: DataFrame, allowed: DataFrame) -> DataFrame:
    """Q9. Names installed but neither declared nor allowed, and allowances nobody needs.

    One aggregation over the three tagged lists takes the place of four anti joins.
    """
    tagged = None
    for tag, df in (("installed", installed), ("declared", declared), ("allowed", allowed)):
        part = df.select("name", *[F.lit(t == tag).alias(t) for t in ("installed", "declared", "allowed")])
        tagged = part if tagged is None else tagged.unionByName(part)
    flags = tagged.groupBy("name").agg(*[F.max(t).alias(t) for t in ("installed", "declared", "allowed")])
    finding = first_of(
        [
            (F.col("installed") & ~F.col("declared") & ~F.col("allowed"), "unexplained"),
            (F.col("allowed") & ~F.col("installed") & ~F.col("declared"), "stale_allowance"),
        ]
    )
    return flags.withColumn("finding", finding).filter("finding IS NOT NULL").select("name", "finding")


def coverage_matrix(df: DataFrame, set_col: str, kind_col: str) -> DataFrame:
    """Q10. Rows per set and kind, with totals per set and over all (``level`` 0, 1, 3)."""
    return (
        df.rollup(set_col, kind_col)
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))
        .select(F.col(set_col).alias("set"), F.col(kind_col).alias("kind"), "level", "n")
    )


def uncovered(df: DataFrame, set_col: str, dimension: DataFrame, dim_col: str) -> DataFrame:
    """Q10. Members of the dimension no row covers, and sets the dimension does not know."""
    have = df.select(F.col(set_col).alias("set")).distinct().withColumn("__have", F.lit(True))
    want = dimension.select(F.col(dim_col).alias("set")).distinct().withColumn("__want", F.lit(True))
    finding = first_of([(F.col("__have").isNull(), "not_covered"), (F.col("__want").isNull(), "not_in_dimension")])
    return have.join(want, "set", "full").withColumn("finding", finding).filter("finding IS NOT NULL").select("set", "finding")


def scan_patterns(docs: DataFrame, rules: Sequence[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Q11. Every line of every text that matches a rule: key, line number, rule.

    ``rules``: (name, pattern). Lines are split and tested inside the scan's tasks; no join.
    """
    lines = docs.select(key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("pos", "line"))
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in rules]))
    return lines.select(key, (F.col("pos") + 1).cast("long").alias("line_number"), F.explode(hits).alias("rule"))


def risk_downgrades(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Q12. Receipts recorded below their action type's default risk."""
    default = taxonomy.select(F.col("type").alias("action_type"), F.col("risk_level").alias("__default"))
    wanted = F.coalesce("__default", F.lit(fixed.UNKNOWN_RISK))
    return (
        df.join(default, "action_type", "left")
        .withColumn("default_risk", wanted)
        .filter(risk_rank(F.col("risk_level")) < risk_rank(F.col("default_risk")))
        .select("chain_id", "sequence", "id", "action_type", "risk_level", "default_risk")
    )


def mixed_issuer_chains(df: DataFrame) -> DataFrame:
    """Q13. Chains whose receipts name more than one issuer."""
    return df.groupBy("chain_id").agg(F.countDistinct("issuer_id").alias("issuers")).filter("issuers > 1")
