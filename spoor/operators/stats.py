"""Aggregations and trail analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.functions.exprs import first_of, mcp_server, mcp_tool, risk_name, risk_rank

# The range picker, in seconds.
RANGES = {"1h": 3600, "6h": 21600, "24h": 86400, "7d": 604800, "30d": 2592000, "all": None}


def trail_totals(df: DataFrame) -> DataFrame:
    """A1. Receipts and chains."""
    return df.agg(F.count(F.lit(1)).alias("receipts"), F.countDistinct("chain_id").alias("chains"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    """A2. Receipts per value, most first; ties in label order."""
    return (
        df.groupBy(F.col(column).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("label"))
    )


def trail_stats(df: DataFrame) -> DataFrame:
    """A3. Totals and the breakdowns by risk, status and action from one scan."""
    dims = ("risk_level", "status", "action_type")
    grouped = df.select(*dims).groupingSets([(), *[(d,) for d in dims]], *dims).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"__g_{d}") for d in dims]
    )
    dimension = first_of([(F.col(f"__g_{d}") == 0, d) for d in dims], "total")
    counts = grouped.select(dimension.alias("dimension"), F.coalesce(*dims).alias("label"), "n")
    # An empty selection has no groups, yet its total is 0.
    none = df.sparkSession.range(1).select(
        F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("n")
    )
    return counts.unionByName(none).groupBy("dimension", "label").agg(F.sum("n").alias("n"))


def in_range(df: DataFrame, picked: str, as_of: str) -> DataFrame:
    seconds = RANGES[picked]
    if seconds is None:
        return df
    return df.filter(F.expr(f"ts >= cast(timestamp_ntz '{as_of}' - interval '{seconds}' second as timestamp_ntz)"))


def _bucket(width: str) -> Column:
    return F.window("ts", width)["start"].alias("bucket")


def activity_timeline(df: DataFrame, width: str, picked: str = "all", as_of: str | None = None) -> DataFrame:
    """A4. Receipts per time bucket inside a picked range."""
    df = df if picked == "all" else in_range(df, picked, as_of)
    return df.groupBy(_bucket(width)).agg(F.count(F.lit(1)).alias("n"))


def _failures() -> Column:
    return F.sum((F.col("status") == "failure").cast("long"))


def error_rate_trend(df: DataFrame, width: str) -> DataFrame:
    """A5. Throughput and share of failures per time bucket."""
    return df.groupBy(_bucket(width)).agg(
        F.count(F.lit(1)).alias("n"),
        _failures().alias("failures"),
        F.round(_failures() / F.count(F.lit(1)), 6).alias("error_rate"),
    )


def actions_by_failure(df: DataFrame, k: int) -> DataFrame:
    """A6. The ``k`` action types that fail most often."""
    return (
        df.groupBy("action_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            _failures().alias("failures"),
            F.round(_failures() / F.count(F.lit(1)), 6).alias("failure_rate"),
        )
        .orderBy(F.desc("failure_rate"), F.desc("n"), "action_type")
        .limit(k)
    )


def server_breakdown(df: DataFrame) -> DataFrame:
    """A7. Receipts per server and tool with a total per server; the server comes out of the tool
    name, or else is the channel."""
    named = df.select(
        F.coalesce(mcp_server(F.col("tool_name")), F.col("channel")).alias("server"),
        mcp_tool(F.col("tool_name")).alias("tool"),
        "status",
    )
    return (
        named.rollup("server", "tool")
        .agg(
            F.count(F.lit(1)).alias("n"),
            _failures().alias("failures"),
            F.grouping_id().cast("long").alias("level"),
        )
        .filter("level < 3")
    )


def session_list(df: DataFrame) -> DataFrame:
    """A8. Sessions with their agents, chains, span, size and highest risk."""
    return df.groupBy("session_id").agg(
        F.countDistinct("agent_id").alias("agents"),
        F.countDistinct("chain_id").alias("chains"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("n"),
        risk_name(F.max(risk_rank(F.col("risk_level")))).alias("max_risk"),
    )


def chain_list(df: DataFrame) -> DataFrame:
    """A9. Chains with their length, span and termination state."""
    terminal = F.coalesce(F.col("terminal"), F.lit(False))
    grouped = df.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("length"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max_by(F.struct(terminal.alias("t"), "chain_status"), F.struct("sequence", "id")).alias("last"),
    )
    state = first_of(
        [(~F.col("last.t"), "unknown"), (F.col("last.chain_status") == "interrupted", "interrupted")],
        "complete",
    )
    return grouped.select("chain_id", "length", "first_ts", "last_ts", state.alias("chain_state"))


def usage_rollup(df: DataFrame) -> DataFrame:
    """A10. Token usage by session, agent and model, with totals (``level`` 0, 1, 3, 7)."""
    used = df.filter(F.col("usage").isNotNull()).select(
        "session_id",
        "agent_id",
        "model",
        *[F.get_json_object("usage", f"$.{f}").try_cast("long").alias(f) for f in ("input_tokens", "output_tokens")],
    )
    return used.rollup("session_id", "agent_id", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.grouping_id().cast("long").alias("level"),
    )


def drop_accounting(df: DataFrame, drop_action: str = fixed.DROP_ACTION) -> DataFrame:
    """A11. Lost events per session and chain, with session totals (``level`` 0, 1, 3)."""
    return (
        df.filter(F.col("action_type") == drop_action)
        .rollup("session_id", "chain_id")
        .agg(
            F.count(F.lit(1)).alias("gaps"),
            F.sum("drop_count").alias("dropped"),
            F.grouping_id().cast("long").alias("level"),
        )
    )


OUTCOMES = ("accepted", "conflict", "rejected", "error")


def ingest_rates(log: DataFrame, width: str) -> DataFrame:
    """A12. Ingest outcomes per time bucket, one column per outcome; ``log``: ts, outcome."""
    return log.groupBy(_bucket(width)).agg(
        *[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in OUTCOMES]
    )


def _logged(field: str) -> Column:
    quoted = F.regexp_extract("line", field + r'="((?:[^"\\]++|\\.)*+)"', 1)
    return F.regexp_replace(quoted, r'\\(["\\])', "$1")


def policy_outcomes(lines: DataFrame) -> DataFrame:
    """A13. Counts and waits per rule, action and outcome out of key=value log lines."""
    events = lines.filter(F.col("line").contains("policy_event ")).select(
        _logged("rule").alias("rule"),
        _logged("action").alias("action"),
        _logged("outcome").alias("outcome"),
        F.regexp_extract("line", r"risk=(\d+)", 1).try_cast("long").alias("risk"),
        F.regexp_extract("line", r"duration_ms=(\d+)", 1).try_cast("long").alias("ms"),
    )
    return events.groupBy("rule", "action", "outcome").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("risk").alias("max_risk"),
        F.sum("ms").alias("total_ms"),
        F.max("ms").alias("max_ms"),
        F.percentile_approx("ms", 0.5, 10000).alias("median_ms"),
    )


def unknown_share(df: DataFrame) -> DataFrame:
    """A14. How much of the trail a risk filter cannot judge."""
    unknown = F.count(F.when(F.col("action_type") == fixed.UNKNOWN_ACTION, 1))
    return df.agg(
        F.count(F.lit(1)).alias("receipts"),
        unknown.alias("unknown"),
        F.round(F.coalesce(F.try_divide(unknown, F.count(F.lit(1))), F.lit(0.0)), 6).alias("unknown_share"),
    )
