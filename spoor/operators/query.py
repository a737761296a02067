"""Filters, point look-ups, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.operators.stats import trail_stats

_EQUAL = ("chain_id", "action_type", "risk_level", "status", "session_id", "agent_id")


def _at(instant: str) -> Column:
    return F.expr(f"timestamp_ntz '{instant}'")


def query_receipts(
    df: DataFrame,
    *,
    after: str | None = None,
    before: str | None = None,
    limit: int | None = None,
    newest_first: bool = False,
    ordered: bool = True,
    **equal: str | None,
) -> DataFrame:
    """F1. Filtered list in time, sequence, ingest order; both time bounds count in."""
    unknown = set(equal) - set(_EQUAL)
    if unknown:
        raise TypeError(f"unknown filters {sorted(unknown)}")
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    if after is not None:
        df = df.filter(F.col("ts") >= _at(after))
    if before is not None:
        df = df.filter(F.col("ts") <= _at(before))
    if ordered or limit is not None:
        side = F.desc if newest_first else F.asc
        df = df.orderBy(side("ts"), side("sequence"), side("ingest_seq" if "ingest_seq" in df.columns else "id"))
    return df if limit is None else df.limit(limit)


def get_by_id(df: DataFrame, receipt_id: str) -> DataFrame:
    """F2. The receipt with an id."""
    return df.filter(F.col("id") == receipt_id)


def exists(df: DataFrame, ids: DataFrame) -> DataFrame:
    """F2. Those of ``ids`` the trail holds, each once.

    The trail is the left side, so that Spark can broadcast a short list instead of shuffling the
    trail's ids.
    """
    return df.select("id").join(ids.select("id"), "id", "left_semi").distinct()


def get_at(df: DataFrame, chain_id: str, sequence: int) -> DataFrame:
    """F2. The receipt at a place in a chain; pruned by the trail's chain and sequence order."""
    return df.filter((F.col("chain_id") == chain_id) & (F.col("sequence") == sequence))


def get_chain(df: DataFrame, chain_id: str) -> DataFrame:
    """F3. A whole chain in order."""
    return df.filter(F.col("chain_id") == chain_id).orderBy("sequence", "id")


def distinct_chains(df: DataFrame) -> DataFrame:
    """F4. Chain names, sorted."""
    return df.select("chain_id").distinct().orderBy("chain_id")


def chain_tails(df: DataFrame, columns: Sequence[str] = ("id", "receipt_hash")) -> DataFrame:
    """F5. Each chain's highest receipt; reduced before the shuffle, one pass for all chains."""
    tail = F.max_by(F.struct("sequence", *columns), F.struct("sequence", "id")).alias("t")
    return df.groupBy("chain_id").agg(tail).select("chain_id", "t.*")


def latest_root_chain(df: DataFrame, order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """F6. The root chain written to last; agent sub-chains do not count."""
    return df.filter(~F.col("chain_id").like("%/agent/%")).agg(
        F.max_by("chain_id", F.struct(*order)).alias("chain_id")
    )


def recent(df: DataFrame, n: int = 50) -> DataFrame:
    """F7. The last ``n`` receipts with the tool, or else the action type, as label."""
    label = F.coalesce(F.nullif("tool_name", F.lit("")), F.col("action_type"))
    return (
        df.select("ts", "sequence", "id", "chain_id", label.alias("label"), "risk_level", "status")
        .orderBy(F.desc("ts"), F.desc("sequence"), F.desc("id"))
        .limit(n)
    )


def since(df: DataFrame, seconds: int, as_of: str, chain_id: str | None = None) -> DataFrame:
    """F8. Receipts of the last ``seconds`` before ``as_of``, with their chain."""
    if seconds <= 0:
        raise ValueError("seconds must be positive")
    cut = F.expr(f"cast(timestamp_ntz '{as_of}' - interval '{int(seconds)}' second as timestamp_ntz)")
    out = df.filter(F.col("ts") >= cut)
    if chain_id is not None:
        out = out.filter(F.col("chain_id") == chain_id)
    return out.select("id", "chain_id", "ts")


def allow_deny(df: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = (), column: str = "tool_name") -> DataFrame:
    """F9. Keep allowed tools; deny wins, an empty allow list allows all."""
    if allow:
        df = df.filter(F.col(column).isin(*allow))
    if deny:
        df = df.filter(~F.coalesce(F.col(column).isin(*deny), F.lit(False)))
    return df


_SEARCHED = ("id", "chain_id", "action_type", "tool_name", "resource", "issuer_id", "principal_id", "error")


def search(df: DataFrame, text: str, columns: Sequence[str] = _SEARCHED) -> DataFrame:
    """F10. Receipts with ``text`` in one of the lifted fields, letter case aside."""
    needle = text.lower()
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.lower(F.col(name)).contains(needle), F.lit(False))
    return df.filter(hit)


def session_summary(df: DataFrame, **filters: str | None) -> DataFrame:
    """F11. Totals and breakdowns of a selection, as ``trail_stats``."""
    return trail_stats(query_receipts(df, ordered=False, **filters))


_OFF = ("", "false", "off", "0")
_ALL = ("true", "all", "1")


def disclosure_filter(policy: str) -> Column:
    """off / all / high / a list of action types, as a condition on a receipt."""
    word = policy.strip().lower()
    if word in _OFF:
        return F.lit(False)
    if word in _ALL:
        return F.lit(True)
    if word == "high":
        return F.col("risk_level").isin(*fixed.RISK_LEVELS[2:])
    names = [part.strip() for part in policy.split(",")]
    for name in names:
        if not name:
            raise ValueError(f"empty action type in {policy!r}")
        if name.lower() in {*_OFF, *_ALL, "high"}:
            raise ValueError(f"reserved word {name!r} in {policy!r}")
    return F.col("action_type").isin(*names)


def select_disclosable(df: DataFrame, policy: str) -> DataFrame:
    """F12. Receipts whose parameters the policy discloses."""
    return df.filter(disclosure_filter(policy))
