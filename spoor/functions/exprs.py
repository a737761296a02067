"""Column expressions shared by several operators. All stay inside generated JVM code."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.functions import fixed

# The columns of a receipt's content, by name. A receipt hash covers those that the table has; only
# the hashes themselves and the proof are left out.
HASH_COLUMNS = (
    "action_type",
    "after_hash",
    "agent_id",
    "before_hash",
    "chain_id",
    "chain_status",
    "correlation_id",
    "delegator_id",
    "drop_count",
    "error",
    "exe_path",
    "grant_ref",
    "id",
    "idempotency_key",
    "issuer_id",
    "model",
    "parent_chain_id",
    "parent_receipt_id",
    "peer_gid",
    "peer_pid",
    "peer_platform",
    "peer_uid",
    "principal_id",
    "resource",
    "response_hash",
    "reversal_of",
    "reversal_window_seconds",
    "reversible",
    "risk_level",
    "sequence",
    "session_id",
    "status",
    "target_system",
    "terminal",
    "tool_name",
    "ts",
    "version",
)


def hashed_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """``columns``, or all content columns of the table; in either case sorted by name."""
    return sorted(columns if columns is not None else set(HASH_COLUMNS) & set(df.columns))


def risk_rank(risk: Column) -> Column:
    """low = 1 .. critical = 4, null for anything else."""
    out = F.lit(None).cast("int")
    for rank, level in enumerate(fixed.RISK_LEVELS, start=1):
        out = F.when(risk == level, F.lit(rank)).otherwise(out)
    return out


def risk_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(level) for level in fixed.RISK_LEVELS]), rank.cast("int"))


def instant_text(ts: Column) -> Column:
    """A time as text with microseconds, the same for any session zone when it has no zone."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less time, whatever the session zone."""
    minutes = F.unix_date(F.to_date(ts)).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    seconds = F.extract(F.lit("SECOND"), ts)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("long")


def hash_field(value: Column) -> Column:
    """``length:value``, or ``-`` for null, so that no two lists of fields join to the same text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hash_content(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The hashed columns of a table as one text; times are written the same in any session zone."""

    def text(name: str) -> Column:
        timed = isinstance(df.schema[name].dataType, T.TimestampType | T.TimestampNTZType)
        return instant_text(F.col(name)) if timed else F.col(name)

    return F.concat(*[hash_field(text(c)) for c in hashed_columns(df, columns)])


def sha256_ref(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def receipt_hash(
    df: DataFrame, columns: Sequence[str] | None = None, previous: str = "previous_receipt_hash"
) -> Column:
    return sha256_ref(F.concat(hash_content(df, columns), hash_field(F.col(previous))))


def is_one_json(text: Column) -> Column:
    """True when the text is exactly one JSON value; the parser alone would ignore what follows it."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1, F.lit(False))


def is_json_text(text: Column) -> Column:
    """Like ``is_one_json``, but an object may name a key twice, which JSON does not forbid."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))


def canonical_uri(raw: Column) -> Column:
    """scheme://host/path in lower-case scheme and host, without query, fragment, end slashes.

    Text that is no such URI only loses its query and fragment.
    """
    pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]+)([^?#\s]*)(?:[?#].*)?$"
    user_at_host = F.regexp_extract(raw, pattern, 2)
    host = F.lower(F.regexp_replace(user_at_host, r"^.*@", ""))
    path = F.regexp_replace(F.regexp_extract(raw, pattern, 3), r"/+$", "")
    rebuilt = F.concat(F.lower(F.regexp_extract(raw, pattern, 1)), F.lit("://"), host, path)
    stripped = F.trim(F.regexp_replace(raw, r"(?s)[?#].*$", ""))
    return F.when(raw.rlike(pattern), rebuilt).otherwise(stripped)


def glob_to_regex(glob: str) -> str | None:
    """An anchored regular expression for a glob, or None when the glob is malformed.

    ``*`` and ``?`` do not cross ``/``; ``[...]`` is a class; ``\\`` takes the next character as is.
    """
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "\\":
            i += 1
            if i == len(glob):
                return None
            out.append(re.escape(glob[i]))
        elif ch == "[":
            found = re.compile(r"\[(\^?)((?:\\.|[^\]\\\-])(?:-(?:\\.|[^\]\\\-]))?"
                               r"(?:(?:\\.|[^\]\\\-])(?:-(?:\\.|[^\]\\\-]))?)*)\]").match(glob, i)
            if not found:
                return None
            body = re.sub(r"([\[&~])", r"\\\1", found.group(2))
            out.append(f"[{found.group(1)}{body}]")
            i = found.end() - 1
        else:
            out.append(re.escape(ch))
        i += 1
    return f"^{''.join(out)}$"


def any_of(column: Column, words: Sequence[str], how: str) -> Column:
    """True when ``column`` starts with, ends with or contains one of ``words``."""
    out = F.lit(False)
    for word in words:
        out = out | getattr(column, how)(word)
    return out


def mcp_server(tool: Column) -> Column:
    """Server part of ``mcp__server__tool``; null for other names."""
    return F.nullif(F.regexp_extract(tool, r"^mcp__(.*?)__.+$", 1), F.lit(""))


def mcp_tool(tool: Column) -> Column:
    """Tool part of ``mcp__server__tool``; other names unchanged."""
    bare = F.regexp_extract(tool, r"^mcp__.*?__(.+)$", 1)
    return F.when(bare != "", bare).otherwise(tool)


def first_of(pairs: Sequence[tuple[Column, Column | str]], default=None) -> Column:
    """The value of the first true condition, in the order given."""
    out = None
    for condition, value in pairs:
        value = F.lit(value) if isinstance(value, (str, int)) else value
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(F.lit(default) if isinstance(default, (str, int)) else default)


def fixed_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of literals whose size Spark knows, so that joins with it broadcast it.

    ``createDataFrame`` makes a table of unknown size, which would shuffle the other side.
    """
    fields = T.StructType.fromDDL(schema).fields
    entries = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(fields, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*entries)))
