"""Secret redaction over whole texts."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.functions import fixed
from spoor.functions.exprs import is_json_text

Patterns = Sequence[tuple[str, str]]


def check_patterns(extra: Patterns) -> list[tuple[str, str]]:
    """R2. Custom (name, pattern) pairs; nameless, blank and invalid ones are refused."""
    for name, pattern in extra:
        if not name:
            raise ValueError("a pattern needs a name")
        if not (pattern or "").strip():
            raise ValueError(f"pattern {name!r} is blank")
        re.compile(pattern)
    return list(extra)


# Text every match of a built-in pattern contains. A scan for it is far cheaper than the pattern,
# and most texts hold no secret.
_MARKS = {
    "github-pat-classic": "ghp_",
    "github-pat-finegrained": "github_pat_",
    "github-oauth": "gho_",
    "github-app-installation": "ghs_",
    "github-user-to-server": "ghu_",
    "github-installation-legacy": "v1.",
    "sk-api-key": "sk-",
    "aws-access-key": "AKIA",
    "bearer-token": "Bearer",
    "jwt": "eyJ",
    "slack-token": "xox",
    "pem-private-key": "-----BEGIN ",
    "url-param-token": "=",
}


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def _replace_marked(text: Column, mark: str, pattern: str, put: str) -> Column:
    return _bound(text, lambda v: F.when(v.contains(mark), F.regexp_replace(v, pattern, put)).otherwise(v))


def redact_expr(text: Column, extra: Patterns = ()) -> Column:
    for name, pattern, keeps_group in fixed.SECRET_PATTERNS:
        text = _replace_marked(text, _MARKS[name], pattern, ("$1" if keeps_group else "") + fixed.REDACTED)
    for _, pattern in check_patterns(extra):
        text = F.regexp_replace(text, pattern, fixed.REDACTED)
    return text


def redact_text(df: DataFrame, column: str, extra: Patterns = ()) -> DataFrame:
    """R1, R2. Replace secrets in a text column; custom patterns come after the built-in ones."""
    return df.withColumn(column, redact_expr(F.col(column), extra))


_KEYS = "|".join(re.escape(k) for k in fixed.SENSITIVE_KEYS)
_PAIR = rf'(?i)("(?:{_KEYS})"\s*:\s*)'
# Possessive loops run without recursion in java.util.regex, whatever the length of the text.
_STRING = r'"((?:[^"\\]++|\\.)*+)"'
_STRING_TEXT = r'"(?:[^"\\]++|\\.)*+"'
_SCALAR = r'(?:"(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+\-]*|true|false|null)'
_TOKEN = re.compile(r'\s+|"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def redact_keys(text: str) -> str:
    """Replace the value of every sensitive key in one JSON text; all other bytes stay."""
    sensitive = set(fixed.SENSITIVE_KEYS)
    out: list[str] = []
    opened: list[str] = []
    skip_depth, armed, expect_key = None, False, False
    for token in _TOKEN.findall(text):
        if skip_depth is not None:
            if token in "{[":
                opened.append(token)
            elif token in "}]":
                opened.pop()
                if len(opened) == skip_depth:
                    skip_depth = None
            continue
        if token.isspace():
            out.append(token)
            continue
        if armed and token != ":":
            out.append(f'"{fixed.REDACTED}"')
            armed = False
            if token in "{[":
                skip_depth = len(opened)
                opened.append(token)
            continue
        out.append(token)
        if token in "{[":
            opened.append(token)
            expect_key = token == "{"
        elif token in "}]":
            opened.pop()
        elif token == ",":
            expect_key = bool(opened) and opened[-1] == "{"
        elif expect_key and token.startswith('"'):
            armed = json.loads(token).lower() in sensitive
            expect_key = False
    return "".join(out)


def _nested(levels: int) -> str:
    """An object or list of up to so many levels, read without going back and without recursion."""
    inner = rf'[^{{}}\[\]"]++|{_STRING_TEXT}'
    value = rf"[{{\[](?:{inner})*+[}}\]]"
    for _ in range(levels - 1):
        value = rf"[{{\[](?:{inner}|{value})*+[}}\]]"
    return value


# What a key holds. Only values nested deeper than this go through Python.
NESTED_LEVELS = 12
_VALUE = rf"(?:{_SCALAR}|{_nested(NESTED_LEVELS)})"


@F.arrow_udf(T.StringType())
def _redact_deep(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else redact_keys(t) for t in texts.to_pylist()], pa.string())


def redact_json_keys(df: DataFrame, column: str) -> DataFrame:
    """R3. Redact sensitive JSON keys at any depth; text that is no JSON stays as it is.

    One pass: values are replaced inside the JVM, objects and lists as well. Only texts where a
    sensitive key holds more than ``NESTED_LEVELS`` levels, or where keys may be written with
    escapes, are handed to Python.
    """
    valid = is_json_text(F.col(column))
    # All strings in turn, the keys among them told by the colon that follows; linear in the text.
    keys = F.arrays_zip(
        F.regexp_extract_all(column, F.lit(_STRING + r"(\s*+:)?+"), F.lit(1)).alias("text"),
        F.regexp_extract_all(column, F.lit(_STRING + r"(\s*+:)?+"), F.lit(2)).alias("colon"),
    )
    escaped = F.exists(keys, lambda k: (k["colon"] != "") & k["text"].contains("\\u"))
    once = F.when(valid, F.regexp_replace(column, _PAIR + _VALUE, f'$1"{fixed.REDACTED}"')).otherwise(F.col(column))
    told = df.withColumn("__valid", valid).withColumn("__once", once)
    left = F.col("__once").rlike(_PAIR + r"[\{\[]") | (F.col(column).contains("\\u") & escaped)
    told = told.withColumn("__hard", F.when(F.col("__valid") & left, F.col(column)))
    # Texts that need no Python are null to it.
    deep = _redact_deep(F.col("__hard"))
    done = F.when(F.col("__hard").isNotNull(), deep).otherwise(F.col("__once"))
    return told.withColumn(column, done).select(*df.columns)


def redaction_report(df: DataFrame, column: str, extra: Patterns = ()) -> DataFrame:
    """R4. Rows and hits per rule, counted in one aggregate over the unredacted text."""
    rules = [(n, p) for n, p, _ in fixed.SECRET_PATTERNS] + check_patterns(extra)
    aggs = []
    counted = []
    for i, (name, pattern) in enumerate(rules):
        hits = F.regexp_count(column, F.lit(pattern))
        if name in _MARKS:
            hits = F.when(F.col(column).contains(_MARKS[name]), hits).otherwise(0)
        counted.append(hits.cast("long").alias(f"n{i}"))
        aggs += [F.count(F.when(F.col(f"n{i}") > 0, 1)).alias(f"r{i}"), F.sum(f"n{i}").alias(f"h{i}")]
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"), F.col(f"r{i}").alias("rows"), F.coalesce(F.col(f"h{i}"), F.lit(0)).alias("hits")
            )
            for i, (name, _) in enumerate(rules)
        ]
    )
    return df.select(*counted).agg(*aggs).select(F.explode(entries).alias("e")).select("e.*")


def redaction_stable(df: DataFrame, column: str, key: str, extra: Patterns = ()) -> DataFrame:
    """R5. Texts that a second redaction would change; empty when redaction is stable."""
    changes = _bound(redact_expr(F.col(column), extra), lambda once: ~redact_expr(once, extra).eqNullSafe(once))
    # One element or none per row: a filter would be pushed below a repartition, onto fewer cores.
    kept = F.when(changes, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return df.select(key, F.explode(kept)).select(key)
