"""C6 and C7 for any number of rules: rules meet distinct tools by an index, not calls one by one.

A glob's longest literal piece must stand in every name it matches, so a rule is filed under the
rarest three letters of that piece, and a tool looks up the three letters it is made of. What meets
is checked by the whole pattern. Each tool then keeps, for each operation, only rules that no more
severe or earlier one covers; calls look their tool up and take the first that their score reaches.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.functions import fixed
from spoor.functions.exprs import first_of, glob_to_regex
from spoor.session import scratch_path

GRAM = 3
_ANY = "\u0000any"
_COMPILED = T.StructType(
    [T.StructField("regex", T.StringType()), T.StructField("literal", T.StringType()), T.StructField("malformed", T.BooleanType())]
)


# The pieces of a well-formed glob; what the last group or an escape holds stands for itself.
_PIECE = re.compile(r"[*?]|\\(.)|\[(?:\\.|[^\]\\])*\]|(.)", re.DOTALL)


def longest_literal(glob: str) -> str:
    """The longest run of characters of a well-formed glob that stand for themselves."""
    runs = [""]
    for piece in _PIECE.finditer(glob):
        own = piece.group(1) or piece.group(2)
        if own:
            runs[-1] += own
        else:
            runs.append("")
    return max(runs, key=len)


@F.arrow_udf(_COMPILED)
def _compiled(globs: pa.Array) -> pa.Array:
    out = []
    for glob in globs.to_pylist():
        regex = glob_to_regex(glob.lower()) if glob else None
        out.append({"regex": regex, "literal": longest_literal(glob.lower()) if regex else "", "malformed": bool(glob) and regex is None})
    return pa.array(out, pa.struct([("regex", pa.string()), ("literal", pa.string()), ("malformed", pa.bool_())]))


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules with their patterns as ``tool`` and ``server`` (regex, literal, malformed) and what is wrong with them."""
    compiled = rules.withColumn("tool", _compiled("tool_pattern")).withColumn("server", _compiled("server_pattern"))
    problem = first_of(
        [
            (~F.coalesce("enabled", F.lit(False)), "disabled"),
            (~F.coalesce(F.col("action").isin(*fixed.POLICY_ACTIONS), F.lit(False)), "unknown_action"),
            (F.col("tool.malformed") | F.col("server.malformed"), "malformed_pattern"),
        ]
    )
    return compiled.withColumn("problem", problem)


def _grams(text: Column, mark: str) -> Column:
    """The text's pieces of ``GRAM`` letters; none if it is shorter."""
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(GRAM)))
    )
    return F.when(F.length(text) >= GRAM, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tool_rules(tools: DataFrame, rules: DataFrame) -> DataFrame:
    """For each (tool, server) in lower case: ``rules``, those that can decide a call, the most restrictive first."""
    severity = F.array_position(F.array(*[F.lit(a) for a in fixed.POLICY_ACTIONS]), F.col("action"))
    live = compile_rules(rules).filter((F.col("problem").isNull()) & (F.col("action") != "pass"))
    operations = F.when(F.size("operation_types") > 0, F.array_sort(F.array_distinct("operation_types"))).otherwise(F.array(F.lit(_ANY)))
    rank = F.struct((-severity).alias("severity"), F.col("rule_order").alias("rule_order"), F.col("name").alias("name"))
    decision = F.struct(rank.alias("rank"), "action", "name", F.col("description").alias("reason"))
    same = ("tool", "server", "operations", "min_risk_score")
    # Of rules with the same conditions only the first can decide.
    live = live.withColumn("operations", operations).groupBy(*same).agg(F.min_by(decision, rank).alias("decision"))
    live = _stored(live.withColumn("rule", F.monotonically_increasing_id()), "rules")
    looked = tools.select(
        "*", F.explode(F.concat(_grams(F.col("tool_name"), "t"), _grams(F.col("server_name"), "s"), F.array(F.lit("")))).alias("gram")
    )
    common = looked.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    mine = F.when(F.length("tool.literal") >= GRAM, _grams(F.col("tool.literal"), "t")).when(
        F.length("server.literal") >= GRAM, _grams(F.col("server.literal"), "s")
    )
    filed = live.select("rule", F.explode(F.coalesce(mine, F.array(F.lit("")))).alias("gram"))
    rarest = F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram")
    filed = filed.join(common, "gram", "left").groupBy("rule").agg(rarest)
    met = looked.join(filed, "gram").join(live, "rule")
    fits = lambda name, pattern: F.coalesce(F.expr(f"{name} RLIKE {pattern}"), F.lit(True))
    met = met.filter(fits("tool_name", "tool.regex") & fits("server_name", "server.regex"))
    each = met.select("tool_name", "server_name", F.explode("operations").alias("operation"), "min_risk_score", "decision")
    # A rule that asks for no less than an earlier one for the same operation can never be the first.
    least = F.coalesce("min_risk_score", F.lit(-(1 << 31)))
    earlier = Window.partitionBy("tool_name", "server_name", "operation").orderBy("decision.rank").rowsBetween(Window.unboundedPreceding, -1)
    useful = each.withColumn("__before", F.min(least).over(earlier)).filter(F.col("__before").isNull() | (least < F.col("__before")))
    rule = F.struct("decision.rank", "operation", "min_risk_score", "decision.action", "decision.name", "decision.reason")
    return useful.groupBy("tool_name", "server_name").agg(F.array_sort(F.collect_list(rule)).alias("rules"))


def evaluate_by_index(df: DataFrame, rules: DataFrame) -> DataFrame:
    """C6 for a table of rules of any size; the same result as the CASE over each row.

    The calls are joined once, with the rules of their tool; Spark sends those to all tasks while
    they are few.
    """
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    tools = df.select(lower("tool_name").alias("tool_name"), lower("server").alias("server_name")).distinct()
    decided = tool_rules(tools, rules).select(F.col("tool_name").alias("__tool"), F.col("server_name").alias("__server"), F.col("rules").alias("__rules"))
    joined = df.join(decided, (lower("tool_name") == F.col("__tool")) & (lower("server") == F.col("__server")), "left")
    reached = lambda r: F.coalesce(
        ((r["operation"] == _ANY) | (r["operation"] == F.col("operation_type")))
        & (r["min_risk_score"].isNull() | (F.col("risk_score") >= r["min_risk_score"])),
        F.lit(False),
    )
    first = F.get(F.filter("__rules", reached), F.lit(0))
    return (
        joined.withColumn("__d", first)
        .withColumn("policy_action", F.coalesce("__d.action", F.lit("pass")))
        .withColumn("policy_rule", F.col("__d.name"))
        .withColumn("policy_reason", F.col("__d.reason"))
        .drop("__d", "__rules", "__tool", "__server")
    )
