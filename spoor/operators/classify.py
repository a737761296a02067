"""Classification and enrichment: row rules as column expressions, look-ups as joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.functions.exprs import any_of, first_of, fixed_table, glob_to_regex
from spoor.functions.exprs import canonical_uri as canonical_uri_expr
from spoor.operators.policy_index import compile_rules, evaluate_by_index


def taxonomy_table(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, fixed.TAXONOMY, "type string, risk_level string")


def classify_actions(df: DataFrame, mapping: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """C1. Tool → action type → risk. Unmapped tools and unregistered types become unknown.

    ``mapping``: tool_name, action_type and optionally rule_order; the first entry of a tool wins.
    Both tables are joined without a hint: Spark broadcasts them while they are small.
    """
    order = "rule_order" if "rule_order" in mapping.columns else "action_type"
    first = mapping.groupBy("tool_name").agg(F.min_by("action_type", order).alias("__mapped"))
    known = taxonomy.select(F.col("type").alias("__mapped"), F.col("risk_level").alias("__risk"))
    return (
        df.join(first, "tool_name", "left")
        .join(known, "__mapped", "left")
        .withColumn("classified_type", F.when(F.col("__risk").isNull(), F.lit(fixed.UNKNOWN_ACTION)).otherwise(F.col("__mapped")))
        .withColumn("classified_risk", F.coalesce("__risk", F.lit(fixed.UNKNOWN_RISK)))
        .drop("__mapped", "__risk")
    )


def validate_mapping(mapping: DataFrame) -> DataFrame:
    """C2. Blank entries and tools mapped more than once."""
    blank = (F.coalesce(F.col("tool_name"), F.lit("")) == "") | (F.coalesce(F.col("action_type"), F.lit("")) == "")
    return (
        mapping.groupBy("tool_name")
        .agg(F.count(F.lit(1)).alias("entries"), F.max(blank).alias("__blank"))
        .withColumn("problem", first_of([(F.col("__blank"), "blank"), (F.col("entries") > 1, "duplicate")]))
        .filter("problem IS NOT NULL")
        .select("tool_name", "entries", "problem")
    )


def operation_type_expr(tool: Column) -> Column:
    lower = F.lower(tool)
    rules = [(any_of(lower, words, "startswith"), op) for op, words in fixed.OPERATION_PREFIXES]
    rules += [(any_of(lower, words, "endswith"), op) for op, words in fixed.OPERATION_SUFFIXES]
    return first_of(rules, "unknown")


def operation_type(df: DataFrame, tool: str = "tool_name") -> DataFrame:
    """C3. Operation type out of the tool name."""
    return df.withColumn("operation_type", operation_type_expr(F.col(tool)))


# The loops over strings here are possessive: java.util.regex then runs them without recursion, so a
# text of any length is safe. None of them could give back a character and still match.
_JSON_STRING = r'"((?:[^"\\]++|\\.)*+)"'


def sql_mutation_expr(arguments: Column) -> Column:
    """True when a SQL-named key, at any depth, holds a mutation without WHERE."""
    pair = rf'(?is)"(?:{"|".join(fixed.SQL_KEYS)})"\s*:\s*{_JSON_STRING}'
    values = F.regexp_extract_all(arguments, F.lit(pair), F.lit(1))

    def bad(raw: Column) -> Column:
        # The value is still JSON-escaped; decode it, since "\nwhere" must read as a new line.
        decoded = F.get(F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>"), F.lit(0))
        text = F.lower(decoded)
        return any_of(text, fixed.SQL_MUTATIONS, "contains") & ~text.rlike(r"(^|[^a-z])where([^a-z]|$)")

    return F.coalesce(F.exists(values, bad), F.lit(False))


def sql_mutation_flag(df: DataFrame, arguments: str = "arguments_json") -> DataFrame:
    """C5. Flag SQL mutations without WHERE in JSON arguments."""
    return df.withColumn("sql_mutation", sql_mutation_expr(F.col(arguments)))


def _risk_terms(tool: Column, arguments: Column | None) -> list[tuple[Column, int, Column]]:
    lower = F.lower(tool)
    op = operation_type_expr(tool)
    word = first_of([(lower.contains(w), w) for w in fixed.SENSITIVE_WORDS])
    terms = [(op == name, score, F.lit(reason)) for name, score, reason in fixed.OPERATION_SCORES]
    terms.append(
        (word.isNotNull(), fixed.SENSITIVE_SCORE, F.concat(F.lit("touches sensitive data ("), word, F.lit(")")))
    )
    if arguments is not None:
        terms.append((sql_mutation_expr(arguments), fixed.SQL_SCORE, F.lit(fixed.SQL_REASON)))
    terms.append((any_of(lower, fixed.CONFIG_WORDS, "contains"), fixed.CONFIG_SCORE, F.lit(fixed.CONFIG_REASON)))
    terms.append((any_of(lower, fixed.MESSAGE_PREFIXES, "startswith"), fixed.MESSAGE_SCORE, F.lit(fixed.MESSAGE_REASON)))
    return terms


def score_risk(df: DataFrame, tool: str = "tool_name", arguments: str | None = "arguments_json") -> DataFrame:
    """C4. Risk score 0–100 and the reasons it is made of."""
    terms = _risk_terms(F.col(tool), F.col(arguments) if arguments else None)
    hits = F.array_compact(
        F.array(*[F.when(cond, F.struct(F.lit(points).alias("points"), reason.alias("reason"))) for cond, points, reason in terms])
    )
    score = F.aggregate("__hits", F.lit(0), lambda total, hit: total + hit["points"])
    return (
        df.withColumn("__hits", hits)
        .withColumn("risk_score", F.least(score, F.lit(fixed.MAX_SCORE)))
        .withColumn("risk_reasons", F.transform("__hits", lambda hit: hit["reason"]))
        .drop("__hits")
    )


_RULE_FIELDS = ("name", "description", "enabled", "tool_pattern", "server_pattern", "operation_types", "min_risk_score", "action")


# So many rules become one expression over the row; more are looked up by an index.
MOST_RULES = 200
_RULE_TABLE = (
    "rule_order long, name string, description string, enabled boolean, tool_pattern string, server_pattern string, "
    "operation_types array<string>, min_risk_score int, action string"
)


def _rules(rules: DataFrame | Sequence[Mapping]) -> list[dict] | None:
    """The rules in order, or None if they are too many for one expression."""
    if isinstance(rules, DataFrame):
        rows = rules.orderBy("rule_order").limit(MOST_RULES + 1).collect()
        rules = [row.asDict() for row in rows]
    return None if len(rules) > MOST_RULES else [{f: rule.get(f) for f in _RULE_FIELDS} for rule in rules]


def rule_table(spark: SparkSession, rules: DataFrame | Sequence[Mapping]) -> DataFrame:
    """Rules as a table; a list's order becomes their ``rule_order``."""
    if isinstance(rules, DataFrame):
        return rules
    names = [part.split()[0] for part in _RULE_TABLE.split(", ")]
    return spark.createDataFrame([tuple({**r, "rule_order": i}.get(n) for n in names) for i, r in enumerate(rules)], _RULE_TABLE)


def _rule_problem(rule: Mapping) -> str | None:
    if not rule["enabled"]:
        return "disabled"
    if rule["action"] not in fixed.POLICY_ACTIONS:
        return "unknown_action"
    for pattern in (rule["tool_pattern"], rule["server_pattern"]):
        if pattern and glob_to_regex(pattern.lower()) is None:
            return "malformed_pattern"
    return None


def _rule_matches(rule: Mapping, call: Column) -> Column:
    match = F.lit(True)
    for pattern, field in ((rule["tool_pattern"], "tool"), (rule["server_pattern"], "server")):
        if pattern:
            match = match & call[field].rlike(glob_to_regex(pattern.lower()))
    if rule["operation_types"]:
        match = match & call["operation"].isin(*rule["operation_types"])
    if rule["min_risk_score"] is not None:
        match = match & (call["score"] >= rule["min_risk_score"])
    return match


def evaluate_policy(df: DataFrame, rules: DataFrame | Sequence[Mapping] = fixed.DEFAULT_RULES) -> DataFrame:
    """C6. The most restrictive matching rule, the earliest among equals; no match passes.

    Up to ``MOST_RULES`` rules become one CASE over each row, most severe first, so nothing is joined or
    shuffled; more are looked up by an index of their patterns, with the same result. Takes
    tool_name, server, operation_type and risk_score, each of which the CASE sees as a value:
    however many rules there are, the score's own expression stands in the plan once.
    """
    few = _rules(rules)
    if few is None:
        return evaluate_by_index(df, rule_table(df.sparkSession, rules))
    live = [r for r in few if _rule_problem(r) is None and r["action"] != "pass"]
    # sorted() keeps the rule order among equal severities.
    live = sorted(live, key=lambda r: -fixed.POLICY_ACTIONS.index(r["action"]))
    call = F.struct(
        F.lower(F.coalesce("tool_name", F.lit(""))).alias("tool"),
        F.lower(F.coalesce("server", F.lit(""))).alias("server"),
        F.col("operation_type").alias("operation"),
        F.col("risk_score").alias("score"),
    )

    def decide(seen: Column) -> Column:
        decision = F.struct(
            F.lit("pass").alias("action"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("reason")
        )
        for rule in reversed(live):
            hit = F.struct(
                F.lit(rule["action"]).alias("action"),
                F.lit(rule["name"]).alias("rule"),
                F.lit(rule["description"]).alias("reason"),
            )
            decision = F.when(_rule_matches(rule, seen), hit).otherwise(decision)
        return decision

    return (
        df.withColumn("__d", F.get(F.transform(F.array(call), decide), F.lit(0)))
        .withColumn("policy_action", F.col("__d.action"))
        .withColumn("policy_rule", F.col("__d.rule"))
        .withColumn("policy_reason", F.col("__d.reason"))
        .drop("__d")
    )


def validate_rules(spark: SparkSession, rules: DataFrame | Sequence[Mapping]) -> DataFrame:
    """C7. Each rule with the reason it is off, if any; of many rules in a table with their own order."""
    few = _rules(rules)
    if few is None:
        return compile_rules(rule_table(spark, rules)).select(F.col("rule_order").cast("long").alias("rule_order"), "name", "action", "problem")
    rows = [(i, r["name"], r["action"], _rule_problem(r)) for i, r in enumerate(few)]
    return fixed_table(spark, rows, "rule_order long, name string, action string, problem string")


def rule_hits(validated: DataFrame, judged: DataFrame) -> DataFrame:
    """C7. How many calls each rule decided; takes ``validate_rules`` and ``evaluate_policy`` output."""
    # Behind explode() the optimizer cannot copy the CASE over all rules into a filter of its own.
    decided = judged.select(F.explode(F.array("policy_rule")).alias("name"))
    hits = decided.groupBy("name").agg(F.count(F.lit(1)).alias("hits"))
    return validated.join(hits, "name", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def describe_rules(validated: DataFrame) -> DataFrame:
    """C7. Rules per action, disabled ones apart; takes ``validate_rules`` output."""
    group = F.when(F.col("problem").isNotNull(), F.lit("off")).otherwise(F.col("action"))
    return (
        validated.groupBy(group.alias("group"))
        .agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("rule_order", "name"))).alias("__r"))
        .select("group", "n", F.array_join(F.transform("__r", lambda r: r["name"]), ",").alias("names"))
    )


def extract_target(df: DataFrame, server: str = "server", arguments: str = "arguments_json") -> DataFrame:
    """C8. target_system and target_resource out of a call's top-level arguments; both or none."""
    args = F.from_json(arguments, "map<string,variant>")
    entries = F.transform(
        F.filter(F.map_entries(args), lambda e: F.schema_of_variant(e["value"]) == "STRING"),
        lambda e: F.struct(
            F.lower(e["key"]).alias("key"), F.trim(F.try_variant_get(e["value"], "$", "string")).alias("value")
        ),
    )

    def lookup(name: str) -> Column:
        named = F.filter("__args", lambda e: (e["key"] == name) & (e["value"] != ""))
        return F.try_element_at(named, F.lit(1))["value"]

    def any_key(names: Sequence[str]) -> Column:
        return F.coalesce(*[lookup(n) for n in names])

    table, qualifier = any_key(fixed.TABLE_KEYS), any_key(fixed.QUALIFIER_KEYS)
    resource = F.coalesce(
        canonical_uri_expr(any_key(fixed.URI_KEYS)),
        F.when(qualifier.isNotNull(), F.concat(qualifier, F.lit("."), table)).otherwise(table),
        F.concat(lookup("owner"), F.lit("/"), lookup("repo")),
        any_key(fixed.GENERIC_KEYS),
    )
    found = df.withColumn("__args", entries).withColumn("__res", resource)
    usable = (
        (F.coalesce(F.col(server), F.lit("")) != "")
        & (F.octet_length(server) <= fixed.MAX_IDENTITY_BYTES)
        & (F.coalesce(F.col("__res"), F.lit("")) != "")
        & (F.octet_length("__res") <= fixed.MAX_RESOURCE_BYTES)
    )
    return (
        found.withColumn("target_system", F.when(usable, F.col(server)))
        .withColumn("target_resource", F.when(usable, F.col("__res")))
        .drop("__args", "__res")
    )


def canonical_uri(df: DataFrame, column: str) -> DataFrame:
    """C9. Add ``canonical_uri`` of a column."""
    return df.withColumn("canonical_uri", canonical_uri_expr(F.col(column)))


# A shell word: bare characters, '...' and "..." parts run together. Double quotes still expand
# $ and `, so those are not allowed inside them.
_SHELL_WORD = r"""(?:'[^']*+'|"[^"$`]*+"|[^ \t'"|;&<(){}$`\n>]++)++"""
_SHELL_LINE = rf"^(?:[ \t]++|{_SHELL_WORD}|>>?)*+$"


def classify_shell(df: DataFrame, command: str = "command") -> DataFrame:
    """C10. Filesystem action and target of a shell command; anything ambiguous gives none.

    A line is taken only when it consists of plain words, quoted words and at most one output
    redirect. rm, mv and cp outrank the redirect.
    """
    text = F.trim(F.col(command))
    decidable = text.rlike(_SHELL_LINE) & ~text.rlike(r"""(^|[ \t>])['"]?[0-9]+['"]?>""") & ~text.contains(">>>")
    tokens = F.transform(
        F.regexp_extract_all(text, F.lit(rf"{_SHELL_WORD}|>>?"), F.lit(0)),
        lambda t: F.when(t == ">>", F.lit(">")).otherwise(t),
    )

    def unquoted(words: Column) -> Column:
        return F.transform(words, lambda w: F.regexp_replace(w, r"""'([^']*)'|"([^"]*)\"""", "$1$2"))

    def path(word: Column) -> Column:
        return F.when((word != "") & ~word.rlike(r"[*?\[~]"), word)

    at = F.col("__at")
    args = F.slice("__words", F.lit(2), F.greatest(F.size("__words") - 1, F.lit(0)))
    dash = F.array_position("__args", "--").cast("int")
    size = F.size("__args")
    plain = F.filter("__args", lambda a: ~a.startswith("-"))
    ended = F.concat(
        F.filter(F.slice("__args", F.lit(1), F.greatest(dash - 1, F.lit(0))), lambda a: ~a.startswith("-")),
        F.slice("__args", dash + 1, F.greatest(size - dash, F.lit(0))),
    )
    verb = F.try_element_at("__words", F.lit(1))
    count = F.size("__operands")
    last = F.try_element_at("__operands", F.lit(-1))
    by_verb = verb.isin("rm", "mv", "cp")
    verb_path = F.when(F.when(verb == "rm", count == 1).otherwise(count >= 2), path(last))
    verb_action = first_of(
        [(verb == "rm", "filesystem.file.delete"), (verb == "mv", "filesystem.file.move")], "filesystem.file.create"
    )
    resource = F.when(by_verb, verb_path).otherwise(path(F.col("__redirect")))
    action = F.when(by_verb, verb_action).otherwise(F.lit("filesystem.file.create"))
    redirects = F.size(F.filter("__tokens", lambda t: t == ">"))
    return (
        df.withColumn("__tokens", F.when(decidable, tokens))
        .withColumn("__at", F.array_position("__tokens", ">").cast("int"))
        .withColumn("__ok", (redirects == 0) | ((redirects == 1) & (at < F.size("__tokens"))))
        .withColumn("__redirect", F.when(at > 0, F.try_element_at(unquoted(F.col("__tokens")), at + 1)))
        .withColumn(
            "__words",
            unquoted(
                F.when(at == 0, F.col("__tokens")).otherwise(
                    F.concat(
                        F.slice("__tokens", F.lit(1), F.greatest(at - 1, F.lit(0))),
                        F.slice("__tokens", at + 2, F.greatest(F.size("__tokens") - at - 1, F.lit(0))),
                    )
                )
            ),
        )
        .withColumn("__args", F.when(F.size("__words") > 0, args).otherwise(F.array().cast("array<string>")))
        .withColumn("__operands", F.when(dash > 0, ended).otherwise(plain))
        .withColumn("shell_resource", F.when(F.col("__ok"), resource))
        .withColumn("shell_action", F.when(F.col("shell_resource").isNotNull(), action))
        .drop("__tokens", "__at", "__ok", "__redirect", "__words", "__args", "__operands")
    )


def derive_status(df: DataFrame) -> DataFrame:
    """C11. Outcome status from decision, error and, on the mcp channel, the tool's error flag."""
    tool_error = (F.col("channel") == "mcp") & (
        F.try_variant_get(F.try_parse_json("output"), "$.isError", "boolean")
    )
    failed = (F.coalesce(F.col("error"), F.lit("")) != "") | F.coalesce(tool_error, F.lit(False))
    status = first_of(
        [
            ((F.col("decision") == "allowed") & failed, "failure"),
            (F.col("decision") == "allowed", "success"),
            (F.col("decision") == "denied", "failure"),
            (F.col("decision") == "pending", "pending"),
        ]
    )
    return df.withColumn("outcome_status", status)


def derive_action_type(df: DataFrame) -> DataFrame:
    """C12. The declared action type, or else ``channel[.server].tool``."""
    built = F.concat_ws(".", "channel", F.nullif("server", F.lit("")), "tool_name")
    return df.withColumn("derived_type", F.coalesce(F.nullif("action_type", F.lit("")), built))


def normalize_hook_events(df: DataFrame, max_bytes: int = 4096) -> DataFrame:
    """C13. Decision and failure text from hook events (hook_event_name, error, is_interrupt).

    ``error`` is JSON text: a JSON string is decoded, other JSON is kept as text. The text is cut
    at ``max_bytes`` without splitting a character.
    """
    failed = F.col("hook_event_name") == "PostToolUseFailure"
    raw = F.trim(F.coalesce(F.col("error"), F.lit("")))
    decoded = F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0))
    text = F.trim(first_of([(raw.isin("", "null"), ""), (raw.startswith('"'), F.coalesce(decoded, raw))], raw))
    as_bytes = F.encode(text, "UTF-8")
    cut = F.try_validate_utf8(F.substring(as_bytes, 1, max_bytes).cast("string"))
    for back in (1, 2, 3):
        cut = F.coalesce(cut, F.try_validate_utf8(F.substring(as_bytes, 1, max_bytes - back).cast("string")))
    short = F.when(F.octet_length(text) > max_bytes, F.concat(cut, F.lit("…(truncated)"))).otherwise(text)
    default = F.when(F.coalesce(F.col("is_interrupt"), F.lit(False)), F.lit("tool call interrupted")).otherwise(
        F.lit("tool call failed")
    )
    return df.withColumn(
        "decision", F.when(F.col("hook_event_name") == "PreToolUse", F.lit("pending")).otherwise(F.lit("allowed"))
    ).withColumn("failure_text", F.when(failed, F.coalesce(F.nullif(short, F.lit("")), default)).otherwise(F.lit("")))


def resolve_principal(df: DataFrame, users: DataFrame) -> DataFrame:
    """C14. Principal from the attested OS user; ``users``: uid, name. Spark broadcasts it if small."""
    names = users.select(F.col("uid").alias("peer_uid"), F.nullif("name", F.lit("")).alias("__name"))
    posix = F.coalesce(F.col("peer_platform").isin("linux", "darwin"), F.lit(False)) & F.col("peer_uid").isNotNull()
    principal = first_of(
        [
            (~posix, "did:user:unknown"),
            (F.col("__name").isNotNull(), F.concat(F.lit("did:user:"), "__name")),
        ],
        F.concat(F.lit("did:user:"), "peer_platform", F.lit(":"), F.col("peer_uid").cast("string")),
    )
    return df.join(names, "peer_uid", "left").withColumn("resolved_principal", principal).drop("__name")


def enrich_usage(df: DataFrame, transcripts: DataFrame) -> DataFrame:
    """C15. Model and usage of the transcript turn that emitted a call; the first such turn wins.

    ``df``: tool_use_id and file; ``transcripts``: ``read_transcripts`` output.
    """
    blocks = (
        transcripts.filter(F.col("type") == "assistant")
        .select("file", "block", "row", "model", "usage", F.explode("content").alias("b"))
        .filter(F.col("b.type") == "tool_use")
        .select("file", F.col("b.id").alias("tool_use_id"), "block", "row", "model", "usage")
    )
    first = blocks.groupBy("file", "tool_use_id").agg(
        F.min_by(F.struct("model", "usage"), F.struct("block", "row")).alias("__hit")
    )
    return (
        df.join(first, ["file", "tool_use_id"], "left")
        .withColumn("turn_model", F.col("__hit.model"))
        .withColumn("turn_usage", F.col("__hit.usage"))
        .withColumn("turn_found", F.col("__hit").isNotNull())
        .drop("__hit")
    )


def pair_calls(intents: DataFrame, results: DataFrame) -> DataFrame:
    """C16. Attach a call's arguments to its result; unpaired ones are kept and flagged.

    ``intents``: call_id, args, at; ``results``: call_id, args, status, at. A repeated call
    replaces the one before; the first result takes it, so later results of the call are
    unannounced. Calls are reduced to one row before the join, so copies never multiply.
    """
    called = intents.groupBy("call_id").agg(
        F.max_by("args", F.struct("at", "args")).alias("__i"), F.lit(True).alias("__called")
    )
    first = results.groupBy("call_id").agg(F.min("at").alias("__first"))
    calls = called.join(first, "call_id", "full")
    takes = F.coalesce(F.col("__called") & (F.col("at") == F.col("__first")), F.lit(False))
    answered = results.join(calls, "call_id").select(
        "call_id",
        F.when(takes, F.coalesce("args", "__i")).otherwise(F.col("args")).alias("args"),
        "status",
        F.when(takes, F.lit("paired")).otherwise(F.lit("unannounced")).alias("pairing"),
    )
    open_calls = calls.filter("__first IS NULL").select(
        "call_id", F.col("__i").alias("args"), F.lit(None).cast("string").alias("status"), F.lit("unanswered").alias("pairing")
    )
    return answered.unionByName(open_calls)


def truncate_preview(df: DataFrame, column: str, n: int = fixed.PREVIEW_CHARS) -> DataFrame:
    """C17. First ``n`` characters and whether any were cut; ``n <= 0`` drops the text."""
    if n <= 0:
        preview, cut = F.lit(""), F.length(column) > 0
    else:
        preview, cut = F.substring(F.col(column), 1, n), F.length(column) > n
    return df.withColumn("preview", preview).withColumn("preview_truncated", cut)


def truncate_error(df: DataFrame, column: str = "error", n: int = fixed.PREVIEW_CHARS) -> DataFrame:
    """C17. Error text cut at ``n`` characters with a mark; ``n <= 0`` leaves it whole."""
    if n <= 0:
        return df.withColumn("error_text", F.col(column))
    cut = F.concat(F.substring(F.col(column), 1, n), F.lit(fixed.ERROR_SUFFIX))
    return df.withColumn("error_text", F.when(F.length(column) > n, cut).otherwise(F.col(column)))
