"""Q6 over whole documents: every field of every receipt against the table of allowed ones.

A document becomes a row for each of its fields, which meets that field's rules in a join with the
small table of them; fields that the table does not know show themselves there. What concerns an
object as a whole, as missing fields do, is told beside it. Nothing is parsed outside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions import document_fields as known
from spoor.functions import fixed
from spoor.functions.exprs import any_of

_RULES = (
    "parent string, field string, kind string, pattern int, one_of array<string>, minimum long, min_length int, is_time boolean, "
    "min_items int, max_items int"
)
_ALL_FIELDS = [*known.OBJECTS.values(), *known.ELEMENTS.values()]
_PATTERNS = sorted({rules["pattern"] for fields in _ALL_FIELDS for _, rules in fields.values() if "pattern" in rules})
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_FINDING = "array<struct<path:string,rule:string>>"
_SUBJECT = "credentialSubject"


def rule_table(spark: SparkSession) -> DataFrame:
    """A row per field: what its value must be."""
    rows = []
    for parent, fields in [*known.OBJECTS.items(), *((f"{p}[]", f) for p, f in known.ELEMENTS.items())]:
        for field, (kind, rules) in fields.items():
            pattern = _PATTERNS.index(rules["pattern"]) if "pattern" in rules else None
            one_of = list(rules["one_of"]) if "one_of" in rules else None
            rows.append(
                (parent, field, kind, pattern, one_of, *[rules.get(r) for r in ("minimum", "min_length", "time", "min_items", "max_items")])
            )
    return spark.createDataFrame(rows, _RULES)


def _at(path: str) -> str:
    """A variant path; ``@`` is only allowed in quotes."""
    return f"$['{path}']" if path.startswith("@") else "$." + path if path else "$"


def _map(document: Column, path: str) -> Column:
    return F.try_variant_get(document, _at(path), "map<string,variant>")


def _is_sealed(entries: Column) -> Column:
    """Parameters may also be a map of texts, which needs no further look."""
    return F.exists(F.map_values(entries), lambda v: F.schema_of_variant(v) != "STRING")


def _part(parent: str, entries=None, needed=None, elements=None, numbered=0, told=None) -> Column:
    kinds = {"entries": "map<string,variant>", "needed": "array<string>", "elements": "array<variant>", "told": _FINDING}
    given = {"entries": entries, "needed": needed, "elements": elements, "told": told}
    held = [(F.lit(None) if c is None else c).cast(kinds[name]).alias(name) for name, c in given.items()]
    return F.struct(F.lit(parent).alias("parent"), F.lit(numbered).alias("numbered"), *held)


def _parts(document: Column, objects: dict[str, Column], told: Column) -> Column:
    """Each known object with the fields it needs, each known array, and what is told of the whole."""
    parts = [_part("", told=told)]
    for path, entries in objects.items():
        needed = F.array(*[F.lit(f) for f in known.NEEDED.get(path, ())])
        parts.append(F.when(entries.isNotNull(), _part(path, entries=entries, needed=needed)))
    for path, fields in known.ELEMENTS.items():
        listed = F.try_variant_get(document, _at(path), "array<variant>")
        parts.append(_part(f"{path}[]", elements=listed, numbered=len(fields) - 1))
    return F.array(*parts)


def _with_missing() -> Column:
    """The entries of a part and, with a null instead of a value, the needed ones that it misses."""
    missing = F.array_except("needed", F.map_keys("entries"))
    nulls = F.array_repeat(F.lit(None).cast("variant"), F.size(missing))
    return F.when(F.size(missing) > 0, F.map_concat("entries", F.map_from_arrays(missing, nulls))).otherwise(F.col("entries"))


def _conditions(document: Column) -> list[tuple[str, str, Column]]:
    """Rules between fields: (path, rule, broken)."""
    text = lambda path: F.try_variant_get(document, _at(path), "string")
    there = lambda path: F.try_variant_get(document, _at(path), "variant").isNotNull()
    bound = F.lit(None).cast("string")
    for version, context in fixed.VERSION_CONTEXT.items():
        bound = F.when(text("version") == version, F.lit(context)).otherwise(bound)
    action, chain = f"{_SUBJECT}.action", f"{_SUBJECT}.chain"
    unknown = text(f"{action}.type") == fixed.UNKNOWN_ACTION
    sequence = F.try_variant_get(document, _at(f"{chain}.sequence"), "double")
    previous = F.try_variant_get(document, _at(f"{chain}.previous_receipt_hash"), "variant")
    is_null = F.schema_of_variant(previous) == "VOID"
    second = F.get(F.try_variant_get(document, _at("@context"), "array<string>"), F.lit(1))
    return [
        ("@context", "version_binding", F.substring_index(second, "/", -1) != bound),
        (f"{action}.target", "required", unknown & ~there(f"{action}.target")),
        (f"{action}.target.system", "required", unknown & there(f"{action}.target") & ~there(f"{action}.target.system")),
        (f"{chain}.previous_receipt_hash", "null_at_start", (sequence == 1) & previous.isNotNull() & ~is_null),
        (f"{chain}.previous_receipt_hash", "hash_behind_start", F.coalesce(sequence != 1, F.lit(True)) & is_null),
        (f"{chain}.terminal", "required", there(f"{chain}.status") & ~there(f"{chain}.terminal")),
    ]


def document_violations(df: DataFrame, column: str = "receipt_json") -> DataFrame:
    """Q6. A row (path, rule) beside the other columns for every rule that a document breaks.

    Rules: ``json`` (no JSON object), ``required``, ``additional`` (a field its object must not have), ``type``,
    ``pattern``, ``one_of``, ``minimum``, ``min_length``, ``date_time``, ``min_items``, ``max_items``, and those
    between fields: ``version_binding``, ``null_at_start``, ``hash_behind_start``. Elements of arrays are
    named by ``[0]``, ``[1]`` where each has its own rules, and ``[*]``. A document that breaks none has no row.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c != column]
    parsed = df.select(F.struct(*rest).alias("__row"), F.try_parse_json(column).alias("__doc"))
    doc = F.col("__doc")
    is_object = _map(doc, "").isNotNull()
    found = lambda path, rule: F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"))
    whole = F.array(F.when(~is_object, found("", "json")), *[F.when(is_object & broken, found(p, r)) for p, r, broken in _conditions(doc)])
    seen = parsed.withColumns({"__sealed": _is_sealed(_map(doc, known.PARAMETERS)), "__told": F.array_compact(whole)})
    # Objects are columns, because an expression that stands in several places is computed in each.
    objects = {}
    for path in known.OBJECTS:
        entries = _map(doc, path)
        objects[path] = F.when(F.col("__sealed"), entries) if path.startswith(known.PARAMETERS) else entries
    names = {path: f"__o{i}" for i, path in enumerate(objects)}
    held = seen.select("__row", "__doc", "__told", *[entries.alias(names[path]) for path, entries in objects.items()])
    # A row per document and part, then one per field or finding. From here on all is generated code: a
    # lambda would end that and copy the values.
    parts = _parts(doc, {path: F.col(name) for path, name in names.items()}, F.col("__told"))
    parts = held.select("__row", F.explode(parts).alias("part")).filter("part IS NOT NULL").select("__row", "part.*")
    rows = parts.select("parent", "numbered", "elements", "told", "__row", F.explode_outer(_with_missing()).alias("key", "entry"))
    rows = rows.select("*", F.posexplode_outer("elements").alias("at", "element"))
    rows = rows.select("*", F.explode_outer("told").alias("finding"))
    place = F.when(F.col("at") < F.col("numbered"), F.col("at").cast("string")).when(F.col("at").isNotNull(), "*")
    is_missing = F.col("key").isNotNull() & F.col("entry").isNull()
    rows = rows.filter("key IS NOT NULL OR at IS NOT NULL OR finding IS NOT NULL").select(
        "__row",
        F.coalesce("finding.path", "parent").alias("parent"),
        F.coalesce("key", place).alias("field"),
        F.coalesce("entry", "element").alias("value"),
        F.when(is_missing, F.lit("required")).otherwise(F.col("finding.rule")).alias("rule"),
    )
    # The table of fields is fixed, about 130 rows.
    rules = rule_table(spark).withColumnRenamed("parent", "__parent").withColumnRenamed("field", "__field")
    at = (F.col("parent") == F.col("__parent")) & (F.col("field") == F.col("__field"))
    # What several rules look at is a column too, and computed for the values that it concerns only.
    looked_up = rows.join(F.broadcast(rules), at, "left").withColumn("is", F.schema_of_variant("value"))
    looked_up = looked_up.withColumns(
        {
            "text": F.when(F.col("is") == "STRING", F.try_variant_get("value", "$", "string")),
            "number": F.when(_is_numeric(), F.try_variant_get("value", "$", "double")),
            "items": F.when(F.col("is").startswith("ARRAY"), F.size(F.try_variant_get("value", "$", "array<variant>"))),
        }
    )
    told = F.when(F.col("rule").isNotNull(), F.array("rule")).otherwise(_broken())
    judged = looked_up.select("__row", "parent", "field", F.explode(told).alias("rule")).filter("rule IS NOT NULL")
    element = F.concat(F.regexp_replace("parent", r"\[\]$", "["), "field", F.lit("]"))
    inside = F.when(F.col("parent").endswith("[]"), element).when(F.col("parent") == "", F.col("field")).otherwise(F.concat_ws(".", "parent", "field"))
    path = F.when(F.col("field").isNull(), F.col("parent")).otherwise(inside)
    return judged.select("__row.*", path.alias("path"), "rule")


def _is_numeric() -> Column:
    return any_of(F.col("is"), ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "startswith")


def _broken() -> Column:
    """The rules that a field's value breaks, and nulls; takes the columns of the rule table and of the value."""
    value, kind, is_, text, number, items = (F.col(c) for c in ("value", "kind", "is", "text", "number", "items"))
    is_text = is_ == "STRING"
    fits = (
        F.when(kind == "any", F.lit(True))
        .when(kind == "string", is_text)
        .when(kind == "string or null", is_text | (is_ == "VOID"))
        .when(kind == "integer", _is_numeric() & (number == F.floor(number)))
        .when(kind == "boolean", is_ == "BOOLEAN")
        .when(kind == "true", (is_ == "BOOLEAN") & F.coalesce(F.try_variant_get(value, "$", "boolean"), F.lit(False)))
        .when(kind == "object", is_.startswith("OBJECT"))
        .when(kind == "array", is_.startswith("ARRAY"))
    )
    matches = F.lit(True)
    for i, pattern in enumerate(_PATTERNS):
        matches = F.when(F.col("pattern") == i, text.rlike(pattern)).otherwise(matches)
    timed = F.coalesce(F.col("is_time"), F.lit(False))
    is_time = text.rlike(_RFC3339) & F.try_to_timestamp(F.upper(text)).isNotNull()
    unknown = kind.isNull() & ~F.col("parent").isin(*known.OPEN_OBJECTS)
    rules = [
        (unknown, "additional"),
        (kind.isNotNull() & ~fits, "type"),
        (F.col("pattern").isNotNull() & ~matches, "pattern"),
        (~F.array_contains("one_of", text), "one_of"),
        (number < F.col("minimum"), "minimum"),
        (F.length(text) < F.col("min_length"), "min_length"),
        (timed & is_text & ~is_time, "date_time"),
        (items < F.col("min_items"), "min_items"),
        (items > F.col("max_items"), "max_items"),
    ]
    return F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for broken, name in rules])


def conformance_of_documents(df: DataFrame, column: str = "receipt_json") -> DataFrame:
    """Q6. How often each rule is broken, by path."""
    found = document_violations(df.select(column), column)
    return found.groupBy("path", "rule").agg(F.count(F.lit(1)).alias("violations"))
