"""Secret scans: a random forest removes false positives from candidate findings.

Candidates are found by a wide pattern: values assigned to a credential name, and runs of key
characters with a digit. Features of a candidate are its length, its character classes and the
transitions between them, its entropy, how much of it words of the corpus cover, whether it has the
format of a known key or stands for one to be put in, its path, and the words beside it. The forest
is trained on labelled findings, a bounded sample of each kind, and decides on all others; a finding
that was given a label keeps it.

Everything runs in Spark's own expressions and Spark ML.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import draw, store

# Labelled findings of each kind that the forest is trained on, those of least hash.
TRAIN_FINDINGS = 4_000
# Words that count as dictionary: of at least four letters, in at least this share of all texts.
DICTIONARY_SHARE = 0.001
TREES, DEPTH = 40, 6
NEAR = 48  # characters on either side in which neighbouring words are read

_NAME = r"token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth|credential|bearer|private[_-]?key"
_MORE = r"(?:[_-]?(?:keys?|id|val(?:ue)?|token|string|base64))?"  # SECRET_KEY, token_value
_SET = r"(?:" + _NAME + r")" + _MORE + r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?"  # a credential's name and its assignment
_CHAR = r"[A-Za-z0-9+/=_.@-]"
# A value ends before the next assignment of a list: a=..&b=.. or a=..,b=..
_VALUE = rf"(?!-----BEGIN )(?:(?![&;,?|]{_CHAR}*?(?i:{_SET}))[^\s\"']){{6,}}+"
# Possessive and lazy loops over single characters: long texts cost their length. A name may stand
# behind a prefix in the same run (DB_PASSWORD=, spring.datasource.password=).
# The look-ahead passes over runs without an assignment at their own cost.
_KEYED = rf"(?=[A-Za-z0-9+/_.@-]*+[\"']?\s{{0,3}}[:=]){_CHAR}*?(?i:{_SET}){_VALUE}"
_RUN = rf"(?=[A-Za-z+/=_.@-]*+[0-9]){_CHAR}{{14,}}+"
# Formats that say by themselves what they are: no name is needed.
_KNOWN = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{36,}+|glpat-[A-Za-z0-9_-]{20,}+"
    r"|xox[abeprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|[rs]k_live_[A-Za-z0-9]{16,}+|npm_[A-Za-z0-9]{36}|sk-(?:[a-z]{2,12}-)?[A-Za-z0-9_-]{20,}+"
    r"|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
)
_KNOWN = rf"(?<![A-Za-z0-9])(?:{_KNOWN})(?![A-Za-z0-9])"
_PEM_HEAD = rf"{_CHAR}*?-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----(?:\s|\\[rn])*+"
_B64, _BREAK = "[A-Za-z0-9+/=]", r"(?:\s|\\[rn])++"
# The body of a private key, whole: lines of 16 or more, the last one may be shorter.
_PEM = rf"(?={_CHAR}*+ [A-Z ]{{0,30}}PRIVATE KEY-----){_PEM_HEAD}{_B64}{{16,}}+(?:{_BREAK}{_B64}{{16,}}+)*+(?:{_BREAK}{_B64}{{1,15}}+(?=(?:{_BREAK})?+-----END))?+"
_CANDIDATE = rf"(?<!{_CHAR})(?:{_PEM}|{_KEYED}|{_RUN})|{_KNOWN}"
# What stands before the value in a candidate: a credential's name, or any other assigned name.
_LEAD = rf"^(?:{_PEM_HEAD}|{_CHAR}*?(?i:{_SET})(?={_VALUE})|[A-Za-z_][A-Za-z0-9_.-]*+=(?=[^=]))"
# Values that stand for a secret to be put in, or read one from elsewhere.
_BLANKS = (
    r"(?i)^(?:[$%]?[{<(\[]|\$[A-Z_][A-Z0-9_]*+[;,)]*$|%[a-z_]+%|os\.|process\.|env[.(\[]|getenv|changeme|change[_-]me|placeholder|redacted"
    r"|your[_-]|example|x{6,}|\*{6,}|(?:null|none|true|false|undefined)[,;)}]*$)"
)
# Keys of manuals and made-up ones.
_MADE_UP = r"(?i)example|sample|dummy|fake|changeme|(.)\1{20,}|0123456789|abcdefgh"
# A call or an index in program text, or a name with its dots.
_CODE = r"^[A-Za-z_][A-Za-z0-9_]*+(?:\.[A-Za-z_][A-Za-z0-9_]*+)*+[\[(]|^[A-Za-z_]++(?:\.[A-Za-z_]++)++[,;)]*$"
# Mail addresses; numbers, dates, versions, network addresses; UUIDs; paths of lower-case names.
_OTHER = (
    r"^[A-Za-z0-9._+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++\.?$|^[0-9.+/_=-]++$|^[0-9T.+/_-]++Z?$"
    r"|^(?i:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})$|^[a-z0-9_.-]*+(?:/[a-z0-9_.-]*+){2,}+$"
)
_DIGEST_NAME = r"(?i)(?:sha-?\d*|md5|hash|digest|checksum|commit|revision|etag|integrity)[\"']?[\s:=(]{0,4}[\"']?$"
_GAP = rf"(?s)(.*?)({_CANDIDATE}|\z)"

FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "hex", "transitions", "entropy", "covered",
    "path_depth", "path_test", "named", "assigned", "quoted", "word_before", "word_after", "known", "stand_in",
]


def find_candidates(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per candidate: ``keep``, ``start`` (from 0), ``value``, ``before``, ``after``.

    Whole texts are read; null texts have no candidates. Places and lengths are in characters.
    """
    found = docs.filter(F.col(text).rlike(_CANDIDATE)).select(
        *keep,
        F.regexp_extract_all(text, F.lit(_GAP), F.lit(1)).alias("gaps"),
        F.regexp_extract_all(text, F.lit(_GAP), F.lit(2)).alias("hits"),
    )
    # The last match is the text's end: its gap is what follows the last candidate.
    ends = F.aggregate(
        F.arrays_zip("gaps", "hits"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")),
        lambda a, m: F.struct(
            (a["at"] + F.length(m["gaps"]) + F.length(m["hits"])).alias("at"),
            F.concat(a["ends"], F.array(a["at"] + F.length(m["gaps"]) + F.length(m["hits"]))).alias("ends"),
        ),
        lambda a: a["ends"],
    )
    each = found.withColumn("ends", ends).select(*keep, "gaps", F.posexplode(F.arrays_zip("hits", "ends")).alias("nth", "hit"))
    whole = F.col("hit.hits")
    lead = F.regexp_extract(whole, _LEAD, 0)
    value = F.substr(whole, F.length(lead) + 1)
    before = F.concat(F.substr(F.get("gaps", F.col("nth")), F.lit(-NEAR)), lead)
    return (
        each.filter(F.length(whole) > 0)
        .select(
            *keep,
            (F.col("hit.ends") - F.length(value)).cast("long").alias("start"),
            value.alias("value"),
            before.alias("before"),
            F.substring(F.coalesce(F.get("gaps", F.col("nth") + 1), F.lit("")), 1, NEAR).alias("after"),
        )
        .filter(F.length("value") > 0)
    )


def dictionary(docs: DataFrame, text: str = "text", share: float = DICTIONARY_SHARE) -> DataFrame:
    """Words (``word``) that stand in at least ``share`` of all texts, and in two; all texts are read."""
    texts = docs.filter(F.col(text).isNotNull()).select(text)
    # Whole words only: pieces of keys are no dictionary.
    alone = F.regexp_extract_all(F.lower(text), F.lit("(?<![0-9a-z])[a-z]{4,}+(?![0-9a-z])"), F.lit(0))
    each = texts.select(F.explode(F.array_distinct(alone)).alias("word"))
    counted = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= max(2.0, share * texts.count())).select("word")


def _add_covered(findings: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``covered``, the share of each value that dictionary words of four letters or more cover."""
    values = findings.select(F.col("value").alias("_of")).distinct()
    runs = values.select("_of", F.explode(F.regexp_extract_all(F.lower("_of"), F.lit("[a-z]{4,}+"), F.lit(0))).alias("word"))
    known = runs.join(words, "word", "left_semi").groupBy("_of").agg(F.sum(F.length("word")).alias("_known"))
    joined = findings.join(known, F.col("value") == F.col("_of"), "left")
    return joined.withColumn("covered", F.coalesce("_known", F.lit(0)) / F.length("value")).drop("_of", "_known")


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def add_features(findings: DataFrame, words: DataFrame | list[str], path: str) -> DataFrame:
    """Add ``FEATURES`` to candidates; ``path`` names the column that says where the text is from.

    ``words``: the dictionary, a table of distinct words (``word``) or a list.
    """
    if isinstance(words, list):
        words = findings.sparkSession.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    value = F.col("value")
    chars = F.array_distinct(F.split(value, ""))
    share = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / F.length(value)
    entropy = F.aggregate(
        F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(F.greatest(share(c), F.lit(1e-9)))
    )
    switches = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    place = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit(""))
    flag = lambda column, pattern: column.rlike(pattern).cast("double")
    added = {
        "length": F.length(value).cast("double"),
        "digits": _share(value, "[0-9]"),
        "uppers": _share(value, "[A-Z]"),
        "lowers": _share(value, "[a-z]"),
        "others": _share(value, "[^0-9A-Za-z]"),
        "hex": _share(value, "[0-9a-fA-F]"),
        "transitions": F.regexp_count(value, F.lit(switches)) / F.greatest(F.length(value) - 1, F.lit(1)),
        "entropy": entropy,
        "path_depth": F.regexp_count(place, F.lit("/")).cast("double"),
        "path_test": flag(place, "(?i)test|example|sample|fixture|mock|doc"),
        "named": flag(F.col("before"), rf"(?i)(?:{_NAME})"),
        "assigned": flag(F.col("before"), r"[:=]\s{0,3}[\"']?$"),
        "quoted": flag(F.col("before"), "[\"']$") * flag(F.col("after"), "^[\"']"),
        "word_before": flag(F.col("before"), r"\p{L}\s*$"),
        "word_after": flag(F.col("after"), r"^\s*\p{L}"),
        "known": is_known(findings).cast("double"),
        "stand_in": (value.rlike(_BLANKS) | value.rlike(_MADE_UP)).cast("double"),
    }
    return _add_covered(findings, words).withColumns(added)


def is_known(findings: DataFrame) -> Column:
    """Whether a value's own format says that it is a secret: vendor keys, JWT, a private key's body."""
    pem = findings["before"].rlike(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:\s|\\[rn])*+$")
    return F.coalesce(findings["value"].rlike(_KNOWN) | pem, F.lit(False))


def weak_label(findings: DataFrame) -> DataFrame:
    """``label`` for findings that nobody has looked at: 1, 0, or null where nothing tells.

    1: values of known formats, named or not, and random values under a credential's name: 16
    characters or more with at least 3 bits of entropy a character, or fewer, with a digit among
    others, with 2.2; program text is neither. 0: placeholders and made-up keys, addresses, numbers
    and dates, UUIDs, paths, digests that are called so and values mostly of dictionary words.
    """
    value, before = F.col("value"), F.col("before")
    given = (F.col("named") > 0) & (F.col("assigned") > 0)
    mixed = value.rlike("[0-9]") & value.rlike("[^0-9]")
    long = (F.col("length") >= 16) & (F.col("entropy") >= 3)
    short = (F.col("length") < 16) & (F.col("entropy") >= 2.2) & mixed
    blank = F.col("stand_in") > 0
    digest = before.rlike(_DIGEST_NAME) & value.rlike("^[0-9a-fA-F]{32,128}$")
    label = (
        F.when((F.col("known") > 0) & ~blank, 1.0)
        .when(blank | digest | (F.col("covered") >= 0.6), 0.0)
        .when(given & (long | short) & (F.col("covered") < 0.3) & ~value.rlike(_CODE), 1.0)
        .when(~given & value.rlike(_OTHER), 0.0)
    )
    return findings.withColumn("label", label)


def train(labelled: DataFrame, key: list[str], each: int = TRAIN_FINDINGS) -> RandomForestClassificationModel | None:
    """A forest from ``FEATURES`` and ``label`` (0 or 1), or None if one class has no finding.

    Findings are of four kinds: of a known format or not, with either label. Of each the ``each`` ones
    that are least by hash of ``key`` are used, so the sample and with it the forest are the same each
    time; kinds weigh alike within their class, and classes alike, however rare one is.
    """
    columns = ["label", *FEATURES, *key]
    drawn = None
    for label in (0.0, 1.0):
        for known in (0.0, 1.0):
            kind = labelled.filter((F.col("label") == label) & (F.col("known") == known)).select(*columns)
            some = draw(kind, each, *key)
            drawn = some if drawn is None else drawn.union(some)
    sample = store(drawn.coalesce(1).sortWithinPartitions("label", *key, *FEATURES), "labelled")
    counts = [(r["label"], r["known"], r["count"]) for r in sample.groupBy("label", "known").count().collect()]
    kinds = {label: sum(1 for other, _, _ in counts if other == label) for label, _, _ in counts}
    if len(kinds) < 2:
        return None
    weight = F.lit(None).cast("double")
    for label, known, n in counts:
        weight = F.when((F.col("label") == label) & (F.col("known") == known), 1000.0 / (n * kinds[label])).otherwise(weight)
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.withColumn("weight", weight))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=0.9, featureSubsetStrategy="0.6", weightCol="weight"
    )
    return forest.fit(assembled)


def score(findings: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Add ``score``, the forest's share of votes for a secret; without a forest the weak label.

    Undecided findings without a forest have 0.
    """
    if model is None:
        return weak_label(findings).withColumn("score", F.coalesce("label", F.lit(0.0))).drop("label")
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings)
    voted = model.transform(assembled).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return voted.drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source", labels: DataFrame | None = None) -> DataFrame:
    """doc_id, start, length, value, named, score, is_secret of every candidate in every text.

    ``labels`` are labelled findings: ``FEATURES``, ``label`` (0 or 1), doc_id and start. The forest learns
    from them, and a candidate at a labelled place has its label as score (of several the least).
    Without them the candidates' weak labels are used, and those that have none are only judged.
    Null ids, null paths and repeated rows are scanned like others; an empty table and one without
    candidates give no rows.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{path}`").alias("path"))
    found = store(find_candidates(own, ["doc_id", "path"]), "candidates")
    findings = store(add_features(found, dictionary(own), "path"), "findings")
    model = train(weak_label(findings) if labels is None else labels, ["doc_id", "start"])
    scored = score(findings, model)
    if labels is not None:
        told = labels.groupBy(F.col("doc_id").alias("_id"), F.col("start").alias("_at")).agg(F.min("label").cast("double").alias("_told"))
        scored = scored.join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("start") == F.col("_at")), "left")
        scored = scored.withColumn("score", F.coalesce("_told", "score"))
    return scored.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "value", (F.col("named") > 0).alias("named"),
        F.round("score", 9).alias("score"), (F.col("score") >= 0.5).alias("is_secret"),
    )
