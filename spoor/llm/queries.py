"""The registered queries of this subpackage, one for each operator, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import decontaminate as decon
from spoor.llm import language_id, licenses, lm_score, mixing, near_dedup, neighbours, prefix_trie, repeats, secrets
from spoor.llm import sharding, spelling, url_filter
from spoor.llm.common import read_table, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# DuckDB: the words of a text after lower-casing A-Z only (lower() would change other letters too).
WORDS_SQL = (
    "regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


def crc32_sql(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of a string's UTF-8 bytes, bit by bit."""
    byte = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte}), lambda c, b: {bits}), 4294967295)"


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


@query(
    f"""
    WITH w AS (SELECT doc_id, {WORDS_SQL.format(text="text")} AS ws FROM documents),
    i AS (SELECT item_id, {WORDS_SQL.format(text="text")} AS ws FROM benchmark),
    windows AS (SELECT DISTINCT item_id, n, list_slice(ws, p, p + n - 1) AS win
        FROM (SELECT item_id, ws, least(len(ws), 13) AS n,
            unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS p FROM i WHERE len(ws) > 0)),
    lengths AS (SELECT DISTINCT n FROM windows),
    places AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, lengths WHERE len(ws) >= n),
    hits AS (SELECT doc_id, p, x.n, item_id FROM places AS x JOIN windows AS y
        ON x.n = y.n AND list_slice(ws, p, p + x.n - 1) = win),
    words AS (SELECT doc_id, count(DISTINCT k) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
        CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
    FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """
)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decon.find_spans(docs, read_table(spark, sf_dir, "benchmark"))
    n_hit, ids = decon.hit_words(F.col("spans")), decon.item_ids(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
        decon.is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


@query(
    r"""
    WITH d AS (SELECT doc_id, source,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
            CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
        FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
            CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END
                AS weight
        FROM d GROUP BY source),
    r AS (SELECT *, row_number() OVER o AS k,
            CAST(sum(source_size) OVER () AS DOUBLE) AS total, CAST(sum(weight) OVER () AS DOUBLE) AS weights,
            coalesce(sum(3.0 * source_size) OVER b, 0) AS full_before, coalesce(sum(weight) OVER b, 0) AS weight_before
        FROM s WINDOW o AS (ORDER BY source_size / weight, source),
            b AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    rate AS (SELECT arg_min(lam, k) AS rate FROM (
        SELECT k, weight, source_size, (total - CAST(full_before AS DOUBLE)) / (weights - CAST(weight_before AS DOUBLE)) AS lam
        FROM r) WHERE CAST(weight AS DOUBLE) * lam < 3.0 * source_size),
    t AS (SELECT source, source_size, weight,
            round(least(CAST(weight AS DOUBLE) * rate, CAST(3.0 * source_size AS DOUBLE)), 6) AS target FROM s, rate),
    c AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS wanted,
            CASE weight WHEN 5.0 THEN 7.5 WHEN 2.0 THEN 2.0 ELSE 0.5 END AS w0,
            CASE weight WHEN 5.0 THEN 2.5 WHEN 2.0 THEN 2.0 ELSE 1.5 END AS w1, CAST(weight AS DOUBLE) AS w,
            CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    p AS (SELECT *, before * w / target AS y, CAST(w0 AS DOUBLE) AS a, CAST(w1 - w0 AS DOUBLE) AS b FROM c)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
        CAST(greatest(0, least(size, wanted - before)) + greatest(0, least(size, wanted - before - source_size))
            + greatest(0, least(size, wanted - before - 2 * source_size)) AS BIGINT) AS taken,
        CASE WHEN size > 0 AND before < wanted THEN
            round(CASE WHEN y <= 0 THEN 0.0 ELSE least(1.0, 2 * y / (a + sqrt(a * a + 2 * b * y))) END, 9) END AS position
    FROM p
    """
)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size")
    )
    sized = store(docs, "sizes")
    schedules = mixing.cycled_schedules(mixing.ranked_sources(sized))
    mixed = mixing.mix(sized, schedules, cut=True)
    return mixing.training_order(mixed).select("doc_id", "size", "source_size", "target", "taken", "position")


@query()
def op10_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.assign(sharding.digest(docs), n_shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query()
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", F.col("kept").alias("keep"))


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format(text="text")} AS ws FROM documents),
    w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) > 0),
    g AS (SELECT r, i, w AS g1, lag(w) OVER p || ' ' || w AS g2,
            lag(w, 2) OVER p || ' ' || lag(w) OVER p || ' ' || w AS g3
        FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
    n1 AS (SELECT g1, count(*) AS c FROM g GROUP BY g1),
    n2 AS (SELECT g2, count(*) AS c FROM g WHERE g2 IS NOT NULL GROUP BY g2),
    n3 AS (SELECT g3, count(*) AS c FROM g WHERE g3 IS NOT NULL GROUP BY g3),
    c AS (SELECT g.r, i, n1.c - count(*) OVER (PARTITION BY g.r, g.g1) AS c1,
            n2.c - count(*) OVER (PARTITION BY g.r, g.g2) AS c2, n3.c - count(*) OVER (PARTITION BY g.r, g.g3) AS c3,
            (SELECT count(*) FROM w) - count(*) OVER (PARTITION BY g.r) AS others
        FROM g JOIN n1 USING (g1) LEFT JOIN n2 USING (g2) LEFT JOIN n3 USING (g3)),
    s AS (SELECT r, CASE
            WHEN c3 > 0 THEN ln(c3 / lag(c2) OVER p)
            WHEN c2 > 0 THEN ln(c2 / lag(c1) OVER p) + least(i - 2, 1) * ln(0.4)
            WHEN c1 > 0 THEN ln(c1 / greatest(others, 1)) + least(i - 1, 2) * ln(0.4)
            ELSE ln(0.4 / greatest(others, 1)) + least(i - 1, 2) * ln(0.4) END AS s
        FROM c WINDOW p AS (PARTITION BY r ORDER BY i))
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(t, 0.0), 6) AS log_score,
        CASE WHEN len(ws) > 0 THEN round(t / len(ws), 6) END AS mean_log_score
    FROM d LEFT JOIN (SELECT r, sum(s) AS t FROM s GROUP BY r) USING (r)
    """
)
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select(
        "doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score")
    )


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(docs.filter(~held))
    found = language_id.identify(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.concat_ws(",", "langs").alias("langs"))


def _license_oracle() -> str:
    def words(text: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"

    rows = ", ".join(
        f"('{t.label}', {t.base}, {words(t.text)}, {words(t.key)}, {(' ' + t.text + ' ').index(' ' + t.key + ' ')})"
        for t in licenses.TEMPLATES
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format(text="text")} AS ws FROM documents),
    t AS (SELECT label, base, words, key, len(string_split(array_to_string(words, ' ')[1:off], ' ')) - 1 AS skip
        FROM (VALUES {rows}) AS x(label, base, words, key, off)),
    p AS (SELECT r, ws, label, base, words, key, skip, unnest(range(1, len(ws) - len(key) + 2)) AS p
        FROM d, t WHERE len(ws) >= len(key) AND list_has_all(ws, key)),
    m AS (SELECT r, label, base, p - 1 AS start,
            list_sum(list_transform(range(1, len(words) + 1),
                lambda j: CASE WHEN p - skip + j - 1 BETWEEN 1 AND len(ws) AND ws[p - skip + j - 1] = words[j]
                    THEN 1 ELSE 0 END)) / len(words) AS share
        FROM p WHERE list_slice(ws, p, p + len(key) - 1) = key),
    g AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
            max(start) FILTER (base) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
            string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
        FROM m WHERE share >= {licenses.LEAST_SHARE} GROUP BY r)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word,
        last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
        round(coalesce(score, 0.0), 9) AS score
    FROM d LEFT JOIN g USING (r)
    """


@query(_license_oracle())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)), 9).alias("score"),
    )


@query()
def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return neighbours.search(vectors, vectors.filter(F.col("id") % 20 == 0), k=20)


def _url_oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({quote(r.name)}, {quote(r.verdict)}, {quote(r.pattern)}, {r.site})" for r in url_filter.RULES)
    return f"""
    WITH u AS (SELECT row_number() OVER () AS r, page_id,
            CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT r, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
    p AS (SELECT r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            substr(rest, length(raw) + 1) AS tail FROM h),
    rules AS (SELECT * FROM (VALUES {rules}) AS x(rule, verdict, pattern, site)),
    f AS (SELECT r, rule, verdict, site FROM p, rules WHERE regexp_matches(host || tail, pattern)),
    g AS (SELECT r, arg_max(rule, length(rule)) FILTER (site) AS rule,
            arg_max(verdict, length(rule)) FILTER (site) AS verdict, min(rule) FILTER (NOT site) AS filter FROM f GROUP BY r)
    SELECT page_id, host, regexp_extract(tail, '^[^?#]*') AS path, rule,
        coalesce(verdict, CASE WHEN filter IS NOT NULL THEN 'block' END, 'allow') AS verdict, filter
    FROM p LEFT JOIN g USING (r)
    """


@query(_url_oracle())
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


@query()
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    # The value itself is not passed on.
    return found.withColumn("value_sha256", F.sha2(F.col("value").cast("binary"), 256)).drop("value")


@query(
    """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    w AS (SELECT r, doc_id, p, md5_number(substr(x, 2 * p + 1, 200)) AS s
        FROM (SELECT *, unnest(range(0, length(x) // 2 - 99)) AS p FROM d WHERE length(x) >= 200)),
    f AS (SELECT s, min(doc_id) AS first_doc FROM w GROUP BY s HAVING count(*) > 1),
    g AS (SELECT r, p FROM (SELECT r, p, doc_id > first_doc AS other, row_number() OVER (PARTITION BY r, s ORDER BY p) AS nth
        FROM w JOIN f USING (s)) WHERE other OR nth > 1),
    k AS (SELECT r, p, sum(opens) OVER (PARTITION BY r ORDER BY p) AS k FROM (SELECT r, p,
        CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 100 THEN 0 ELSE 1 END AS opens FROM g)),
    s AS (SELECT r, min(p) AS a, max(p) + 100 AS b FROM k GROUP BY r, k),
    t AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS past FROM s),
    h AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS ends,
            string_agg(substr(x, 2 * past + 1, 2 * (a - past)), '' ORDER BY a) AS head
        FROM t JOIN d USING (r) GROUP BY r)
    SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
        CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
        sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(ends, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN h USING (r)
    """
)
def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query(
    rf"""
    WITH r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')),
            '{spelling.UPPER}', '{spelling.LOWER}') AS run FROM documents),
    d AS (SELECT run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS told FROM r GROUP BY doc_id, run),
    h AS (SELECT run, n, {crc32_sql("told")} AS h FROM d),
    w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
        FROM h),
    v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    g AS (SELECT word, n, substr(word, 1, j) || '_' || substr(word, j + 2) AS gap, substr(word, 1, j) || substr(word, j + 2) AS cut
        FROM (SELECT *, unnest(range(0, length(word))) AS j FROM v)),
    p AS (SELECT DISTINCT a.word AS a, b.word AS b FROM g AS a JOIN g AS b USING (gap) WHERE a.word <> b.word
        UNION SELECT g.word, v.word FROM g JOIN v ON g.cut = v.word UNION SELECT v.word, g.word FROM g JOIN v ON g.cut = v.word),
    f AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-v.n, b)) AS best, max(v.n) AS best_n FROM p JOIN v ON b = v.word GROUP BY a),
    m AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form,
        CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN f USING (word)),
    c AS (WITH RECURSIVE t AS (SELECT word, word AS root, form AS onward FROM m
        UNION ALL SELECT t.word, t.onward, m.form FROM t JOIN m ON t.onward = m.word) SELECT * FROM t WHERE onward IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM m JOIN c USING (word)
    """
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    f"""
    WITH x AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    i AS (SELECT conv_id, turn, md5(strlen(role) || ':' || role || text) AS id, strlen(text) AS size FROM x),
    t AS (SELECT conv_id, id, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id, size) AS k FROM i),
    c AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT c.conv_id, 0 AS own, k, id, size FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND k <= h
        UNION ALL SELECT conv_id, 1, k, id, size FROM c JOIN t USING (conv_id) WHERE k > h),
    s AS (SELECT conv_id, size, row_number() OVER o AS d, string_agg(id, '') OVER o AS prefix FROM r
        WINDOW o AS (PARTITION BY conv_id ORDER BY own, k)),
    m AS (SELECT conv_id, d, prefix, size FROM s UNION ALL SELECT conv_id, 0, '', 0 FROM c),
    e AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM m),
    n AS (SELECT prefix, any_value(d) AS d, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
        string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ids FROM e GROUP BY prefix),
    k AS (SELECT left(prefix, 32 * (d - 1)) AS prefix, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
    u AS (SELECT left(n.prefix, 32 * a) AS prefix, count(*) FILTER (n_children IS NULL) AS n_leaves,
            sum((n_convs - 1) * size) AS saved_tokens
        FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM n) AS n LEFT JOIN k ON n.prefix = k.prefix GROUP BY 1)
    SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
        CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
    FROM n JOIN u USING (prefix) LEFT JOIN k USING (prefix) LEFT JOIN n AS p ON n.d > 0 AND p.prefix = left(n.prefix, 32 * (n.d - 1))
    """
)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.conversation_turns(read_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.shared_heads(turns))
