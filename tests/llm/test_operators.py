"""Operators against brute force, exact round trips and held-out accuracy, and on odd input."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest_llm import SF, words
from spoor.llm import (
    bagminhash,
    decontaminate,
    language_id,
    licenses,
    lm_score,
    mixing,
    near_dedup,
    neighbours,
    secrets,
    sharding,
    url_filter,
)
from spoor.llm.components import components
from spoor.llm.words import words_of


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- near duplicates ---------------------------------------------------------------------------


def bag(text, n=5):
    w = words(text)
    grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else [])
    return {g: grams.count(g) for g in set(grams)}


def weighted_jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def family(rng, name, n, edits, length=150):
    base = [f"{name}{rng.randrange(40)}" for _ in range(length)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(length)] = f"{name}x{rng.randrange(1000)}"
        out.append(" ".join(own))
    return out


def classes(texts, least=0.8):
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    bags = [bag(t) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if bags[i] and bags[j] and weighted_jaccard(bags[i], bags[j]) >= least:
            a, b = sorted((find(i), find(j)))
            top[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("small", [32, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(11)
    texts = family(rng, "a", 40, 8) + family(rng, "b", 15, 2) + family(rng, "c", 10, 30)
    texts += texts[:12] + ["", "short text", "Short   TEXT!", "short", "- -", "- -"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)
    kept = near_dedup.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({got[i] for i in got})


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(4)
    key = bagminhash.mix(rng.integers(0, 2**62, 400).astype(np.uint64))
    a = rng.integers(0, 30, 400)
    b = np.where(rng.random(400) < 0.6, a, rng.integers(0, 30, 400))
    text = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    keys, weights = np.concatenate([key[a > 0], key[b > 0]]), np.concatenate([a[a > 0], b[b > 0]])
    signed = bagminhash.signatures(text, keys, weights, 2, 5000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signed[0] == signed[1]).mean() - want) < 0.03


def test_overlaps_equal_similarity():
    rng = random.Random(2)
    texts = family(rng, "q", 12, 5, 60) + ["", "a b", "a b a b a b a b a b"]
    text, key, weight = bagminhash.bags(words_of(pa.array(texts)), 5)
    one, two = np.arange(0, 8), np.arange(8, 15)
    got = bagminhash.overlaps(text, key, weight, len(texts), one, two)
    for i, j in itertools.product(range(8), range(7)):
        a, b = bag(texts[i]), bag(texts[8 + j])
        assert got[i, j] == pytest.approx(weighted_jaccard(a, b) if b else 0.0)


def test_near_duplicates_on_odd_rows(spark, odd_docs):
    got = rows_of(near_dedup.near_duplicates(odd_docs).select("doc_id", "class_id"))
    assert len(got) == odd_docs.count() and all(a == b for a, b in got)
    kept = near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == odd_docs.count() - 1  # the repeated row
    assert near_dedup.keep_one(odd_docs.limit(0)).count() == 0


def test_one_document_stays_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (None, text), (None, text + " x"), (7, text + " y"), (7, text + " z"), (None, "other words"), (None, "other words")]
    for some, left in ((rows, 2), (rows[:3], 1), (rows[3:], 2)):
        docs = spark.createDataFrame(some, "doc_id long, text string")
        assert near_dedup.keep_one(docs).count() == left


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    want = {x: find(x) for x in top if find(x) != x}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


# --- decontamination ---------------------------------------------------------------------------


@pytest.mark.parametrize("window", [2, 5, 13])
def test_search_equals_brute_force(window):
    rng = random.Random(window)
    vocab = ["a", "b", "the", "Éa", "x1", "Of"]
    docs = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 40, 700]))) for _ in range(12)] + [None, ""]
    items = []
    for i in range(14):
        own = words(rng.choice(docs))
        k, p = rng.randint(0, 20), rng.randint(0, max(0, len(own) - 1))
        items.append((i, "-".join(own[p : p + k])))
    groups, spelled = decontaminate.build_patterns(items, window)
    found = decontaminate._spans_of(words_of(pa.array(docs)), groups, spelled)
    for doc, spans in zip(docs, found):
        own, hit, named = words(doc), set(), set()
        for i, text in items:
            w = words(text)
            n = min(len(w), window)
            for p, q in itertools.product(range(len(w) - n + 1), range(len(own) - n + 1)) if n else ():
                if own[q : q + n] == w[p : p + n]:
                    hit |= set(range(q, q + n))
                    named.add(str(i))
        assert {k for s in spans for k in range(s["start"], s["end"])} == hit
        assert {s["item"] for s in spans} == named


def test_many_passes_and_odd_rows(spark, odd_docs):
    items = spark.createDataFrame(
        [(1, "alpha beta gamma delta epsilon zeta"), (2, None), (None, "one two three"), (3, ""), (4, "four five six"), (4, "six seven")],
        "item_id long, text string",
    )
    spans = F.col("spans")
    told = ["doc_id", "n_words", decontaminate.hit_words(spans).alias("n_hit"), decontaminate.item_ids(spans).alias("ids")]
    one = rows_of(decontaminate.find_spans(odd_docs, items).select(*told))
    many = rows_of(decontaminate.find_spans(odd_docs, items, pass_bytes=10).select(*told))
    assert one == many and (None, 7, 4, ["4"]) in one
    kept = decontaminate.decontaminate(odd_docs, items)
    assert kept.columns == odd_docs.columns  # its own column Spans stays
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert decontaminate.find_spans(odd_docs, items.limit(0)).filter(F.size("spans") > 0).count() == 0
    assert decontaminate.decontaminate(odd_docs.limit(0), items).count() == 0


# --- language ----------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(docs.filter(~held))
    got = language_id.identify(docs.filter(held), model).select("doc_id", "lang", "lang_pred", "score").collect()
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(docs.count()))
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_finds_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs)
    some = {lang: docs.filter((F.col("lang") == lang) & (F.col("n_chars") > 1500)).orderBy("doc_id").first().text for lang in ("de", "fr")}
    both = spark.createDataFrame([(1, some["de"][:1500] + " " + some["fr"][:900]), (2, some["fr"])], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(both, model).collect()}
    assert got[1].langs == ["de", "fr"] and 0.5 < got[1].score < 0.75
    assert got[2].langs == ["fr"]


def test_language_of_odd_rows(spark, odd_docs):
    model = language_id.learn(odd_docs)
    assert model.languages == ["de", "en", "fr"]
    got = language_id.identify(odd_docs, model)
    undetermined = {r.doc_id for r in got.filter("lang_pred = 'und'").collect()}
    assert undetermined == {2, 3, 6} and got.count() == odd_docs.count()
    assert language_id.keep_identified(odd_docs, model).columns == odd_docs.columns
    nothing = language_id.learn(odd_docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd_docs, nothing).collect()} == {"und"}


# --- LM scores, licences -----------------------------------------------------------------------


def test_lm_scores_on_odd_rows(spark, odd_docs):
    got = {(r.doc_id, r.n_words): r for r in lm_score.score(odd_docs).collect()}
    assert got[(2, 0)].log_score == 0 and got[(2, 0)].mean_log_score is None
    assert got[(4, 60_000)].log_score < 0 and (None, 7) in got
    twice = [r for r in lm_score.score(odd_docs).collect() if r.doc_id == 1 and r.n_words > 20]
    assert len(twice) == 2 and twice[0].log_score == twice[1].log_score
    assert lm_score.score(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("buckets", [1, 7, 300])
def test_lm_scores_do_not_depend_on_blocks(spark, monkeypatch, buckets):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: r.log_score for r in lm_score.score(docs).collect()}
    monkeypatch.setattr(lm_score, "LEAST_BLOCK", 100_000)
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 1 + 600_000 // buckets)
    got = {r.doc_id: r.log_score for r in lm_score.score(docs).collect()}
    assert got == pytest.approx(want)


def test_licenses_on_odd_rows(spark, odd_docs):
    got = licenses.scan(odd_docs, outputs=("n_words", "spans")).select("doc_id", "n_words", "spans").collect()
    first = [r for r in got if r.doc_id == 1 and r.spans]
    assert [(m.label, m.start, m.share) for m in first[0].spans] == [("cc-by", 2, 1.0), ("cc-by-nc", 2, 1.0)]
    assert len(first) == 2 and sum(r.n_words == 0 for r in got) == 2
    assert licenses.scan(odd_docs.limit(0)).count() == 0


# --- mixing, sharding --------------------------------------------------------------------------


def test_mix_meets_its_targets(spark, odd_docs):
    rng = random.Random(6)
    rows = [(i, f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}", rng.randrange(0, 400)) for i in range(3000)] + [(None, None, 7)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(docs, mixing.cycled_schedules(mixing.ranked_sources(docs)), cut=True, slice_rows=50).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 3 * r.size and r.taken == sum(t.words for t in r.takes)
        assert all(0 <= t.time <= 1 for t in r.takes)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(sum(r.size for r in got))
    for rs in by.values():
        assert sum(r.taken for r in rs) == int(rs[0].target) and rs[0].target <= 3 * rs[0].source_size
    # A fading source has more than half of its words in the first half of training.
    early = {s: sum(t.words for r in rs for t in r.takes if t.time < 0.5) / max(1, sum(r.taken for r in rs)) for s, rs in by.items()}
    assert early["s0"] > 0.55 and abs(early["s1"] - 0.5) < 0.05 and early["s2"] < 0.45


def test_schedules_of_several_pieces(spark):
    docs = spark.createDataFrame([(i, "a", 10) for i in range(1000)], "doc_id long, source string, size long")
    knots = spark.createDataFrame([("a", [(0.5, 0.0), (0.0, 1.0), (1.0, 1.0)])], "source string, knots array<struct<t double, weight double>>")
    times = [r.takes[0].time for r in mixing.mix(docs, knots, cut=True).collect()]
    share = lambda lo, hi: sum(lo <= t < hi for t in times) / 1000
    assert share(0, 0.25) == pytest.approx(0.375, abs=0.01) and share(0.25, 0.5) == pytest.approx(0.125, abs=0.01)


def test_mixed_documents(spark, odd_docs):
    got = mixing.mix_documents(odd_docs, mixing.cycled_schedules)
    assert got.columns == odd_docs.columns and got.count() > 0
    assert mixing.mix_documents(odd_docs.limit(0), mixing.cycled_schedules).count() == 0


def test_sharding_is_exact_and_repeatable(spark):
    rows = [(i % 700, f"text {i % 90}") for i in range(3001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = sharding.assign(sharding.digest(docs), 40, block_rows=100)
    got = rows_of(placed)
    assert got == rows_of(sharding.assign(sharding.digest(docs.repartition(7)), 40, block_rows=100))
    shards = {}
    for r in placed.collect():
        shards.setdefault(r.shard, []).append(r.slot)
    assert sorted(shards) == list(range(40)) and {len(s) for s in shards.values()} == {75, 76}
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_draws_are_hypergeometric():
    rng = np.random.default_rng(3)
    got = np.bincount([sharding._draw(rng, 30, 70, 20) for _ in range(20_000)], minlength=21) / 20_000
    want = np.bincount(np.random.default_rng(4).hypergeometric(30, 70, 20, 200_000), minlength=21) / 200_000
    assert np.abs(got - want).max() < 0.012
    matrix = sharding.communication_matrix([0, 5, 10**12], sharding.shard_sizes(10**12 + 5, 7))
    assert matrix.sum(axis=1).tolist() == [0, 5, 10**12]
    assert matrix.sum(axis=0).tolist() == sharding.shard_sizes(10**12 + 5, 7)


def test_sharded_rows(spark, odd_docs):
    got = sharding.shard_rows(odd_docs, 3, outputs=("shard", "n_chars"))
    assert [c for c in got.columns if c != "n_chars"] == [c for c in odd_docs.columns if c != "n_chars"] + ["shard"]
    assert rows_of(got.select("doc_id", "text")) == rows_of(odd_docs.select("doc_id", "text"))
    assert sorted(got.groupBy("shard").count().toPandas()["count"]) == [3, 3, 4]
    assert sharding.shard_rows(odd_docs.limit(0), 3).count() == 0


# --- neighbours --------------------------------------------------------------------------------


def test_neighbours_against_all(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, size=(1500, 1))
    vectors[100:400] = vectors[100]  # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] + [1.0] * 15), (5004, [None] + [1.0] * 15), (5005, [1.0]), (None, rows[0][1])]
    table = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {}
    for r in neighbours.search(table, table.filter(F.col("id") % 20 == 0), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        score = vectors @ vectors[q]
        assert [s for _, _, s in found] == pytest.approx([score[v] for _, v, _ in found])
        order = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        hit += len(set(order) & {v for _, v, _ in found})
    assert hit >= 0.9 * 20 * len(got)
    # Equal vectors: the least ids come first.
    assert [v for _, v, _ in got[120]][:3] == [v for _, v, _ in got[140]][:3]


def test_few_neighbours(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "id long, vec array<double>")
    got = rows_of(neighbours.search(table, table.filter("id % 20 = 0"), 20))
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert neighbours.search(table.limit(0), table.limit(0), 20).count() == 0


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(1)
    left, right, sizes = rng.normal(size=9), rng.normal(size=7), rng.integers(0, 4, 63)
    got = neighbours.walk(left, right, sizes.tolist(), 10**9)
    order = np.argsort(-(left[:, None] + right[None, :]).ravel(), kind="stable")
    assert got == [c for c in order.tolist() if sizes[c]]


# --- urls, secrets -----------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        (1, "https://www.Example.com/en/1", "allow", "www.example.com/en/"),
        (2, "http://blog.example.com/en/", "block", "example.com/en/"),
        (3, "http://notexample.com/en/", "allow", "com/"),
        (4, "http://example.com/EN/", "allow", "com/"),
        (5, "http://a.net/fr/x?y#z", "block", "net/fr/"),
        (6, "http://a.net/de/", "allow", None),
        (7, "http://free-bets.example.org/a", "block", None),
        (8, "http://example.org/free-bets/", "allow", None),
        (9, None, "allow", None),
        (10, "no scheme.com/en/", "allow", None),
        (11, "http://example.com?x/en/", "allow", None),
        (12, "http://casino.example.com/x", "allow", "com/"),
        (1, "https://www.Example.com/en/1", "allow", "www.example.com/en/"),
        (None, "x://y://net/es/", "allow", None),
    ]
    pages = spark.createDataFrame([(a, b, "h") for a, b, _, _ in rows], "page_id long, url string, host string")
    got = sorted([(r.page_id, r.url, r.verdict, r.rule) for r in url_filter.judge(pages).collect()], key=repr)
    assert got == sorted([tuple(r) for r in rows], key=repr)
    one = url_filter.judge(pages).filter("page_id = 5").first()
    assert (one.host, one.path) == ("a.net", "/fr/x")
    assert url_filter.judge(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(pages, rules=[url_filter.Rule("r", "block", "^.", ())])


def test_secrets_are_told_from_other_findings(spark, odd_docs):
    rng = random.Random(9)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, secret = [], {}
    for i in range(200):
        value = hexes(40)
        rows.append((i, f'lorem token = "{value}" ipsum 4929348385146306 and 10.20.30.40 or ab.12@mail1.example.com', "p/a"))
        secret[i] = value
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secrets.scan(docs).collect()
    text = {i: t for i, t, _ in rows}
    assert all(text[r.doc_id][r.start : r.start + r.length] == r.value for r in got)
    assert {r.doc_id: r.value for r in got if r.is_secret} == secret and len(got) > 400
    assert secrets.scan(odd_docs).filter("is_secret").count() == 0
    assert secrets.scan(docs.limit(0)).count() == 0


def test_forest_learns_from_given_labels(spark):
    """Held-out findings are told apart by what the labelled ones teach: here, by the words beside them."""
    rows = [(i, ("rotated" if i % 2 else "12:") + f" A{i * 7919:015d}zQ{i % 7} end", "p") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.add_features(secrets.find_candidates(docs, ["doc_id", "source"]), ["lorem"], "source")
    labelled = found.withColumn("label", (F.col("doc_id") % 2).cast("double"))
    model = secrets.train(labelled.filter("doc_id < 200"), ["doc_id", "start"])
    judged = secrets.score(labelled.filter("doc_id >= 200"), model).collect()
    assert len(judged) == 100 and all((r.score >= 0.5) == bool(r.label) for r in judged)


# --- clashing names ----------------------------------------------------------------------------


def test_columns_with_internal_names_stay(spark):
    names = ["_gone_id", "_wanted_takes", "_placed_doc_id", "_key_copy", "_key", "_judged_url", "site", "subject", "_time", "_letter", "node", "N_WORDS"]
    rows = [(1, f"http://a.com/en/{' word' * 9}", "s", *names), (2, f"http://b.net/fr/{' text' * 9}", None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    model = language_id.learn(docs.withColumn("lang", F.lit("en")))
    items = spark.createDataFrame([(1, "nothing of this")], "item_id long, text string")
    for out in (
        near_dedup.keep_one(docs),
        mixing.mix_documents(docs, mixing.cycled_schedules),
        sharding.shard_rows(docs, 2),
        url_filter.judge(docs, url="text"),
        decontaminate.decontaminate(docs, items),
        language_id.keep_identified(docs, model),
    ):
        assert rows_of(out.select(*names).distinct()) == [tuple(names)]
