"""Spelling variants against all pairs of words, and the contract's words against plain Python."""

import random
import re
import zlib
from collections import Counter

from spoor.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio):
    form = {}
    out = []
    for word, n in counts.items():
        others = [w for w in counts if near(word, w)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= ratio * n else None
        out.append((word, n, len(others)))
    rows = []
    for word, n, n_near in out:
        root = word
        while form[root] is not None:
            root = form[root]
        rows.append((word, form[word], root, n, n_near, counts.get(form[word])))
    return sorted(rows)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_equals_all_pairs(spark):
    rng = random.Random(2)
    for letters, n in (("ab", 60), ("abcé", 150), ("aàbcdefgh", 200)):
        words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n)}
        counts = {w: rng.choice([1, 1, 2, 3, 7, 20, 21, 150, 900]) for w in words}
        df = spark.createDataFrame(list(counts.items()), "word string, n long")
        for ratio in (2, 5):
            assert got(spelling.variants(df, ratio)) == brute(counts, ratio)


def test_runs_of_a_letter_count_once_and_chains_are_followed(spark):
    counts = {"aab": 500, "ab": 100, "b": 20, "aaab": 3, "aac": 500, "zz": 1}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = got(spelling.variants(df))
    assert rows == brute(counts, 5)
    assert ("b", "ab", "aab", 20, 1, 100) in rows and ("zz", None, "zz", 1, 0, None) in rows


def contract_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_contract_words_of_odd_texts(spark):
    rng = random.Random(4)
    words = ["Straße", "strasse", "Éclair", "ÉCLAIR", "éclairs", "x×y÷zw", "colour", "color", "colours", "COLOUR", "Colouring", "naïveté"]
    rows = [(i % 300, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))), "x") for i in range(400)]
    rows += [(None, "colour " * 50, "y"), (1, None, None), (2, "", "z"), (3, "1234 -- ##", "z"), (4, "colour" * 20_000, "z"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    counts = contract_counts([r[:2] for r in rows])
    assert any(h not in {w.lower() for w in words} for h in counts)  # some were misspelt
    assert got(spelling.spelling_variants(docs)) == brute(counts, 5)
    assert got(spelling.spelling_variants(docs.limit(0))) == []


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = contract_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got(spelling.spelling_variants(docs)) == brute(counts, 5)
