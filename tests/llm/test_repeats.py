"""Repeated passages against brute force, and the pieces they are found with."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.llm import repeats
from spoor.llm.suffix_arrays import permuted_prefixes, suffix_array

SCHEMA = "doc_id long, text string, Spans string"


def common(a, b):
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def strings():
    rng = random.Random(1)
    yield from (b"", b"a", b"ba", b"aa", b"mississippi", b"aaaaaaab", b"baaaaaaa", b"\x00\x00\xff\x00", b"abc" * 30, b"a" * 99)
    for _ in range(300):
        letters = rng.choice([1, 2, 3, 256])
        yield bytes(rng.randrange(letters) for _ in range(rng.randrange(120)))


def test_suffix_array_and_permuted_prefixes():
    for raw in strings():
        data = np.frombuffer(raw, np.uint8)
        order = sorted(range(len(raw)), key=lambda i: raw[i:])
        got = suffix_array(data)
        assert got.tolist() == order, raw
        shared = [0] * len(raw)
        for x, y in zip(order, order[1:]):
            shared[y] = common(raw[x:], raw[y:])
        assert permuted_prefixes(data, got).tolist() == shared, raw


def test_sliding_least_is_the_least_of_each_window():
    rng = np.random.default_rng(3)
    for n, width in ((1, 1), (7, 3), (50, 7), (77, 77), (200, 77)):
        value = rng.integers(0, 50, n).astype(np.uint64)
        want = [int(value[i : i + width].min()) for i in range(n - width + 1)]
        assert repeats._sliding_least(value, width).tolist() == want


def brute(rows, length):
    """What to remove of each row, by the definition."""
    last = 1 << 63
    rank = lambda i: last if i is None else i
    firsts = {}
    for i, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            firsts[s] = min(firsts.get(s, last), rank(i))
    out = []
    for i, text in rows:
        raw, own = (text or "").encode(), {}
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if firsts[s] < rank(i) or s in own:
                gone[p : p + length] = [True] * length
            own.setdefault(s, p)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def found(spark, rows, length, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    out = repeats.find_repeats(docs, length=length, **more)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_removed", "kept_sha256", "spans"]
    told = out.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), "kept_sha256",
                      F.coalesce(repeats.kept_bytes("text", "spans"), F.lit(b"")).alias("kept"))
    return sorted([(*r[:5], bytes(r[5])) for r in told.collect()], key=str)


def texts(rng, n, words):
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def odd_rows():
    rng = random.Random(5)
    words = ["alpha", "bé", "gamma", "d", "aaaaaa", "zzz"] + [f"w{i}" for i in range(40)]
    rows = [(rng.randrange(40), t) for t in texts(rng, 60, words)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(100 + i, f"{t} {passage} {t[::-1]}") for i, t in enumerate(texts(rng, 30, words))]
    rows += [(7, rows[0][1]), rows[1], rows[1], (None, passage), (None, passage), (None, None), (3, None), (4, ""), (5, "a" * 3000)]
    rows += [(200 + i, "ab" * 300 + "c" * i) for i in range(5)] + [(-5, passage[50:])]
    return rows


@pytest.mark.parametrize("length", [8, 100])
def test_equals_brute_force(spark, length):
    rows = odd_rows()
    assert found(spark, rows, length) == brute(rows, length)


def test_large_and_frequent_anchors_and_pieces_give_the_same(spark, monkeypatch):
    rows = odd_rows()
    want = brute(rows, 20)
    # Every anchor that is not alone is larger than a shard.
    assert found(spark, rows, 20, shard_bytes=1) == want
    # Some shards, some too large.
    assert found(spark, rows, 20, shard_bytes=700, shard_hashes=50) == want
    assert found(spark, rows, 20, shard_hashes=1) == want
    # Every anchor of three documents is frequent.
    monkeypatch.setattr(repeats, "FREQUENT", 0.0)
    assert found(spark, rows, 20) == want
    monkeypatch.setattr(repeats, "PIECE", 64)
    assert found(spark, rows, 20) == want


def test_ids_that_differ(spark):
    rows = [(i, t) for i, (_, t) in enumerate(odd_rows())]
    assert found(spark, rows, 20) == brute(rows, 20)


def test_empty_table(spark):
    assert found(spark, [], 100) == []
    assert found(spark, [(1, "short")], 100) == brute([(1, "short")], 100)
