import random

import pyarrow as pa

from conftest_llm import words
from spoor.llm.words import chunks, ngram_hashes, words_of


def _texts(seed=3):
    rng = random.Random(seed)
    alphabet = "abZÉß09 -_.\n\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 9, 300]))) for _ in range(80)]
    return texts + [None, "", "a" * 1000, "a" * 1001, "é" * 600, "end"]


def test_words_equal_the_pattern():
    texts = _texts()
    for kind in (pa.string(), pa.large_string()):
        got = words_of(pa.array(texts, kind))
        want = [words(t) for t in texts]
        assert got.counts.tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        assert [got.bytes_of(i).decode() for i in range(len(flat))] == flat
        assert len(set(got.hash.tolist())) == len(set(flat))


def test_sliced_arrays_and_chunks():
    texts = _texts(5)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]).slice(7)
    parts = list(chunks(batch, "text", most=200))
    assert sum(p.num_rows for p in parts) == len(texts) - 7
    hashes = [h for p in parts for h in words_of(p.column(0)).hash.tolist()]
    assert hashes == words_of(pa.array(texts[7:])).hash.tolist()
    assert words_of(pa.array([], pa.string())).counts.tolist() == []
    assert words_of(pa.array([None, None], pa.string())).counts.tolist() == [0, 0]


def test_ngrams_stay_within_texts():
    texts = ["a b c d", "c d e", "", "a b"]
    got = words_of(pa.array(texts))
    for n in (1, 2, 3, 5):
        hashes, at = ngram_hashes(got, n)
        want = [tuple(words(t)[i : i + n]) for t in texts for i in range(len(words(t)) - n + 1)]
        assert len(at) == len(want) and len(set(hashes.tolist())) == len(set(want))
