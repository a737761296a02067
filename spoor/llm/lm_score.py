"""LM scoring: stupid-backoff scores from n-gram counts of all documents.

``S(w | context) = c(context w) / c(context)`` if the n-gram occurs, else 0.4 times the score with
a context shorter by one word; at the end ``c(w) / N``, or 0.4 / N for a word that never occurs.
Counts come from all documents but the scored one, so a text does not vouch for itself.

The tables are partitioned by hash, as one shuffled row per n-gram would cost tens of bytes:

* Documents are read in blocks. A block sends each bucket of the hash range the sorted distinct
  n-grams that lie in it, with their numbers, as one compressed row.
* A bucket adds them up to its part of the count tables and answers each block, in the order of
  what it sent, with the totals.
* Answers meet the exploded n-grams of the same block, which give the score of each word, summed
  per document.

Common n-grams are counted in blocks before they are shuffled, so no bucket gets more than one
entry per block for any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.words import Words, chunks, ngram_hashes, words_of

ORDER = 3
BACKOFF = 0.4
LEAST_BLOCK, MOST_BLOCK = 16 << 20, 128 << 20
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 1 << 18


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed: high bytes of small numbers vanish."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + _zstd().compress(raw.tobytes(), asbytes=True)


def unpack(data: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    raw = np.frombuffer(_zstd().decompress(data[8:], decompressed_size=n * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(dtype).reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int):
    """Number, ids, word hashes and word bounds of each block of rows.

    Blocks depend on the order of the rows alone, so reading the same table again gives the same.
    """
    part, n = TaskContext.get().partitionId(), 0
    ids, hashes, counts, size = [], [], [], 0
    for batch in batches:
        for piece in chunks(batch, "text"):
            words = words_of(piece.column(1))
            ids.append(piece.column(0))
            hashes.append(words.hash)
            counts.append(words.counts)
            size += len(words.data)
            if size >= block_bytes:
                yield (part << 32) + n, ids, np.concatenate(hashes), np.concatenate(counts)
                n, size = n + 1, 0
                ids, hashes, counts = [], [], []
    if ids:
        yield (part << 32) + n, ids, np.concatenate(hashes), np.concatenate(counts)


def _as_words(hashes: np.ndarray, counts: np.ndarray) -> Words:
    none = np.zeros(0, np.uint8)
    return Words(none, none, none, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), hashes)


def _bounds(buckets: int) -> np.ndarray:
    """The first hash of each bucket but the first."""
    return np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)


def _requests(docs: DataFrame, order: int, block_bytes: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(buckets)
        for block, _, hashes, counts in _blocks(batches, block_bytes):
            words = _as_words(hashes, counts)
            check = int(np.bitwise_xor.reduce(hashes, initial=np.uint64(0)).view(np.int64))
            found = []
            for n in range(1, order + 1):
                grams = np.sort(ngram_hashes(words, n)[0])
                starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else []
                times = np.diff(np.append(starts, len(grams))).astype(np.uint32)
                grams = grams[starts] if len(grams) else grams
                found.append((grams, times, np.concatenate([[0], np.searchsorted(grams, bounds), [len(grams)]])))
            for lo in range(0, buckets, 256):
                mine = range(lo, min(lo + 256, buckets))
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(mine, pa.int64()),
                        "block": pa.array([block] * len(mine), pa.int64()),
                        "check": pa.array([check] * len(mine), pa.int64()),
                        "words": pa.array([0 if k else len(hashes) for k in mine], pa.int64()),
                        "grams": pa.array([[pack_sorted(g[at[k] : at[k + 1]]) for g, _, at in found] for k in mine], pa.list_(pa.binary())),
                        "times": pa.array([[pack(t[at[k] : at[k + 1]]) for _, t, at in found] for k in mine], pa.list_(pa.binary())),
                    }
                )

    return docs.mapInArrow(
        run, "bucket bigint, block bigint, check bigint, words bigint, grams array<binary>, times array<binary>"
    )


def _answers(requests: DataFrame) -> DataFrame:
    """Per bucket and block: the total of each n-gram sent; bucket 0 also counts all words."""

    def run(group: pa.Table) -> pa.Table:
        total = sum(group["words"].to_pylist())
        answers = [[] for _ in range(group.num_rows)]
        grams, times = group["grams"].to_pylist(), group["times"].to_pylist()
        for n in range(len(grams[0])):
            lists = [unpack_sorted(row[n]) for row in grams]
            every = np.concatenate(lists)
            numbers = np.concatenate([unpack(row[n], np.uint32) for row in times]).astype(np.int64)
            order = np.argsort(every, kind="stable")
            ranked = every[order]
            new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)]
            table = np.add.reduceat(numbers[order], np.flatnonzero(new)) if len(ranked) else numbers
            totals = np.empty(len(every), dtype=np.int64)
            totals[order] = table[np.cumsum(new) - 1]
            for row, own in zip(answers, np.split(totals, np.cumsum([len(x) for x in lists])[:-1])):
                row.append(pack(own))
        return pa.table(
            {
                "block": group["block"],
                "bucket": group["bucket"],
                "check": group["check"],
                "words": pa.array([total] * group.num_rows, pa.int64()),
                "ids": pa.nulls(group.num_rows, pa.list_(pa.string())),
                "data": pa.array(answers, pa.list_(pa.binary())),
            }
        )

    return requests.groupBy("bucket").applyInArrow(run, _MET.format(ids="string"))


_MET = "block bigint, bucket bigint, check bigint, words bigint, ids array<{ids}>, data array<binary>"


def _texts(docs: DataFrame, block_bytes: int) -> DataFrame:
    """The blocks' documents: ids, and words as places in a list of the block's distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, hashes, counts in _blocks(batches, block_bytes):
            distinct, codes = np.unique(hashes, return_inverse=True)
            check = int(np.bitwise_xor.reduce(hashes, initial=np.uint64(0)).view(np.int64))
            flat = pa.concat_arrays([x.cast(pa.string()) for x in ids])
            data = [pack(counts.astype(np.int64)), pack_sorted(distinct), pack(codes.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array([v], pa.int64()) for v in (block, -1, check, 0)],
                    pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat),
                    pa.array([data], pa.list_(pa.binary())),
                ],
                names=["block", "bucket", "check", "words", "ids", "data"],
            )

    return docs.mapInArrow(run, _MET.format(ids="string"))


def _counts_without_own(words: Words, n: int, totals: np.ndarray) -> np.ndarray:
    """Per word, the count of the n-gram that ends there in all other documents."""
    grams, at = ngram_hashes(words, n)
    order = np.argsort(grams, kind="stable")
    ranked, owner = grams[order], words.owner[at[order]]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)]
    fresh = new.copy()
    fresh[1:] |= owner[1:] != owner[:-1]
    runs = np.flatnonzero(fresh)
    own = np.repeat(np.diff(np.append(runs, len(ranked))), np.diff(np.append(runs, len(ranked))))
    out = np.zeros(len(words.hash), dtype=np.int64)
    out[at[order] + n - 1] = totals[np.cumsum(new) - 1] - own
    return out


def word_scores(words: Words, counts: list[np.ndarray], total: int, backoff: float) -> np.ndarray:
    """Log score of each word; ``counts[n - 1]``: of the n-gram that ends at each word."""
    place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], words.counts)
    others = np.maximum(total - np.repeat(words.counts, words.counts), 1)
    longest = np.minimum(place + 1, len(counts))
    score = np.log(backoff / others) + (longest - 1) * np.log(backoff)
    open_ = np.ones(len(place), dtype=bool)
    for n in range(len(counts), 0, -1):
        hit = np.flatnonzero(open_ & (longest >= n) & (counts[n - 1] > 0))
        below = counts[n - 2][hit - 1] if n > 1 else others[hit]
        score[hit] = np.log(counts[n - 1][hit] / below) + (longest[hit] - n) * np.log(backoff)
        open_[hit] = False
    return score


def _scores(met: DataFrame, order: int, backoff: float) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("bucket").to_pylist()
        if rows[0]["bucket"] != -1 or len({r["check"] for r in rows}) > 1:
            raise RuntimeError("the documents were not read in the same order twice; store them first")
        texts, answers = rows[0], rows[1:]
        per_text = unpack(texts["data"][0], np.int64)
        words = _as_words(unpack_sorted(texts["data"][1])[unpack(texts["data"][2], np.uint32)], per_text)
        total = answers[0]["words"]
        counts = [
            _counts_without_own(words, n + 1, np.concatenate([unpack(a["data"][n], np.int64) for a in answers]))
            for n in range(order)
        ]
        score = word_scores(words, counts, total, backoff)
        return pa.table(
            {
                "id": pa.array(texts["ids"], pa.string()),
                "n_words": pa.array(words.counts.astype(np.int64)),
                "log_score": pa.array([score[a:b].sum() for a, b in zip(words.first[:-1], words.first[1:])], pa.float64()),
            }
        )

    return met.groupBy("block").applyInArrow(run, "id string, n_words bigint, log_score double")


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, ``n_words``, ``log_score`` (sum over the words) and ``mean_log_score`` (null without words).

    One row per row of (doc_id, text); null texts have no words and score 0. Repeated rows and
    copies are documents of their own and do vouch for each other. ``docs`` must be a stored table
    or give its rows in the same order whenever it is read; a checksum guards that.
    """
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes = min(max(size // 4096, LEAST_BLOCK), MOST_BLOCK)
    buckets = min(max(-(-size // BUCKET_BYTES), 1), MOST_BUCKETS)
    answers = _answers(_requests(docs, order, block_bytes, buckets))
    scored = _scores(_texts(docs, block_bytes).unionByName(answers), order, backoff)
    return scored.select(
        F.col("id").cast(kind).alias("doc_id"),
        "n_words",
        "log_score",
        F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"),
    )
