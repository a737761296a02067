"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised by codebooks of their own, so few centroids make many
cells: a cell is a pair of centroids. A query sorts the centroids of either half by inner product
and walks the pairs in order of the summed distance with a heap, from the nearest pair on, until
the visited cells hold as many entries as the search has set; these are reranked by the exact inner
product in double precision.

How many entries are needed depends on the data. It is set by calibration: for a few queries the
exact neighbours are found, and the number is such that the walk would have reached ``REACH`` of
them.

Equal vectors are one entry with their least ids, as many as can be asked for; equal queries are
searched once. So copies cost nothing, and one cell never grows with them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import draw, store

# The codebooks are fitted on this many vectors at most; all vectors are indexed.
SAMPLE = 20_000
ENTRIES_PER_CELL = 32
MOST_CENTROIDS = 1024
CALIBRATION = 100
REACH = 0.95
LEAST_CANDIDATES = 500
BUCKET_ENTRIES = 4096
QUERY_BLOCK = 512
FIT_ROUNDS = 8


@dataclass(frozen=True)
class Codebooks:
    left: np.ndarray
    right: np.ndarray

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        nearest = [
            np.argmax(part @ book.T - 0.5 * (book * book).sum(axis=1), axis=1)
            for part, book in ((vectors[:, : self.half], self.left), (vectors[:, self.half :], self.right))
        ]
        return nearest[0] * len(self.right) + nearest[1]


def fit_half(vectors: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from distinct random vectors; an emptied centroid stays where it was."""
    distinct = np.unique(vectors, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        nearest = np.argmax(vectors @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1), axis=1)
        number = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        centroids = np.where(number[:, None] > 0, sums / np.maximum(number, 1)[:, None], centroids)
    return centroids


def walk(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of the summed distance (the negative inner products with the query's halves).

    Stops when the cells hold ``wanted`` entries. Of each pair of ranks only those are on the heap
    whose neighbours nearer to the query are done.
    """
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    x, y = (-left[a]).tolist(), (-right[b]).tolist()
    a_of, b_of, n, m = (a * len(b)).tolist(), b.tolist(), len(a), len(b)
    held = sizes
    heap, cells, entries = [(x[0] + y[0], 0, 0)], [], 0
    done = [0] * n  # per left rank, how many right ranks are done
    while heap and entries < wanted:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        cell = a_of[i] + b_of[j]
        if held[cell]:
            cells.append(cell)
            entries += held[cell]
        if i + 1 < n and done[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < m and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return cells


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """id and vec (array of double) of the vectors that take part.

    Null and zero vectors and those with null or non-finite components do not, nor do those of
    another length than most have (the shorter one in a tie).
    """
    good = vectors.filter(
        F.col("id").isNotNull()
        & F.col("vec").isNotNull()
        & F.coalesce(
            F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)
        )
        & F.exists("vec", lambda x: x != 0)
    )
    length = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("vec") == (length["n"] if length else 0)).select("id", F.col("vec").cast("array<double>").alias("vec"))


def fit(entries: DataFrame, sample: int = SAMPLE) -> Codebooks:
    """Codebooks from the ``sample`` entries of least hash."""
    rows = draw(entries, sample, "entry").select("vec").toArrow()["vec"].combine_chunks()
    vectors = _matrix(rows)
    k = int(np.clip(np.sqrt(entries.count() / ENTRIES_PER_CELL), 1, MOST_CENTROIDS))
    half = (vectors.shape[1] + 1) // 2
    right = vectors[:, half:] if vectors.shape[1] > 1 else np.zeros((len(vectors), 0))
    return Codebooks(fit_half(vectors[:, :half], k, 1), fit_half(right, k, 2))


def _assign(entries: DataFrame, books: Codebooks) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = books.cells(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int64))], names=[*batch.schema.names, "cell"])

    return entries.select("entry", "vec", "ids").mapInArrow(run, "entry bigint, vec array<double>, ids array<bigint>, cell bigint")


def _exact(entries: DataFrame, queries: np.ndarray, k: int) -> dict[int, list[int]]:
    """Cells of the k nearest entries of a few queries, by comparing them with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = queries @ _matrix(batch.column(0)).T
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            query = np.repeat(np.arange(len(queries)), best.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(query), batch.column(1).take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, 1).ravel())],
                names=["query", "cell", "score"],
            )

    found = entries.select("vec", "cell").mapInArrow(run, "query bigint, cell bigint, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cell"))
    out: dict[int, list[int]] = {}
    for row in found.withColumn("place", place).filter(F.col("place") <= k).collect():
        out.setdefault(row["query"], []).append(row["cell"])
    return out


def candidates_needed(index: DataFrame, queries: DataFrame, books: Codebooks, sizes: np.ndarray, k: int) -> int:
    """Entries that a walk has to visit to reach ``REACH`` of the true neighbours."""
    some = draw(queries, CALIBRATION, "entry").select("vec").toArrow()["vec"].combine_chunks()
    vectors = _matrix(some)
    depths = []
    for q, cells in _exact(index, vectors, k + 1).items():
        left, right = books.left @ vectors[q, : books.half], books.right @ vectors[q, books.half :]
        order = np.argsort(-(left[:, None] + right[None, :]).ravel(), kind="stable")
        reached = np.empty(len(order), dtype=np.int64)
        reached[order] = np.cumsum(sizes[order])
        depths += reached[cells].tolist()
    return max(int(np.quantile(depths, REACH)) if depths else 0, LEAST_CANDIDATES)


def _buckets(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bucket of each cell and number of buckets: small cells share one, large ones are split."""
    parts = np.maximum(-(-sizes // BUCKET_ENTRIES), 1)
    share = np.where(parts > 1, parts * BUCKET_ENTRIES, sizes)
    ends = np.cumsum(share)
    first = (ends - share) // BUCKET_ENTRIES
    # A split cell starts a bucket of its own.
    first = first + np.where(parts > 1, 1, 0)
    return first, parts


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each query.

    ``vectors`` and ``queries`` have ``id`` and ``vec``. A query's own id is no candidate. Nearness
    is the inner product; equal scores are ordered by id. Vectors that take no part (``usable``)
    are neither queries nor candidates. Repeated ids with equal vectors count once.
    """
    spark = vectors.sparkSession
    good = store(usable(vectors), "vectors")
    limited = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    entries = store(
        good.distinct().withColumn("place", limited)
        .filter(F.col("place") <= k + 1)
        .groupBy("vec")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.get("ids", F.lit(0)).alias("entry"), "vec", "ids"),
        "entries",
    )
    asked = usable(queries).distinct()
    asked = store(asked.join(entries.select("vec", "entry"), "vec").select("id", "entry"), "asked")
    if asked.isEmpty():
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    books = fit(entries)
    index = store(_assign(entries, books), "index")
    sizes = np.zeros(len(books.left) * len(books.right), dtype=np.int64)
    counted = index.groupBy("cell").count().toArrow()
    sizes[counted["cell"].to_numpy()] = counted["count"].to_numpy()
    distinct = index.join(asked.select("entry").distinct(), "entry", "left_semi")
    wanted = candidates_needed(index, distinct, books, sizes, k)
    first, parts = _buckets(sizes)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = sizes.tolist()
        for batch in batches:
            matrix = _matrix(batch.column(1))
            left, right = matrix[:, : books.half] @ books.left.T, matrix[:, books.half :] @ books.right.T
            for begin in range(0, len(matrix), 256):
                rows = {"bucket": [], "row": [], "cells": []}
                for r in range(begin, min(begin + 256, len(matrix))):
                    cells = np.array(walk(left[r], right[r], listed, wanted))
                    bucket = np.repeat(first[cells], parts[cells])
                    bucket += np.arange(len(bucket)) - np.repeat(np.cumsum(parts[cells]) - parts[cells], parts[cells])
                    cells = np.repeat(cells, parts[cells])
                    order = np.argsort(bucket, kind="stable")
                    found, starts = np.unique(bucket[order], return_index=True)
                    rows["bucket"] += found.tolist()
                    rows["row"] += [r] * len(found)
                    rows["cells"] += np.split(cells[order], starts[1:])
                row = pa.array(rows["row"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["bucket"], pa.int64()), batch.column(0).take(row), batch.column(1).take(row),
                     pa.array(rows["cells"], pa.list_(pa.int64()))],
                    names=["bucket", "query", "vec", "cells"],
                )

    visits = store(
        distinct.select("entry", "vec").mapInArrow(visit, "bucket bigint, query bigint, vec array<double>, cells array<bigint>"), "visits"
    )
    # Each bucket meets its queries in blocks of bounded size.
    demand = visits.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("int").alias("blocks"))
    bucketed = _with_bucket(index, first, parts).join(demand, "bucket")
    bucketed = bucketed.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "entry", "vec", "ids", "cell")
    visits = visits.join(demand, "bucket").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))
    keep = k + 1

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, held = left.combine_chunks(), right.combine_chunks()
        query, entry = _matrix(asked["vec"].combine_chunks()), _matrix(held["vec"].combine_chunks())
        cell = held["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, entry = cell[order], entry[order]
        # Which queries visit each cell.
        visited = asked["cells"].combine_chunks()
        flat, who = visited.flatten().to_numpy(), np.repeat(np.arange(len(query)), visited.value_lengths().to_numpy())
        by_cell = np.argsort(flat, kind="stable")
        flat, who = flat[by_cell], who[by_cell]
        score = np.full((len(query), len(entry)), -np.inf)
        for c, a, b in zip(*np.unique(cell, return_index=True), np.append(np.unique(cell, return_index=True)[1][1:], len(cell))):
            mine = who[np.searchsorted(flat, c) : np.searchsorted(flat, c, side="right")]
            if len(mine):
                score[mine, a:b] = query[mine] @ entry[a:b].T
        few = min(keep, len(entry))
        least = -np.partition(-score, few - 1, axis=1)[:, few - 1 : few]
        row, col = np.nonzero((score >= least) & np.isfinite(score))  # ties with the last are kept
        return pa.table(
            {
                "query": asked["query"].combine_chunks().take(pa.array(row)),
                "ids": held["ids"].combine_chunks().take(pa.array(order[col])),
                "score": pa.array(score[row, col]),
            }
        )

    found = visits.groupBy("bucket", "block").cogroup(bucketed.groupBy("bucket", "block"))
    found = found.applyInArrow(rerank, "query bigint, ids array<bigint>, score double")
    each = found.select("query", F.explode("ids").alias("vec_id"), "score")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    nearest = each.withColumn("place", best).filter(F.col("place") <= keep).drop("place")
    named = asked.select(F.col("id").alias("query_id"), F.col("entry").alias("query")).join(nearest, "query").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_bucket(index: DataFrame, first: np.ndarray, parts: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, cell = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            bucket = first[cell] + (entry.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], names=[*batch.schema.names, "bucket"])

    return index.mapInArrow(run, "entry bigint, vec array<double>, ids array<bigint>, cell bigint, bucket bigint")
