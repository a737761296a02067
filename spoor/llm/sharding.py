"""Uniform random sharding with exact shard sizes: a hypergeometric communication matrix.

Rows lie in blocks. How many rows of each block go to each shard is drawn first, exactly as a
uniform shuffle of all rows would have it: block after block, the shards' open places are drawn
from without replacement (multivariate hypergeometric). Then every block is permuted by itself and
dealt out by its line of the matrix, rows are exchanged, and every shard is permuted by itself.
Any order of all rows is as likely as any other, and shard sizes differ by one row at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import free_name, free_prefix, row_hash, store
from spoor.llm.slices import even_hash, run_along, slice_of

SEED = 20260101
MOST_BLOCK_ROWS = 1_000_000
LEAST_BLOCK_ROWS = 1_000
BLOCKS = 256


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric: good ones among n drawn from good + bad, for numbers of any size.

    Inverse of the distribution on the window of 12 standard deviations round the mode, outside of
    which less than 1e-30 of it lies; the terms follow from their ratios.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    spread = (n * (good / total) * (bad / total) * max(total - n, 1) / max(total - 1, 1)) ** 0.5
    reach = int(12 * spread) + 40
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    ratios = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[1:]) - np.log(bad - n + k[1:])
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(np.searchsorted(chances, rng.random() * chances[-1], side="right"), len(k) - 1)])


def communication_matrix(blocks: list[int], shards: list[int], seed: int = SEED) -> np.ndarray:
    """Rows of each block for each shard; lines and columns sum to ``blocks`` and ``shards``."""
    rng = np.random.default_rng(seed)
    free = list(shards)
    matrix = np.zeros((len(blocks), len(shards)), dtype=np.int64)
    for i, rows in enumerate(blocks):
        others, left = sum(free), rows
        for j, places in enumerate(free):
            others -= places
            matrix[i, j] = _draw(rng, places, others, left)
            left -= matrix[i, j]
            free[j] -= matrix[i, j]
    return matrix


def shard_sizes(rows: int, n_shards: int) -> list[int]:
    """Equal but for one row; the first shards have it."""
    return [rows // n_shards + (i < rows % n_shards) for i in range(n_shards)]


def rows_per_block(rows: int) -> int:
    """Some hundred blocks, so that all tasks have work; more when they would grow too large."""
    return min(max(rows // BLOCKS, LEAST_BLOCK_ROWS), MOST_BLOCK_ROWS)


def assign(digests: DataFrame, n_shards: int, seed: int = SEED, block_rows: int | None = None) -> DataFrame:
    """Add ``copy`` (from 1), ``shard`` and ``slot`` to rows of (doc_id, size, text_crc32).

    Rows equal in all three are numbered, counted before they are shuffled and spread again, so
    the draw depends on the rows alone: another order, partitioning or a repeated task gives the
    same result. Texts that are equal in rows of different ids are dealt out independently.
    The driver sees one count per block and the matrix, blocks times shards numbers.
    """
    names = digests.columns
    counted = digests.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    each = (
        counted.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
        .withColumn("_key", even_hash(F.lit(seed), F.lit("block"), *[F.col(c) for c in names], F.col("copy")))
    )
    each = store(each, "digests")
    rows = each.count()
    block_rows = block_rows or rows_per_block(rows)
    n_blocks = max(1, -(-rows // block_rows))
    blocked = each.withColumn("_block", slice_of(F.col("_key"), F.lit(n_blocks)))
    sizes = dict(blocked.groupBy("_block").count().collect())
    matrix = communication_matrix([sizes.get(i, 0) for i in range(n_blocks)], shard_sizes(rows, n_shards), seed)
    lines = digests.sparkSession.createDataFrame(
        [(i, np.cumsum(line).tolist()) for i, line in enumerate(matrix)], "_line long, _ends array<long>"
    )
    # A block is permuted by a hash of its own; ranks in it are dealt out by its line.
    local = even_hash(F.lit(seed), F.lit("local"), *[F.col(c) for c in names], F.col("copy"))
    order = [*names, "copy"]
    permuted = run_along(
        blocked.withColumn("_local", local).withColumn("_one", F.lit(0).cast("long")),
        ["_block"], "_one", ["_local", *order], rank="_rank",
    )
    dealt = permuted.join(lines, F.col("_block") == F.col("_line")).withColumn(
        "shard", F.size(F.filter("_ends", lambda end: end <= F.col("_rank")))
    )
    # A shard may be far larger than a block: its last permutation runs along slices of its hash.
    last = even_hash(F.lit(seed), F.lit("shard"), *[F.col(c) for c in names], F.col("copy"))
    slices = max(1, -(-rows // (n_shards * block_rows)))
    exchanged = dealt.select(*names, "copy", "shard", last.alias("_last")).withColumn(
        "_slice", slice_of(F.col("_last"), F.lit(slices))
    )
    return run_along(exchanged, ["shard"], "_slice", ["_last", *order], rank="slot").select(*names, "copy", "shard", "slot")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size in bytes (16 more than the text's) and the text's CRC; a null text is empty."""
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(bytes_) + 16).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
    )


def shard_rows(
    docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text", seed: int = SEED,
    outputs: tuple[str, str] = ("shard", "slot"),
) -> DataFrame:
    """All rows with their columns, and ``shard`` and ``slot`` (in its shard, from 0).

    Columns of the input named as an output give way. Rows are dealt out by digest and then joined
    once, so whole rows are exchanged once. Only if digests repeat, their rows are numbered, in the
    partitions of that join.
    """
    key = digest(docs, doc_id, text)
    placed = store(assign(key, n_shards, seed), "placed")
    taken = {o.lower() for o in outputs}
    kept = [c for c in docs.columns if c.lower() not in taken]
    names = {c: free_name(docs.columns, f"_key_{c}") for c in ("doc_id", "size", "text_crc32", "copy")}
    bytes_ = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col(f"`{doc_id}`").alias(names["doc_id"]),
        (F.octet_length(bytes_) + 16).cast("long").alias(names["size"]),
        F.crc32(bytes_).alias(names["text_crc32"]),
    )
    on = list(names)
    if placed.filter(F.col("copy") > 1).isEmpty():
        on.remove("copy")
    else:
        same = Window.partitionBy(*[names[c] for c in on[:-1]]).orderBy(row_hash(docs.select(*[f"`{c}`" for c in kept])))
        rows = rows.withColumn(names["copy"], F.row_number().over(same).cast("long"))
    to = free_prefix(docs.columns, "_placed")
    right = placed.select(*[F.col(c).alias(f"{to}_{c}") for c in [*on, "shard", "slot"]])
    match = [F.col(names[c]).eqNullSafe(F.col(f"{to}_{c}")) for c in on]
    return rows.join(right, match).select(
        *[F.col(f"`{c}`") for c in kept], F.col(f"{to}_shard").alias(outputs[0]), F.col(f"{to}_slot").alias(outputs[1])
    )
