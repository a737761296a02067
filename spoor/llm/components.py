"""Connected components of a link table by alternating large-star and small-star steps.

Every step joins a node's links with the least neighbour of that node, one row per node, so a node
with very many links costs its links and no more; adaptive execution splits its partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for all linked nodes but the roots.

    ``links`` has columns ``a`` and ``b``, which may be any type that can be ordered.
    """
    current = store(_directed(links.select("a", "b")), "links")
    mark = _mark(current)
    while True:
        current = store(_small_star(store(_large_star(current), "large")), "small")
        before, mark = mark, _mark(current)
        if before == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _directed(links: DataFrame) -> DataFrame:
    """Each link once, from the greater node to the lesser."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    moved = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _directed(moved)


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    rest = links.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )
    return _directed(rest.union(least.select("a", F.col("m").alias("b"))))
