"""Ranks and running sums within groups, without ever holding a group in one task.

Rows are put in order by a hash that is spread evenly over [0, 2^60), so cutting a group's hash
range into equal slices cuts its rows evenly, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 60
# A group's slices are summed up in one task, a row each: a group of 10^10 rows has 2.5 million.
SLICE_ROWS = 4_000


def even_hash(*parts: Column) -> Column:
    """A hash in [0, 2^60) that other engines can compute too: the head of an MD5."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def slice_of(hash_: Column, slices: Column) -> Column:
    """The slice of a row when its group has so many slices."""
    # Hashes next to the end of the range are rounded up to it.
    return F.least(F.floor(hash_ / F.lit(float(1 << HASH_BITS)) * slices).cast("long"), slices.cast("long") - 1)


def run_along(
    df: DataFrame, group: list[str], slice_: str, order: list[str], rank: str | None = None, sums: dict[str, str] | None = None
) -> DataFrame:
    """Add each row's rank (from 0) in its group, and sums over the group's rows before it.

    ``slice_`` numbers the slices in the order of the rows; ``order`` orders rows of a slice.
    """
    sums = sums or {}
    totals = df.groupBy(*group, slice_).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{out}") for out, c in sums.items()]
    )
    earlier = Window.partitionBy(*group).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_{c}") for c in [*group, slice_]],
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)).alias(f"_before_{out}") for out in sums],
    )
    inside = Window.partitionBy(*group, slice_).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    added = {f"_in_{out}": F.coalesce(F.sum(c).over(before), F.lit(0)) for out, c in sums.items()}
    if rank:
        added["_in_rank"] = F.row_number().over(inside) - 1
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, slice_]]
    joined = df.withColumns(added).join(offsets, same)
    out = [F.col(f"`{c}`") for c in df.columns]
    if rank:
        out.append((F.col("_rows_before") + F.col("_in_rank")).cast("long").alias(rank))
    out += [(F.col(f"_before_{name}") + F.col(f"_in_{name}")).cast("long").alias(name) for name in sums]
    return joined.select(*out)
