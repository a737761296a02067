"""Ordered per-key computations that stay parallel when one key holds a large share of the rows.

``Window.partitionBy(key).orderBy(...)`` puts a whole key into one task. In large inputs keys are
counted first. Those of at most a slice's rows take the plain window: one shuffle, into tasks of about
as many rows, and of those columns only that are used later. The others are scanned by prefixes in a
distributed way: rows are range-partitioned once on key and order, whole values of whatever type, so
every slice has about as many rows, however many of them one key holds and however alike they are.
Windows run inside a slice. Only the first and the last key of a slice can go on in another; these,
two rows a slice at most, are summed up, scanned over the slices, and sent to all tasks, which add
what came before. The result equals the plain window's.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.session import scratch_path

# An input estimated below this fits one task whatever its keys, so slicing buys nothing.
SMALL_INPUT_BYTES = 256 << 20
# Rows of a slice, and about of a task; with documents beside them a few hundred megabytes.
SLICE_ROWS = 250_000
_NULL_KEY = "\u0000null"


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate for ``df``; reads statistics only, runs no job."""
    if not hasattr(df, "_jdf"):  # a remote client has no plan at hand
        return None
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly per-row work on an input of fewer splits than cores.

    A large input has more splits than that and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    size = estimated_bytes(df)
    return size is not None and size <= (SMALL_INPUT_BYTES if limit is None else limit)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """So many tasks that each gets about a slice's rows, and at least one per core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // SLICE_ROWS))


def _ranged(df: DataFrame, ks: list[str], by: Sequence[str], slice_rows: int) -> DataFrame:
    """The rows in slices of about ``slice_rows``, ``_al_slice``, in order of keys and ``by``.

    Spark draws the cuts anew each time the plan is run, so the rows are written.
    """
    slices = max(1, -(-df.count() // slice_rows))
    ranged = df.repartitionByRange(slices, *ks, *by).withColumn("_al_slice", F.spark_partition_id())
    path = scratch_path(df.sparkSession, "slices")
    ranged.write.parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path)


def _going_on(ranged: DataFrame, ks: list[str]) -> DataFrame:
    """The keys that lie in more than one slice; fewer than there are slices."""
    key = F.struct(*ks)
    edges = ranged.groupBy("_al_slice").agg(F.min(key).alias("_al_first"), F.max(key).alias("_al_last"))
    before = F.lag("_al_last").over(Window.orderBy("_al_slice"))  # one row per slice
    return edges.select("_al_first", before.alias("_al_before")).filter("_al_first = _al_before").select("_al_first.*").distinct()


def along(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    *,
    position: str | None = None,
    total: str | None = None,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    running: Mapping[str, Column] | None = None,
    last_seen: Mapping[str, Column] | None = None,
    next_seen: Mapping[str, Column] | None = None,
    lowest: Mapping[str, Column] | None = None,
    slice_rows: int | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Add columns computed along ``by`` within ``keys``.

    ``position``: 1-based row number. ``total``: rows of the key. ``lag``/``lead``: value of a
    column in the row before/after. ``running``: inclusive running sum. ``last_seen``/
    ``next_seen``: nearest non-null value strictly before/after the row. ``lowest``: the minimum
    over the whole key.

    ``by`` must end in a column unique within the key. ``slice_rows`` forces slicing; by default only
    keys that may not fit one task are sliced. ``dealt``: the rows come from ``along`` with the same
    keys, so another shuffle is left to Spark, which mostly needs none.
    """
    added = {
        "position": position,
        "total": total,
        "lag": dict(lag or {}),
        "lead": dict(lead or {}),
        "running": dict(running or {}),
        "last_seen": dict(last_seen or {}),
        "next_seen": dict(next_seen or {}),
        "lowest": dict(lowest or {}),
    }
    if slice_rows is not None or is_small(df):
        return _along(df, keys, by, slice_rows=slice_rows, **added)
    rows, large = _large_keys(df, keys)

    def plain(part: DataFrame) -> DataFrame:
        tasked = part if dealt else part.repartition(tasks_for(df.sparkSession, rows), *keys)
        return _along(tasked, keys, by, slice_rows=None, **added)

    if large is None:
        return plain(df)
    same = [F.col(key).eqNullSafe(F.col(held)) for key, held in zip(keys, large.columns)]
    hot, rest = (df.join(F.broadcast(large), same, how) for how in ("left_semi", "left_anti"))
    return plain(rest).unionByName(_along(hot, keys, by, slice_rows=SLICE_ROWS, **added))


def _large_keys(df: DataFrame, keys: Sequence[str]) -> tuple[int, DataFrame | None]:
    """How many rows there are, and the keys of more than a slice's; fewer than there are slices."""
    held = [F.col(key).alias(f"_al_h{i}") for i, key in enumerate(keys)]
    counts = df.groupBy(*held).agg(F.count(F.lit(1)).alias("_al_n"))
    rows, most = counts.agg(F.sum("_al_n"), F.max("_al_n")).first()
    if not rows or most <= SLICE_ROWS:
        return rows or 0, None
    path = scratch_path(df.sparkSession, "large")
    large = counts.filter(F.col("_al_n") > SLICE_ROWS).drop("_al_n")
    large.write.parquet(path)
    return rows, df.sparkSession.read.schema(large.schema).parquet(path)


def _along(df, keys, by, *, position, total, lag, lead, running, last_seen, next_seen, lowest, slice_rows):
    """The plain window, or with ``slice_rows`` the sliced one."""
    sliced = slice_rows is not None
    source = df
    for group in (running, last_seen, next_seen, lowest):
        for name, expr in group.items():
            source = source.withColumn(f"_al_in_{name}", expr)
    if sliced:
        ks = [f"_al_k{i}" for i in range(len(keys))]
        for k, key in zip(ks, keys):
            source = source.withColumn(k, F.coalesce(F.col(key).cast("string"), F.lit(_NULL_KEY)))
        source = _ranged(source, ks, by, slice_rows)
        part = [*ks, "_al_slice"]
    else:
        ks, part = list(keys), list(keys)

    up = Window.partitionBy(*part).orderBy(*by)
    down = Window.partitionBy(*part).orderBy(*[F.desc(b) for b in by])
    before = (Window.unboundedPreceding, -1)
    upto = (Window.unboundedPreceding, 0)

    added: list[Column] = []
    if position or sliced:
        added.append(F.row_number().over(up).cast("long").alias("_al_pos"))
    whole = Window.partitionBy(*part)
    if total:
        added.append(F.count(F.lit(1)).over(whole).alias(total))
    added += [F.min(f"_al_in_{name}").over(whole).alias(name) for name in lowest]
    for name, src in lag.items():
        added.append(F.lag(src).over(up).alias(name))
    for name, src in lead.items():
        added.append(F.lead(src).over(up).alias(name))
    for name in running:
        added.append(F.sum(f"_al_in_{name}").over(up.rowsBetween(*upto)).alias(name))
    for name in last_seen:
        added.append(F.last(f"_al_in_{name}", ignorenulls=True).over(up.rowsBetween(*before)).alias(name))
    for name in next_seen:
        # Read backwards, because a frame open to the end is recomputed for every row.
        added.append(F.last(f"_al_in_{name}", ignorenulls=True).over(down.rowsBetween(*before)).alias(name))
    if sliced and lead:
        added.append(F.lead(F.lit(True)).over(up).isNull().alias("_al_ends"))
    out = source.select("*", *added)

    if sliced:
        out = _add_carried(source, out, ks, by, position, total, lag, lead, running, last_seen, next_seen, lowest)
    if position:
        out = out.withColumn(position, F.col("_al_pos"))
    scratch = [c for c in out.columns if c.startswith("_al_in_") or c in {*ks, "_al_slice", "_al_pos", "_al_ends"}]
    return out.drop(*[c for c in scratch if c not in df.columns])


def _add_carried(source, out, ks, by, position, total, lag, lead, running, last_seen, next_seen, lowest):
    order = F.struct(*by)
    aggs = [F.count(F.lit(1)).alias("_al_n")]
    if lag:
        aggs.append(F.max_by(F.struct(*[F.col(s).alias(n) for n, s in lag.items()]), order).alias("_al_tail"))
    if lead:
        aggs.append(F.min_by(F.struct(*[F.col(s).alias(n) for n, s in lead.items()]), order).alias("_al_head"))
    for name in running:
        aggs.append(F.sum(f"_al_in_{name}").alias(f"_al_sum_{name}"))
    for name in last_seen:
        seen = F.col(f"_al_in_{name}")
        aggs.append(F.max_by(seen, F.when(seen.isNotNull(), order)).alias(f"_al_last_{name}"))
    for name in next_seen:
        seen = F.col(f"_al_in_{name}")
        aggs.append(F.min_by(seen, F.when(seen.isNotNull(), order)).alias(f"_al_next_{name}"))
    for name in lowest:
        aggs.append(F.min(f"_al_in_{name}").alias(f"_al_low_{name}"))
    spread = F.broadcast(_going_on(source, ks))
    summary = source.join(spread, ks, "left_semi").groupBy(*ks, "_al_slice").agg(*aggs)

    # Two rows per slice at most from here on.
    fore = Window.partitionBy(*ks).orderBy("_al_slice")
    back = Window.partitionBy(*ks).orderBy(F.desc("_al_slice"))
    earlier = fore.rowsBetween(Window.unboundedPreceding, -1)
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_al_n").over(earlier), F.lit(0)).alias("_al_c_pos")]
    if total:
        carried.append(F.sum("_al_n").over(Window.partitionBy(*ks)).alias("_al_c_total"))
    for name in lowest:
        carried.append(F.min(f"_al_low_{name}").over(Window.partitionBy(*ks)).alias(f"_al_c_{name}"))
    if lag:
        carried.append(F.lag("_al_tail").over(fore).alias("_al_c_tail"))
    if lead:
        carried.append(F.lead("_al_head").over(fore).alias("_al_c_head"))
    for name in running:
        carried.append(F.sum(f"_al_sum_{name}").over(earlier).alias(f"_al_c_{name}"))
    for name in last_seen:
        carried.append(F.last(f"_al_last_{name}", ignorenulls=True).over(earlier).alias(f"_al_c_{name}"))
    for name in next_seen:
        carried.append(F.last(f"_al_next_{name}", ignorenulls=True).over(later).alias(f"_al_c_{name}"))
    path = scratch_path(source.sparkSession, "carried")
    carry = summary.select(*ks, "_al_slice", *carried)
    carry.write.parquet(path)
    carry = F.broadcast(source.sparkSession.read.schema(carry.schema).parquet(path))

    out = out.join(carry, [*ks, "_al_slice"], "left")
    if total:
        out = out.withColumn(total, F.coalesce("_al_c_total", total))
    for name in lowest:
        out = out.withColumn(name, F.least(f"_al_c_{name}", name))
    for name in lag:
        # Inside a slice a null is a real null of the row before, so only the first row looks back.
        value = F.when(F.col("_al_pos") == 1, F.col(f"_al_c_tail.{name}")).otherwise(F.col(name))
        out = out.withColumn(name, value)
    for name in lead:
        out = out.withColumn(name, F.when(F.col("_al_ends"), F.col(f"_al_c_head.{name}")).otherwise(F.col(name)))
    for name in running:
        carried_sum = F.col(f"_al_c_{name}")
        out = out.withColumn(
            name,
            F.when(F.col(name).isNull(), carried_sum).otherwise(F.col(name) + F.coalesce(carried_sum, F.lit(0))),
        )
    for name in (*last_seen, *next_seen):
        out = out.withColumn(name, F.coalesce(F.col(name), F.col(f"_al_c_{name}")))
    out = out.withColumn("_al_pos", F.col("_al_pos") + F.coalesce("_al_c_pos", F.lit(0)))
    return out.drop(*[c for c in out.columns if c.startswith("_al_c_")])


def fold_along(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    inputs: Sequence[str],
    outputs: T.StructType,
    step,
    dealt: bool = False,
) -> DataFrame:
    """Add columns from a fold that must run in order, one row after another.

    ``step(state, *inputs)`` gets ``None`` as state at a key's first row and returns
    ``(state, *outputs)``. ``dealt``: whole keys lie in order in the partitions already. Rows stream through each task in Arrow batches, so a key is never held
    in memory as a whole.
    """
    schema = T.StructType([*df.schema.fields, *outputs.fields])
    out_types = [_arrow_type(f.dataType) for f in outputs.fields]
    names = [f.name for f in schema.fields]
    key_names, input_names = list(keys), list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            key_cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key_names]
            in_cols = [batch.column(batch.schema.get_field_index(i)).to_pylist() for i in input_names]
            results: list[list] = [[] for _ in out_types]
            for row_key, row in zip(zip(*key_cols), zip(*in_cols)):
                if row_key != key:
                    key, state = row_key, None
                state, *values = step(state, *row)
                for target, value in zip(results, values):
                    target.append(value)
            arrays = [*batch.columns, *(pa.array(r, t) for r, t in zip(results, out_types))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    ordered = df if dealt else df.repartition(*keys).sortWithinPartitions(*keys, *by)
    return ordered.mapInArrow(run, schema)


def _arrow_type(dtype: T.DataType) -> pa.DataType:
    return {T.StringType: pa.string(), T.LongType: pa.int64(), T.BooleanType: pa.bool_()}[type(dtype)]
