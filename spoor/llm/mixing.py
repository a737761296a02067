"""Mixing sources to target weights: a curriculum whose weights change during training.

Each source has a schedule: a weight at some points of training time (0 to 1), straight lines
between them. The integral of the schedule is the source's overall weight, and its integral up to
``t`` is its demand for words up to ``t``. Documents of a source are read in an order drawn by
hash, over and over until the source's target is met; the words read so far, put into the inverse
of the demand, give the training time at which a document is due. Sorting all documents by that
time, in ranges, gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import free_name, free_prefix, row_hash, store
from spoor.llm.slices import SLICE_ROWS, even_hash, run_along, slice_of

MOST_REPEATS = 3
_SPACE_SPLIT = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_SPACE_SPLIT)), F.lit(0)).cast("long")


def integrate(knots: Column) -> Column:
    """Segments (t0, t1, w0, w1, before) of a schedule; ``before`` is the integral up to ``t0``.

    ``knots``: array of (t, weight), which need not be sorted.
    """
    ordered = F.array_sort(knots)
    pairs = F.transform(
        F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))),
        lambda k, i: F.struct(
            F.get(ordered, i)["t"].alias("t0"),
            k["t"].alias("t1"),
            F.get(ordered, i)["weight"].alias("w0"),
            k["weight"].alias("w1"),
        ),
    )
    area = lambda s: (s["t1"] - s["t0"]) * (s["w0"] + s["w1"]) / 2
    return F.transform(
        pairs,
        lambda s, i: F.struct(
            s["t0"],
            s["t1"],
            s["w0"],
            s["w1"],
            F.aggregate(F.slice(pairs, 1, i), F.lit(0.0), lambda a, p: a + area(p)).alias("before"),
        ),
    )


def overall_weight(segments: Column) -> Column:
    last = F.element_at(segments, -1)
    return last["before"] + (last["t1"] - last["t0"]) * (last["w0"] + last["w1"]) / 2


def due_time(segments: Column, area: Column) -> Column:
    """The time at which the integral of the schedule reaches ``area``."""
    inside = F.element_at(F.filter(segments, lambda s: s["before"] <= area), -1)
    rest = area - inside["before"]
    slope = (inside["w1"] - inside["w0"]) / (inside["t1"] - inside["t0"])
    root = F.sqrt(F.greatest(inside["w0"] * inside["w0"] + 2 * slope * rest, F.lit(0.0)))
    step = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (inside["w0"] + root))
    return F.least(inside["t0"] + step, inside["t1"])


def share_out(sources: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """``target`` words of each source from ``source_size`` and ``weight``.

    All targets together are all words. A target ends at ``most`` times the source's size; what is
    above goes to the other sources by weight, until none is above. Each round ends with one more
    source or more at its limit; a round reads one row per source.
    """
    limit = F.col("source_size") * F.lit(float(most))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full = F.col("weight") <= 0
    rate, n_full = 0.0, -1
    while True:
        r = sources.agg(
            F.sum(F.when(full, F.when(F.col("weight") > 0, limit).otherwise(0.0)).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(full).alias("n_full"),
        ).first()
        if not r.weight or r.n_full == n_full:
            break
        rate, n_full = (total - r.used) / r.weight, r.n_full
        full = (F.col("weight") <= 0) | (F.col("weight") * F.lit(rate) >= limit)
    target = F.when(F.col("weight") <= 0, F.lit(0.0)).otherwise(F.least(F.col("weight") * F.lit(rate), limit))
    return sources.withColumn("target", F.round(target, 6))


def mix(
    docs: DataFrame, schedules: DataFrame, cut: bool, most: int = MOST_REPEATS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Add ``source_size``, ``target``, ``taken``, ``takes`` to documents (doc_id, source, size).

    ``schedules``: one row per source (null is a source too) with ``knots``, an array of
    (t, weight) from t = 0 to 1. A source without a schedule is left out of the mix: target 0.

    ``takes`` lists each reading of the document: words and training time. With ``cut`` the
    reading that meets the target takes only the words still wanted, so a source's taken words are
    its target rounded down; without, a document is taken whole if its middle word is wanted.
    Equal rows (same id, size, source) are different documents whose places may be exchanged.
    """
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = (
        sources.join(
            schedules.select(F.col("source").alias("_source"), integrate(F.col("knots")).alias("segments")),
            F.col("source").eqNullSafe(F.col("_source")),
            "left",
        )
        .drop("_source")
        .withColumn("weight", F.coalesce(overall_weight(F.col("segments")), F.lit(0.0)))
    )
    plan = share_out(store(plan, "sources"), most).withColumnRenamed("source", "_source")

    cut_up = (
        docs.join(plan, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source", "weight")
        .withColumn("_hash", even_hash(F.col("doc_id")))
        .withColumn("_slice", slice_of(F.col("_hash"), F.ceil(F.col("n") / F.lit(slice_rows))))
    )
    placed = run_along(cut_up, ["source"], "_slice", ["_hash", "doc_id", "size"], sums={"_before": "size"})

    wanted, size, whole = F.floor(F.col("target")), F.col("size"), F.col("source_size")
    starts = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: e * whole + F.col("_before") < wanted),
        lambda e: e * whole + F.col("_before"),
    )
    if cut:
        words = lambda at: F.least(size, wanted - at)
    else:
        words = lambda at: F.when(at + size / 2 <= wanted, size).otherwise(0).cast("long")
    reach = overall_weight(F.col("segments")) / F.col("target")
    takes = F.filter(
        F.transform(
            starts,
            lambda at: F.struct(words(at).alias("words"), due_time(F.col("segments"), at * reach).alias("time")),
        ),
        lambda take: take["words"] > 0,
    )
    out = placed.withColumn("takes", takes)
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, take: a + take["words"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "source_size", "target", taken.alias("taken"), "takes")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per document with the time of its first reading, range-sorted by it; unread ones last."""
    first = F.get("takes", F.lit(0))["time"]
    return mixed.withColumn("position", F.round(first, 9)).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def cycled_schedules(sources: DataFrame) -> DataFrame:
    """Schedules with overall weights 5, 2, 1 repeating over sources (column ``nth``, from 0).

    Heavy sources fade and light ones grow during training.
    """
    ramps = [(7.5, 2.5), (2.0, 2.0), (0.5, 1.5)]  # mean weight 5, 2, 1
    knots = [
        F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("weight")) for t, w in zip((0.0, 1.0), ramp)])
        for ramp in ramps
    ]
    which = F.col("nth") % len(ramps)
    return sources.select("source", F.when(which == 0, knots[0]).when(which == 1, knots[1]).otherwise(knots[2]).alias("knots"))


def ranked_sources(docs: DataFrame) -> DataFrame:
    """``nth`` (from 0) of each source by code point, null last.

    Sources are sorted in ranges; a place is the one within its range plus the rows of the ranges
    before it, so that no task holds all sources.
    """
    ordered = (
        docs.select("source")
        .distinct()
        .repartitionByRange(F.col("source").isNull(), F.col("source"))
        .sortWithinPartitions(F.col("source").isNull(), F.col("source"))
    )
    mask = F.lit((1 << 33) - 1)
    at = F.monotonically_increasing_id()
    kept = store(
        ordered.select("source", F.shiftright(at, 33).alias("part"), at.bitwiseAND(mask).alias("place")), "ranks"
    )
    # The ranges are few: one row each.
    sizes = kept.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select(
        "part",
        F.coalesce(
            F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    return kept.join(before, "part").select("source", (F.col("before") + F.col("place")).alias("nth"))


def mix_documents(docs: DataFrame, schedules_of, most: int = MOST_REPEATS) -> DataFrame:
    """The documents of the mix with all their columns (doc_id, text and source among them), whole,
    one row for each reading, in training order.

    ``schedules_of`` makes the schedules from the ranked sources (``source``, ``nth``). A document
    that the mix does not take has no row, nor has one without words. Texts are joined once to what
    was planned on ids, sources and sizes, and sorted once, in ranges of training time.
    """
    size = word_count(F.col("text"))
    sized = store(docs.select("doc_id", "source", size.alias("size")), "sizes")
    plan = mix(sized, schedules_of(ranked_sources(sized)), cut=False, most=most).filter("taken > 0")
    plan = store(plan.select("doc_id", "source", "size", "takes"), "takes")
    key = {name: free_name(docs.columns, f"_{name}") for name in ("doc_id", "source", "size", "nth")}
    rows = docs.select("*", *[F.col(c).alias(key[c]) for c in ("doc_id", "source")], size.alias(key["size"]))
    on = ["doc_id", "source", "size"]
    if not sized.groupBy(*on).count().filter("count > 1").isEmpty():
        # Rows equal in these three are numbered, and so are their readings, to pair them.
        plan = plan.withColumn("nth", F.row_number().over(Window.partitionBy(*on).orderBy(F.to_json("takes"))))
        rows = rows.withColumn(key["nth"], F.row_number().over(Window.partitionBy(*[key[c] for c in on]).orderBy(row_hash(docs))))
        on.append("nth")
    wish = free_prefix(docs.columns, "_wanted")
    wanted = plan.select(*[F.col(c).alias(f"{wish}_{c}") for c in [*on, "takes"]])
    met = rows.join(wanted, [F.col(key[c]).eqNullSafe(F.col(f"{wish}_{c}")) for c in on])
    own = [F.col(f"`{c}`") for c in docs.columns]
    time = free_name(docs.columns, "_time")
    each = met.select(*own, F.explode(F.transform(f"{wish}_takes", lambda t: t["time"])).alias(time))
    return each.orderBy(time, F.col("doc_id")).select(*own)
