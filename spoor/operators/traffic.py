"""Traffic shape: automation or people?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.functions.carry import along
from spoor.functions.exprs import first_of


def active_window(series: DataFrame) -> DataFrame:
    """T1. Daily series (entity, day, n) from the first to the last day above zero, gaps as zero."""
    daily = series.groupBy("entity", "day").agg(F.sum("n").alias("n"))
    bounds = daily.filter("n > 0").groupBy("entity").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = bounds.select("entity", F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.join(daily, ["entity", "day"], "left").select(
        "entity", "day", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def spike_threshold(window: DataFrame) -> DataFrame:
    """T2. max(floor, ten times the median of days above zero, cut to a whole number).

    A series has one row per day, so the exact median holds at most one count per day.
    """
    typical = F.median(F.when(F.col("n") > 0, F.col("n")))
    scaled = F.coalesce((typical * fixed.SPIKE_FACTOR).cast("long"), F.lit(0))
    return window.groupBy("entity").agg(F.greatest(scaled, F.lit(fixed.SPIKE_FLOOR)).alias("spike_threshold"))


def series_metrics(window: DataFrame, threshold: DataFrame | None = None) -> DataFrame:
    """T3. Shape of each series; the weekly rhythm is read on baseline days only."""
    rows = window.join(spike_threshold(window) if threshold is None else threshold, "entity")
    n, spike = F.col("n"), F.col("n") >= F.col("spike_threshold")
    base = F.when(~spike, n)
    weekend = F.weekday("day") >= 5
    grouped = rows.groupBy("entity").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("active_days"),
        F.max("spike_threshold").alias("spike_threshold"),
        F.count(F.when(spike, 1)).alias("spike_days"),
        F.sum(F.when(spike, n).otherwise(0)).alias("__spiked"),
        F.coalesce(F.median(base), F.lit(0.0)).alias("baseline_median"),
        F.coalesce(F.avg(base), F.lit(0.0)).alias("__mean"),
        F.count(F.when(~spike & (n == 0), 1)).alias("zero_days"),
        F.coalesce(F.avg(F.when(~weekend, base)), F.lit(0.0)).alias("__wd"),
        F.coalesce(F.avg(F.when(weekend, base)), F.lit(0.0)).alias("__we"),
    )
    return grouped.select(
        "entity",
        "total",
        "active_days",
        "spike_threshold",
        "spike_days",
        F.when(F.col("total") > 0, F.col("__spiked") / F.col("total")).otherwise(0.0).alias("spike_share"),
        "baseline_median",
        F.col("__mean").alias("baseline_mean"),
        "zero_days",
        F.col("__wd").alias("weekday_per_day"),
        F.col("__we").alias("weekend_per_day"),
        F.when(F.col("__wd") != 0, F.col("__we") / F.col("__wd")).otherwise(0.0).alias("weekend_weekday_ratio"),
    )


def version_metrics(versions: DataFrame) -> DataFrame:
    """T4. How each entity's downloads spread over versions (entity, version, n)."""
    active = versions.groupBy("entity", "version").agg(F.sum("n").alias("n")).filter("n > 0")
    # The smaller version string wins a tie.
    top = F.min_by("version", F.struct((-F.col("n")).alias("m"), "version"))
    return active.groupBy("entity").agg(
        F.count(F.lit(1)).alias("versions_with_downloads"),
        F.count(F.when(F.col("version").contains("-"), 1)).alias("prerelease_versions"),
        top.alias("top_version"),
        (F.max("n") / F.sum("n")).alias("top_share"),
    )


def _percent(column: str) -> Column:
    return F.concat(F.round(F.col(column) * 100).cast("long").cast("string"), F.lit("%"))


def _two_places(value: Column) -> Column:
    return F.round(value, 2).cast("decimal(18,2)").cast("string")


def _told(sign: str, *figures: str | Column) -> Column:
    return F.concat(F.lit(f"{sign}: "), F.concat_ws(" ", *[F.lit(f) if isinstance(f, str) else f for f in figures]))


def traffic_verdict(
    metrics: DataFrame, versions: DataFrame | None = None, mirrors: DataFrame | None = None, entities: DataFrame | None = None
) -> DataFrame:
    """T5. Weigh machine against human signs; votes, label and the signs seen, with their figures.

    ``versions``: T4; ``mirrors``: entity, mirror_fraction; ``entities``: all entities, so that
    those without data are reported too.
    """
    rows = metrics if entities is None else entities.select("entity").join(metrics, "entity", "left")
    no_data = F.col("total").isNull()
    if versions is not None:
        rows = rows.join(versions, "entity", "left")
    if mirrors is not None:
        rows = rows.join(mirrors, "entity", "left")
    ratio, rhythm = F.col("weekend_weekday_ratio"), F.col("weekday_per_day") != 0
    low, high = fixed.FLAT_WEEK
    week = F.concat(F.lit("weekend to weekday "), _two_places(ratio))
    signs = [
        (F.col("spike_share") >= 0.5, "machine", _told("same-day spikes", _percent("spike_share"), "from", _two_places(F.col("spike_threshold")), "a day")),
        (~rhythm, "none", F.lit("no weekday baseline")),
        (rhythm & ratio.between(low, high), "machine", _told("flat week", week)),
        (rhythm & ~ratio.between(low, high) & (ratio < fixed.HUMAN_WEEKDAY_RATIO), "human", _told("weekday-skewed", week)),
        (F.col("zero_days") > 0, "machine", _told("zero days", F.col("zero_days").cast("string"))),
    ]
    if versions is not None:
        signs += [
            (F.col("prerelease_versions") > 0, "machine", _told("pre-releases drawing downloads", F.col("prerelease_versions").cast("string"))),
            (F.col("top_share") < 0.5, "machine", _told("smeared over versions", "top one", _percent("top_share"))),
            (F.col("top_share") >= 0.5, "human", _told("concentrated on one version", F.col("top_version"), _percent("top_share"))),
        ]
    if mirrors is not None:
        signs += [
            (F.col("mirror_fraction") >= 0.5, "machine", _told("mostly mirrors", _percent("mirror_fraction"))),
            (F.col("mirror_fraction") < 0.5, "none", _told("mirror share", _percent("mirror_fraction"))),
        ]

    def votes(side: str) -> Column:
        one = [F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0) for cond, s, _ in signs if s == side]
        return F.when(no_data, F.lit(0)).otherwise(sum(one, F.lit(0))).cast("long")

    seen = F.concat_ws("; ", *[F.when(F.coalesce(cond, F.lit(False)), text) for cond, _, text in signs])
    rows = rows.withColumn("machine_votes", votes("machine")).withColumn("human_votes", votes("human"))
    label = first_of(
        [
            (no_data, fixed.NO_DATA_LABEL),
            (F.col("machine_votes") > F.col("human_votes"), fixed.MACHINE_LABEL),
            (F.col("human_votes") > F.col("machine_votes"), fixed.HUMAN_LABEL),
        ],
        fixed.MIXED_LABEL,
    )
    reasons = F.when(no_data, F.lit("no downloads recorded in the window")).otherwise(seen)
    return rows.select("entity", "machine_votes", "human_votes", label.alias("label"), reasons.alias("reasons"))


def asset_platform(asset: Column) -> Column:
    """darwin / linux / windows, or null for checksums, signatures and unknown names."""
    name = F.lower(asset)
    extra = F.lit(False)
    for suffix in fixed.NON_BINARY_SUFFIXES:
        extra = extra | name.endswith(suffix)
    return first_of(
        [
            (extra, F.lit(None).cast("string")),
            (name.contains("darwin") | name.contains("macos"), "darwin"),
            (name.contains("linux"), "linux"),
            (name.contains("windows"), "windows"),
        ]
    )


_ASSET = r"(?i)^(.+)_v?(\d[A-Za-z0-9.\-]*)_(?:darwin|linux|windows|macos)_"


def release_split(assets: DataFrame) -> DataFrame:
    """T6. Per release: human and automated downloads; ``assets``: release, asset_no, asset, n.

    A checksum list fetched together with a Linux build marks a sweep; a sweep also took one of
    every desktop build. Linux is automation.
    """
    rows = assets.select("release", "asset_no", "asset", "n", asset_platform(F.col("asset")).alias("platform"))
    loaded = F.col("n") > 0
    binary = loaded & F.col("platform").isNotNull()
    desktop = binary & (F.col("platform") != "linux")
    named = F.when(binary & F.col("asset").rlike(_ASSET), F.col("asset_no"))

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    grouped = rows.groupBy("release").agg(
        F.min_by("asset", named).alias("__first"),
        F.max(loaded & F.col("platform").isNull() & F.lower("asset").contains("checksum")).alias("__sums"),
        F.max(loaded & F.coalesce(F.col("platform") == "linux", F.lit(False))).alias("__linux"),
        total(binary & (F.col("platform") == "darwin")).alias("darwin"),
        total(binary & (F.col("platform") == "linux")).alias("linux"),
        total(binary & (F.col("platform") == "windows")).alias("windows"),
        F.count(F.when(desktop, 1)).alias("__desktop_assets"),
        F.count(F.when(binary, 1)).alias("binaries"),
    )
    swept = F.col("__sums") & F.col("__linux")
    taken = F.when(swept, F.col("__desktop_assets")).otherwise(0)
    return grouped.select(
        "release",
        F.coalesce(F.regexp_extract("__first", _ASSET, 1), F.lit("")).alias("module"),
        F.coalesce(F.regexp_extract("__first", _ASSET, 2), F.lit("")).alias("version"),
        (F.col("darwin") + F.col("windows") - taken).alias("human"),
        (F.col("linux") + taken).alias("ci"),
        swept.alias("swept"),
        "darwin",
        "linux",
        "windows",
        "binaries",
    )


def release_metrics(split: DataFrame) -> DataFrame:
    """T7. All releases together: platforms, sweeps, install events and the peak single build.

    The smaller release name wins a tied peak. No row when nothing was ever downloaded.
    """
    peak = F.min_by(F.struct("human", "module"), F.struct((-F.col("human")).alias("m"), "release"))
    total = F.sum(F.col("darwin") + F.col("linux") + F.col("windows"))
    return (
        split.agg(
            total.alias("total_downloads"),
            F.sum("darwin").alias("darwin"),
            F.sum("linux").alias("linux"),
            F.sum("windows").alias("windows"),
            F.count(F.when(F.col("swept"), 1)).alias("ci_sweep_releases"),
            F.sum("ci").alias("ci_downloads"),
            peak.alias("__peak"),
        )
        .filter("total_downloads > 0")
        .select(
            "total_downloads",
            "darwin",
            "linux",
            "windows",
            "ci_sweep_releases",
            "ci_downloads",
            (F.col("total_downloads") - F.col("ci_downloads")).alias("install_events"),
            F.greatest(F.col("__peak.human"), F.lit(0)).alias("peak_build"),
            F.when(F.col("__peak.human") > 0, F.col("__peak.module")).otherwise(F.lit("")).alias("peak_build_module"),
        )
    )


def module_downloads(split: DataFrame) -> DataFrame:
    """T7. Downloads per module."""
    return (
        split.filter("module <> ''")
        .groupBy("module")
        .agg(F.sum(F.col("darwin") + F.col("linux") + F.col("windows")).alias("downloads"))
    )


_TAG = r"^(.*?)[/-]v?(\d[\w.\-]*)$"
_BARE = r"^v?(\d[\w.\-]*)$"


def _number_key(digits: Column) -> Column:
    significant = F.regexp_replace(digits, "^0+", "")
    return F.concat(F.lit("0"), F.lpad(F.length(significant).cast("string"), 10, "0"), significant)


def version_key(version: Column) -> Column:
    """A text that sorts as versions do: numeric parts by value, a pre-release before its release.

    A number is written with its length before it, so one of any size sorts by value; a part that
    is no number sorts behind all numbers. Ends of parts sort before more parts.
    """
    base = F.split_part(version, F.lit("-"), F.lit(1))
    pre = F.when(version.contains("-"), F.regexp_replace(version, r"^[^-]*-", "")).otherwise(F.lit(""))
    parts = F.transform(
        F.split(base, r"\."),
        lambda p: F.when(p.rlike(r"^\d+$"), _number_key(p)).otherwise(F.concat(F.lit("1"), p)),
    )
    return F.concat(
        F.array_join(parts, "."), F.lit(" "), F.when(pre == "", F.lit("1")).otherwise(F.concat(F.lit("0"), pre))
    )


def release_timeline(split: DataFrame) -> DataFrame:
    """T8. Releases with downloads per module in version order; the tag names module and version,
    else the asset does."""
    tag_version = F.regexp_extract("release", _TAG, 2)
    bare = F.regexp_extract("release", _BARE, 1)
    from_tag = F.when(tag_version != "", tag_version).otherwise(bare)
    tag_module = F.when(tag_version != "", F.regexp_replace(F.regexp_extract("release", _TAG, 1), r"[/-]+$", "")).otherwise(F.lit(""))
    clean = from_tag != ""
    placed = split.filter("binaries > 0").select(
        "release",
        F.coalesce(F.nullif(F.when(clean, tag_module).otherwise(F.lit("")), F.lit("")), F.col("module")).alias("module"),
        F.when(clean, from_tag).otherwise(F.col("version")).alias("version"),
        "human",
        "ci",
        "swept",
    )
    keyed = placed.withColumn("__key", version_key(F.col("version")))
    return along(keyed, ("module",), ("__key", "release"), position="place").drop("__key")


def release_verdict(metrics: DataFrame) -> DataFrame:
    """T9. Desktop installs, Linux automation, or neither."""
    desktop = F.col("darwin") + F.col("windows")
    label = first_of(
        [
            (
                (F.col("install_events") > 0)
                & (desktop / F.col("total_downloads") >= fixed.DESKTOP_FRACTION_HUMAN),
                fixed.DESKTOP_LABEL,
            ),
            (F.col("linux") > desktop, fixed.LINUX_LABEL),
        ],
        fixed.MIXED_LABEL,
    )
    return metrics.select(
        label.alias("label"), "total_downloads", "install_events", desktop.alias("desktop"), F.col("linux").alias("server")
    )


def mirror_fraction(df: DataFrame) -> DataFrame:
    """T10. max(0, (with − without) / with) per entity, 0 without data; df: entity, category, n."""
    having = F.sum(F.when(F.col("category") == "with_mirrors", F.col("n")).otherwise(0))
    without = F.sum(F.when(F.col("category") == "without_mirrors", F.col("n")).otherwise(0))
    return df.groupBy("entity").agg(
        F.when(having > 0, F.greatest(F.lit(0.0), (having - without) / having)).otherwise(0.0).alias("mirror_fraction")
    )


def install_base(timeline: DataFrame) -> DataFrame:
    """T11. Best single build per module; the largest is the estimate."""
    peaks = timeline.groupBy("module").agg(F.greatest(F.max("human"), F.lit(0)).alias("peak"))
    best = peaks.agg(F.min_by("module", F.struct((-F.col("peak")).alias("m"), "module")).alias("best"))
    # One row against one row per module.
    return peaks.join(F.broadcast(best), F.col("module") == F.col("best"), "left").select(
        "module", "peak", F.col("best").isNotNull().alias("estimate")
    )


def spikes_near_publish(window: DataFrame, publishes: DataFrame, days: int = 2) -> DataFrame:
    """T12. Spike days and whether a publish lies at most ``days`` days before.

    ``publishes``: entity, published. Each publish is spread over the days it explains, which
    turns the range condition into an equi-join.
    """
    spikes = (
        window.join(spike_threshold(window), "entity").filter(F.col("n") >= F.col("spike_threshold")).select("entity", "day", "n")
    )
    explained = publishes.select(
        "entity", F.explode(F.sequence("published", F.date_add("published", days))).alias("day")
    ).distinct()
    return spikes.join(explained.withColumn("__by", F.lit(True)), ["entity", "day"], "left").select(
        "entity", "day", "n", F.coalesce("__by", F.lit(False)).alias("explained")
    )
