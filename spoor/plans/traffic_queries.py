"""Traffic shape: automation or people?"""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.operators import traffic as T
from spoor.plans import demo
from spoor.plans.registry import query

# Daily counts per order priority: a burst on the first of a month, quiet weekends for one
# priority, nothing before 1996 for another, and one that never has anything.
_SERIES = (
    "SELECT entity, day, cast(CASE WHEN entity = '5-LOW' OR (entity = '4-NOT SPECIFIED' AND year(day) < 1996) OR (entity = '2-HIGH' AND day(day) = 13) THEN 0 "
    "WHEN day(day) = 1 THEN c * 5 + 400 WHEN entity = '1-URGENT' AND {dow} >= 5 THEN 1 ELSE c * 5 END as bigint) AS n FROM "
    "(SELECT o_orderpriority AS entity, cast(o_orderdate as date) AS day, count(*) AS c FROM {orders} GROUP BY 1, 2) s"
)
_SPARK_SERIES = _SERIES.replace("{dow}", "weekday(day)")
_DUCK_SERIES = _SERIES.replace("{dow}", "(isodow(day) - 1)").replace("{orders}", "orders")


def series(spark, sf):
    return spark.sql(_SPARK_SERIES, orders=spark.read.parquet(f"{sf}/orders.parquet"))


_WINDOW = (
    "SELECT d.entity, cast(d.day as date) AS day, coalesce(s.n, 0) AS n FROM (SELECT entity, unnest(generate_series(lo, hi, interval 1 day)) AS day FROM "
    "(SELECT entity, min(day) AS lo, max(day) AS hi FROM series WHERE n > 0 GROUP BY 1) b) d LEFT JOIN series s ON s.entity = d.entity AND s.day = cast(d.day as date)"
)
_THRESHOLD = (
    "SELECT entity, greatest(50, coalesce(cast(trunc(10 * median(n) FILTER (WHERE n > 0)) as bigint), 0)) AS spike_threshold FROM win GROUP BY 1"
)
_METRICS = (
    "SELECT entity, total, active_days, spike_threshold, spike_days, spiked / total AS spike_share, baseline_median, baseline_mean, zero_days, weekday_per_day, weekend_per_day, "
    "CASE WHEN weekday_per_day <> 0 THEN weekend_per_day / weekday_per_day ELSE 0.0 END AS weekend_weekday_ratio FROM ("
    "SELECT entity, cast(sum(n) as bigint) AS total, count(*) AS active_days, max(spike_threshold) AS spike_threshold, count(*) FILTER (WHERE n >= spike_threshold) AS spike_days, "
    "cast(coalesce(sum(n) FILTER (WHERE n >= spike_threshold), 0) as bigint) AS spiked, coalesce(median(n) FILTER (WHERE n < spike_threshold), 0.0) AS baseline_median, "
    "coalesce(avg(n) FILTER (WHERE n < spike_threshold), 0.0) AS baseline_mean, count(*) FILTER (WHERE n < spike_threshold AND n = 0) AS zero_days, "
    "coalesce(avg(n) FILTER (WHERE n < spike_threshold AND isodow(day) < 6), 0.0) AS weekday_per_day, coalesce(avg(n) FILTER (WHERE n < spike_threshold AND isodow(day) >= 6), 0.0) AS weekend_per_day "
    "FROM win JOIN thr USING (entity) GROUP BY entity) g"
)
_TO_METRICS = f"WITH series AS ({_DUCK_SERIES}), win AS ({_WINDOW}), thr AS ({_THRESHOLD}), metrics AS ({_METRICS})"


@query("T1", _TO_METRICS + " SELECT entity, day, n FROM win")
def active_window(spark, sf):
    return T.active_window(series(spark, sf))


@query("T2", _TO_METRICS + " SELECT entity, spike_threshold FROM thr")
def spike_threshold(spark, sf):
    return T.spike_threshold(T.active_window(series(spark, sf)))


_ROUNDED = ("spike_share", "baseline_mean", "weekday_per_day", "weekend_per_day", "weekend_weekday_ratio")


def _rounded(columns):
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query(
    "T3",
    _TO_METRICS + " SELECT entity, total, active_days, spike_threshold, spike_days, baseline_median, zero_days, " + _rounded(_ROUNDED) + " FROM metrics",
)
def series_metrics(spark, sf):
    out = T.series_metrics(T.active_window(series(spark, sf)))
    return out.select(*[F.round(c, 6).alias(c) if c in _ROUNDED else c for c in out.columns])


_VERSIONS = (
    "SELECT l_returnflag AS entity, 'v' || cast(l_linenumber as string) || '.0' || CASE WHEN l_tax > 0.06 THEN '-rc' ELSE '' END AS version, "
    "cast(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 20 WHEN l_returnflag = 'A' AND l_tax > 0.06 THEN 0 ELSE 1 END as bigint) AS n FROM {lineitem}"
)
_VERSION_METRICS = (
    "SELECT entity, count(*) AS versions_with_downloads, count(*) FILTER (WHERE contains(version, '-')) AS prerelease_versions, "
    "arg_min(version, {'a': -n, 'b': version}) AS top_version, max(n) / sum(n) AS top_share FROM "
    f"(SELECT entity, version, cast(sum(n) as bigint) AS n FROM ({_VERSIONS.format(lineitem='lineitem')}) v GROUP BY 1, 2 HAVING sum(n) > 0) a GROUP BY 1"
)


def versions(spark, sf):
    return spark.sql(_VERSIONS, lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))


@query("T4", f"SELECT entity, versions_with_downloads, prerelease_versions, top_version, round(top_share, 6) AS top_share FROM ({_VERSION_METRICS}) m")
def version_metrics(spark, sf):
    return T.version_metrics(versions(spark, sf)).withColumn("top_share", F.round("top_share", 6))


_MIRRORS = (
    "SELECT l_returnflag AS entity, CASE WHEN l_linestatus = 'O' THEN 'with_mirrors' ELSE 'without_mirrors' END AS category, "
    "cast(CASE WHEN l_returnflag = 'A' THEN l_quantity * 3 WHEN l_linestatus = 'O' THEN l_quantity * 2 ELSE l_quantity END as bigint) AS n FROM {lineitem}"
)
_MIRROR_FRACTION = (
    "SELECT entity, CASE WHEN w > 0 THEN greatest(0.0, (w - wo) / w) ELSE 0.0 END AS mirror_fraction FROM (SELECT entity, coalesce(sum(n) FILTER (WHERE category = 'with_mirrors'), 0) AS w, "
    f"coalesce(sum(n) FILTER (WHERE category = 'without_mirrors'), 0) AS wo FROM ({_MIRRORS.format(lineitem='lineitem')}) m GROUP BY 1) g"
)


@query("T10", f"SELECT entity, round(mirror_fraction, 6) AS mirror_fraction FROM ({_MIRROR_FRACTION}) f")
def mirror_fraction(spark, sf):
    given = spark.sql(_MIRRORS, lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))
    return T.mirror_fraction(given).withColumn("mirror_fraction", F.round("mirror_fraction", 6))


# Order priorities borrow the version and mirror figures of a return flag.
_FLAG = "CASE entity WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'N' WHEN '3-MEDIUM' THEN 'R' ELSE entity END"


@query(
    "T5",
    _TO_METRICS
    + f", ver AS ({_VERSION_METRICS}), mir AS ({_MIRROR_FRACTION}), ent AS (SELECT DISTINCT o_orderpriority AS entity FROM orders), j AS (SELECT e.entity AS name, m.* EXCLUDE (entity), v.* EXCLUDE (entity), "
    f"r.mirror_fraction FROM ent e LEFT JOIN metrics m USING (entity) LEFT JOIN ver v ON v.entity = {_FLAG.replace('entity', 'e.entity')} LEFT JOIN mir r ON r.entity = {_FLAG.replace('entity', 'e.entity')}), "
    "s AS (SELECT *, weekday_per_day <> 0 AS rhythm, weekend_weekday_ratio BETWEEN 0.7 AND 1.4 AS flat FROM j), "
    "v AS (SELECT *, CASE WHEN total IS NULL THEN 0 ELSE cast(coalesce(spike_share >= 0.5, false) as int) + cast(coalesce(rhythm AND flat, false) as int) + cast(coalesce(zero_days > 0, false) as int) "
    "+ cast(coalesce(prerelease_versions > 0, false) as int) + cast(coalesce(top_share < 0.5, false) as int) + cast(coalesce(mirror_fraction >= 0.5, false) as int) END AS machine, "
    "CASE WHEN total IS NULL THEN 0 ELSE cast(coalesce(rhythm AND NOT flat AND weekend_weekday_ratio < 0.7, false) as int) + cast(coalesce(top_share >= 0.5, false) as int) END AS human FROM s) "
    f"SELECT name AS entity, cast(machine as bigint) AS machine_votes, cast(human as bigint) AS human_votes, CASE WHEN total IS NULL THEN '{fixed.NO_DATA_LABEL}' WHEN machine > human THEN '{fixed.MACHINE_LABEL}' "
    f"WHEN human > machine THEN '{fixed.HUMAN_LABEL}' ELSE '{fixed.MIXED_LABEL}' END AS label, CASE WHEN total IS NULL THEN 'no downloads recorded in the window' ELSE concat_ws('; ', "
    "CASE WHEN spike_share >= 0.5 THEN 'same-day spikes: ' || cast(cast(round(spike_share * 100) as bigint) as string) || '% from ' || cast(cast(round(spike_threshold, 2) as decimal(18,2)) as string) || ' a day' END, CASE WHEN NOT rhythm THEN 'no weekday baseline' END, CASE WHEN rhythm AND flat THEN 'flat week: weekend to weekday ' || cast(cast(round(weekend_weekday_ratio, 2) as decimal(18,2)) as string) END, "
    "CASE WHEN rhythm AND NOT flat AND weekend_weekday_ratio < 0.7 THEN 'weekday-skewed: weekend to weekday ' || cast(cast(round(weekend_weekday_ratio, 2) as decimal(18,2)) as string) END, CASE WHEN zero_days > 0 THEN 'zero days: ' || cast(zero_days as string) END, "
    "CASE WHEN prerelease_versions > 0 THEN 'pre-releases drawing downloads: ' || cast(prerelease_versions as string) END, CASE WHEN top_share < 0.5 THEN 'smeared over versions: top one ' || cast(cast(round(top_share * 100) as bigint) as string) || '%' END, CASE WHEN top_share >= 0.5 THEN 'concentrated on one version: ' || top_version || ' ' || cast(cast(round(top_share * 100) as bigint) as string) || '%' END, "
    "CASE WHEN mirror_fraction >= 0.5 THEN 'mostly mirrors: ' || cast(cast(round(mirror_fraction * 100) as bigint) as string) || '%' WHEN mirror_fraction < 0.5 THEN 'mirror share: ' || cast(cast(round(mirror_fraction * 100) as bigint) as string) || '%' END) END AS reasons FROM v",
)
def traffic_verdict(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    entities = orders.select(F.col("o_orderpriority").alias("entity")).distinct()
    names = entities.selectExpr("entity AS name", f"{_FLAG} AS entity")

    def renamed(df):
        return names.join(df, "entity").drop("entity").withColumnRenamed("name", "entity")

    mirrors = T.mirror_fraction(spark.sql(_MIRRORS, lineitem=spark.read.parquet(f"{sf}/lineitem.parquet")))
    metrics = T.series_metrics(T.active_window(series(spark, sf)))
    return T.traffic_verdict(metrics, renamed(T.version_metrics(versions(spark, sf))), renamed(mirrors), entities)


# Releases: module by supplier, version by part; each line is an asset.
_MODULE = "CASE l_suppkey % 3 WHEN 0 THEN 'daemon' WHEN 1 THEN 'hook' ELSE 'collector_2' END"
_NUMBER = "'0.' || cast(l_suppkey % 12 as string) || '.' || cast(l_partkey % 4 as string) || CASE WHEN l_partkey % 8 > 5 THEN '-rc1' ELSE '' END"
_ASSETS = (
    f"SELECT CASE WHEN l_suppkey % 25 = 7 THEN 'untagged-' || cast(l_suppkey as string) ELSE {_MODULE} || '/v' || {_NUMBER} END AS release, asset_no, "
    f"CASE l_linenumber WHEN 1 THEN {_MODULE} || '_' || {_NUMBER} || '_Darwin_arm64.tar.gz' WHEN 2 THEN {_MODULE} || '_' || {_NUMBER} || '_linux_amd64.tar.gz' WHEN 3 THEN 'checksums.txt' "
    f"WHEN 4 THEN {_MODULE} || '_' || {_NUMBER} || '_windows_amd64.zip' WHEN 5 THEN 'release.sig' ELSE {_MODULE} || '-extra-macos' END AS asset, "
    "cast(CASE WHEN l_linenumber = 2 AND l_suppkey % 3 = 1 THEN 0 WHEN l_linenumber = 3 AND l_suppkey % 4 > 1 THEN 0 ELSE floor(l_quantity / 5) END as bigint) AS n FROM "
    "(SELECT *, l_orderkey * 100 + l_linenumber AS asset_no FROM {lineitem}) l"
)
_PLATFORM = (
    "CASE WHEN regexp_matches(lower(asset), '\\.(txt|sig|pem|sbom|json)$') THEN NULL WHEN regexp_matches(lower(asset), 'darwin|macos') THEN 'darwin' "
    "WHEN contains(lower(asset), 'linux') THEN 'linux' WHEN contains(lower(asset), 'windows') THEN 'windows' END"
)
_NAME = "'(?i)^(.+)_v?(\\d[A-Za-z0-9.\\-]*)_(?:darwin|linux|windows|macos)_'"
_SPLIT = (
    "SELECT release, coalesce(module, '') AS module, coalesce(version, '') AS version, darwin + windows - taken AS human, linux + taken AS ci, swept, darwin, linux, windows, binaries FROM "
    "(SELECT *, CASE WHEN swept THEN desktop ELSE 0 END AS taken FROM (SELECT release, arg_min(regexp_extract(asset, " + _NAME + ", 1), asset_no) FILTER (WHERE n > 0 AND p IS NOT NULL AND regexp_matches(asset, " + _NAME + ")) AS module, "
    "arg_min(regexp_extract(asset, " + _NAME + ", 2), asset_no) FILTER (WHERE n > 0 AND p IS NOT NULL AND regexp_matches(asset, " + _NAME + ")) AS version, "
    "bool_or(n > 0 AND p IS NULL AND contains(lower(asset), 'checksum')) AND bool_or(n > 0 AND coalesce(p = 'linux', false)) AS swept, "
    "cast(coalesce(sum(n) FILTER (WHERE n > 0 AND p = 'darwin'), 0) as bigint) AS darwin, cast(coalesce(sum(n) FILTER (WHERE n > 0 AND p = 'linux'), 0) as bigint) AS linux, "
    "cast(coalesce(sum(n) FILTER (WHERE n > 0 AND p = 'windows'), 0) as bigint) AS windows, count(*) FILTER (WHERE n > 0 AND p IN ('darwin', 'windows')) AS desktop, "
    f"count(*) FILTER (WHERE n > 0 AND p IS NOT NULL) AS binaries FROM (SELECT *, {_PLATFORM} AS p FROM ({_ASSETS.format(lineitem='lineitem')}) a) q GROUP BY 1) g) h"
)


def assets(spark, sf):
    return spark.sql(_ASSETS, lineitem=demo.read(spark, sf, "lineitem"))


@query("T6", _SPLIT)
def release_split(spark, sf):
    return T.release_split(assets(spark, sf))


_RELEASE_METRICS = (
    "SELECT total_downloads, darwin, linux, windows, ci_sweep_releases, ci_downloads, total_downloads - ci_downloads AS install_events, peak AS peak_build, "
    "CASE WHEN peak > 0 THEN best ELSE '' END AS peak_build_module FROM (SELECT cast(sum(darwin + linux + windows) as bigint) AS total_downloads, cast(sum(darwin) as bigint) AS darwin, "
    "cast(sum(linux) as bigint) AS linux, cast(sum(windows) as bigint) AS windows, count(*) FILTER (WHERE swept) AS ci_sweep_releases, cast(sum(ci) as bigint) AS ci_downloads, "
    "greatest(max(human), 0) AS peak, arg_min(module, {'a': -human, 'b': release}) AS best FROM split) m WHERE total_downloads > 0"
)


@query("T7", f"WITH split AS ({_SPLIT}) {_RELEASE_METRICS}")
def release_metrics(spark, sf):
    return T.release_metrics(T.release_split(assets(spark, sf)))


@query("T7", f"WITH split AS ({_SPLIT}) SELECT module, cast(sum(darwin + linux + windows) as bigint) AS downloads FROM split WHERE module <> '' GROUP BY 1")
def module_downloads(spark, sf):
    return T.module_downloads(T.release_split(assets(spark, sf)))


_TAG = "'^(.*?)[/-]v?(\\d[\\w.\\-]*)$'"
# "untagged-32" is a tag of module "untagged" and version "32", as the tag rule has it. Parts a
# version lacks sort before any number.
_PARTS = ", ".join(f"coalesce(try_cast(split_part(base, '.', {i}) as int), -1) AS key{i}" for i in (1, 2, 3))
_TIMELINE = (
    "SELECT release, module, version, human, ci, swept, row_number() OVER (PARTITION BY module ORDER BY key1, key2, key3, pre, release) AS place FROM "
    f"(SELECT *, {_PARTS} FROM (SELECT *, split_part(version, '-', 1) AS base, CASE WHEN contains(version, '-') THEN '0' || split_part(version, '-', 2) ELSE '1' END AS pre FROM "
    f"(SELECT release, regexp_extract(release, {_TAG}, 1) AS module, regexp_extract(release, {_TAG}, 2) AS version, human, ci, swept FROM tagged WHERE binaries > 0) a) b) c"
)


@query("T8", f"WITH tagged AS ({_SPLIT}) {_TIMELINE}")
def release_timeline(spark, sf):
    return T.release_timeline(T.release_split(assets(spark, sf)))


@query(
    "T9",
    f"WITH split AS ({_SPLIT}), m AS ({_RELEASE_METRICS}) SELECT CASE WHEN install_events > 0 AND (darwin + windows) / total_downloads >= 0.6 THEN '{fixed.DESKTOP_LABEL}' "
    f"WHEN linux > darwin + windows THEN '{fixed.LINUX_LABEL}' ELSE '{fixed.MIXED_LABEL}' END AS label, total_downloads, install_events, darwin + windows AS desktop, linux AS server FROM m",
)
def release_verdict(spark, sf):
    return T.release_verdict(T.release_metrics(T.release_split(assets(spark, sf))))


@query(
    "T11",
    f"WITH tagged AS ({_SPLIT}), peaks AS (SELECT module, greatest(max(human), 0) AS peak FROM ({_TIMELINE}) t GROUP BY 1) "
    "SELECT module, peak, row_number() OVER (ORDER BY peak DESC, module) = 1 AS estimate FROM peaks",
)
def install_base(spark, sf):
    return T.install_base(T.release_timeline(T.release_split(assets(spark, sf))))


_PUBLISHES = "SELECT DISTINCT o_orderpriority AS entity, cast(o_orderdate as date) AS published FROM {orders} WHERE o_orderstatus = 'P'"


@query(
    "T12",
    _TO_METRICS
    + f", pub AS ({_PUBLISHES.format(orders='orders')}), sp AS (SELECT entity, day, n FROM win JOIN thr USING (entity) WHERE n >= spike_threshold) "
    "SELECT entity, day, n, EXISTS (SELECT 1 FROM pub p WHERE p.entity = sp.entity AND sp.day BETWEEN p.published AND p.published + 2) AS explained FROM sp",
)
def spikes_near_publish(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return T.spikes_near_publish(T.active_window(series(spark, sf)), spark.sql(_PUBLISHES, orders=orders))
