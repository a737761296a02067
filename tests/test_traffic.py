"""Traffic shapes by literal series and release lists."""

import datetime

import pytest
from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.operators import traffic as T

MONDAY = datetime.date(2024, 1, 1)


def series(spark, **values):
    rows = [(name, MONDAY + datetime.timedelta(days=i), n) for name, ns in values.items() for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "entity string, day date, n long")


MACHINE = [200 if i % 7 == 0 else 7 for i in range(56)]
HUMAN = [3 if (i % 7) >= 5 else 20 for i in range(56)]


@pytest.fixture(scope="module")
def metrics(spark):
    given = series(spark, machine=MACHINE, human=HUMAN, zero=[0] * 9, edges=[0, 0, 5, 0, 7, 0], silent=[10, 10, 10, 10, 10, 0, 0] * 4)
    return T.series_metrics(T.active_window(given)).cache()


def test_window_is_trimmed_and_gaps_count_as_zero(spark):
    given = series(spark, a=[0, 3, 0, 4, 0]).filter("n > 0")
    assert [(r.day.day, r.n) for r in T.active_window(given).orderBy("day").collect()] == [(2, 3), (3, 0), (4, 4)]


def test_thresholds(spark):
    got = {r.entity: r.spike_threshold for r in T.spike_threshold(series(spark, low=[1, 2, 3], high=[7, 10, 0], none=[0, 0], half=[6, 7])).collect()}
    assert got == {"low": 50, "high": 85, "none": 50, "half": 65}


def test_shapes(metrics):
    got = {r.entity: r for r in metrics.collect()}
    assert set(got) == {"machine", "human", "edges", "silent"}
    m, h = got["machine"], got["human"]
    assert (m.total, m.active_days, m.spike_threshold, m.spike_days) == (sum(MACHINE[:50]) + 6 * 7, 56, 70, 8)
    assert m.spike_share == pytest.approx(1600 / m.total) and m.weekend_weekday_ratio == 1
    assert (h.spike_days, h.zero_days) == (0, 0) and h.weekend_weekday_ratio == pytest.approx(0.15)
    assert (got["edges"].active_days, got["edges"].zero_days) == (3, 1)


def test_verdicts(spark, metrics):
    entities = spark.createDataFrame([("machine",), ("human",), ("zero",), ("silent",)], "entity string")
    got = {r.entity: r for r in T.traffic_verdict(metrics, entities=entities).collect()}
    assert got["machine"].label == fixed.MACHINE_LABEL and got["machine"].machine_votes == 2
    assert got["human"].label == fixed.HUMAN_LABEL and got["human"].human_votes == 1
    assert got["zero"].label == fixed.NO_DATA_LABEL
    assert (got["silent"].machine_votes, got["silent"].human_votes) == (1, 1)
    assert got["silent"].label == fixed.MIXED_LABEL


def test_versions_and_mirrors(spark, metrics):
    rows = [("human", "1.0", 90), ("human", "0.9", 10), ("machine", "1.0", 30), ("machine", "1.1-rc", 30), ("machine", "0.9", 40), ("machine", "0.1", 0)]
    versions = T.version_metrics(spark.createDataFrame(rows, "entity string, version string, n long"))
    got = {r.entity: r for r in versions.collect()}
    assert (got["machine"].versions_with_downloads, got["machine"].prerelease_versions, got["machine"].top_version) == (3, 1, "0.9")
    assert got["human"].top_share == 0.9
    sides = [("human", "with_mirrors", 10), ("human", "without_mirrors", 9), ("machine", "with_mirrors", 10), ("machine", "without_mirrors", 2), ("odd", "without_mirrors", 5), ("up", "with_mirrors", 1), ("up", "without_mirrors", 5)]
    mirrors = T.mirror_fraction(spark.createDataFrame(sides, "entity string, category string, n long"))
    share = {r.entity: r.mirror_fraction for r in mirrors.collect()}
    assert share == {"human": pytest.approx(0.1), "machine": pytest.approx(0.8), "odd": 0, "up": 0}
    verdicts = {r.entity: (r.machine_votes, r.human_votes) for r in T.traffic_verdict(metrics, versions, mirrors).collect()}
    assert verdicts["human"] == (0, 2) and verdicts["machine"] == (5, 0)


ASSETS = {
    "desktop/v1.0.0": [("desktop_1.0.0_darwin_arm64.tar.gz", 10), ("desktop_1.0.0_windows_amd64.zip", 2), ("checksums.txt", 0)],
    "swept/v0.2.0": [("swept_0.2.0_darwin_arm64.tar.gz", 3), ("swept_0.2.0_windows_amd64.zip", 1), ("swept_0.2.0_linux_amd64.tar.gz", 4), ("checksums.txt", 1)],
    "swept/v0.10.0": [("swept_0.10.0_Linux_amd64.tar.gz", 5), ("swept_0.10.0_linux.sig", 7)],
    "swept/v0.10.0-rc.1": [("swept_0.10.0-rc.1_macOS_arm64.tar.gz", 1)],
    "untagged": [("foo_2_0.1.0_darwin_amd64.tar.gz", 2)],
    "none/v1": [("none_1_darwin_amd64.tar.gz", 0), ("source.zip", 9)],
}


@pytest.fixture(scope="module")
def split(spark):
    rows = [(release, i, name, n) for release, names in ASSETS.items() for i, (name, n) in enumerate(names)]
    return T.release_split(spark.createDataFrame(rows, "release string, asset_no long, asset string, n long")).cache()


def test_release_split(split):
    got = {r.release: (r.module, r.version, r.human, r.ci, r.swept) for r in split.collect()}
    assert got == {
        "desktop/v1.0.0": ("desktop", "1.0.0", 12, 0, False),
        "swept/v0.2.0": ("swept", "0.2.0", 2, 6, True),
        "swept/v0.10.0": ("swept", "0.10.0", 0, 5, False),
        "swept/v0.10.0-rc.1": ("swept", "0.10.0-rc.1", 1, 0, False),
        "untagged": ("foo_2", "0.1.0", 2, 0, False),
        "none/v1": ("", "", 0, 0, False),
    }


def test_release_totals_timeline_and_base(split):
    total = T.release_metrics(split).first()
    assert (total.total_downloads, total.darwin, total.linux, total.windows) == (28, 16, 9, 3)
    assert (total.ci_sweep_releases, total.ci_downloads, total.install_events) == (1, 11, 17)
    assert (total.peak_build, total.peak_build_module) == (12, "desktop")
    assert T.release_verdict(T.release_metrics(split)).first().label == fixed.DESKTOP_LABEL
    timeline = T.release_timeline(split)
    places = {(r.module, r.version): r.place for r in timeline.collect()}
    assert places == {
        ("desktop", "1.0.0"): 1, ("swept", "0.2.0"): 1, ("swept", "0.10.0-rc.1"): 2, ("swept", "0.10.0"): 3, ("foo_2", "0.1.0"): 1,
    }
    base = {r.module: (r.peak, r.estimate) for r in T.install_base(timeline).collect()}
    assert base == {"desktop": (12, True), "swept": (2, False), "foo_2": (2, False)}


@pytest.mark.parametrize(
    "assets, label",
    [
        ([("a_1.0_linux_x", 5)], fixed.LINUX_LABEL),
        ([("a_1.0_linux_x", 5), ("a_1.0_darwin_x", 4)], fixed.LINUX_LABEL),
        ([("a_1.0_linux_x", 4), ("a_1.0_darwin_x", 4)], fixed.MIXED_LABEL),
        ([("a_1.0_linux_x", 2), ("a_1.0_darwin_x", 3)], fixed.DESKTOP_LABEL),
    ],
)
def test_release_labels(spark, assets, label):
    rows = [("r", i, *a) for i, a in enumerate(assets)]
    split = T.release_split(spark.createDataFrame(rows, "release string, asset_no long, asset string, n long"))
    assert T.release_verdict(T.release_metrics(split)).first().label == label


def test_nothing_downloaded_gives_no_metrics(split):
    assert T.release_metrics(split.filter("release = 'none/v1'")).count() == 0


def test_spikes_near_publish(spark):
    window = T.active_window(series(spark, a=[5, 5, 90, 5, 5, 90, 5, 90]))
    published = spark.createDataFrame([("a", MONDAY), ("a", MONDAY + datetime.timedelta(days=1)), ("a", MONDAY + datetime.timedelta(days=7))], "entity string, published date")
    got = [(r.day.day, r.explained) for r in T.spikes_near_publish(window, published).orderBy("day").collect()]
    assert got == [(3, True), (6, False), (8, True)]


def test_versions_of_any_length_sort_by_value(spark):
    from spoor.operators.traffic import version_key

    ordered = ["0.9", "1.2", "1.10", "1.010.1", "9" * 25, "1" + "0" * 25, "1" + "0" * 25 + ".1", "x"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ordered)], "i int, v string")
    assert [r.i for r in df.orderBy(version_key(F.col("v")), "i").collect()] == list(range(len(ordered)))
