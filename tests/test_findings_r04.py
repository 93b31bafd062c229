"""What the fourth review found: the wide report's figures follow its SQL on series of any kind."""

import datetime
import math
import random

import numpy as np
import pytest

from tests.compare import against_sql
from tracewell.operators import kernels
from tracewell.plans.catalogue import ORACLES, QUERIES


def _events(spark, folder, series):
    """``series`` as an events table of one file: (user, type, values), a second between samples."""
    rows, second = [], datetime.timedelta(seconds=1)
    for user, kind, values in series:
        rows += [(len(rows) + k, datetime.datetime(2024, 1, 1) + len(rows) * second + k * second, user, kind, v) for k, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/from")
    (file,) = (folder / "from").glob("*.parquet")
    file.rename(folder / "events.parquet")
    return str(folder)


def _report(spark, folder):
    return against_sql(QUERIES["signal_report"](spark, folder), ORACLES["signal_report"], folder)


def test_report_of_single_samples(spark, tmp_path):
    """One sample crosses nothing, which is 0 and not null."""
    got, want = _report(spark, _events(spark, tmp_path, [(1, "view", [3.25]), (2, "view", [7.5]), (2, "click", [1.0, 4.0, 2.0])]))
    assert got == want


def test_report_rounds_halves_as_its_sql(spark, tmp_path):
    """The mean of 32 hundredths may be a half of the sixth decimal, whose sum is off by its last bit."""
    r = random.Random(3)
    got, want = _report(spark, _events(spark, tmp_path, [(k, "view", [r.randint(0, 40_000) / 100 for _ in range(32)]) for k in range(120)]))
    assert got == want


@pytest.mark.parametrize("part", ["samples", "keys"])
def test_report_of_nulls(spark, tmp_path, part):
    r = random.Random(5)
    hole = lambda: None if r.random() < 0.2 else r.randint(0, 40_000) / 100
    series = [(k, "view", [hole() for _ in range(r.randint(1, 20))]) for k in range(60)] + [(99, "view", [None] * 5)]
    if part == "keys":
        series = [(1, "view", [2.0, 5.0, 1.0]), (None, "view", [2.0, 5.0, 1.0]), (1, None, [2.0, 5.0, 1.0])]
    got, want = _report(spark, _events(spark, tmp_path, series))
    assert got == want


def test_report_finds_bins_beyond_the_eighth(spark, tmp_path):
    """The strongest of 40 samples' 20 bins is the 15th; also beside the SQL, on lengths of 16 to 60 and flat ones."""
    waves = [round(50 + 20 * math.cos(2 * math.pi * 15 * k / 40) + 5 * math.cos(2 * math.pi * 3 * k / 40), 2) for k in range(40)]
    r = random.Random(7)
    series = [(k, "click", [r.randint(0, 40_000) / 100 for _ in range(r.randint(16, 60))]) for k in range(80)] + [(100 + n, "error", [0.1] * n) for n in range(1, 12)]
    folder = _events(spark, tmp_path, [(1, "view", waves), *series])
    got, want = _report(spark, folder)
    assert got == want
    report = {(x.user_id, x.event_type): x.dominant_freq_hz for x in QUERIES["signal_report"](spark, folder).collect()}
    assert report[1, "view"] == 15 * 10 / 40
    assert sum(report[u, kind] * len(v) / 10 > 8.01 for u, kind, v in series if kind == "click") > 20


def test_strongest_bin_by_all_bins():
    r = np.random.default_rng(2)
    for t in range(200):
        x = r.normal(10, 3, r.integers(2, 70)).round(t % 4)
        if t % 5 == 0:
            x[r.random(len(x)) < 0.2] = np.nan
        c = np.nan_to_num(x - np.nanmean(x)) if not np.isnan(x).all() else np.zeros(len(x))
        power = [abs(sum(v * np.exp(-2j * np.pi * k * i / len(x)) for i, v in enumerate(c))) ** 2 for k in range(1, len(x) // 2 + 1)]
        assert power[kernels.strongest_bin(x) - 1] >= max(power) * (1 - 1e-9)
    assert kernels.strongest_bin(np.array([1.0])) is None and kernels.strongest_bin(np.full(5, np.nan)) == 1
    # a long series whose bins are all equally strong
    assert 1 <= kernels.strongest_bin(np.eye(1, 1 << 14, 77)[0]) <= 1 << 13


def test_peaks_drops_by_its_rules_only():
    """Against each candidate in turn, by height; whatever goes has a standing peak within the distance."""
    r = np.random.default_rng(6)
    for t in range(300):
        x = r.integers(0, 3 + t % 40, r.integers(0, 80)).astype(float)
        if t % 7 == 0:
            x[r.random(len(x)) < 0.1] = np.nan
        distance, i, found = t % 9, 1, []
        while i < len(x) - 1:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j + 1
        want = []
        for p in sorted(found, key=lambda p: (-x[p], -p)):
            if all(abs(p - q) >= distance for q in want):
                want.append(p)
        assert kernels.peaks(x, distance=distance).tolist() == sorted(want)
        assert kernels.peaks(x, 2.0).tolist() == [p for p in found if x[p] >= 2]
