"""What the third review found: plans that don't multiply rows, and figures that follow their SQL."""

import datetime
import random

import numpy as np

from tests.compare import against_sql
from tracewell.operators import calibration, kernels, report, traces
from tracewell.operators import sequence as seq
from tracewell.plans.catalogue import ORACLES, QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lags_are_summed_without_a_join(spark):
    r = random.Random(5)
    rows = [(k, i, r.random()) for k in "ab" for i in sorted(r.sample(range(40), 25))] + [(None, i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {(x.k, x.lag): x.acf for x in seq.autocorrelation(df, ["k"], "i", "v", 6).collect()}
    want = {}
    for k in "ab":
        own = {i: v for n, i, v in rows if n == k}
        mean = sum(own.values()) / len(own)
        for lag in range(1, 7):
            if pairs := [(own[i] - mean) * (own[i + lag] - mean) for i in own if i + lag in own]:
                want[k, lag] = sum(pairs)
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    plan = _plan(calibration.periods(df, ["k"], "i", "v"))
    assert "Join" not in plan and "Generate" not in plan


def test_scale_joins_records_only(spark, sf):
    plan = _plan(QUERIES["scale_calibration"](spark, sf))
    assert plan.count("Join ") == 4 and "Generate" not in plan


def test_offsets_are_tried_where_a_record_is(spark, monkeypatch):
    """Against every offset tried in turn, also in shares and small blocks; without a row for each offset."""
    r = random.Random(9)
    labels = {k: [(r.randint(0, 400) / 4, f"{k}{j:02d}") for j in range(r.randint(1, 12))] for k in range(12)}
    drawn = {k: sorted({r.randint(0, 400) / 4 for _ in range(r.randint(1, 12))}) for k in range(12)}

    def brute(own, lines):
        own, best = sorted(own), None
        for a, (y, _) in enumerate(own):
            for b, t in enumerate(lines):
                pairs, error = [], 0.0
                for x, name in own:
                    near = [(abs(z - (x + t - y)), z) for z in lines if z not in [p[1] for p in pairs] and abs(z - (x + t - y)) <= 5]
                    if near:
                        error, pairs = error + min(near)[0], [*pairs, (name, min(near)[1])]
                best = min(x for x in (best, (-len(pairs), error, a, b, t - y, pairs)) if x)
        return best[4], -best[0], best[1], best[5]

    want = {k: brute(labels[k], drawn[k]) for k in labels}
    a = spark.createDataFrame([(k, n, y) for k, own in labels.items() for y, n in own] + [(0, "none", None), (None, "x", 1.0)], "k int, name string, y double")
    b = spark.createDataFrame([(k, y) for k, own in drawn.items() for y in own + own[:2]] + [(None, 1.0), (77, 1.0), (0, float("nan"))], "k int, y double")
    found = lambda: {x.k: (x.offset, x.matches, x.error, [tuple(p) for p in x.pairs]) for x in traces.offset_matches(a, b, ["k"], "name", "y", 5.0).collect()}
    assert found() == want
    monkeypatch.setattr(traces, "SHARE", 50)
    assert found() == want
    monkeypatch.setattr(kernels, "MATCHED", 1)
    own = [np.array(sorted(x)) for x in ([y for y, _ in labels[3]], drawn[3])]
    whole = kernels.best_offset(*own, 5.0)
    assert (-whole[0], whole[1]) == want[3][1:3]
    assert "Join" not in _plan(traces.offset_matches(a, b, ["k"], "name", "y", 5.0))


#: a user's purchases in sf0.1: one of them is their mean
AT_MEAN = [9.64, 132.19, 42.74, 56.99, 65.17, 39.27, 0.4, 19.34, 13.2, 52.04, 37.53, 2.73]


def _scrambled():
    """The values' numbers in an order whose plain sum gives other sign changes than the sum in order."""

    def crossings(order):
        total = 0.0
        for k in order:  # sum() would make up for what rounding takes
            total += AT_MEAN[k]
        x = [v - total / len(AT_MEAN) for v in AT_MEAN]
        return sum(a * b < 0 for a, b in zip(x, x[1:]))

    r, order = random.Random(0), list(range(len(AT_MEAN)))
    right = crossings(order)
    while crossings(order) == right:
        r.shuffle(order)
    return order, right


def test_report_sums_in_order(spark):
    order, right = _scrambled()
    df = spark.createDataFrame([("a", k, AT_MEAN[k]) for k in order], "k string, i int, v double").coalesce(1)
    (got,) = report.signal_report(df, ["k"], "i", "v", 10.0, 0.25, 2, 8).collect()
    assert got.zero_crossing_rate == right / len(AT_MEAN)


def test_wide_statistics_sum_in_order(spark, tmp_path):
    order, _ = _scrambled()
    rows = [(k, datetime.datetime(2024, 1, 1 + k), 1, "view", AT_MEAN[k]) for k in order]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/from")
    (file,) = (tmp_path / "from").glob("*.parquet")
    file.rename(tmp_path / "events.parquet")
    got, want = against_sql(QUERIES["signal_stats_wide"](spark, str(tmp_path)), ORACLES["signal_stats_wide"], str(tmp_path))
    assert got == want
