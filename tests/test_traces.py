"""Drawn traces, calibration, validation and sampling on small cases."""

import json
import math
import os
import random

from pyspark.sql import functions as F

from tracewell.operators import calibration, sampling, traces, validation
from tracewell.operators import sequence as seq
from tracewell.streaming import ingest


def _points(spark, rows):
    return spark.createDataFrame([("r", *x) for x in rows], "rec string, x long, y long")


def test_offsets_match_labels_to_traces(spark):
    labels = spark.createDataFrame([("r", "I", 100.0), ("r", "II", 200.0), ("r", "III", 300.0), ("s", "I", 5.0)], "rec string, name string, y double")
    drawn = spark.createDataFrame([("r", 131.0), ("r", 229.0), ("r", 330.0), ("r", 900.0), ("r", None)], "rec string, y double")
    (got,) = traces.offset_matches(labels, drawn, ["rec"], "name", "y", 45.0).collect()
    assert (got.rec, got.offset, got.matches) == ("r", 30.0, 3) and {p.name: p.trace for p in got.pairs} == {"I": 131.0, "II": 229.0, "III": 330.0}
    assert got.error == 2.0
    # two labels want one trace: the upper has it
    close = spark.createDataFrame([("r", "a", 0.0), ("r", "b", 10.0)], "rec string, name string, y double")
    (got,) = traces.offset_matches(close, spark.createDataFrame([("r", 0.0)], "rec string, y double"), ["rec"], "name", "y", 45.0).collect()
    assert got.matches == 1 and got.pairs[0].name == "a" and got.error == 0.0


def test_a_trace_is_followed(spark):
    rows = [(0, 10), (1, 11), (1, 60), (2, 13), (2, 14), (2, 50), (3, 90), (3, 95), (5, 40), (6, 200), (6, 300)]
    got = {r.x: r.trace for r in traces.followed(_points(spark, rows), ["rec"], "x", "y", F.lit(10), gap=3, most=20).collect()}
    assert got == {0: 10.0, 1: 11.0, 2: 13.5, 3: None, 5: 40.0, 6: None}
    mv = {r.x: r.mv for r in traces.unfolded(traces.followed(_points(spark, rows), ["rec"], "x", "y", F.lit(10), 3, 20), ["rec"], "x", F.lit(10.0), 10.0).collect()}
    assert set(mv) == set(range(7)) and mv[0] == 0 and abs(mv[3] - (10 - (13.5 + 26.5 / 3)) / 10) < 1e-9 and mv[6] == -3.0
    # several groups from the start: the nearest to the base
    first = traces.followed(_points(spark, [(0, 1), (0, 30), (0, 60)]), ["rec"], "x", "y", F.lit(28), 3, 20).collect()
    assert [r.trace for r in first] == [30.0]


def test_a_hidden_lane_is_put_back(spark):
    lanes = [100 + 20 * k for k in range(6)] + [260 + 40 * k for k in range(5)]
    rows = [("r", y, float(50 - abs(y - c)) if abs(y - c) < 4 else 0.0) for y in range(500) for c in [min(lanes, key=lambda c: abs(y - c))]]
    rows += [("s", y, 9.0 if y in (50, 90) else 0.0) for y in range(120)] + [("t", y, 0.0) for y in range(30)]
    got = {r.rec: r.lanes for r in traces.lanes(spark.createDataFrame(rows, "rec string, y long, mass double"), ["rec"], "y", "mass", taps=3, distance=10).collect()}
    assert got == {"r": lanes[:6] + [230] + lanes[6:], "s": [50, 90], "t": []}


def test_pulses_and_crossings(spark):
    rows = [(0, y) for y in range(0, 200)] + [(3, y) for y in range(20, 31)] + [(3, 40)] + [(5, y) for y in range(10, 21)]
    (got,) = traces.pulses(_points(spark, rows), ["rec"], "x", "y", 10.0).collect()
    assert (got.at, got.top, got.height) == (3, 20, 10)
    (none,) = traces.pulses(_points(spark, [(0, 1)]), ["rec"], "x", "y", 10.0).collect()
    assert none.at is None
    pts = spark.createDataFrame([("r", "a", 1.0, 5.0), ("r", "a", 2.0, 9.0), ("r", "a", 4.0, 9.0), ("r", "b", 1.0, 1.0), ("r", "b", 3.0, 2.0), ("r", "b", 9.0, 3.0), ("q", "a", 1.0, 1.0)], "rec string, s string, x double, y double")
    got = {r.rec: r for r in traces.crossing(pts, ["rec"], "s", "a", "b", "x", "y", 1.0).collect()}
    assert tuple(got["r"])[1:] == (2.0, 9.0, 2, 2, 1.0, 1.0, 8.0) and got["q"].second_at is None


def test_scale_falls_back(spark):
    keys = ["rec"]
    records = spark.createDataFrame([(r, 1000.0) for r in "abcd"], "rec string, width double")
    heights = spark.createDataFrame([("a", 80.0), ("a", 82.0), ("b", 70.0)], "rec string, height double")
    spacing = spark.createDataFrame([("b", 8, 9), ("c", 8, None)], "rec string, h int, v int")
    strips = spark.createDataFrame([("a", 0.0, 400.0), ("d", 0.0, 320.0)], "rec string, lo double, hi double")
    got = {r.rec: r for r in calibration.calibrated(records, heights, spacing, strips, keys).collect()}
    assert (got["a"].method, got["a"].px_per_mv) == ("calibration_pulse", 81.0) and abs(got["a"].confidence - (0.6 + 0.35 * (1 - 1 / 81))) < 1e-6
    assert (got["b"].method, got["b"].confidence) == ("calibration_pulse", 0.5)
    assert (got["c"].method, got["c"].px_per_mv, got["c"].px_per_sec) == ("grid_spacing", 80.0, 200.0)
    assert (got["d"].method, got["d"].px_per_mv, got["d"].px_per_sec) == ("estimated", 80.0, 100.0)
    wave = spark.createDataFrame([("w", k, math.sin(2 * math.pi * k / 12)) for k in range(240)] + [("f", k, 1.0) for k in range(60)], "rec string, i int, v double")
    assert {r.rec: r.period for r in calibration.periods(wave, keys, "i", "v").collect()} == {"w": 12, "f": None}
    step = spark.createDataFrame([("p", k, 5.0 if 10 <= k < 20 else 0.0, 10.0) for k in range(40)] + [("q", k, 0.0, 10.0) for k in range(40)], "rec string, i int, v double, extent double")
    (found,) = calibration.plateaus(step, keys, "i", "v", "extent", half=1).collect()
    assert found.rec == "p" and abs(found.height - 4.666666) < 0.35


def test_beats_by_magnitude(spark):
    rows = [("up", k, 10.0 if k in (5, 25, 45) else 0.5) for k in range(60)] + [("down", k, -10.0 if k in (7, 30) else 0.5) for k in range(60)] + [("flat", k, 1e-9 * k) for k in range(60)]
    df = spark.createDataFrame(rows, "rec string, i long, v double")
    assert {r.rec: r.kept for r in seq.threshold_peaks(df, ["rec"], "i", "v", refractory=3).collect()} == {"up": [5, 25, 45], "down": [7, 30]}


def test_long_islands_stream(spark, monkeypatch):
    r = random.Random(2)
    rows = sorted({(k, r.randint(0, 900)) for k in (1, 2) for _ in range(400)})
    df = spark.createDataFrame(rows, "k int, i int")
    kept = lambda: sorted(map(tuple, seq.spaced_rows(df, ["k"], "i", 5).collect()))
    merged = lambda: sorted((k, round(x, 9)) for k, x in seq.merged_close_rows(df, ["k"], "i", 3.0).collect())
    a, b = kept(), merged()
    monkeypatch.setattr(seq, "FOLD", 2)
    assert kept() == a and merged() == b
    for key in (1, 2):
        want, last = [], None
        for k, i in rows:
            if k == key and (last is None or i - last >= 5):
                want.append(i)
                last = i
        assert [i for k, i in a if k == key] == want


def test_rebuilt_beats_keep_their_height(spark):
    ref = [("r", k, 10.0 if k % 20 == 5 else (k % 7) / 7) for k in range(200)]
    df = spark.createDataFrame(ref, "rec string, i long, v double")
    same = validation.beat_distortion(df, df, ["rec"], "i", "v", 1.0, 4, 5, 5, 5).first()
    half = validation.beat_distortion(df.withColumn("v", F.col("v") / 2), df, ["rec"], "i", "v", 1.0, 4, 5, 5, 5).first()
    none = validation.beat_distortion(df.limit(8), df, ["rec"], "i", "v", 1.0, 4, 5, 5, 5).first()
    assert same.beats == 10 and same.wdd == 0.0 and abs(half.wdd - 100 * math.sqrt(0.125)) < 1e-9 and none.wdd is None


def test_noise_is_the_same_in_every_run(spark):
    df = spark.createDataFrame([(k, [0.0] * 200) for k in range(30)], "id long, x array<double>")
    levels = (("low", 0.1, 1.0), ("high", 1.0, 0.5))
    rows = lambda d: {(r.id, r.level): r.noised for r in validation.noised(d, "x", "id", levels, seed=3).collect()}
    a, b = rows(df), rows(df.repartition(7))
    assert a == b and a != {(r.id, r.level): r.noised for r in validation.noised(df, "x", "id", levels, seed=4).collect()}
    for level, sd, _ in levels:
        x = [v for (_, name), own in a.items() if name == level for v in own]
        assert abs(sum(x) / len(x)) < 0.05 * sd and abs(math.sqrt(sum(v * v for v in x) / len(x)) - sd) < 0.05 * sd


def test_rates_and_agreement(spark):
    rates = spark.createDataFrame([("r", "V2", 80.0), ("r", "II", 300.0), ("s", "I", 10.0)], "rec string, lead string, rate double")
    got = {r.rec: (r.lead, r.rate) for r in validation.chosen_rate(rates, ["rec"], "lead", "rate", ("II", "V2", "I")).collect()}
    assert got == {"r": ("V2", 80.0), "s": (None, None)}
    rows = spark.createDataFrame([(3.0, True), (8.0, False), (None, True), (20.0, None)], "e double, ok boolean")
    a = validation.agreement(rows, "e", "ok").first()
    assert (a.n, round(a.mae, 6), round(a.within_5, 6), round(a.within_10, 6), a.judged, a.consistent) == (3, 10.333333, 0.333333, 0.666667, 3, 2)


def test_groups_stay_together(spark):
    rows = [(f"g{k % 37}", k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(6)
    out = sampling.grouped_order(df, "g", ["k"], seed=1).orderBy("position").collect()
    assert [r.position for r in out] == list(range(500)) and len({r.slot for r in out}) == 37
    assert [r.slot for r in out] == sorted(r.slot for r in out)
    assert all(a.k < b.k for a, b in zip(out, out[1:]) if a.g == b.g)
    other = sampling.grouped_order(df, "g", ["k"], seed=1, epoch=1).orderBy("position").collect()
    assert [r.g for r in other] != [r.g for r in out]


def test_files_settle_over_batches(spark, tmp_path):
    """What a file's size was is carried from batch to batch; a file passes once for each size that stands."""
    folder = tmp_path / "in"
    folder.mkdir()
    batches = [[("a", 10, 0), ("b", 5, 0)], [("a", 20, 1), ("b", 5, 1)], [("a", 20, 2), ("b", 5, 9)], [("a", 20, 9), ("b", 6, 10)]]
    for k, rows in enumerate(batches):
        file = folder / f"{k}.json"
        file.write_text("\n".join(json.dumps({"path": p, "size": s, "seen": f"2024-01-01T00:00:{t:02d}.000Z"}) for p, s, t in rows))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # a stream takes files by age
    stream = ingest.watched(spark, str(folder), "path string, size long, seen timestamp", files_a_batch=1)
    found = ingest.settled(stream, "path", "size", "seen", 1.0)
    q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.path, r.size, r.ready_at.second) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 20, 2), ("b", 5, 1)]
