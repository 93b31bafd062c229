"""Micro cases with answers by hand."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tracewell.functions import categories as C
from tracewell.functions import documents as D
from tracewell.functions import signal as S
from tracewell.operators import metrics, quality
from tracewell.operators import sequence as seq
from tracewell.operators import warehouse as wh


def series(spark, values, key=0):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "k int, i int, v double")


def one(spark, column, **arrays):
    row = spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{n} array<double>" for n in arrays))
    return row.select(column.alias("out")).first().out


def test_resample(spark):
    ramp = [float(i) for i in range(10)]
    assert one(spark, S.resampled(F.col("x"), 10), x=ramp) == ramp
    assert one(spark, S.resampled(F.col("x"), 19), x=ramp) == [i / 2 for i in range(19)]
    assert one(spark, S.resampled(F.col("x"), 4), x=[]) is None
    assert one(spark, S.resampled(F.col("x"), 3), x=[7.0]) == [7.0, 7.0, 7.0]


def test_array_statistics(spark):
    assert one(spark, S.median(F.col("x")), x=[3.0, 1.0, 2.0, 10.0]) == 2.5
    assert one(spark, S.std_pop(F.col("x")), x=[1.0, 3.0]) == 1.0
    assert one(spark, S.centered(F.col("x")), x=[1.0, 2.0, 4.0]) == [-1.0, 0.0, 2.0]
    assert one(spark, S.padded(F.col("x"), 3), x=[]) == [0.0, 0.0, 0.0]
    assert one(spark, S.linspace(0.0, 1.0, 3), x=[]) == [0.0, 0.5, 1.0]
    assert len(one(spark, S.synthetic(100, 60.0), x=[])) == 100
    assert one(spark, S.joined(F.col("x")), x=[1.0, 0.25]) == "1.0000 0.2500"


def test_peaks_by_distance(spark):
    p = seq.local_peaks(series(spark, [0, 2, 0, 3, 0, 2, 0]), ["k"], ["i"], "v")
    assert [r.i for r in p.orderBy("i").collect()] == [1, 3, 5]
    assert seq.spaced(p, ["k"], "i", 3).first().kept == [1, 5]
    assert seq.local_peaks(series(spark, [0, 2, 2, 0]), ["k"], ["i"], "v").count() == 0


def test_runs(spark):
    df = series(spark, [1, 1, 0, 1, 0, 0, 1, 1, 1])
    got = seq.runs(df, ["k"], "i", F.col("v") == 1, merge_gap=1).orderBy("start").collect()
    assert [(r.start, r.stop) for r in got] == [(0, 4), (6, 9)]


def test_fills(spark):
    df = series(spark, [None, 1.0, None, 3.0, None])
    assert [r.filled for r in seq.lerp_fill(df, ["k"], "i", "v").orderBy("i").collect()] == [1, 1, 2, 3, 3]
    assert [r.filled for r in seq.forward_fill(df, ["k"], ["i"], "v").orderBy("i").collect()] == [None, 1, 1, 3, 3]


def test_folds(spark):
    df = series(spark, [1.0, 1.5, 5.0, 9.0])
    assert seq.merged_close(df, ["k"], "v", 1.0).first().merged == [1.25, 5.0, 9.0]
    arrays = spark.createDataFrame([([0.0, 10.0, None],)], "y array<double>")
    assert seq.momentum_track(arrays, "y").first().tracked == pytest.approx([0.0, 10.0, 14.0])


def test_lead_laws(spark):
    i, ii = [float(k) for k in range(1, 7)], [2.0 * k for k in range(1, 7)]
    made = {"I": i, "II": ii, "III": [b - a for a, b in zip(i, ii)], "aVR": [-(a + b) / 2 for a, b in zip(i, ii)], "aVL": [a - b / 2 for a, b in zip(i, ii)], "aVF": [b - a / 2 for a, b in zip(i, ii)]}
    rows = [made, {**made, "aVF": [v + 1 for v in made["aVF"]]}, {**made, "aVL": None}, {k: v[:5] for k, v in made.items()}]
    df = spark.createDataFrame([tuple(r[k] for k in made) for r in rows], ", ".join(f"{k} array<double>" for k in made))
    got = quality.lead_laws(df, {k: k for k in made}).select("worst", "status").collect()
    assert [r.status for r in got] == ["OK", "REVIEW", "skip", "skip"]
    assert got[0].worst == 0 and got[1].worst == pytest.approx(1.0)


def test_fidelity_identities(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [1.0, 2.0, 4.0]), ([2.0, 2.0], [2.0, 2.0]), ([1.0, 2.0, 4.0], [1.0, 2.5, 3.5])], "a array<double>, b array<double>")
    same, flat, off = metrics.fidelity(df, "a", "b").collect()
    assert same.prd == 0 and same.r == pytest.approx(1.0) and flat.r == 1.0
    assert off.snr == pytest.approx(-20 * math.log10(off.prd / 100), abs=1e-6)


def test_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert metrics.auc(df, "s", "y").first().auc == 0.75
    assert metrics.auc(df.where("y = 1"), "s", "y").first().auc is None


def test_verified(spark):
    leads = {k: [0.0] * 50 for k in quality.LIMB}
    rows = [(leads, 500, 0.1, 6), ({"I": [float("nan")]}, 500, 0.1, 6), (leads, 333, 1.0, 6), (None, None, None, None)]
    df = spark.createDataFrame(rows, "leads map<string, array<double>>, sampling_rate int, duration_sec double, num_leads int")
    assert [r.status for r in quality.verified(df).collect()] == ["OK", "FAIL", "WARN", "FAIL"]


def test_categories(spark):
    df = spark.createDataFrame([("HR: 72 bpm PR 160 ms QRS 90 ms QT/QTc 380/410 RV5/SV1 1.20/0.80 ID 1 Male Sinus rhythm",), ("Female, HR=130 Sinus tachycardia",), (None,)], "t string")
    m = df.select(C.measurements(F.col("t")).alias("m"), C.sex(F.col("t")).alias("sex"), C.rhythm(F.col("t")).alias("r")).collect()
    assert (m[0].m.heart_rate_bpm, m[0].m.pr_ms, m[0].m.qtc_ms, m[0].m.sv1_mv, m[0].sex) == (72, 160, 410, 0.8, "M")
    assert m[1].sex == "F" and m[1].r.category == "tachy" and tuple(m[0].r) == ("sinus", 50, 110) and tuple(m[2].r) == ("other", None, None) and m[2].m.heart_rate_bpm is None
    d = spark.createDataFrame([("/a/b/rec_12lead.CSV", "  Ada  Byron King", datetime.date(2000, 6, 16))], "p string, n string, d date")
    r = d.select(C.stem(F.col("p")), C.file_format(F.col("p")), C.expected_leads(F.col("p")), C.initials(F.col("n")), C.age_years(F.col("d"), F.lit("2024-06-15").cast("date"))).first()
    assert tuple(r) == ("rec_12lead", "csv", 12, "AB", 23)


def test_documents(spark):
    rec = spark.createDataFrame([("r1", {"I": [0.1, 0.2], "X": [0.0, 0.0]}, 500, 0.004, 6, "csv", None, None, 61, ["I"])], "record_id string, leads map<string, array<double>>, sampling_rate int, duration_sec double, num_leads int, input_format string, device_vendor string, patient_id string, hr int, low array<string>")
    p = D.processed(rec).first()
    assert p.quality.flat_leads == ["X"] and p.quality.missing_leads == ["II", "III", "aVR", "aVL", "aVF"]
    o = {r.lead: r.resource for r in D.observations(rec, "low").collect()}
    assert o["I"].status == "preliminary" and o["X"].status == "final" and o["X"].code.code == "lead-X"
    assert o["I"].valueSampledData.period == 2.0 and o["I"].valueSampledData.data == "0.1000 0.2000"
    text = spark.createDataFrame([(1, "HR: 72 PR 160 ms")], "id int, t string")
    assert {(r.name, r.value) for r in D.measured(text, "id", "t").collect()} == {("heart_rate_bpm", 72.0), ("pr_ms", 160.0)}


def test_split_and_sample_agree_with_themselves(spark):
    df = spark.range(1000)
    a = wh.split(df, "id", 0.15).where("part = 'val'").count()
    assert 100 < a < 200
    assert wh.sampled(df, "id", 10, 3).collect() == wh.sampled(df.repartition(7), "id", 10, 3).collect()
