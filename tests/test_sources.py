"""Readers of each format, the router, sinks and streaming ingest on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import kernels
from tracewell.sources import records, sinks
from tracewell.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text("I,AVR,junk,V1\n0.12345,1,9,2\n,2,9,3\n")
    (d / "b.json").write_text(json.dumps({"fs": 250, "device": "d1", "leads": {"I": [0.1, 0.2], "AVR": [1, 2]}}))
    (d / "c.json").write_text(json.dumps({"leadI": [1, 2, 3], "leadAVR": [4, 5, 6], "patient_id": "p9"}))
    (d / "d.json").write_text(json.dumps({"channels": [{"name": "I", "data": [1, 2]}, {"name": "zz", "data": [3, 4]}]}))
    (d / "e.json").write_text(json.dumps({"channels": [{"name": "zz", "data": [3, 4]}]}))
    (d / "f.xml").write_text('<ECG xmlns="urn:x"><SampleRate>500</SampleRate><Patient><PatientID>p1</PatientID></Patient><lead name="I"><values>1 2 3</values></lead><lead name="II"><values>4 5 6</values></lead></ECG>')
    (d / "g.xml").write_text('<AnnotatedECG xmlns="urn:hl7-org:v3"><id extension="q7"/><sequence><code code="MDC_ECG_LEAD_I"/><value><scale value="0.005"/><digits>100 200</digits></value></sequence></AnnotatedECG>')
    (d / "h.hea").write_text("h 2 100 4\nh.dat 16 200/mV 16 0 0 0 0 I\nh.dat 16 200/mV 16 0 0 0 0 AVR\n")
    (d / "h.dat").write_bytes(np.array([[200, 400], [-32768, 400], [200, 0], [200, 0]], "<i2").tobytes())
    (d / "k.hea").write_text("k 1 100 4\nk.dat 16 200/mV 16 0 0 0 0 I\n")
    (d / "m.pdf").write_bytes(b"x")
    (d / ".hidden.csv").write_text("I\n1\n")
    return str(d)


def test_every_format(spark, folder):
    got = {(r.record_id, r.input_format): r for r in records.read_any(spark, folder).collect()}
    assert set(got) == {("a", "csv"), ("b", "json"), ("c", "json"), ("d", "json"), ("e", "json"), ("f", "xml"), ("g", "xml"), ("h", "wfdb"), ("k", "wfdb"), ("m", "pdf")}
    a = got["a", "csv"]
    assert a.leads == {"I": [pytest.approx(0.1234, abs=1.1e-4), 0.0], "aVR": [1.0, 2.0], "V1": [2.0, 3.0]}
    assert a.num_leads == 6 and a.y_max == pytest.approx(3.6) and a.duration_sec == pytest.approx(0.004)
    b = got["b", "json"]
    assert (b.sampling_rate, b.device_vendor, b.leads["aVR"]) == (250, "d1", [1.0, 2.0])
    assert got["c", "json"].patient_id == "p9" and got["c", "json"].leads["aVR"] == [4.0, 5.0, 6.0]
    assert set(got["d", "json"].leads) == {"I"}
    assert got["e", "json"].error and got["m", "pdf"].error and got["k", "wfdb"].error
    assert got["f", "xml"].leads["II"] == [4.0, 5.0, 6.0] and got["f", "xml"].patient_id == "p1"
    assert got["g", "xml"].leads["I"] == [0.5, 1.0] and got["g", "xml"].patient_id == "q7"
    h = got["h", "wfdb"]
    assert h.sampling_rate == 500 and len(h.leads["I"]) == 20 and h.leads["aVR"][0] == 2.0
    long = records.to_long(records.read_csv(spark, folder + "/a.csv")).where("lead = 'V1'").orderBy("i").collect()
    assert [(r.i, r.t_sec, r.mv, r.lead_idx) for r in long] == [(0, 0.0, 2.0, 6), (1, 0.002, 3.0, 6)]


def test_polylines(spark):
    rows = [("f", 0, p, k, float(k), float(p * 10 + (k == 300))) for p in range(6) for k in range(501)]
    rows += [("f", 0, 9, k, float(k), 0.0) for k in range(500)]
    rows += [("g", 0, p, k, float(k), float(p)) for p in range(7) for k in range(501)]
    points = spark.createDataFrame(rows, "file string, page int, path_id int, pos int, x double, y double")
    got = records.from_polylines(points, 1.0, 1.0, 1.0).orderBy("row").collect()
    assert {r.file for r in got} == {"f"} and [r.row for r in got] == list(range(6))
    assert all(len(r.signal) == 500 and r.signal[0] == 0.0 and min(r.signal) < -0.5 for r in got)
    assert records.pages_joined(records.from_polylines(points, 1.0, 1.0, 1.0)).count() == 6


def test_sinks(spark, folder, tmp_path):
    r = records.read_any(spark, folder)
    sinks.routed(r, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 7
    assert {x.record_id for x in spark.read.json(str(tmp_path / "bad")).collect()} == {"e", "k", "m"}
    sinks.write_by_lead_count(r.where("error is null").drop("error"), str(tmp_path / "docs"))
    assert {p.name for p in (tmp_path / "docs").iterdir() if p.is_dir()} == {"num_leads=6"}
    sinks.write_leads_csv(records.to_long(r.where("record_id = 'a'")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 6


def test_stream_is_the_batch(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"id": 10 * k + j, "v": "x" if j == 4 else str(j)}) for j in range(5)))

    def parse(df):
        n = F.col("v").try_cast("int")
        return df.select("id", n.alias("n"), F.when(n.isNull(), "not a number").alias("error"))

    stream = ingest.watched(spark, str(src), "id int, v string", files_a_batch=2)
    for _ in range(2):  # a second drain finds nothing new
        ingest.ingest(stream, parse, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp"), drain=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 12
    assert spark.read.json(str(tmp_path / "bad")).count() == 3


def test_windows_drop_late_rows(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"at": "2024-01-01T00:00:10Z", "k": 1, "v": 2}\n{"at": "2024-01-01T00:01:10Z", "k": 1, "v": 3}')
    stream = ingest.watched(spark, str(tmp_path / "s"), "at timestamp, k int, v int")
    q = ingest.windowed(stream, "at", ["k"], "v", "1 minute", "1 minute").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.total) for r in spark.table("win").orderBy("window").collect()] == [(1, 2), (1, 3)]


def test_kernels():
    assert kernels.peaks([0, 2, 2, 0]).tolist() == [1]
    assert kernels.peaks([0, 2, 0, 3, 0, 2, 0], distance=3).tolist() == [3]
    assert kernels.peaks([0, 2, 1.9, 3, 0], prominence=0.5).tolist() == [3]
    t = np.arange(2000) / 250
    x = np.sin(2 * np.pi * 5 * t)
    assert np.abs(kernels.zero_phase_high(x + 3, 250) - x)[900:-900].max() < 0.02
    assert np.allclose(kernels.fft_resampled(np.cos(2 * np.pi * np.arange(32) / 16), 64), np.cos(2 * np.pi * np.arange(64) / 32))
    assert kernels.cheapest_path([np.array([0.0, 5]), np.array([6.0, 1]), np.array([2.0, 9])]).tolist() == [0.0, 1.0, 2.0]
    assert kernels.cheapest_path([np.array([0.0]), np.array([1.0, 4]), np.array([2.0, 9])], 2).tolist() == [0.0, 1.0, 2.0]
    assert kernels.normalise_bands([(0, 10), (10, 11), (20, 30)], 2) == [(0, 10), (20, 30)]
    assert kernels.offset_match(np.array([0.0, 10, 20]), np.array([5.0, 15, 25])) == (5.0, [(0, 0), (1, 1), (2, 2)])


def test_kernel_columns(spark):
    df = spark.createDataFrame([([0.0, 2.0, 0.0, 3.0, 0.0],), (None,)], "x array<double>")
    assert [r.p for r in df.select(kernels.find_peaks(F.col("x")).alias("p")).collect()] == [[1, 3], None]
    c = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 6.0), ("a", 1, 1.0)], "k string, c int, v double")
    assert [r.y for r in kernels.tracked(c, ["k"], "c", "v").orderBy("c").collect()] == [0.0, 1.0]


def test_standard_waveforms(spark, tmp_path):
    rng = np.random.default_rng(0)
    t = np.arange(250) / 250
    wave = np.round(2000 * np.sin(2 * np.pi * 3 * t)).astype("<i2")
    full = rng.integers(-900, 900, (500, 12)).astype("<i2")
    line = lambda name, lead: f"{name}.dat 200.0/mV 200/mV 16 0 0 0 0 {lead}"
    (tmp_path / "a.hea").write_text("a 2 250 250\n" + "\n".join(line("a", x) for x in ("I", "AVR")) + "\n")
    (tmp_path / "a.dat").write_bytes(np.stack([wave, np.full(250, -32768, "<i2")], 1).tobytes())
    (tmp_path / "b.hea").write_text("b 12 500 500\n" + "\n".join(line("b", x) for x in records.LEADS) + "\n")
    (tmp_path / "b.dat").write_bytes(full.tobytes())
    for name, text, data in (("c", "c two 500\n", b""), ("d", "d 2 500\nd.dat 16 200 x I\n", b"1234"), ("e", "e 2 500 1\n" + line("e", "I") + "\n" + line("e", "II") + "\n", b"12"), ("f", "f 1 500 0\n" + line("f", "I") + "\n", b"")):
        (tmp_path / f"{name}.hea").write_text(text)
        (tmp_path / f"{name}.dat").write_bytes(data)
    got = {r.record_id: r for r in records.read_standard_waveforms(spark, str(tmp_path)).collect()}
    a, b = got["a"], got["b"]
    assert set(a.leads) == set(records.LEADS[:6]) and a.num_leads == 6 and a.sampling_rate == 500 and a.duration_sec == 1.0
    assert len(a.leads["I"]) == 500 and not any(a.leads["aVR"]) and not any(a.leads["II"])
    want = 10 * np.sin(2 * np.pi * 3 * np.arange(500) / 500)
    assert np.abs(np.array(a.leads["I"]) - want).max() < 0.01 and (a.y_min, a.y_max) == (-5.0, 5.0)
    assert b.num_leads == 12 and b.leads["V6"][:2] == [round(x / 200, 4) for x in full[:2, 11].tolist()]
    assert records.read_standard_waveforms(spark, str(tmp_path), six=True).where("record_id = 'b'").first().num_leads == 6
    assert all(got[k].error and got[k].leads is None for k in "cdef")
    plain = {r.record_id: r.error for r in records.read_waveforms(spark, str(tmp_path)).collect()}
    assert plain["a"] is None and all(plain[k] for k in "cde")
