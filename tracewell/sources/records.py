"""Readers that bring recordings of several formats to one record type.

Universal record: record_id, leads (map of lead name to millivolts, 4 decimals),
sampling_rate, duration_sec, num_leads, y_min, y_max, input_format,
device_vendor, patient_id, error. A file that can't be read gives a row with an
error instead of leads, so one bad file never stops a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import categories as C
from ..functions import signal as S

LEADS = ("I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6")
#: spellings of a lead's name beside its own: fixed forms of devices' exports
ALIASES = {lead: (lead, lead.upper(), f"lead_{lead}", f"lead{lead}", f"lead{lead.upper()}", f"lead{lead}_counts", *([f"C{lead[1:]}"] if lead.startswith("V") else [])) for lead in LEADS}
TARGET_RATE = 500
SCHEMA = "record_id string, leads map<string, array<double>>, sampling_rate int, duration_sec double, num_leads int, y_min double, y_max double, input_format string, device_vendor string, patient_id string, error string"


#: what a name must look like for each format; hidden and temporary files match none
GLOBS = {"csv": "[!.~]*.csv", "json": "[!.~]*.json", "xml": "[!.~]*.xml", "wfdb": "[!.~]*.{hea,dat}"}


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path and format of every file below a folder but hidden and temporary ones; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return found.where(~name.rlike(r"^[.~]|\.(tmp|part)$")).withColumn("format", C.file_format(F.col("path")))


def _texts(spark: SparkSession, path: str, fmt: str, name: str) -> DataFrame:
    """path and whole text of each file of a format at or below ``path``."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", GLOBS[fmt]).text(path, wholetext=True)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias(name))


def named(raw: Column) -> Column:
    """A map of raw names to arrays as one of canonical names; the first spelling that is there wins."""
    pick = lambda lead: F.coalesce(*[F.try_element_at(raw, F.lit(a)) for a in dict.fromkeys(ALIASES[lead])])
    entries = F.array(*[F.struct(F.lit(lead).alias("key"), pick(lead).alias("value")) for lead in LEADS])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def finished(df: DataFrame) -> DataFrame:
    """The universal record from path, leads (canonical, of raw values), fs, vendor, patient and format."""
    clean = F.transform_values("leads", lambda _, s: F.transform(s, lambda v: F.bround(F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v), 4)))
    samples = F.array_max(F.transform(F.map_values("leads"), F.size))
    most = F.array_max(F.transform(F.map_values("leads"), lambda s: F.array_max(F.transform(s, F.abs))))
    ok = F.col("leads").isNotNull() & (F.size("leads") > 0)
    df = df.withColumn("error", F.when(~F.coalesce(ok, F.lit(False)), "no known lead")).withColumn("leads", F.when(ok, clean))
    chest = F.forall(F.array(*map(F.lit, ("V1", "V2", "V3"))), lambda v: F.map_contains_key("leads", v))
    return df.select(
        C.stem(F.col("path")).alias("record_id"),
        "leads",
        F.col("fs").cast("int").alias("sampling_rate"),
        (samples / F.col("fs")).alias("duration_sec"),
        F.when(ok, F.when(chest, 12).otherwise(6)).alias("num_leads"),
        (-1.2 * most).alias("y_min"),
        (1.2 * most).alias("y_max"),
        F.col("format").alias("input_format"),
        F.coalesce("vendor", F.lit("unknown")).alias("device_vendor"),
        F.col("patient").alias("patient_id"),
        "error",
    )


def read_csv(spark: SparkSession, path: str, fs: int = TARGET_RATE, vendor: str = "generic") -> DataFrame:
    """One record a file: a header of lead names, a row a sample; empty cells are 0. Rows stay whole in a file's one partition."""
    lines = _texts(spark, path, "csv", "text").select("path", F.split(F.regexp_replace("text", r"\s+$", ""), r"\r?\n").alias("lines"))
    header = F.transform(F.split(F.col("lines")[0], ","), lambda h: F.trim(h))
    rows = F.transform(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda line: F.split(line, ","))
    df = lines.select("path", header.alias("header"), rows.alias("rows"))
    column = lambda k: F.transform("rows", lambda r: F.coalesce(F.get(r, k).try_cast("double"), F.lit(0.0)))
    raw = F.map_from_entries(F.transform("header", lambda h, k: F.struct(h.alias("key"), column(k).alias("value"))))
    df = df.select("path", named(raw).alias("leads"), F.lit(fs).alias("fs"), F.lit(vendor).alias("vendor"), F.lit(None).cast("string").alias("patient"), F.lit("csv").alias("format"))
    return finished(df)


_ARRAYS = "map<string, array<double>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One record a file, in any of three shapes: ``leads`` by name; arrays at the top, by lead; ``channels`` of name and data."""
    t = _texts(spark, path, "json", "doc")
    first = lambda *keys: F.coalesce(*[F.get_json_object("doc", f"$.{k}") for k in keys])
    shape_a = F.from_json(F.get_json_object("doc", "$.leads"), _ARRAYS)
    tops = [a for lead in LEADS for a in ALIASES[lead]]
    entries = F.array(*[F.struct(F.lit(a).alias("key"), F.from_json(F.get_json_object("doc", f"$.{a}"), "array<double>").alias("value")) for a in dict.fromkeys(tops)])
    shape_b = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    channels = F.from_json(F.get_json_object("doc", "$.channels"), "array<struct<name: string, data: array<double>>>")
    shape_c = F.map_from_entries(F.transform(channels, lambda c: F.struct(c["name"].alias("key"), c["data"].alias("value"))))
    raw = F.coalesce(shape_a, shape_c, shape_b)
    fs = F.coalesce(first("fs", "sampling_rate", "sample_rate", "frequency").try_cast("double"), F.lit(float(TARGET_RATE)))
    df = t.select("path", named(raw).alias("leads"), fs.alias("fs"), first("vendor", "device", "device_vendor").alias("vendor"), first("patient_id", "patient.id", "patientId").alias("patient"), F.lit("json").alias("format"))
    return finished(df)


def read_xml(spark: SparkSession, path: str, to_rate: int = TARGET_RATE) -> DataFrame:
    """One record a file: annotated ECG (sequence, digits, scale) or a generic list of leads; namespaces are dropped.

    Signals of another rate are resampled to ``to_rate`` along straight lines.
    """
    t = _texts(spark, path, "xml", "doc").withColumn("doc", F.regexp_replace("doc", r"\s+xmlns(:\w+)?=\"[^\"]*\"", ""))
    t = t.withColumn("doc", F.regexp_replace("doc", r"<(/?)\w+:", "<$1"))
    xs = lambda path: F.xpath("doc", F.lit(path))
    one = lambda *paths: F.coalesce(*[F.nullif(F.trim(F.xpath_string("doc", F.lit(p))), F.lit("")) for p in paths])
    # parts stand in document order, one of each for every sequence, so they are zipped
    gains = F.transform(xs("//sequence[code/@code][value/digits]/value/scale/@value"), lambda v: v.try_cast("double"))
    aecg = F.zip_with(xs("//sequence[code/@code][value/digits]/code/@code"), xs("//sequence[code/@code][value/digits]/value/digits/text()"), lambda n, d: F.struct(n.alias("key"), d.alias("value")))
    gain = F.coalesce(F.try_element_at(gains, F.lit(1)), F.lit(1.0 / 1000))
    aecg = F.transform(aecg, lambda e: F.struct(F.regexp_replace(e["key"], "^.*LEAD_", "").alias("key"), F.transform(S.split_numbers(e["value"]), lambda v: v * gain).alias("value")))
    generic = F.zip_with(F.concat(xs("//lead[values]/@name"), xs("//LeadData/LeadID/text()")), F.concat(xs("//lead[values]/values/text()"), xs("//LeadData/WaveFormData/text()")), lambda n, d: F.struct(F.trim(n).alias("key"), S.split_numbers(F.translate(d, ",;", "  ")).alias("value")))
    raw = F.map_from_entries(F.when(F.size(aecg) > 0, aecg).otherwise(generic))
    fs = F.coalesce(one("//frequencyValue/@value", "//SampleRate/text()", "//SamplingRate/text()").try_cast("double"), F.lit(float(to_rate)))
    df = t.select("path", named(raw).alias("leads"), fs.alias("fs"), one("//manufacturerModelName/text()", "//Device/text()").alias("vendor"), one("//PatientID/text()", "//patientID/text()", "//id/@extension").alias("patient"), F.lit("xml").alias("format"))
    return finished(resampled(df, to_rate))


def resampled(df: DataFrame, to_rate: int) -> DataFrame:
    """Leads at ``to_rate``, as many samples as the duration holds, along straight lines."""

    def at_rate(s: Column) -> Column:
        def on(x: Column) -> Column:
            n = F.greatest(F.round(F.size(x) * F.lit(float(to_rate)) / F.col("fs")).cast("int"), F.lit(1))
            step = (F.size(x) - 1) / F.greatest(n - 1, F.lit(1)).cast("double")
            low = lambda i: F.least(F.floor(i * step).cast("int"), F.greatest(F.size(x) - 2, F.lit(0)))
            line = lambda i, k: F.get(x, k) + (F.coalesce(F.get(x, k + 1), F.get(x, k)) - F.get(x, k)) * (i * step - k)
            return F.transform(F.sequence(F.lit(0), n - 1), lambda i: line(i, low(i)))

        return F.when((F.size(s) > 0) & (F.col("fs") != to_rate), S.let(s, on)).otherwise(s)

    df = df.withColumn("leads", F.transform_values("leads", lambda _, s: at_rate(s)))
    return df.withColumn("fs", F.lit(to_rate))


def read_any(spark: SparkSession, folder: str) -> DataFrame:
    """Records of every file below a folder, by format; formats without a reader give an error row."""
    readers = {"csv": read_csv, "json": read_json, "xml": read_xml, "wfdb": read_waveforms}
    out = spark.createDataFrame([], SCHEMA)
    for reader in readers.values():
        out = out.unionByName(reader(spark, folder))
    rest = files(spark, folder).where(~F.col("format").isin(*readers))
    failed = rest.select(C.stem(F.col("path")).alias("record_id"), F.col("format").alias("input_format"), F.concat(F.lit("no reader for "), "format").alias("error"))
    return out.unionByName(failed, allowMissingColumns=True)


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    """base, head and data of each pair of a header and a sample file of one stem; null where one is missing."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOBS["wfdb"]).load(path).select("path", "content")
    both = found.withColumn("kind", C.extension(F.col("path"))).withColumn("base", F.regexp_replace("path", r"\.[^.]*$", ""))
    return both.groupBy("base").agg(F.max(F.when(F.col("kind") == "hea", F.col("content"))).alias("head"), F.max(F.when(F.col("kind") == "dat", F.col("content"))).alias("data"))


def _samples(head: bytes, data: bytes):
    """Names, rate and millivolts (a row for each time, NaN where missing) that a header and its 16-bit samples hold; ValueError if they don't fit."""
    import numpy as np

    lines = [line.split() for line in bytes(head).decode("latin-1").splitlines() if line.strip() and line[0] != "#"]
    try:
        n, fs = int(lines[0][1]), float(lines[0][2].split("/")[0])
        own = lines[1 : n + 1]
        gain = np.array([float(x[2].split("/")[0].split("(")[0]) or 200.0 for x in own])
        names = [x[-1] for x in own]
    except (IndexError, ValueError) as e:
        raise ValueError(f"header: {e}") from e
    if len(own) != n or n < 1 or not fs > 0:
        raise ValueError("header: signals are missing")
    raw = np.frombuffer(data, "<i2")
    if len(raw) % n:
        raise ValueError("samples: not a whole number of rows")
    values = raw.reshape(-1, n).astype(float)
    values[values == -32768] = np.nan  # the format's mark of a missing sample
    return names, fs, values / gain


def read_waveforms(spark: SparkSession, path: str, to_rate: int = TARGET_RATE) -> DataFrame:
    """One record for each pair of a header and 16-bit sample file of one stem; a header without samples, or one that doesn't fit them, gives an error row."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = []
            for base, head, data in zip(frame["base"], frame["head"], frame["data"], strict=True):
                leads, fs = None, float(to_rate)
                if head is not None and data is not None:
                    try:
                        names, fs, values = _samples(head, data)
                        leads = {name: values[:, k].tolist() for k, name in enumerate(names)}
                    except ValueError:
                        pass
                rows.append((f"{base}.hea", leads, fs))
            yield pd.DataFrame(rows, columns=["path", "raw", "fs"])

    df = _pairs(spark, path).mapInPandas(run, f"path string, raw {_ARRAYS}, fs double")
    df = df.select("path", named(F.col("raw")).alias("leads"), "fs", F.lit(None).cast("string").alias("vendor"), F.lit(None).cast("string").alias("patient"), F.lit("wfdb").alias("format"))
    return finished(resampled(df, to_rate))


def read_standard_waveforms(spark: SparkSession, path: str, six: bool = False, to_rate: int = TARGET_RATE) -> DataFrame:
    """Records of waveform pairs in the standard form: 12 leads if all are there (and ``six`` isn't asked for), else the six
    of the limbs; leads that are missing are zeros, and so are missing samples.

    Other rates are resampled band-limited (FFT) to ``to_rate``. y_min and y_max are
    1.2 times the least and largest value, within -5 and 5. A pair that can't be read gives a row with its error.
    """
    import numpy as np
    import pandas as pd

    from ..operators.kernels import fft_resampled

    spelled = {a: lead for lead in LEADS for a in (*ALIASES[lead], lead.lower())}

    def record(base: str, head, data) -> tuple:
        stem = base.rsplit("/", 1)[-1]
        failed = lambda why: (stem, None, None, None, None, None, None, "wfdb", "unknown", None, why)
        if head is None or data is None:
            return failed("header or samples missing")
        try:
            names, fs, values = _samples(head, data)
        except ValueError as e:
            return failed(str(e))
        if not len(values):
            return failed("samples: none")
        have = {}
        for k, name in enumerate(names):
            have.setdefault(spelled.get(name, name), np.nan_to_num(values[:, k]))
        wanted = LEADS if not six and set(LEADS) <= set(have) else LEADS[:6]
        n = len(values) if fs == to_rate else int(len(values) * to_rate / fs)
        leads = {}
        for lead in wanted:
            x = have.get(lead, np.zeros(len(values)))
            leads[lead] = np.round(x if fs == to_rate else fft_resampled(x, n), 4).tolist()
        lo, hi = min(map(min, leads.values())), max(map(max, leads.values()))
        return (stem, leads, to_rate, len(values) / fs, len(wanted), max(-5.0, 1.2 * lo), min(5.0, 1.2 * hi), "wfdb", "unknown", None, None)

    def run(frames):
        for frame in frames:
            rows = [record(*x) for x in zip(frame["base"], frame["head"], frame["data"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in SCHEMA.replace("map<string, array<double>>", "map").split(",")]).astype({"sampling_rate": "Int32", "num_leads": "Int32"})

    return _pairs(spark, path).mapInPandas(run, SCHEMA)


def to_long(records: DataFrame) -> DataFrame:
    """record_id, lead, lead_idx, i, t_sec, mv: a row for each sample."""
    index = F.create_map(*(x for k, lead in enumerate(LEADS) for x in (F.lit(lead), F.lit(k))))
    each = records.select("record_id", "sampling_rate", F.explode("leads").alias("lead", "signal"))
    each = each.select("record_id", "sampling_rate", "lead", F.posexplode("signal").alias("i", "mv"))
    return each.select("record_id", "lead", index[F.col("lead")].alias("lead_idx"), "i", (F.col("i") / F.col("sampling_rate")).alias("t_sec"), "mv")


def from_polylines(points: DataFrame, fs: float, pt_per_sec: float, pt_per_mv: float, least_points: int = 500) -> DataFrame:
    """Signals of drawn paths (file, page, path_id, pos, x, y): file, page, row (top to bottom from 0) and signal.

    Paths of ``least_points`` or fewer are no traces; pages of other than 6 or 12
    traces are left out. Points are taken in order of x, the first of each x; the
    baseline is the median of y; the time grid has round(width / pt_per_sec * fs)
    points on straight lines.
    """
    from pyspark.sql import Window as W

    path = W.partitionBy("file", "page", "path_id")
    p = points.withColumn("n", F.count("*").over(path)).where(F.col("n") > least_points)
    p = p.withColumn("base", F.median("y").over(path))
    p = p.withColumn("k", F.row_number().over(W.partitionBy("file", "page", "path_id", "x").orderBy("pos"))).where("k = 1")
    g = p.groupBy("file", "page", "path_id").agg(F.max("base").alias("base"), F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))
    page = W.partitionBy("file", "page")
    g = g.withColumn("traces", F.count("*").over(page)).where(F.col("traces").isin(6, 12))
    g = g.withColumn("row", F.row_number().over(page.orderBy("base", "path_id")) - 1)
    at = lambda k: F.get("points", k)
    width = F.col("points")[F.size("points") - 1]["x"] - F.col("points")[0]["x"]
    g = g.withColumn("n", F.greatest(F.lit(1), F.round(width / pt_per_sec * fs).cast("int"))).withColumn("width", width)
    step = F.col("width") / F.greatest(F.col("n") - 1, F.lit(1))
    # both the grid and the points go by x: each grid point looks up the last point at or before it
    grid = g.select("file", "page", "row", "base", "points", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("points")[0]["x"] + i * step)).alias("i", "gx"))
    low = F.greatest(F.lit(0), F.least(F.size(F.filter("points", lambda q: q["x"] <= F.col("gx"))) - 1, F.size("points") - 2))
    grid = grid.withColumn("low", low)
    a, b = at(F.col("low")), at(F.col("low") + 1)
    y = F.when(b.isNull(), a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (F.col("gx") - a["x"]) / (b["x"] - a["x"]))
    mv = F.bround((F.col("base") - y) / pt_per_mv, 4)
    made = grid.withColumn("mv", mv).groupBy("file", "page", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mv"))), lambda s: s["mv"]).alias("signal"))
    return made


def pages_joined(traces: DataFrame) -> DataFrame:
    """Each file's rows of 6 traces end to end over its pages in order."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "signal")))
    return traces.groupBy("file", "row").agg(F.flatten(F.transform(ordered, lambda s: s["signal"])).alias("signal"))
