"""Categories, defaults and text patterns of clinical records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate_category(hr: Column) -> Column:
    return F.when(hr.isNull(), "unknown").when(hr < 60, "bradycardia").when(hr > 100, "tachycardia").otherwise("normal")


def in_range(x: Column, lo: float, hi: float) -> Column:
    """False for null."""
    return F.coalesce(x.between(lo, hi), F.lit(False))


def age_years(birth: Column, on: Column) -> Column:
    """Completed years."""
    early = F.date_format(on, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(on) - F.year(birth) - early.cast("int")


def bmi(kg: Column, cm: Column) -> Column:
    return F.when(cm > 0, kg / ((cm / 100) * (cm / 100)))


def or_unknown(x: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("unknown"))


def role(x: Column) -> Column:
    """The role that a spelling stands for; PATIENT by default."""
    u = F.upper(F.trim(x))
    return F.when(u.isin("ADMIN", "ADMINISTRATOR"), "ADMIN").when(u.isin("NAKES", "DOCTOR", "NURSE", "STAFF"), "NAKES").otherwise("PATIENT")


def rhythm(dx: Column) -> Column:
    """category and the heart-rate range that goes with a diagnosis, null where none does; the first rule that fits wins."""
    t = F.lower(F.coalesce(dx, F.lit("")))
    made = lambda name, lo=None, hi=None: F.struct(F.lit(name).alias("category"), F.lit(lo).cast("int").alias("lo"), F.lit(hi).cast("int").alias("hi"))
    return (
        F.when(t.contains("brady"), made("brady", 0, 60))
        .when(t.contains("tachy"), made("tachy", 100, 250))
        .when(t.contains("lead off"), made("lead_off"))
        .when(t.contains("sinus") | t.contains("arrhythmia") | t.contains("rhythm"), made("sinus", 50, 110))
        .otherwise(made("other"))
    )


def consistent(hr: Column, lo: Column, hi: Column, slack: int = 8) -> Column:
    return hr.between(lo - slack, hi + slack)


def initials(name: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.slice(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


#: fixed values: file formats by extension
FORMATS = {"dat": "wfdb", "hea": "wfdb", "csv": "csv", "xml": "xml", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "bmp": "image", "tif": "image", "tiff": "image", "mat": "mat", "h5": "hdf5", "hdf5": "hdf5", "json": "json", "edf": "edf"}


def file_format(path: Column) -> Column:
    by_extension = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return F.coalesce(F.try_element_at(by_extension, extension(path)), F.lit("unknown"))


def expected_leads(path: Column) -> Column:
    """6 or 12 where a file's name says so; else null."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return F.when(name.rlike("12[-_ ]?lead|lead12"), 12).when(name.rlike("6[-_ ]?lead|lead6"), 6)


def stable_id(prefix: str, *keys: Column) -> Column:
    """A urn with ten hexadecimal digits that follow from the keys, so that reruns agree."""
    return F.concat(F.lit(f"urn:uuid:{prefix}-"), F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 10))


def notes(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws(" | ", *parts), r"^[ |]+|[ |]+$", "")


def matched(text: Column, *patterns: str) -> Column:
    """The first group of the first pattern that matches; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


#: fixed values: patterns of printed measurements
MEASUREMENTS = {
    "heart_rate_bpm": (r"(?i)HR\s*[:=]?\s*(\d{2,3})", r"(?i)(\d{2,3})\s*bpm"),
    "p_ms": (r"\bP\s*[:=]\s*(\d+)\s*ms",),
    "pr_ms": (r"\bPR\s*[:=]?\s*(\d+)\s*ms",),
    "qrs_ms": (r"\bQRS\s*[:=]?\s*(\d+)\s*ms",),
    "qt_ms": (r"\bQT/QTc\w*\s*[:=]?\s*(\d+)/\d+",),
    "qtc_ms": (r"\bQT/QTc\w*\s*[:=]?\s*\d+/(\d+)",),
    "rv5_mv": (r"RV5/SV1\s*[:=]?\s*([\d.]+)/",),
    "sv1_mv": (r"RV5/SV1\s*[:=]?\s*[\d.]+/([\d.]+)",),
}


def measurements(text: Column) -> Column:
    """A struct of the printed measurements found in a report's text, each null if absent."""
    kind = lambda k: "double" if k.endswith("_mv") else "int"
    return F.struct(*[matched(text, *p).try_cast(kind(k)).alias(k) for k, p in MEASUREMENTS.items()])


def sex(text: Column) -> Column:
    """'Female' holds no 'Male' with a capital, so the case-sensitive order is safe."""
    return F.when(text.contains("Male"), "M").when(text.contains("Female"), "F")
