"""Nested clinical documents as struct columns: processed records and FHIR-like bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import categories as C
from . import signal as S

LIMB = ("I", "II", "III", "aVR", "aVL", "aVF")
#: fixed values: system and codes of leads in a clinical vocabulary
LEAD_SYSTEM = "urn:oid:2.16.840.1.113883.6.24"
LEAD_CODES = {"I": "131329", "II": "131330", "III": "131389", "aVR": "131390", "aVL": "131391", "aVF": "131392", "V1": "131331", "V2": "131332", "V3": "131333", "V4": "131334", "V5": "131335", "V6": "131336"}


def limb_only(leads: Column) -> Column:
    return F.map_filter(leads, lambda k, _: k.isin(*LIMB))


def processed(records: DataFrame) -> DataFrame:
    """A document for each universal record: patient, recording, leads with units, quality with flat and missing leads."""
    leads = F.transform_values("leads", lambda _, s: F.struct(F.lit("mV").alias("units"), F.transform(s, lambda v: F.bround(v, 4)).alias("signal")))
    flat = F.map_keys(F.map_filter("leads", lambda _, s: S.std_pop(s) < 1e-4))
    expected = F.when(F.col("num_leads") == 12, F.array(*map(F.lit, LEAD_CODES))).otherwise(F.array(*map(F.lit, LIMB)))
    return records.select(
        "record_id",
        F.struct(F.col("patient_id").alias("id")).alias("patient"),
        F.struct("sampling_rate", "duration_sec", "num_leads", "input_format", "device_vendor").alias("recording"),
        leads.alias("leads"),
        F.struct(F.array_sort(flat).alias("flat_leads"), F.array_except(expected, F.map_keys("leads")).alias("missing_leads")).alias("quality"),
    )


def processed_v1(records: DataFrame, low: str, digital: str, printed: str) -> DataFrame:
    """record_id and document, the first version of a processed record: leads with their confidence, and the measured heart rate beside the printed one.

    ``low`` is an array of the leads of low confidence, ``digital`` and ``printed`` are rates, null where unknown.
    """
    sure = lambda lead: F.when(F.array_contains(low, lead), "low").otherwise("high")
    leads = F.transform_values("leads", lambda k, s: F.struct(F.lit("mV").alias("units"), sure(k).alias("confidence"), F.transform(s, lambda v: F.bround(v, 4)).alias("signal")))
    expected = F.when(F.col("num_leads") == 12, F.array(*map(F.lit, LEAD_CODES))).otherwise(F.array(*map(F.lit, LIMB)))
    apart = F.bround(F.abs(F.col(digital) - F.col(printed)), 1)
    recording = F.struct("sampling_rate", "duration_sec", F.size(F.element_at(F.map_values("leads"), 1)).alias("n_samples"), F.size("leads").alias("lead_count"), F.lit("mV").alias("units"))
    quality = F.struct(
        F.array_sort(low).alias("low_confidence_leads"),
        F.array_except(expected, F.map_keys("leads")).alias("missing_leads"),
        F.struct(F.col(digital).alias("digital_bpm"), F.col(printed).alias("printed_bpm"), apart.alias("abs_diff_bpm")).alias("hr_crosscheck"),
    )
    document = F.struct(F.lit("processed-ecg/v1").alias("schema"), F.struct(F.col("patient_id").alias("id")).alias("patient"), recording.alias("recording"), leads.alias("leads"), quality.alias("quality"))
    return records.select("record_id", document.alias("document"))


def sampled_data(signal: Column, fs: Column) -> Column:
    return F.struct(F.lit(0.0).alias("origin"), (F.lit(1000.0) / fs).alias("period"), F.lit(1).alias("dimensions"), S.joined(signal).alias("data"))


def lead_code(lead: Column) -> Column:
    codes = F.create_map(*(F.lit(x) for pair in LEAD_CODES.items() for x in pair))
    code = F.try_element_at(codes, lead)
    return F.struct(F.when(code.isNotNull(), LEAD_SYSTEM).otherwise("urn:provisional").alias("system"), F.coalesce(code, F.concat(F.lit("lead-"), lead)).alias("code"), lead.alias("display"))


def observation(lead: Column, signal: Column, fs: Column, doubted: Column) -> Column:
    return F.struct(
        F.lit("Observation").alias("resourceType"),
        F.when(doubted, "preliminary").otherwise("final").alias("status"),
        lead_code(lead).alias("code"),
        sampled_data(signal, fs).alias("valueSampledData"),
        F.when(doubted, "low confidence").alias("note"),
    )


def observations(records: DataFrame, low: str | None = None) -> DataFrame:
    """A row for each lead of each record; leads named in the array column ``low`` are preliminary, with a note."""
    extra = [low] if low else []
    each = records.select("record_id", "sampling_rate", *extra, F.explode("leads").alias("lead", "signal"))
    doubted = F.coalesce(F.array_contains(low, F.col("lead")), F.lit(False)) if low else F.lit(False)
    return each.select(
        "record_id",
        "lead",
        C.stable_id("obs", F.col("record_id"), F.col("lead")).alias("full_url"),
        observation(F.col("lead"), F.col("signal"), F.col("sampling_rate"), doubted).alias("resource"),
    )


def measured(reports: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row for each printed measurement that a report's text holds."""
    m = reports.select(id_col, C.measurements(F.col(text)).alias("m")).select(id_col, *[F.col(f"m.{k}").cast("double").alias(k) for k in C.MEASUREMENTS])
    return m.unpivot([id_col], list(C.MEASUREMENTS), "name", "value").where("value is not null")


def bundles(records: DataFrame, stamp: Column, hr: str | None = None) -> DataFrame:
    """A bundle for each record: report, patient, device, leads, heart rate, in that order; the report refers to its observations. A record's bundle is made where the record is."""
    rid = F.col("record_id")
    order = F.create_map(*(F.lit(x) for k, lead in enumerate(LEAD_CODES) for x in (lead, k)))
    entry = lambda n, url, body: F.struct(n.alias("n"), url.alias("fullUrl"), F.to_json(body, {"ignoreNullFields": "true"}).alias("resource"))
    url_of = lambda lead: C.stable_id("obs", rid, lead)
    of_lead = lambda e: entry(F.lit(10) + F.try_element_at(order, e["key"]), url_of(e["key"]), observation(e["key"], e["value"], F.col("sampling_rate"), F.lit(False)))
    none = F.array().cast("array<string>")
    refs = F.array_sort(F.coalesce(F.transform(F.map_keys("leads"), url_of), none))
    report = F.struct(F.lit("DiagnosticReport").alias("resourceType"), F.lit("final").alias("status"), stamp.alias("issued"), F.transform(refs, lambda r: F.struct(r.alias("reference"))).alias("result"))
    patient = F.struct(F.lit("Patient").alias("resourceType"), C.or_unknown(F.col("patient_id")).alias("id"))
    device = F.struct(F.lit("Device").alias("resourceType"), C.or_unknown(F.col("device_vendor")).alias("manufacturer"))
    rows = [entry(F.lit(0), C.stable_id("rep", rid), report), entry(F.lit(1), C.stable_id("pat", rid), patient), entry(F.lit(2), C.stable_id("dev", rid), device)]
    if hr:
        rate = F.struct(F.lit("Observation").alias("resourceType"), F.lit("final").alias("status"), F.lit("8867-4").alias("code"), F.col(hr).alias("value"))
        rows.append(F.when(F.col(hr).isNotNull(), entry(F.lit(90), C.stable_id("hr", rid), rate)))
    heads = F.array_compact(F.array(*rows))
    every = F.concat(heads, F.coalesce(F.transform(F.map_entries("leads"), of_lead), F.slice(heads, 1, 0)))
    entries = F.transform(F.array_sort(every), lambda e: F.struct(e["fullUrl"], e["resource"]))
    return records.select("record_id", F.lit("Bundle").alias("resourceType"), F.lit("transaction").alias("type"), entries.alias("entry"))


def analysis(df: DataFrame, printed: str, digital: str, diagnosis: str) -> DataFrame:
    """heart_rate (the printed one first) and a conclusion's text."""
    hr = F.coalesce(F.col(printed), F.round(F.col(digital)).cast("int"))
    text = C.notes(F.col(diagnosis), F.when(hr.isNotNull(), F.concat(F.lit("HR "), hr, F.lit(" bpm"))), C.rate_category(hr))
    return df.withColumn("heart_rate", hr).withColumn("conclusion", text)
