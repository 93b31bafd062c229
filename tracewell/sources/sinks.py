"""Writers of records and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(docs: DataFrame, path: str, partition_by: str | None = None, mode: str = "error") -> None:
    """One JSON document a row, without null fields; in a folder for each value of ``partition_by``."""
    keep = [partition_by] if partition_by else []
    out = docs.select(*keep, F.to_json(F.struct(*[c for c in docs.columns if c not in keep]), {"ignoreNullFields": "true"}).alias("value"))
    w = out.write.mode(mode)
    (w.partitionBy(*keep) if keep else w).text(path)


def write_by_lead_count(records: DataFrame, path: str, mode: str = "error") -> None:
    """Folders num_leads=6 and num_leads=12."""
    write_documents(records, path, "num_leads", mode)


def write_leads_csv(long: DataFrame, path: str, mode: str = "error") -> None:
    """t_sec and mV, to 4 decimals, in a folder for each record and lead."""
    out = long.select("record_id", "lead", F.format_string("%.4f", F.col("t_sec")).alias("t_sec"), F.format_string("%.4f", F.col("mv")).alias("mV"))
    out.repartition("record_id", "lead").sortWithinPartitions("record_id", "lead", F.col("t_sec").cast("double")).write.mode(mode).option("header", True).partitionBy("record_id", "lead").csv(path)


def routed(records: DataFrame, ok_path: str, error_path: str, mode: str = "append") -> None:
    """Good records to one folder; those with an error, and its text, to another."""
    records.where("error is null").drop("error").write.mode(mode).parquet(ok_path)
    records.where("error is not null").select("record_id", "input_format", "error").write.mode(mode).json(error_path)
