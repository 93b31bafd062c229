"""The corpus pipeline: documents through five stages, each written as Parquet
and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontam, mixing, neardup, quality, tokenfiles
from tracewell.llm.common import saved, table
from tracewell.llm.queries import END_ID, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on their labelled ones, rejects go.

    Null and empty texts are judged as one passage without characters; rows that
    repeat stay or go together; without labels of both kinds all rows get one
    score. An empty table gives no rows. Columns stay as they are, whatever their names.
    """
    return quality.kept(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that of the least doc_id.

    Null and empty texts are one class; rows that repeat are one; a class without
    any doc_id keeps one row. An empty table gives no rows.
    """
    return neardup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    Null texts and texts without words stay, as does everything where there are no
    items; rows that repeat stay or go together. An empty table gives no rows.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document for each one that the mix takes words of, with the words it takes.

    Null and wordless texts have no words to take and go; a null source is a source
    of its own; rows that repeat are documents of their own. An empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what each document is in them.

    Null and empty texts have the end id alone; rows that repeat are documents of
    their own. An empty table gives no rows.
    """
    return tokenfiles.token_output(docs, tokenizer_path(), END_ID)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: SQL expresses neither the classifier nor the sketches
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written and read again; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
