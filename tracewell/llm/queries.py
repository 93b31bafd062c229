"""The queries of this subpackage: each operator on its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .oracles import mix_sql, ranked_sql, spelling_sql, topk_sql, url_sql

#: production parameters
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SCAN_END_ID = 65_535  # no id of the tokenizer, so that no text holds it


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of the contract is named; a verdict of the pattern rules is the method's, with no rule named."""
    from .urlfilter import CONTRACT_RULES, PATTERN_RULES, judge

    judged = judge(table(spark, sf_dir, "pages"), CONTRACT_RULES + PATTERN_RULES)
    named = F.when(F.col("rank") == 1, F.col("rule"))
    return judged.select("page_id", "host", "path", named.alias("rule"), "verdict")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import licenses

    found = licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sepscan import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), SCAN_END_ID)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import languages

    return languages(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_decontamination,
        op3_exact_topk,
        op4_token_output,
        op5_source_mixing,
        op6_near_duplicates,
        op7_url_filter,
        op8_licenses,
        op9_quality,
        op10_token_counts,
        op11_language_id,
        op12_lexical_search,
        op13_spelling_variants,
    )
}

ORACLES: dict[str, str] = {
    "op3_exact_topk": topk_sql(),
    "op5_source_mixing": mix_sql(),
    "op7_url_filter": url_sql(),
    "op12_lexical_search": ranked_sql(),
    "op13_spelling_variants": spelling_sql(),
}
