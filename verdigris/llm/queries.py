"""The queries of this subpackage: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .exact_dedup import exact_dedup
from .fingerprints import fingerprints
from .mixing import mix
from .near_dedup import near_dedup
from .packing import pack
from .personal_data import personal_data
from .preferences import paired_conversations, preference_pairs
from .quality import classify
from .url_rules import filter_urls
from .warc import capture

#: The tokenizer of the packing query; a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_pairs(paired_conversations(table(spark, sf_dir, "conversations")))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture(table(spark, sf_dir, "pages"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_preference_format,
        op2_url_rules,
        op3_exact_dedup,
        op4_weighted_sampling,
        op5_minhash_near_dedup,
        op6_mixture_packing,
        op7_personal_data,
        op8_warc_index,
        op9_source_mixing,
        op10_quality,
    )
}
