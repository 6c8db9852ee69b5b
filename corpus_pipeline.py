"""From documents to packed sequences: quality, exact copies, near copies, mixture, packing.

Each stage reads what the one before wrote and works on all of it. All but the last return the columns of documents, whatever further ones the table has and however they are named.

In every stage a null text counts as an empty one, texts have no upper length, an empty table gives an empty one, and rows that share a doc_id or have none are judged row by row. What comes of empty texts and of ties is said with the stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import removed, scratch, table, text_or_empty
from verdigris.llm.exact_dedup import exact_dedup
from verdigris.llm.mixing import mixed_documents
from verdigris.llm.near_dedup import near_dedup
from verdigris.llm.packing import pack
from verdigris.llm.quality import accepted

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; those at the threshold stay. Empty texts have the score of the intercept, and repeated rows the same one. Without a label for any of the documents every score is 1/2, which is below the threshold, so all go."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def _one_of_each(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], group: str, order: list[Column]) -> DataFrame:
    """The rows that stay: of each group of the operator's the first by order, doc_id (null last) and row."""
    spark = docs.sparkSession
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        return docs.join(operator(docs).where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    # Here doc_id does not tell rows apart; they get numbers, written down so that each keeps its own.
    docs.withColumn("row number", F.monotonically_increasing_id()).write.parquet(path := scratch(spark, "numbered"))
    rows = spark.read.parquet(path)
    groups = operator(rows.select(F.col("row number").alias("doc_id"), "text")).select(F.col("doc_id").alias("row number"), F.col(group).alias("group"))
    best = F.min(F.struct(*order, F.col("doc_id").isNull().alias("nameless"), "doc_id", "row number"))
    first = rows.select("row number", "doc_id", "text").join(groups, "row number").groupBy("group").agg(best.alias("best")).select("best.row number")
    return rows.join(first, "row number", "left_semi").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one stays, the longest and then that of smallest doc_id, whatever rows share a doc_id or have none. Of all empty texts one stays."""
    return _one_of_each(docs, exact_dedup, "keep_id", [(-F.char_length(text_or_empty())).alias("longest")])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one of smallest doc_id stays, whatever rows share a doc_id or have none. Texts without words are linked with nothing and stay."""
    return _one_of_each(docs, near_dedup, "component_id", [])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and the last time as far, as the mix takes them. Texts without words add nothing to it and go; repeated rows are documents of their own."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences: an empty text is its end id, repeated rows are packed one by one."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: SQL has no classifier, sketches or tokenizer; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, f"stage-{name}"))
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
