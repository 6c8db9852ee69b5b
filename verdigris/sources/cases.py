"""Content records and labelled cases as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.operators.accuracy import CASES

REQUESTS = "content_id string, content_type string, text string, image binary, image_filename string, image_content_type string, request_id string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases, one JSON object a line; a line that is none is an error."""
    return spark.read.schema(CASES).option("mode", "FAILFAST").json(path)


def read_requests(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(REQUESTS).format(format).load(path)


def stream_requests(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(REQUESTS).format(format).load(path)
