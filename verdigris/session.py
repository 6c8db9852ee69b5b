"""A session with the settings that the engine expects, and the checks of its own settings."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from verdigris.operators.ocr import LANGUAGES, languages

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "false",  # data URLs have no line ends
}


def session(name: str = "verdigris", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='verdigris-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Arrow batches to Python workers stay below so many bytes, or hold a single row.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds the session's Arrow batches by bytes, since the rows of a batch (the bound that is commonly set) can be of any size."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def _between(name: str, value: int, low: int, high: int | None = None) -> None:
    if value < low or high is not None and value > high:
        raise ValueError(f"{name} must be " + (f"at least {low}" if high is None else f"from {low} to {high}"))


@dataclass(frozen=True)
class MediaSettings:
    distance_threshold: int = 31
    quality_threshold: int = 49
    max_image_bytes: int = 10 * 1024 * 1024
    max_image_pixels: int = 40_000_000
    ocr_enabled: bool = False
    ocr_languages: tuple[str, ...] = field(default=LANGUAGES)
    ocr_timeout_seconds: int = 10
    ocr_max_text_chars: int = 20_000
    ocr_concurrency: int = 2

    def __post_init__(self) -> None:
        _between("distance_threshold", self.distance_threshold, 0, 256)
        _between("quality_threshold", self.quality_threshold, 0, 100)
        _between("max_image_bytes", self.max_image_bytes, 1)
        _between("max_image_pixels", self.max_image_pixels, 1)
        _between("ocr_timeout_seconds", self.ocr_timeout_seconds, 1, 60)
        _between("ocr_max_text_chars", self.ocr_max_text_chars, 1, 20_000)
        _between("ocr_concurrency", self.ocr_concurrency, 1, 8)
        languages("+".join(self.ocr_languages))
