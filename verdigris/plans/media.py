"""From images to their signals: gates, decoding, perceptual hash, the store of observed hashes, the blocklist, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators import ocr
from verdigris.operators.hamming import DISTANCE_THRESHOLD, QUALITY_THRESHOLD, match_signal
from verdigris.operators.pdq import hashed
from verdigris.session import shared_folder
from verdigris.sources.hashes import append_observed
from verdigris.sources.images import decoded, judged

#: Faults of an image and the status that its analysis ends with.
STATUS_OF = {"empty image": 400, "image exceeds size limit": 413}


def media_signals(requests: DataFrame, blocked: DataFrame, observed: str | None = None, texts: DataFrame | None = None, quality: int = QUALITY_THRESHOLD, threshold: int = DISTANCE_THRESHOLD) -> DataFrame:
    """A row for each record (content_id, image) that has an image: content_id, media_status, matched, quality_accepted, ocr_status, ocr_text, media_http_status.

    An image that its gates or the decoder refuse has media_status error and the status of its fault. The hashes of all decoded images are stored in ``observed`` first, whatever their quality, and then compared with ``blocked``. ``texts``: what an engine read in the images, as (content_id, ocr_raw, ocr_failed); without it OCR is disabled. Content_ids are expected once.
    """
    images = judged(requests.where("image is not null").select("content_id", F.col("image").alias("content"), F.octet_length("image").cast("long").alias("size")))
    # Written once, so that images are decoded once for the store, the comparison and the signals.
    hashed(decoded(images, "content_id")).write.parquet(path := shared_folder(requests.sparkSession, "hashes"))
    hashes = requests.sparkSession.read.parquet(path)
    if observed:
        append_observed(hashes, observed)
    found = match_signal(hashes, blocked, quality, threshold).select("content_id", "matched", "quality_accepted")
    out = images.select("content_id", "fault").join(found, "content_id", "left")
    fault = F.coalesce("fault", F.when(F.col("matched").isNull(), "invalid image"))
    status = F.lit(422)
    for name, code in STATUS_OF.items():
        status = F.when(fault == name, code).otherwise(status)
    if texts is None:
        out = out.withColumn("ocr", ocr.result(F.lit(None).cast("string"), enabled=False))
    else:
        out = out.join(texts.select("content_id", "ocr_raw", "ocr_failed"), "content_id", "left").withColumn("ocr", ocr.result(F.col("ocr_raw"), failed=F.col("ocr_failed")))
    refused = fault.isNotNull()
    return out.select(
        "content_id",
        F.when(refused, "error").otherwise("ok").alias("media_status"),
        "matched",
        "quality_accepted",
        F.when(~refused, F.col("ocr.status")).alias("ocr_status"),
        F.when(~refused, F.col("ocr.text")).alias("ocr_text"),
        F.when(refused, status).cast("int").alias("media_http_status"),
    )
