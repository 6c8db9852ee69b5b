"""Validation of content records, in the order in which errors are to be reported, and what a rejected record is told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import is_blank, java_trim, sentence, utf16_length

CONTENT_TYPES = ("POST", "COMMENT", "USERNAME")
IMAGE_TYPES = ("image/jpeg", "image/png", "image/gif")
MOST_TEXT = 20_000
MOST_ID = 128
MOST_IMAGE_BYTES = 10 * 1024 * 1024

# Error code and default message by HTTP status.
CODE_OF = {400: "INVALID_INPUT", 404: "NOT_FOUND", 405: "METHOD_NOT_ALLOWED", 406: "NOT_ACCEPTABLE", 413: "PAYLOAD_TOO_LARGE", 415: "UNSUPPORTED_MEDIA_TYPE", 422: "UNPROCESSABLE_IMAGE", 503: "SERVICE_UNAVAILABLE"}
MESSAGE_OF = {
    404: "Endpoint not found.",
    405: "HTTP method is not supported.",
    406: "Requested response type is not supported.",
    413: "Image exceeds the size limit.",
    415: "Media type is not supported.",
    422: "Image could not be processed.",
}
# HTTP status by kind of failure.
STATUS_OF = {"upload_too_large": 413, "media_type": 415, "missing_parameter": 400, "validation": 400, "multipart": 400}


def parsed_type(value: Column) -> Column:
    """The content type that a value names; null for none."""
    named = F.upper(java_trim(value))
    return F.when(named.isin(*CONTENT_TYPES), named)


def status_of(kind: Column, explicit: Column) -> Column:
    """The status of a failure: the explicit one, else by kind, else 500."""
    table = F.create_map(*(F.lit(x) for pair in STATUS_OF.items() for x in pair))
    return F.coalesce(explicit, F.try_element_at(table, kind), F.lit(500))


def error_code(status: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CODE_OF.items() for x in pair))
    return F.coalesce(F.try_element_at(table, status), F.when((status >= 500) & (status < 600), "INTERNAL_ERROR").otherwise("INVALID_INPUT"))


def error_message(status: Column, reason: Column) -> Column:
    """Errors of the server hide their reason; others say it as a sentence, or the status's default."""
    table = F.create_map(*(F.lit(x) for pair in MESSAGE_OF.items() for x in pair))
    return (
        F.when(status == 503, "Service is not available.")
        .when((status >= 500) & (status < 600), "Internal server error.")
        .when(reason.isNotNull() & ~F.coalesce(is_blank(reason), F.lit(True)), sentence(reason))
        .otherwise(F.coalesce(F.try_element_at(table, status), F.lit("Request is invalid.")))
    )


def request_id(*supplied: Column) -> Column:
    """The first that is not blank, else a random one (so results differ between runs)."""
    return F.coalesce(*(F.when(~is_blank(x), x) for x in supplied), F.uuid())


def _fault(status: int, reason: str | Column) -> Column:
    return F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def request_fault(content_id: Column, content_type: Column, text: Column, image_bytes: Column) -> Column:
    """A struct (status, reason) of the first fault of a record, null without one. ``image_bytes``: the image's size, null without an image."""
    kind, blank = parsed_type(content_type), F.coalesce(is_blank(text), F.lit(True))
    return (
        F.when(content_id.isNull() | is_blank(content_id), _fault(400, "contentId must not be blank"))
        .when(utf16_length(content_id) > MOST_ID, _fault(400, f"contentId size must be between 0 and {MOST_ID}"))
        .when(content_type.isNull() | is_blank(content_type), _fault(400, "contentType must not be blank"))
        .when(utf16_length(text) > MOST_TEXT, _fault(400, f"text size must be between 0 and {MOST_TEXT}"))
        .when(kind.isNull(), _fault(400, "contentType must be POST, COMMENT, or USERNAME"))
        .when((kind != "POST") & image_bytes.isNotNull(), _fault(400, "images are accepted only for POST"))
        .when(image_bytes == 0, _fault(400, "empty image"))
        .when(blank & image_bytes.isNull(), _fault(400, "text or image is required"))
        .when((kind != "POST") & blank, _fault(400, F.concat(kind, F.lit(" requires text"))))
    )


def _image_type(mime: Column) -> Column:
    return F.lower(F.coalesce(mime, F.lit(""))).isin(*IMAGE_TYPES)


def image_fault(image_bytes: Column, mime: Column, most: int = MOST_IMAGE_BYTES) -> Column:
    """Of a record that is not settled by its name: size, then type."""
    return F.when(image_bytes > most, _fault(413, "image exceeds size limit")).when(image_bytes.isNotNull() & ~_image_type(mime), _fault(415, "unsupported image content type"))


def analysis_image_fault(content_type: Column, image_bytes: Column, mime: Column, most: int = MOST_IMAGE_BYTES) -> Column:
    """As the analyser of images checks: type of content, type of image, emptiness, size."""
    return (
        F.when(content_type != "POST", _fault(400, "images are accepted only for POST"))
        .when(~_image_type(mime), _fault(415, "unsupported image content type"))
        .when(image_bytes == 0, _fault(400, "empty image"))
        .when(image_bytes > most, _fault(413, "image exceeds size limit"))
    )


def media_image_fault(image_bytes: Column, decoded: Column, most: int = MOST_IMAGE_BYTES) -> Column:
    """As the hasher of images checks: emptiness, size, then whether it can be decoded."""
    return F.when(image_bytes == 0, _fault(400, "empty image")).when(image_bytes > most, _fault(413, "image exceeds size limit")).when(~F.coalesce(decoded, F.lit(False)), _fault(422, "invalid image"))


def upstream_fault(status: Column) -> Column:
    """What a failed image analysis means: a fault of the image where the status is 4xx, else null, and the media signal is error."""
    return F.when((status >= 400) & (status < 500), _fault(422, "image failed media validation"))


def split_by_fault(df: DataFrame, fault: Column, key: str = "content_id") -> tuple[DataFrame, DataFrame]:
    """The records without a fault, and the rejects: key, http_status, error_code, message."""
    judged = df.withColumn("fault", fault)
    rejects = judged.where("fault is not null").select(key, F.col("fault.status").alias("http_status"), error_code(F.col("fault.status")).alias("error_code"), error_message(F.col("fault.status"), F.col("fault.reason")).alias("message"))
    return judged.where("fault is null").drop("fault"), rejects
