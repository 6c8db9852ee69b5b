"""The whole pipeline over a table of content records: validation, local policy, signals, decision, response."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.provider import number_entries, parse_classification, parse_moderation, true_entries
from verdigris.operators.decision import POLITICS, THRESHOLD, decide, enum_signal, image_match, investment_signal, politics_signal
from verdigris.operators.dictionary import Term, has_political_term
from verdigris.operators.ocr import analysis_text
from verdigris.operators.username import local_violation
from verdigris.operators.validate import image_fault, parsed_type, request_fault, split_by_fault

RESPONSE = ("content_id", "content_type", "decision", "violation", "investment", "politics", "image_match")
MEDIA = "content_id string, media_status string, matched boolean, quality_accepted boolean, ocr_status string, ocr_text string, media_http_status int"
ANSWERS = "content_id string, moderation_raw string, classification_raw string"


def moderate(
    requests: DataFrame,
    media: DataFrame,
    answers: DataFrame,
    terms: Sequence[Term],
    political: Sequence[str],
    moderation_model: str = "moderation",
    classification_model: str = "classification",
    threshold: float = THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """Responses (RESPONSE) and rejects (content_id, http_status, error_code, message).

    ``media``: image signals by content_id (MEDIA); an image without one counts as a failed analysis. ``answers``: the providers' raw answers by content_id (ANSWERS); a missing one counts as a failed call. Identifiers are expected once in each table.
    """
    size = F.octet_length("image") if "image" in requests.columns else F.lit(None).cast("int")
    records = requests.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("image_bytes", size)
    good, rejects = split_by_fault(records, request_fault(F.col("content_id"), F.col("content_type"), F.col("text"), F.col("image_bytes")))
    good = good.withColumn("content_type", parsed_type(F.col("content_type"))).drop("image")
    nothing = F.lit(None).cast("string")
    mime = F.col("image_content_type") if "image_content_type" in requests.columns else nothing
    good, more = split_by_fault(good, image_fault(F.col("image_bytes"), mime))
    rejects = rejects.unionByName(more)
    has_image = F.col("image_bytes").isNotNull()
    joined = good.join(media, "content_id", "left").withColumn("media_status", F.when(has_image, F.coalesce("media_status", F.lit("error"))))
    upstream = F.when(has_image & F.col("media_http_status").between(400, 499), F.struct(F.lit(422).alias("status"), F.lit("image failed media validation").alias("reason")))
    joined, more = split_by_fault(joined, upstream)
    rejects = rejects.unionByName(more)

    # Only from here on, past all filters, is a text judged: once, in one pass with the signals of its providers.
    joined = joined.join(answers, "content_id", "left").withColumn("local_violation", local_violation(F.col("content_type"), F.col("text"), terms))
    # A name that its policy settles asks no provider, so whatever the tables hold for it does not count.
    named = (F.col("content_type") == "USERNAME") & (F.col("local_violation") != "NONE")
    joined = joined.withColumn("named", named)
    asked_of = lambda raw: F.when(~F.col("named"), F.col(raw))
    joined = joined.withColumn("m", parse_moderation(asked_of("moderation_raw"), moderation_model)).withColumn("c", parse_classification(asked_of("classification_raw"), classification_model))
    shown = F.when(has_image, analysis_text(F.col("text"), F.col("ocr_status"), F.col("ocr_text"))).otherwise(F.col("text"))
    result = decide(
        F.col("content_type"),
        F.col("local_violation"),
        F.col("m.status"),
        F.col("m.flagged"),
        true_entries(F.col("m.categories")),
        number_entries(F.col("m.category_scores")),
        F.col("c.status"),
        F.col("c.action"),
        F.col("c.category"),
        F.col("c.investment"),
        has_image & F.col("matched"),
        F.col("media_status"),
        threshold=threshold,
    )
    # Only texts whose answer is NOT_RELATED are searched for political terms.
    asked = (F.col("content_type") != "USERNAME") & (enum_signal(F.col("c.politics"), POLITICS) == "NOT_RELATED")
    judged = joined.withColumn("political_text", F.when(asked, shown)).withColumn("result", result)
    responses = judged.select(
        "content_id",
        "content_type",
        F.when(F.col("named"), "BLOCK").otherwise(F.col("result.decision")).alias("decision"),
        F.when(F.col("named"), F.col("local_violation")).otherwise(F.col("result.violation")).alias("violation"),
        investment_signal(F.col("content_type"), F.col("c.investment")).alias("investment"),
        politics_signal(F.col("content_type"), F.col("c.politics"), has_political_term(F.col("political_text"), political)).alias("politics"),
        image_match(has_image, F.col("matched").isNotNull(), F.col("quality_accepted"), F.col("matched")).alias("image_match"),
    )
    return responses, rejects


def as_json(responses: DataFrame) -> DataFrame:
    """(content_id, body): fields without a value are left out."""
    names = {"content_id": "contentId", "content_type": "contentType", "decision": "decision", "violation": "violation", "investment": "investment", "politics": "politics", "image_match": "imageMatch"}
    return responses.select("content_id", F.to_json(F.struct(*(F.col(a).alias(b) for a, b in names.items()))).alias("body"))


def status_table(spark, hash_count: int | None, ocr_status: str, provider_ready: bool) -> DataFrame:
    """One row: whether each part is ready; the whole is ready when both others are."""
    media_ready = hash_count is not None
    return spark.createDataFrame([("ready" if provider_ready and media_ready else "unavailable", "ready" if provider_ready else "unavailable", "ready" if media_ready else "unavailable", hash_count, ocr_status)], "status string, ai string, media string, hash_count bigint, ocr string")
