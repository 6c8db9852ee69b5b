"""What classification providers are sent and what they answer, as Column expressions. Answers come as columns; the engine calls no network."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, java_trim, log_safe, utf16_truncate

# A provider's labels and the violation that each stands for.
VIOLATION_OF = {
    "": "NONE",
    "none": "NONE",
    "null": "NONE",
    "harassment": "HARASSMENT",
    "hate": "HATE",
    "hate/threatening": "HATE",
    "threat": "THREAT",
    "harassment/threatening": "THREAT",
    "self_harm": "SELF_HARM",
    "self_harm/intent": "SELF_HARM",
    "self_harm/instructions": "SELF_HARM",
    "sexual": "SEXUAL",
    "sexual_minors": "SEXUAL_MINORS",
    "sexual/minors": "SEXUAL_MINORS",
    "graphic_violence": "GRAPHIC_VIOLENCE",
    "violence/graphic": "GRAPHIC_VIOLENCE",
    "violence": "VIOLENCE",
    "illicit": "ILLICIT",
    "illicit/violent": "ILLICIT",
    "spam_scam": "SPAM_SCAM",
    "vulgar": "VULGAR",
    "impersonation": "IMPERSONATION",
    "reserved_username": "IMPERSONATION",
}
# The answers that a classifier may give.
ACTIONS = ("allow", "block", "unknown")
CATEGORIES = ("none", "harassment", "hate", "threat", "self_harm", "sexual", "sexual_minors", "graphic_violence", "violence", "illicit", "spam_scam", "other")
INVESTMENTS = ("related", "not_related", "uncertain")
POLITICS = ("not_related", "neutral_or_supportive", "critical_or_negative", "high_risk", "uncertain")
TEXT_CAP = 20_000
MOST_OUTPUT_TOKENS = 120

CLASSIFICATION = "status string, model string, action string, category string, investment string, politics string"
MODERATION = "status string, model string, flagged boolean, categories map<string,string>, category_scores map<string,string>, applied_input_types map<string,array<string>>"

#: A prompt for each content type; users may give their own.
PROMPTS = {
    "POST": "You review posts on an investment platform. Decide whether the post may be published, name the main problem if there is one, and say how it relates to investment and to politics.",
    "COMMENT": "You review comments under investment posts. Decide whether the comment may be published, name the main problem if there is one, and say how it relates to politics.",
    "USERNAME": "You review names that people choose on an investment platform. Decide whether the name may be used and name the main problem if there is one.",
}


def violation_of(label: Column) -> Column:
    """The violation of a provider's label; a missing label is NONE, an unknown one OTHER."""
    key = F.translate(F.lower(java_trim(F.coalesce(label, F.lit("null")))), "-", "_")
    table = F.create_map(*(F.lit(x) for pair in VIOLATION_OF.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.lit("OTHER"))


def first_flagged(entries: Column) -> Column:
    """The violation of the first true entry of an array of (key, value), in the provider's order; OTHER without one."""
    hit = F.get(F.filter(entries, lambda e: e["value"].eqNullSafe(F.lit(True))), F.lit(0))
    return F.when(hit.isNull(), F.lit("OTHER")).otherwise(violation_of(hit["key"]))


def top_score(entries: Column) -> Column:
    """(key, value) of the highest number of an array of (key, value double); the first of equal ones; ("", -1) without numbers. NaN exceeds nothing that is asked of it, so it is left as NaN for the caller's test."""
    none = F.struct(F.lit("").alias("key"), F.lit(-1.0).alias("value"), F.lit(False).alias("any"))
    best = F.aggregate(
        F.filter(entries, lambda e: e["value"].isNotNull()),
        none,
        lambda a, e: F.when(~a["any"] | (e["value"] > a["value"]), F.struct(e["key"].alias("key"), e["value"].alias("value"), F.lit(True).alias("any"))).otherwise(a),
    )
    return F.struct(best["key"].alias("key"), best["value"].alias("value"))


def at_least(score: Column, threshold: Column | float) -> Column:
    return ~F.isnan(score) & (score >= threshold)


def quoted_keys(raw: Column) -> Column:
    """The keys of a flat JSON object whose values are strings."""
    return F.regexp_extract_all(raw, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:\s*"'), F.lit(1))


def true_entries(raw: Column) -> Column:
    """A JSON object's entries in its order, with true where the value is the literal true (not a string)."""
    quoted = quoted_keys(raw)
    return F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), ((e["value"] == "true") & ~F.array_contains(quoted, e["key"])).alias("value")))


def number_entries(raw: Column) -> Column:
    """A JSON object's entries in its order, null where the value is not a number."""
    quoted = quoted_keys(raw)
    number = lambda e: F.when(e["value"].rlike(r"^-?[0-9]") & ~F.array_contains(quoted, e["key"]), e["value"].try_cast("double"))
    return F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), number(e).alias("value")))


# Requests


def data_url(content: Column, mime: Column) -> Column:
    """Needs spark.sql.chunkBase64String.enabled = false, else long values hold line ends; they are removed here in any case."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def moderation_text_request(model: str, text: Column) -> Column:
    return F.to_json(F.struct(F.lit(model).alias("model"), text.alias("input")))


def moderation_image_request(model: str, content: Column, mime: Column, context: Column) -> Column:
    kind = "array<struct<type:string,text:string,image_url:struct<url:string>>>"
    image = F.array(F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(data_url(content, mime).alias("url")).alias("image_url"))).cast(kind)
    said = F.array(F.struct(F.lit("text").alias("type"), utf16_truncate(context, TEXT_CAP).alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url"))).cast(kind)
    parts = F.when(context.isNull() | is_blank(context), image).otherwise(F.concat(said, image))
    return F.to_json(F.struct(F.lit(model).alias("model"), parts.alias("input")))


def image_context(text: Column) -> Column:
    return F.when(is_blank(text), F.lit("")).otherwise(F.concat(F.lit("Post text: "), text))


def prompt_for(content_type: Column, prompts: dict[str, str] = PROMPTS) -> Column:
    table = F.create_map(*(F.lit(x) for pair in prompts.items() for x in pair))
    return F.try_element_at(table, content_type)


def answer_schema(content_type: str) -> dict:
    """The JSON schema that an answer must follow."""
    categories = [*CATEGORIES, *(["vulgar"] if content_type in ("COMMENT", "USERNAME") else []), *(["impersonation"] if content_type == "USERNAME" else [])]
    fields = {"action": ACTIONS, "category": categories}
    if content_type == "POST":
        fields["investment"] = INVESTMENTS
    if content_type != "USERNAME":
        fields["politics"] = POLITICS
    return {"type": "object", "properties": {k: {"type": "string", "enum": list(v)} for k, v in fields.items()}, "required": list(fields), "additionalProperties": False}


def follows_schema(content_type: Column, answer: Column) -> Column:
    """Whether a parsed answer (struct action, category, investment, politics) follows its content type's schema."""
    out = F.lit(False)
    for kind in ("POST", "COMMENT", "USERNAME"):
        fields = answer_schema(kind)["properties"]
        ok = F.lit(True)
        for name in ("action", "category", "investment", "politics"):
            value = answer[name]
            ok &= F.coalesce(value.isin(fields[name]["enum"]), F.lit(False)) if name in fields else value.isNull()
        out = F.when(content_type == kind, ok).otherwise(out)
    return out


def classification_text_request(model: str, content_type: Column, text: Column, prompts: dict[str, str] = PROMPTS) -> Column:
    user = F.concat(F.lit("Content type: "), content_type, F.lit("\nThe content to judge, as its author wrote it:\n<content>"), text, F.lit("</content>"))
    return _structured(model, content_type, user, prompts)


def classification_image_request(model: str, content_type: Column, content: Column, mime: Column, text: Column, prompts: dict[str, str] = PROMPTS) -> Column:
    shown = F.when(is_blank(text), F.lit("[none]")).otherwise(utf16_truncate(text, TEXT_CAP))
    context = F.concat(F.lit("Content type: "), content_type, F.lit("\nPost text: "), shown, F.lit("\nJudge the image together with this text."))
    parts = F.array(
        F.struct(F.lit("input_text").alias("type"), context.alias("text"), F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("string").alias("detail")),
        F.struct(F.lit("input_image").alias("type"), F.lit(None).cast("string").alias("text"), data_url(content, mime).alias("image_url"), F.lit("high").alias("detail")),
    )
    return _structured(model, content_type, parts, prompts)


def _structured(model: str, content_type: Column, user: Column, prompts: dict[str, str]) -> Column:
    """The envelope of a classification: nothing stored, few output tokens, the answer's schema."""
    import json

    schemas = F.lit(None).cast("string")
    for kind in ("POST", "COMMENT", "USERNAME"):
        schemas = F.when(content_type == kind, F.lit(json.dumps(answer_schema(kind)))).otherwise(schemas)
    developer = F.struct(F.lit("developer").alias("role"), prompt_for(content_type, prompts).alias("content"))
    content = F.struct(F.lit("user").alias("role"), user.alias("content"))
    # The two messages differ in the type of their content, so they are joined as text.
    messages = F.concat(F.lit("["), F.to_json(developer), F.lit(","), F.to_json(content), F.lit("]"))
    head = json.dumps({"model": model, "store": False, "max_output_tokens": MOST_OUTPUT_TOKENS})[:-1]
    return F.concat(F.lit(head + ', "input": '), messages, F.lit(', "text": {"format": {"type": "json_schema", "name": "content_analysis", "strict": true, "schema": '), schemas, F.lit("}}}"))


# Answers


def parse_moderation(raw: Column, default_model: str) -> Column:
    """The signal of a moderation answer; status is error where it holds no result. Categories and scores keep the provider's order, as JSON text."""
    first = F.get_json_object(raw, "$.results[0]")
    shown = F.coalesce(F.get_json_object(raw, "$.model"), F.lit(default_model))
    # asBoolean: true, or a number other than 0; a string counts when it is "true".
    flag = F.get_json_object(first, "$.flagged")
    flagged = F.coalesce((flag == "true") | (F.coalesce(flag.try_cast("double"), F.lit(0.0)).cast("int") != 0), F.lit(False))
    objects = lambda name: F.when(F.get_json_object(first, f"$.{name}").rlike(r"^\{"), F.get_json_object(first, f"$.{name}")).otherwise(F.lit("{}"))
    ok = first.isNotNull()
    return F.struct(
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(ok, shown).alias("model"),
        F.when(ok, flagged).alias("flagged"),
        F.when(ok, objects("categories")).alias("categories"),
        F.when(ok, objects("category_scores")).alias("category_scores"),
        F.when(ok, objects("category_applied_input_types")).alias("applied_input_types"),
    )


OUTPUT = "struct<output:array<struct<type:string,content:array<struct<type:string,text:string>>>>,model:string>"


def output_text(raw: Column) -> Column:
    """The first non-blank output text of the first message that has one; null without."""
    messages = F.filter(F.from_json(raw, OUTPUT)["output"], lambda o: o["type"] == "message")
    texts = F.flatten(F.transform(messages, lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    return F.get(F.filter(texts, lambda c: (c["type"] == "output_text") & c["text"].isNotNull() & ~is_blank(c["text"])), F.lit(0))["text"]


def parse_classification(raw: Column, default_model: str) -> Column:
    """The signal of a classification answer. What the answer itself says of status and model comes before the envelope's; no text or no object gives status error."""
    text = output_text(raw)
    parsed = F.from_json(text, "map<string,string>")
    ok = parsed.isNotNull() & F.coalesce(text.rlike(r"^\s*\{"), F.lit(False))
    said = lambda name: F.try_element_at(parsed, F.lit(name))
    model = F.coalesce(said("model"), F.from_json(raw, OUTPUT)["model"], F.lit(default_model))
    return F.struct(
        F.when(ok, F.coalesce(said("status"), F.lit("ok"))).otherwise("error").alias("status"),
        F.when(ok, model).alias("model"),
        *(F.when(ok, said(name)).alias(name) for name in ("action", "category", "investment", "politics")),
    )


def provider_error(body: Column, status: Column, status_text: Column, request_id: Column) -> Column:
    """What a failed call says, fit for a log: type, code and message with defaults by status."""
    said = lambda name: F.get_json_object(body, f"$.error.{name}")
    first = lambda x, other: F.when(x.isNull() | is_blank(x), other).otherwise(x)
    return F.struct(
        log_safe(request_id).alias("request_id"),
        log_safe(first(said("type"), F.lit("http_error"))).alias("type"),
        log_safe(first(said("code"), F.concat(F.lit("http_"), status.cast("string")))).alias("code"),
        log_safe(first(said("message"), status_text)).alias("message"),
    )


class Provider(Protocol):
    """A provider to plug in: called within ``mapInPandas`` for batches of rows, it returns the raw answers."""

    name: str

    def ready(self) -> bool: ...

    def details(self) -> dict[str, str]: ...

    def moderate(self, rows: pd.DataFrame) -> pd.Series: ...

    def classify(self, rows: pd.DataFrame) -> pd.Series: ...


def asked(df, provider: Provider):
    """The rows with the provider's raw answers (null where the call failed) in ``moderation_raw`` and ``classification_raw``. The two calls fail independently."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("moderation_raw", T.StringType()), T.StructField("classification_raw", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {}
            for name, call in (("moderation_raw", provider.moderate), ("classification_raw", provider.classify)):
                try:
                    out[name] = call(pdf)
                except Exception:  # noqa: BLE001  a failed call is an answer: status error
                    out[name] = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            yield pdf.assign(**out)

    return df.mapInPandas(run, schema)
