"""The decision policy: all signals of a record fused into one decision and one violation, by a strict order of conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.provider import at_least, first_flagged, top_score, violation_of

DECISIONS = ("ALLOW", "BLOCK", "UNKNOWN")
VIOLATIONS = (
    "NONE HARASSMENT HATE THREAT SELF_HARM SEXUAL SEXUAL_MINORS GRAPHIC_VIOLENCE VIOLENCE ILLICIT SPAM_SCAM VULGAR IMPERSONATION NOT_INVESTMENT KNOWN_IMAGE ANALYZER_ERROR OTHER".split()
)
INVESTMENTS = ("RELATED", "NOT_RELATED", "UNCERTAIN")
POLITICS = ("NOT_RELATED", "NEUTRAL_OR_SUPPORTIVE", "CRITICAL_OR_NEGATIVE", "HIGH_RISK", "UNCERTAIN")
#: At or above this score an otherwise clean record is UNKNOWN.
THRESHOLD = 0.70


def _is(condition: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(condition, F.lit(False))


def _result(decision: str, violation: Column | str) -> Column:
    return F.struct(F.lit(decision).alias("decision"), (F.lit(violation) if isinstance(violation, str) else violation).alias("violation"))


def best_score(scores: Column, fallback: Column | None = None) -> Column:
    """The top entry of ``scores``; that of ``fallback`` where the former gives none."""
    top = top_score(F.coalesce(scores, F.array().cast("array<struct<key:string,value:double>>")))
    if fallback is None:
        return top
    return F.when(top["value"] < 0, top_score(F.coalesce(fallback, F.array().cast("array<struct<key:string,value:double>>")))).otherwise(top)


def decide(
    content_type: Column,
    local_violation: Column,
    moderation_status: Column,
    flagged: Column,
    categories: Column,
    scores: Column,
    classification_status: Column,
    action: Column,
    category: Column,
    investment: Column,
    pdq_matched: Column,
    media_status: Column,
    fallback_scores: Column | None = None,
    threshold: float = THRESHOLD,
) -> Column:
    """A struct (decision, violation). ``categories``: array of (key, value boolean) in the provider's order, ``scores`` likewise with doubles. Missing signals are null."""
    top = best_score(scores, fallback_scores)
    ok = lambda status: _is(status == "ok")
    mapped = violation_of(category)
    or_other = F.when(mapped == "NONE", "OTHER").otherwise(mapped)
    post = content_type == "POST"
    entries = F.coalesce(categories, F.array().cast("array<struct<key:string,value:boolean>>"))
    return (
        F.when(_is(pdq_matched), _result("BLOCK", "KNOWN_IMAGE"))
        .when(ok(moderation_status) & _is(flagged), _result("BLOCK", first_flagged(entries)))
        .when(content_type.isin("COMMENT", "USERNAME") & _is(local_violation != "NONE"), _result("BLOCK", local_violation))
        .when(post & ok(classification_status) & _is(investment == "not_related"), _result("BLOCK", "NOT_INVESTMENT"))
        .when(~ok(moderation_status) | ~ok(classification_status) | _is(media_status == "error"), _result("UNKNOWN", "ANALYZER_ERROR"))
        .when(_is(action == "block"), _result("BLOCK", or_other))
        .when(_is(action == "unknown"), _result("UNKNOWN", or_other))
        .when(~_is(action == "allow"), _result("UNKNOWN", "ANALYZER_ERROR"))
        .when(mapped != "NONE", _result("UNKNOWN", mapped))
        .when(at_least(top["value"], threshold), _result("UNKNOWN", violation_of(top["key"])))
        .when(post & ~_is(investment == "related"), _result("UNKNOWN", "NOT_INVESTMENT"))
        .otherwise(_result("ALLOW", "NONE"))
    )


def enum_signal(value: Column, members: tuple[str, ...], fallback: str = "UNCERTAIN") -> Column:
    """The member that the value names, whatever its case and blanks around it; the fallback for anything else."""
    named = F.upper(F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return F.when(_is(named.isin(*members)), named).otherwise(F.lit(fallback))


def investment_signal(content_type: Column, value: Column) -> Column:
    """Null unless POST."""
    return F.when(content_type == "POST", enum_signal(value, INVESTMENTS))


def politics_signal(content_type: Column, value: Column, political_term: Column) -> Column:
    """Null for USERNAME; NOT_RELATED becomes UNCERTAIN where the text names a political term."""
    signal = enum_signal(value, POLITICS)
    return F.when(content_type != "USERNAME", F.when((signal == "NOT_RELATED") & _is(political_term), "UNCERTAIN").otherwise(signal))


def image_match(has_image: Column, has_pdq: Column, quality_accepted: Column, matched: Column) -> Column:
    """Null without an image."""
    return F.when(has_image, F.when(~_is(has_pdq), "UNAVAILABLE").when(~_is(quality_accepted), "LOW_QUALITY").when(_is(matched), "MATCHED").otherwise("NOT_MATCHED"))
