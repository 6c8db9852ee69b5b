"""The username policy: reserved roles and staff identities, beside the dictionary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.text import camel_split, compact, is_blank, latin_skeleton, let, name_tokens, username_normalized

from .dictionary import Term, banned_violation

# Roles, cues and prefixes that are harmless.
LATIN_ROLES = ("admin", "administrator", "moderator", "admini", "adminisi", "inzibatci", "yonetici", "yoneticisi")
CYRILLIC_ROLES = ("админ", "администратор", "модератор")
LATIN_HARMLESS = ("administration", "administrative", "administer")
CYRILLIC_HARMLESS = ("администрац", "административ", "администрир")
LATIN_CUES = ("official", "resmi", "platform", "platforma", "tribe", "bank", "customer", "client", "service", "team", "fake", "notreal")
LATIN_STAFF = ("support", "helpdesk", "staff", "security", "system", "root", "superuser", "destek", "destegi", "desteyi")
CYRILLIC_CUES = ("официал", "платформ", "банк", "клиент", "служб", "команд")
CYRILLIC_STAFF = ("поддерж", "безопасност", "систем", "сотрудник")


def _alternatives(words: Sequence[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _starts(value: Column, words: Sequence[str]) -> Column:
    return value.rlike("^" + _alternatives(words))


def role_at_edge(value: Column, roles: Sequence[str], harmless: Sequence[str]) -> Column:
    bare = F.regexp_replace(value, r"\p{N}+$", "")
    return ~_starts(bare, harmless) & (_starts(bare, roles) | bare.rlike(_alternatives(roles) + r"\z"))


def reserved_identity(value: Column, roles: Sequence[str], harmless: Sequence[str]) -> Column:
    return F.exists(name_tokens(value), lambda t: role_at_edge(t, roles, harmless)) | role_at_edge(compact(value), roles, harmless)


def staff_identity(normalized: Column, skeleton: Column) -> Column:
    some = lambda tokens, test: F.exists(tokens, test)
    own, joined = name_tokens(normalized), compact(normalized)
    cyrillic = (some(own, lambda t: _starts(t, CYRILLIC_CUES)) & some(own, lambda t: _starts(t, CYRILLIC_STAFF))) | (_starts(joined, CYRILLIC_CUES) & joined.rlike(_alternatives(CYRILLIC_STAFF)))
    latin, whole = name_tokens(skeleton), compact(skeleton)
    ends = lambda words: whole.rlike(_alternatives(words) + r"\z")
    return (
        cyrillic
        | whole.isin(*LATIN_STAFF)
        | (some(latin, lambda t: t.isin(*LATIN_CUES)) & some(latin, lambda t: t.isin(*LATIN_STAFF)))
        # Beginning and end are separate tests: they may overlap.
        | (_starts(whole, LATIN_CUES) & ends(LATIN_STAFF))
        | (_starts(whole, LATIN_STAFF) & ends(LATIN_CUES))
    )


def username_violation(text: Column, terms: Sequence[Term]) -> Column:
    """NONE for blank names; else the dictionary's violation of the name split at camel case, unless that is IMPERSONATION or NONE; else IMPERSONATION for reserved and staff identities."""
    said = banned_violation(camel_split(text), terms)

    def identity(normalized: Column) -> Column:
        return let(latin_skeleton(normalized), lambda s: reserved_identity(normalized, CYRILLIC_ROLES, CYRILLIC_HARMLESS) | reserved_identity(s, LATIN_ROLES, LATIN_HARMLESS) | staff_identity(normalized, s))

    def judged(x: Column) -> Column:
        return F.when(~x["said"].isin("NONE", "IMPERSONATION"), x["said"]).when(x["reserved"] | (x["said"] == "IMPERSONATION"), "IMPERSONATION").otherwise("NONE")

    both = F.struct(said.alias("said"), let(username_normalized(text), identity).alias("reserved"))
    return F.when(text.isNull() | is_blank(text), "NONE").otherwise(let(both, judged))


def local_violation(content_type: Column, text: Column, terms: Sequence[Term]) -> Column:
    """Of COMMENT the dictionary's violation, IMPERSONATION counting as none; of USERNAME the policy's; of POST none."""
    # Texts that a branch does not need are null there, so that Python normalises nothing in vain.
    comment, name = F.when(content_type == "COMMENT", text), F.when(content_type == "USERNAME", text)
    said = let(banned_violation(comment, terms), lambda v: F.when(v == "IMPERSONATION", "NONE").otherwise(v))
    return F.when(content_type == "COMMENT", said).when(content_type == "USERNAME", username_violation(name, terms)).otherwise("NONE")
