"""Matching of ordered term dictionaries: the first term in file order wins."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import dictionary_normalized, is_blank, let, mixed_scripts_folded, without_inner_punctuation

BEGIN, END, BETWEEN = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])", r"[\p{Z}\p{P}_]+"


class Term(NamedTuple):
    """A dictionary entry; ``term`` in the form in which texts are matched."""

    ord: int
    violation: str
    term: str


def quoted(word: str) -> str:
    return r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E"


def pattern(term: str) -> str:
    """Java's pattern of a normalised term: its words, with separators between them, not within a longer word."""
    return f"(?U){BEGIN}{BETWEEN.join(quoted(w) for w in re.split(r'\s+', term))}{END}"


def any_of(terms: Sequence[str]) -> str:
    """One pattern for a whole list."""
    return f"(?U){BEGIN}(?:{'|'.join(BETWEEN.join(quoted(w) for w in re.split(r'\s+', t)) for t in terms)}){END}"


#: A run of letters and digits.
RUN = r"[\p{L}\p{N}]+"


def may_hold(normalized: Column, terms: Sequence[str]) -> Column:
    """Whether a text can hold some term: the first run of letters and digits of a term is a whole run of each text that holds it, so one split of the text and a look-up spare most texts the patterns. Terms without such a run can be anywhere."""
    runs = [F.regexp_extract(F.lit(t), f"({RUN})", 1) for t in terms]
    # A pattern that finds nothing gives the empty string, which is then looked for among the runs.
    held = F.concat(F.split(normalized, r"[^\p{L}\p{N}]+"), F.array(F.lit("")))
    return F.arrays_overlap(held, F.array(*runs))


def first_violation(normalized: Column, terms: Sequence[Term]) -> Column:
    """The violation of the first term in the list that the text holds, NONE without one. Most rows are settled by ``may_hold``, most others by one pattern of all terms."""
    if not terms:
        return F.lit("NONE")
    ordered = sorted(terms, key=lambda t: t.ord)
    # Neighbours of one violation share a search.
    out, groups = None, []
    for t in ordered:
        if groups and groups[-1][0] == t.violation:
            groups[-1][1].append(t.term)
        else:
            groups.append((t.violation, [t.term]))
    for violation, words in groups:
        hit = normalized.rlike(any_of(words))
        out = F.when(hit, violation) if out is None else out.when(hit, violation)
    all_terms = [t.term for t in ordered]
    return F.when(~(may_hold(normalized, all_terms) & normalized.rlike(any_of(all_terms))), "NONE").otherwise(out.otherwise("NONE"))


def banned_violation(text: Column, terms: Sequence[Term], composed: bool = False) -> Column:
    """The violation of a text: of its normalised form, else of the form without punctuation within words and with mixed scripts folded."""

    def second(normalized: Column) -> Column:
        return let(mixed_scripts_folded(without_inner_punctuation(normalized)), lambda c: F.when(c == normalized, "NONE").otherwise(first_violation(c, terms)))

    def both(normalized: Column) -> Column:
        return let(first_violation(normalized, terms), lambda v: F.when(v != "NONE", v).otherwise(second(normalized)))

    return F.when(text.isNull() | is_blank(text), "NONE").otherwise(let(dictionary_normalized(text, composed), both))


def has_political_term(text: Column, terms: Sequence[str], composed: bool = False) -> Column:
    if not terms:
        return F.lit(False)
    held = let(dictionary_normalized(text, composed), lambda t: may_hold(t, terms) & t.rlike(any_of(terms)))
    return F.when(text.isNull() | is_blank(text), False).otherwise(held)


def banned_violation_by_join(df: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """For dictionaries too long for an expression: (key, violation), a row for each row of ``df``, by an inverted index on the terms' first runs of letters and digits. ``terms``: ord, violation, term (normalised).

    Both forms of a text are searched as ``banned_violation`` does: a hit of the normalised form counts before any of the other. A text joins, by narrow rows, only terms whose first run is among its own; the terms that a text may hold then come to it once, and their patterns are tested there, in the dictionary's order. Terms without a run may be in any text. Rows that repeat a key are judged by their own texts; null and blank texts are NONE.
    """
    numbered = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shown = F.when(~is_blank(F.col("text")), dictionary_normalized(F.col("text")))
    forms = numbered.select("key", shown.alias("first")).select("key", "first", let(F.col("first"), lambda t: mixed_scripts_folded(without_inner_punctuation(t))).alias("second"))
    # One judgement for each distinct form; it is named by a digest, and rows of equal forms share it.
    forms = forms.select("key", "first", F.when(F.col("first") == F.col("second"), None).otherwise(F.col("second")).alias("second")).select("*", F.sha2(F.concat_ws("\u0000", "first", "second"), 256).alias("id"))
    runs = lambda c: F.split(c, r"[^\p{L}\p{N}]+")
    own = F.array_distinct(F.concat(runs(F.col("first")), F.coalesce(runs(F.col("second")), F.array().cast("array<string>")), F.array(F.lit(""))))
    escaped = F.transform(F.split("term", r"\s+"), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    indexed = terms.select("ord", "violation", F.regexp_extract("term", f"({RUN})", 1).alias("run"), F.concat(F.lit("(?U)" + BEGIN), F.array_join(escaped, BETWEEN), F.lit(END)).alias("pattern"))
    told = forms.where("first is not null").select("id", F.explode(own).alias("run")).distinct().join(indexed, "run")
    told = told.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("ord", "violation", "pattern"))).alias("terms"))
    first_hit = lambda t: F.get(F.filter("terms", lambda e: F.call_function("rlike", t, e["pattern"])), F.lit(0))["violation"]
    judged = forms.join(told, "id", "left").select("key", F.coalesce(first_hit(F.col("first")), first_hit(F.col("second")), F.lit("NONE")).alias("violation"))
    return judged.withColumnRenamed("key", key)
