"""Term dictionaries: ``VIOLATION|term`` lines for banned terms, one term a line for political ones. Lines of white space and those that begin with ``#`` are skipped."""

from __future__ import annotations

import re
import unicodedata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.text import LEET_FROM, LEET_TO
from verdigris.operators.decision import VIOLATIONS
from verdigris.operators.dictionary import Term

#: Violations that no dictionary may name.
RESERVED = ("NONE", "NOT_INVESTMENT", "KNOWN_IMAGE", "ANALYZER_ERROR")

#: The terms that show a political topic, for those who give no file of their own.
POLITICAL_TERMS = Path(__file__).with_name("political_terms.txt")


class DictionaryError(ValueError):
    """A dictionary that cannot be used; the message names the line."""


def normalized(term: str) -> str:
    """A term in the form in which texts are matched (see ``dictionary_normalized``); dictionaries are small, so this runs on the driver."""
    folded = unicodedata.normalize("NFKC", term).lower().translate(str.maketrans(LEET_FROM, LEET_TO)).strip()
    return "".join(c for c in folded if unicodedata.category(c) != "Cf" and c != "\u0307")


def parse_banned(lines: list[str]) -> list[Term]:
    """The ordered terms. Faults: no separator, an unknown or reserved violation, an empty term, a repeated pair of violation and term, no terms at all."""
    out, seen = [], set()
    for number, raw in enumerate(lines, 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        violation, mark, term = line.partition("|")
        violation = violation.strip().upper()
        if not mark:
            raise DictionaryError(f"line {number}: expected VIOLATION|term")
        if violation not in VIOLATIONS or violation in RESERVED:
            raise DictionaryError(f"line {number}: violation {violation!r} is not allowed")
        form = normalized(term)
        if not form:
            raise DictionaryError(f"line {number}: empty term")
        if (violation, form) in seen:
            raise DictionaryError(f"line {number}: repeated term")
        seen.add((violation, form))
        out.append(Term(number, violation, form))
    if not out:
        raise DictionaryError("the dictionary has no terms")
    return out


def parse_political(lines: list[str]) -> list[str]:
    """The terms in order, repeated ones once."""
    found = [normalized(x) for x in lines if x.strip() and not x.strip().startswith("#")]
    out = [x for x in dict.fromkeys(found) if x]
    if not out:
        raise DictionaryError("the dictionary has no terms")
    return out


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """A dictionary's lines in order. A missing file is an error at once, before any plan is built."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except Exception as error:
        raise DictionaryError(f"cannot read the dictionary {path}") from error
    return [line for r in rows for line in re.split(r"\r\n|\r|\n", r["value"])]


def banned_terms(spark: SparkSession, path: str) -> list[Term]:
    return parse_banned(read_lines(spark, path))


def political_terms(spark: SparkSession | None = None, path: str | None = None) -> list[str]:
    """Of a file, or of the one that comes with the package."""
    if path:
        return parse_political(read_lines(spark, path))
    return parse_political(POLITICAL_TERMS.read_text("utf-8").splitlines())


def as_table(spark: SparkSession, terms: list[Term]) -> DataFrame:
    return spark.createDataFrame([tuple(t) for t in terms], "ord int, violation string, term string")


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """A banned-term file as a table (line, violation, term), without validation."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line", "raw"))
    text = F.trim(F.regexp_replace("raw", r"^\p{javaWhitespace}+|\p{javaWhitespace}+$", ""))
    return lines.select((F.col("line") + 1).alias("line"), text.alias("raw")).where("raw <> '' and not startswith(raw, '#')").select("line", F.upper(F.trim(F.split("raw", r"\|", 2)[0])).alias("violation"), F.get(F.split("raw", r"\|", 2), F.lit(1)).alias("term"))
