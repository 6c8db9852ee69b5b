r"""Text functions as Column expressions. Only NFKC and UTF-16 cuts that may split a pair need Python; both are Arrow-batched, and rows that cannot change skip them natively where that is possible.

Patterns are Java's: ``\p{L}`` and the like are Unicode classes, ``\p{javaWhitespace}`` excludes the no-break space.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Look-alike characters and what they stand for.
LEET_FROM, LEET_TO = "013457@$", "oieastas"
USERNAME_LEET_FROM, USERNAME_LEET_TO = "0134578@$", "oieastbas"
CYRILLIC_TO_BY_LETTER = {"а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x"}
SKELETON = {"ç": "c", "ə": "e", "е": "e", "ё": "e", "ğ": "g", "ı": "i", "і": "i", "ö": "o", "о": "o", "ş": "s", "ü": "u", "а": "a", "р": "p", "с": "c", "х": "x", "у": "y", "к": "k", "м": "m", "т": "t", "в": "b"}

SUPPLEMENTARY = r"[\x{10000}-\x{10FFFF}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row, however often the body names it. The value may hold Python functions, the body may not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else s if s.isascii() else unicodedata.normalize("NFKC", s))


# Declared not deterministic, although it is: the optimizer then keeps what is made of it in one place instead of copying long expressions to wherever they are named.
_nfkc_udf = F.pandas_udf(_nfkc, StringType()).asNondeterministic()


def nfkc(text: Column) -> Column:
    """Compatibility composition; plain ASCII is returned as it is."""
    return _nfkc_udf(text)


def java_trim(text: Column) -> Column:
    """Without the characters up to U+0020 at both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def strip(text: Column) -> Column:
    """Without white space at both ends (Java's notion: no-break spaces stay)."""
    return F.regexp_replace(text, r"^\p{javaWhitespace}+|\p{javaWhitespace}+$", "")


def is_blank(text: Column) -> Column:
    """Only white space, or empty; null stays null."""
    return text.rlike(r"^\p{javaWhitespace}*$") & ~text.rlike(r"\P{javaWhitespace}")


def utf16_length(text: Column) -> Column:
    return F.char_length(text) + F.regexp_count(text, F.lit(SUPPLEMENTARY))


def utf16_cut(text: Column, most: Column | int) -> Column:
    """The longest beginning of at most ``most`` UTF-16 units that splits no pair."""
    most = F.lit(most) if isinstance(most, int) else most
    plain = F.substring(text, F.lit(1), F.greatest(most, F.lit(0)))
    # With pairs: code points are counted with their widths, up to the limit.
    chars = F.split(text, "")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("taken"), F.lit(True).alias("open"))

    def step(acc: Column, c: Column) -> Column:
        width = F.when(c.rlike(SUPPLEMENTARY), 2).otherwise(1)
        fits = acc["open"] & (acc["n"] + width <= most)
        return F.struct((acc["n"] + F.when(fits, width).otherwise(0)).alias("n"), (acc["taken"] + fits.cast("int")).alias("taken"), fits.alias("open"))

    counted = F.aggregate(F.filter(chars, lambda c: c != ""), start, step)["taken"]
    return F.when(utf16_length(text) <= most, text).when(~text.rlike(SUPPLEMENTARY), plain).otherwise(F.substring(text, F.lit(1), counted))


def _cut_units(values: pd.Series, most: pd.Series) -> pd.Series:
    def one(s: str | None, n: int) -> str | None:
        # A lone half of a pair cannot be written as UTF-8; it becomes a question mark, as when Java encodes it.
        return None if s is None else s.encode("utf-16-le", "surrogatepass")[: 2 * n].decode("utf-16-le", "surrogatepass").encode("utf-8", "replace").decode()

    return pd.Series([one(s, int(n)) for s, n in zip(values, most, strict=True)])


_cut_units_udf = F.pandas_udf(_cut_units, StringType())


def utf16_truncate(text: Column, most: int) -> Column:
    """The first ``most`` UTF-16 units, even if that splits a pair."""
    return F.when(utf16_length(text) <= most, text).when(~text.rlike(SUPPLEMENTARY), F.substring(text, 1, most)).otherwise(_cut_units_udf(text, F.lit(most)))


def dictionary_normalized(text: Column, composed: bool = False) -> Column:
    """The form in which terms are matched: NFKC, lower case, look-alike signs folded, stripped, format characters and U+0307 removed. ``composed``: the text is known to be NFKC."""
    folded = F.translate(F.lower(text if composed else nfkc(text)), LEET_FROM, LEET_TO)
    return F.regexp_replace(strip(folded), r"[\p{Cf}\u0307]", "")


def without_inner_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=\p{L})[\p{P}_]+(?=\p{L})", "")


def mixed_scripts_folded(text: Column) -> Column:
    """In runs of letters and digits that hold both Latin and Cyrillic letters, Cyrillic look-alikes become Latin."""
    source, target = "".join(CYRILLIC_TO_BY_LETTER), "".join(CYRILLIC_TO_BY_LETTER.values())
    runs = F.regexp_extract_all(text, F.lit(r"(\p{javaLetterOrDigit}+|\P{javaLetterOrDigit}+)"), F.lit(1))
    both = lambda t: t.rlike(r"\p{IsLatin}") & t.rlike(r"\p{IsCyrillic}")
    return F.when(both(text), F.array_join(F.transform(runs, lambda t: F.when(both(t), F.translate(t, source, target)).otherwise(t)), "")).otherwise(text)


def camel_split(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " ")


def username_normalized(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(nfkc(text)), USERNAME_LEET_FROM, USERNAME_LEET_TO), r"\p{Cf}", "")


def latin_skeleton(text: Column) -> Column:
    return F.translate(text, "".join(SKELETON), "".join(SKELETON.values()))


def name_tokens(text: Column) -> Column:
    separated = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    return F.when(separated == "", F.array().cast("array<string>")).otherwise(F.split(separated, " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def sentence(text: Column) -> Column:
    trimmed = java_trim(text)
    return F.when(trimmed.rlike(r"[.!?]\z"), trimmed).otherwise(F.concat(trimmed, F.lit(".")))


def log_safe(text: Column) -> Column:
    """For a log line: blanks instead of line ends and tabs, 500 characters at most, and ``unavailable`` for nothing."""
    shown = F.when(text.isNull() | is_blank(text), F.lit("unavailable")).otherwise(F.translate(text, "\r\n\t", "   "))
    return utf16_truncate(shown, 500)
