"""Text that was read from images: status, clean-up and merging with a record's own text. Extraction itself is an engine to plug in; by default its result is a column."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.text import is_blank, let, nfkc, utf16_cut, utf16_length

LABEL = "Image text:\n"
MOST_TEXT = 20_000
LANGUAGES = ("aze", "eng", "rus", "tur")


def languages(setting: str) -> tuple[str, ...]:
    """The languages of a setting such as ``aze+eng``, in order and once each."""
    parts = [p.strip().lower() for p in setting.split("+")]
    if any(p not in LANGUAGES for p in parts):
        raise ValueError(f"unsupported OCR language in {setting!r}")
    return tuple(dict.fromkeys(parts))


def normalized(raw: Column, most: int = MOST_TEXT) -> Column:
    """NFKC; runs of white space become one blank, none at the ends; control characters go; at most ``most`` UTF-16 units, no pair split."""
    composed = nfkc(raw)
    controls = F.regexp_replace(composed, r"[\p{javaISOControl}&&[^\p{javaWhitespace}\p{javaSpaceChar}]]|\p{Cs}", "")
    text = F.trim(F.regexp_replace(controls, r"[\p{javaWhitespace}\p{javaSpaceChar}]+", " "))
    return F.when(raw.isNull() | is_blank(raw), "").otherwise(let(text, lambda t: utf16_cut(t, most)))


def result(raw: Column, enabled: bool = True, available: bool = True, failed: Column | None = None, busy: Column | None = None, most: int = MOST_TEXT) -> Column:
    """A struct (status, text): disabled, error, busy, no_text or ok; the text only when ok."""
    told = lambda flag: F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    if not enabled or not available:
        return F.struct(F.lit("error" if enabled else "disabled").alias("status"), F.lit(None).cast("string").alias("text"))

    def both(text: Column) -> Column:
        status = F.when(told(busy), "busy").when(told(failed), "error").when(text == "", "no_text").otherwise("ok")
        return F.struct(status.alias("status"), F.when(status == "ok", text).alias("text"))

    return let(normalized(raw, most), both)


def analysis_text(text: Column, status: Column, ocr_text: Column, most: int = MOST_TEXT) -> Column:
    """The record's text, and below a label as much of the image's text as has room in ``most`` UTF-16 units."""
    label = F.when(text == "", LABEL).otherwise("\n\n" + LABEL)
    room = F.lit(most) - utf16_length(text) - utf16_length(label)
    use = F.coalesce((status == "ok") & ~is_blank(ocr_text), F.lit(False)) & (room > 0)
    return F.when(use, F.concat(text, label, utf16_cut(ocr_text, room))).otherwise(text)


class Engine(Protocol):
    """An extractor to plug in; it is called within ``mapInPandas`` with encoded images."""

    languages: tuple[str, ...]

    def extract(self, content: bytes, languages: tuple[str, ...], most: int) -> str: ...


def ready(engine: Engine, wanted: tuple[str, ...]) -> bool:
    return set(wanted) <= set(engine.languages)


def extracted(df, engine: Engine, wanted: tuple[str, ...], most: int = MOST_TEXT):
    """The rows with columns ocr_raw and ocr_failed, from the column ``content``."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("ocr_raw", T.StringType()), T.StructField("ocr_failed", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, failed = [], []
            for content in pdf["content"]:
                try:
                    texts.append(engine.extract(bytes(content), wanted, most))
                    failed.append(False)
                except Exception:  # noqa: BLE001  a failed extraction is status error
                    texts.append(None)
                    failed.append(True)
            yield pdf.assign(ocr_raw=texts, ocr_failed=failed)

    return df.mapInPandas(run, schema)
