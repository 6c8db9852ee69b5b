r"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton finds anchors: at-signs, plus signs, dots and other digits' neighbours (a digit), schemes and identifier cues. Each anchor is handed to a deterministic parser that expands it to both sides and validates what it gets. Nothing of a text but the surroundings of its anchors is looked at by the parsers.

Base kinds, with the spans that a leftmost non-overlapping search of the pattern gives (a match that fails its test is dropped, not tried again):

* email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
* ip     ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``, parts at most 255
* card   ``[0-9]([\x20-]?[0-9])+``, 13 to 19 digits that pass Luhn's test
* phone  ``\+[0-9][\x20().0-9-]+[0-9]``, 9 to 15 digits

Kinds that the method adds, from cues:

* account  a value after a cue such as ``iban``, ``ssn``, ``account``, ``token`` and a separator; IBANs must pass the remainder test, other values hold a digit and 6 characters or more, and end where their characters do; those of SECRETS go on over single dots
* userinfo the part ``user`` or ``user:password`` before the at-sign of a URL with a scheme, and the address of ``mailto:`` and number of ``tel:`` links
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
ADDED = ("account", "userinfo")
#: Cues of identifiers, lower case.
CUES = ("iban", "ssn", "passport", "account", "acct", "token", "api_key", "apikey", "password", "passwd", "secret")
#: Cues whose values may be dotted, as JSON web tokens are.
SECRETS = frozenset(("token", "api_key", "apikey", "password", "passwd", "secret"))
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:", "tel:")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = frozenset("0123456789")
_DOTTED, _SPACED = _DIGITS | {"."}, _DIGITS | {" ", "-"}
_GIVEN = re.compile(r"""[ ]{0,2}(?:number|no\.?|id)?[ ]{0,2}[:=#][ ]{0,2}["']?""", re.IGNORECASE)
_VALUE = re.compile(r"[A-Za-z0-9_+/-]+")
_SECRET = re.compile(r"[A-Za-z0-9_+/-]+(?:\.[A-Za-z0-9_+/-]+)*")
_IBAN = re.compile(r"[ ]{0,2}[:=#]?[ ]{0,2}([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_USERINFO = re.compile(r"([^\s/?#@]+)@")

Span = tuple[str, int, int]


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), *((d, "9") for d in sorted(_DIGITS)), *((c, "cue") for c in CUES), *((s, "scheme") for s in SCHEMES)]:
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def lowered(text: str) -> str:
    """A-Z in lower case; the length stays."""
    return text.translate(_LOWER)


_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def find(text: str | None, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans (kind, start, end) in code points, by kind in the order of KINDS and ADDED, then start."""
    if not text:
        return []
    n = len(text)
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*KINDS, *ADDED)}
    email_end = phone_end = 0  # searches go on from the end of the last match, whether it was dropped or not
    dotted_end = spaced_end = 0  # runs of an anchor's characters are looked at once

    for last, (kind, length) in anchors.iter(lowered(text)):
        if kind == "9":
            if last >= dotted_end:
                start, dotted_end = _run(text, last, _DOTTED, dotted_end)
                for m in _QUAD.finditer(text, start, dotted_end):
                    # Without leading zeros, of which there may be more than int() takes.
                    if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
                        found["ip"].append(m.span())
            if last >= spaced_end:
                start, spaced_end = _run(text, last, _SPACED, spaced_end)
                if spaced_end - start >= 13:
                    for m in _CARD.finditer(text, start, spaced_end):
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 13 <= len(digits) <= 19 and luhn(digits):
                            found["card"].append(m.span())
        elif kind == "@":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                found["email"].append((start, email_end))
        elif kind == "+":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == "cue":
            begin = last + 1 - length
            if (begin and text[begin - 1].isalnum()) or (last + 1 < n and text[last + 1].isalnum()):
                continue
            if (m := _IBAN.match(text, last + 1)) and iban(m[1]):
                found["account"].append(m.span(1))
            elif m := _GIVEN.match(text, last + 1):
                value = _SECRET if lowered(text[begin : last + 1]) in SECRETS else _VALUE
                if (m := value.match(text, m.end())) and len(m[0]) >= 6 and any(c in _DIGITS for c in m[0]):
                    found["account"].append(m.span())
        else:
            scheme = lowered(text[last + 1 - length : last + 1])
            if scheme == "mailto:":
                if (m := re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+").match(text, last + 1)) is not None:
                    found["userinfo"].append(m.span())
            elif scheme == "tel:":
                if (m := re.compile(r"\+?[0-9][0-9().-]{5,}").match(text, last + 1)) is not None:
                    found["userinfo"].append(m.span())
            elif (m := _USERINFO.match(text, last + 1)) is not None:
                found["userinfo"].append(m.span(1))
    return [(k, *s) for k, spans in found.items() for s in sorted(set(spans))]


def _run(text: str, at: int, chars: frozenset, least: int) -> tuple[int, int]:
    """The longest run of the characters around ``at``, not before ``least``."""
    start, end, n = at, at + 1, len(text)
    while start > least and text[start - 1] in chars:
        start -= 1
    while end < n and text[end] in chars:
        end += 1
    return start, end


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    anchors = automaton()
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            spans = find(text, anchors)
            base = [s for s in spans if s[0] in KINDS]
            rows.append((doc_id, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    Null and empty texts have no spans; base_sha256 is then that of the empty string. Counts and base_sha256 are of the base kinds, spans lists and n_spans counts all. Spans of different kinds may overlap. Repeated rows give equal rows; a null doc_id stays null. An empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(_found, SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; of overlapping spans the earliest, then longest, is replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = automaton()
        for pdf in batches:
            texts = []
            for text in pdf["text"]:
                out, at = [], 0
                for a, b, k in sorted((a, b, k) for k, a, b in find(text, anchors)):
                    if a >= at:
                        out += [text[at:a], f"<{k}>"]
                        at = b
                texts.append(None if text is None else "".join(out) + text[at:])
            yield pdf.assign(text=texts)

    small_batches(docs.sparkSession)
    return docs.mapInPandas(run, docs.schema)
