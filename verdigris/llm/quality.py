r"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates (McMahan and others, 2013) and scored as sparse dot products.

Features of a text: n-grams of its words ([^\x20\x09-\x0D]+) and n-grams of the words' shapes (letters, digits and other characters by class, runs squeezed), hashed into 2 ** BITS places, each kind into an eighth of its own; a word that repeats the one before it has a shape of its own. A feature's value is the square root of its share of all n-grams of its kind. Labels, lang, source and doc_id are never inputs.

The model is fitted on a bounded sample of labelled rows: at most SAMPLE of those outside the held-out fold that have a document, the ones of least hash of doc_id, in one task. Scoring takes the weights (a few MB, of fixed size) to every task and reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, small_batches

BITS = 20
SAMPLE = 10_000
EPOCHS = 3
#: FTRL-proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

_CLASSES = [(re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[a-zß-öø-ɏ]+"), "a"), (re.compile("[0-9]+"), "9"), (re.compile(r"([^Aa9])\1+"), r"\1+")]


def shape(word: str) -> str:
    if word.isascii() and word.isalpha() and word.islower():
        return "a"
    for pattern, to in _CLASSES:
        word = pattern.sub(to, word)
    return word


class Features:
    """Places and values of a text's features. Place 0 is the intercept's; each kind has a range of its own, so a text has no place twice."""

    KINDS = 5

    def __init__(self, bits: int = BITS) -> None:
        self.room = 1 << (bits - 3)
        self.hashes = Kept(self._hashes)

    @staticmethod
    def _hashes(word: bytes) -> bytes:
        """Of a word and of its shape."""
        w = word.decode("utf-8", "surrogatepass")
        low = w.lower().encode("utf-8", "surrogatepass")
        return xxhash.xxh3_64_intdigest(low).to_bytes(8, "little") + xxhash.xxh3_64_intdigest(shape(w).encode("utf-8", "surrogatepass"), 1).to_bytes(8, "little")

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes, this parts by [\x20\x09-\x0D] alone
        places, values = [np.zeros(1, np.int32)], [np.ones(1)]
        both = np.frombuffer(b"".join(map(self.hashes.__getitem__, words)), "<u8").reshape(-1, 2)
        word, form = both[:, 0].copy(), both[:, 1].copy()
        with np.errstate(over="ignore"):
            same = np.flatnonzero(word[1:] == word[:-1]) + 1
            form[same] = form[same] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
            mix = lambda a, b: (a * np.uint64(0xBF58476D1CE4E5B9) ^ (b + np.uint64(0x94D049BB133111EB)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(7)
            kinds = [word >> np.uint64(3), mix(word[:-1], word[1:]), form >> np.uint64(3), mix(form[:-1], form[1:]), mix(mix(form[:-2], form[1:-1]), form[2:])]
        for i, kind in enumerate(kinds):
            if n := len(kind):
                at = (kind & np.uint64(self.room - 1)).astype(np.int32)
                at.sort()
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                places.append(at[first] + np.int32((i + 1) * self.room))
                values.append(np.sqrt(np.diff(first, append=n) / n))
        return np.concatenate(places), np.concatenate(values)


def train(rows: Iterable[tuple[str | None, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights by FTRL-proximal updates over the rows (text, label) in their order. Place 0 is the intercept."""
    features = Features(bits)
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    # All rows' features end to end, 8 bytes each, in two blocks that go back to the system as a whole.
    places, values, ends, labels = bytearray(), bytearray(), [0], []
    for text, label in rows:
        at, x = features(text)
        places += at.tobytes()
        values += x.astype(np.float32).tobytes()
        ends.append(ends[-1] + len(at))
        labels.append(float(label))
    all_places, all_values = np.frombuffer(places, np.int32), np.frombuffer(values, np.float32)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for a, b, y in zip(ends, ends[1:], labels, strict=False):
            at, x = all_places[a:b], all_values[a:b].astype(float)
            w = weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w  # no place is there twice
            n[at] += g * g
    return weights(z, n).astype(np.float32)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """The weights; of zeros (all scores 1/2) where no row is labelled. Several labels or texts of a doc_id count as the least; null labels are left out."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y")).where(~held_out("label_id") & F.col("y").isNotNull() & F.col("label_id").isNotNull())
    # Labels without a document do not use up the sample.
    known = known.groupBy("label_id").agg(F.min("y").alias("y")).join(docs.select(F.col("doc_id").alias("label_id")), "label_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    # Broadcast: at most SAMPLE rows of 12 bytes.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).repartition(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts)
        parts.clear()
        pdf["order"] = [xxhash.xxh3_64_intdigest(str(x)) for x in pdf["doc_id"]]
        pdf = pdf.sort_values(["order", "doc_id"], kind="stable")
        yield pd.DataFrame({"weights": [train(zip(pdf["text"], pdf["y"], strict=True)).tobytes()]})

    found = rows.mapInPandas(run, "weights binary").collect()
    return np.frombuffer(bytes(found[0]["weights"]), np.float32) if found else np.zeros(1 << BITS, np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, columns: list[str] | None = None, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The documents' columns (or the named ones), score and predicted, under the names of ``out``. Only texts go to Python, in batches bounded by bytes."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS floats

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, w = Features(), held.value
        for batch in batches:
            sums = []
            for text in batch:
                at, x = features(text.as_py())
                sums.append(float(w[at] @ x))
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(sums, float), -35, 35))), pa.float64())

    # The result's names may clash with the documents'; nothing is looked up by them.
    of = scored.asNondeterministic()("text").alias("scored text")
    found = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns or docs.columns)), of)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns or docs.columns)), F.col("scored text").alias(out[0]), (F.col("scored text") >= threshold).cast("int").alias(out[1]))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    scored = score(docs, fit(docs, labels, label), threshold, out=("accepted score", "accepted"))
    return scored.where("accepted = 1").select(*(F.col(f"`{c}`") for c in docs.columns))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have the score of the intercept. Repeated rows have the same score. Without labelled rows every score is 1/2. A null doc_id is not held out and never labelled. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    return score(docs.select("doc_id", "text"), fit(docs, labels, label), columns=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
