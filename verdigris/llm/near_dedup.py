"""MinHash near-deduplication: fast similarity sketches, banding, exact verification on whole shingle sets.

Sketch (fast similarity sketching, Dahlgaard, Knudsen and Thorup, 2017): in round i < t every element is thrown into one of t hashed bins with the value i + u, in round t + j every element goes to bin j; a bin keeps its least value. Rounds go on until all bins are filled, so each coordinate fills, after about t log t element hashes.

Steps:

1. Documents with equal shingle sets form a class; one document, the one of smallest doc_id, stands for it.
2. Of t = rows * bands coordinates each band of ``rows`` gives a key. Two sets of similarity s share some key with probability 1 - (1 - s**rows) ** bands.
3. Every member of a bucket is compared with one member, the pivot (never all pairs): the one with most bucket neighbours in all, the likely centre of a family of copies. A compared pair counts as linked after its whole texts' shingle sets have been intersected.
4. Buckets that then still hold members of several components may hide links between members. Their documents go through an exact prefix join: shingles are put in order of rising document frequency, and two sets of the asked similarity must share one of their first n - ceil(s * n) + 1 shingles, early enough in both that what follows can still make up the overlap (positional filter). What shares one, differs in component and fits in size is compared as in step 3. Edited copies of one text differ in rare shingles, so this join stays small where a bucket's pairs would not, and it loses no link.
5. Components come from large-star and small-star steps (Kiveris and others, 2014), over tables in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Kept, cut, removed, scratch, small_batches, tidied

WORDS = 5
ROWS = 6
BANDS = 56
#: Pairs are linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Rows that one copy of a pivot's text is joined to.
FAN = 128
#: Rows of one shingle and band of sizes that a task of the prefix join compares with the others.
CELL = 512

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


class Shingler:
    r"""Sets of word shingles as sorted unique 64-bit hashes. A-Z are lower-cased and words are [^\x20\x09-\x0D]+ (``bytes.split`` parts by exactly these characters)."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.ids = words, Kept(lambda w: xxhash.xxh3_64_intdigest(w).to_bytes(8, "little"))

    def word_hashes(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.ids.__getitem__, (text or "").encode("utf-8", "surrogatepass").lower().split())), "<u8")

    def shingles(self, text: str | None) -> np.ndarray:
        h = self.word_hashes(text)
        if not len(h):
            return h
        n, m = min(self.words, len(h)), len(h) - min(self.words, len(h)) + 1
        out = np.full(m, n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                out = mixed(out * _M1 + h[j : j + m])
        return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t 64-bit coordinates for each non-empty set, computed round by round for all sets that have empty bins."""
    n = len(sets)
    out = np.full((n, t), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    active = np.flatnonzero(sizes)
    elements = np.concatenate([sets[i] for i in active]) if len(active) else np.empty(0, np.uint64)
    owner = np.repeat(active, sizes[active])
    room = np.uint64(2 * t)
    low = np.uint64((1 << 50) - 1)
    for i in range(2 * t):
        if not len(active):
            break
        with np.errstate(over="ignore"):
            h = mixed(elements ^ mixed(np.uint64(i + 1) * _M1 + _M3))
            # Of the 64 bits the upper ones choose the bin and 50 others the value; the round goes above them, so later rounds never replace earlier ones.
            bins = ((h >> np.uint64(40)) % np.uint64(t)).astype(np.int64) if i < t else np.full(len(h), i - t, np.int64)
            values = (np.uint64(i) << np.uint64(50)) | (mixed(h + _M1) & low)
        assert np.uint64(i) < room
        np.minimum.at(flat, owner * t + bins, values)
        full = (out[active] != np.iinfo(np.uint64).max).all(axis=1)
        if full.any():
            active = active[~full]
            keep = np.isin(owner, active)
            elements, owner = elements[keep], owner[keep]
    return out


def _sketched(words: int, rows: int, bands: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                sets = [shingler.shingles(x) for x in part["text"]]
                s = sketches(sets, rows * bands).reshape(len(sets), bands, rows)
                keys = np.zeros((len(sets), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(rows):
                        keys = mixed(keys * _M1 + s[:, :, j])
                    keys = mixed(keys + np.arange(1, bands + 1, dtype=np.uint64) * _M3)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].array,
                        "n_shingles": [len(x) for x in sets],
                        "class": [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets],
                        "keys": [k if len(x) else None for k, x in zip(keys.view(np.int64), sets, strict=True)],
                    }
                )

    return run


def _verified(words: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, last, known = Shingler(words), None, None
        for pdf in batches:
            linked = []
            for b, text_a, text_b in zip(pdf["b"], pdf["text_a"], pdf["text_b"], strict=True):
                if (b, text_b) != last:  # rows of one pivot come together; it may have several texts
                    last, known = (b, text_b), shingler.shingles(text_b)
                own = shingler.shingles(text_a)
                both = len(np.intersect1d(own, known, assume_unique=True))
                linked.append(bool(both) and 100 * both >= percent * (len(own) + len(known) - both))
            yield pdf.loc[linked, ["a", "b"]]

    return run


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of the distinct pairs (a, b) those that are linked. The text of a much-wanted b is copied once for each FAN of its pairs, so one b does not gather in a task."""
    # Cut, so that both sides of its joins are plain shuffles and a much-wanted b's partition can be split.
    spread = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / FAN).cast("int").alias("copies")))
    right = texts.join(spread, texts["doc_id"] == spread["b"]).select("b", F.col("text").alias("text_b"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), "copies")
    left = pairs.join(spread, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies").cast("long")).cast("int").alias("salt"))
    left = left.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(right.drop("copies"), ["b", "salt"]).select("a", "b", "text_a", "text_b")
    return both.mapInPandas(_verified(words, percent), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """doc_id and component (the smallest doc_id that links reach) of all ends of the links (a, b)."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    # Large-star and small-star steps (Kiveris and others, 2014) on edges that point to smaller identifiers.
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Cut, so that both sides of the join are plain shuffles and the edges of a large component's centre can be split.
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = cut(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("doc_id"), F.col("b").alias("component")).distinct())


def near_dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A null or empty text, or one without words, has no shingles and is linked with nothing. A text of fewer words than a shingle has is one shingle. Rows with equal shingle sets, repeated rows included, are linked. A doc_id on several rows is one document: what any of its texts is linked with, it is linked with. A row without doc_id cannot name a component: it is linked with nothing and has kept = true and a null component_id. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    base = cut(docs.mapInPandas(_sketched(words, rows, bands), "doc_id bigint, n_shingles bigint, class binary, keys array<bigint>"))
    sets = base.where("class is not null and doc_id is not null")
    classes = cut(sets.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("keys").alias("keys")))
    # A doc_id of several classes may be in a bucket twice; it is then its own neighbour, which changes nothing.
    members = classes.select("doc_id", F.explode("keys").alias("key"))
    counted = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = cut(members.join(counted, "key"))
    weights = buckets.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    docs.join(weights, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).write.parquet(path := scratch(spark, "texts"))
    texts = spark.read.schema("doc_id bigint, text string").parquet(path)

    weighed = buckets.join(weights, "doc_id").select("key", "doc_id", "weight")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("weight", F.bitwise_not(F.col("doc_id")).alias("x"))).alias("p")).select("key", F.bitwise_not(F.col("p.x")).alias("b"))
    stars = cut(weighed.join(pivots, "key").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct())
    del members, counted, weights, weighed, pivots
    tidied(spark)
    links = cut(verified(stars, texts, words, percent))
    tidied(spark)
    # One doc_id may stand for several classes, and a class has one doc_id, so links between doc_ids are all there are.
    labels = cut(components(links))
    hard = cut(_undecided(buckets, labels))
    del buckets
    tidied(spark)
    if not hard.isEmpty():
        more = cut(verified(cut(_prefix_pairs(texts, hard, words, percent).join(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")), texts, words, percent))
        tidied(spark)
        if not more.isEmpty():
            labels = cut(components(links.unionByName(more)))
    removed(spark, path)
    tidied(spark)
    # Rows of one doc_id with several texts join the classes of these texts.
    unite = sets.join(classes.select("class", F.col("doc_id").alias("rep")), "class").where("doc_id <> rep")
    again = unite.join(classes.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    if not (again := cut(again)).isEmpty():
        labels = cut(components(again.unionByName(labels.select(F.col("doc_id").alias("a"), F.col("component").alias("b")))))
    named = classes.select("class", F.col("doc_id").alias("rep")).join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
    out = base.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _undecided(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and component of all members of buckets that hold several components."""
    named = buckets.join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed_ = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return named.join(mixed_, "key").select("doc_id", "component").distinct()


def _listed(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                sets = [shingler.shingles(x).view(np.int64) for x in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "component": part["component"].array, "set": [xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in sets], "hashes": sets})

    return run


def _prefix_pairs(texts: DataFrame, hard: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b), a > b, of different components that can be linked: they share a shingle of their prefixes and fit in size."""
    listed = texts.join(hard, "doc_id").select("doc_id", "component", "text").mapInPandas(_listed(words), "doc_id bigint, component bigint, set bigint, hashes array<bigint>")
    rows = cut(listed.select("doc_id", "component", "set", F.size("hashes").alias("n"), F.explode("hashes").alias("h")))
    frequency = rows.groupBy("h").agg(F.count("*").alias("df"))
    at = F.row_number().over(W.partitionBy("doc_id", "set").orderBy("df", "h"))
    # n - ceil(percent * n / 100) + 1
    prefix = rows.join(frequency.where("df > 1"), "h", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("at", at).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1)
    prefix = cut(prefix.where("df > 1").select("doc_id", "component", "n", "h", "at"))
    del rows, frequency, listed
    tidied(texts.sparkSession)
    # Sizes that fit lie in one band or in neighbouring ones (a band is a little wider than the ratio of sizes that fit), so the larger set looks among the smaller ones of its own band and of the band below.
    width = math.log(100 / percent) * 1.001
    prefix = prefix.withColumn("band", F.floor(F.ln("n") / width).cast("int"))
    cells = prefix.select("h", "component", F.explode(F.array("band", F.col("band") + 1)).alias("band")).groupBy("h", "band")
    # Cells whose documents are all of one component join nothing; large ones are dealt out to several tasks.
    cells = cells.agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / CELL).cast("int").alias("shares")).where("low <> high").select("h", "band", "shares")
    share = F.pmod(F.xxhash64("doc_id"), F.col("shares").cast("long")).cast("int").alias("share")
    left = prefix.join(cells, ["h", "band"]).select(F.col("doc_id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("at").alias("ia"), "h", "band", share)
    right = prefix.withColumn("band", F.explode(F.array("band", F.col("band") + 1))).join(cells, ["h", "band"])
    right = right.select(F.col("doc_id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("ib"), "h", "band", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    larger = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    size_fits = 100 * F.col("nb") >= percent * F.col("na")
    # Of the pair's first common shingle: with what follows it, it must still reach the overlap that the similarity asks for.
    rest_fits = (100 + percent) * (1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))) >= percent * (F.col("na") + F.col("nb"))
    found = left.join(right, ["h", "band", "share"]).where(larger & (F.col("ca") != F.col("cb")) & size_fits & rest_fits)
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
