r"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: the sources, in code point order (null last), have weights that repeat a cycle. They share ``percent`` of all words; a target stops at CAP times its source's size and the excess goes to the others by weight, until none is above.
2. Blocks: the targets' words are seats that sources get by highest quotients target / (2k + 1) (Sainte-Laguë), which rounds them so that they add up. A block is BLOCK_WORDS words. A source's whole blocks go to its shards by highest quotients of the shards' words; what is left, and what shards have no room for as whole blocks, goes to the next quotients as short blocks. So a source gives its target to the word.
3. Selection: a shard's documents are put in an order by a seeded hash and laid end to end as a ring of words, cut into blocks. The seed draws the block at which the quota begins; from there the quota's blocks go along the ring, once around for each full repeat, so documents are cut at the two ends of the run alone. What blocks cover of a document is taken from its start on; no document is taken more than CAP times.

A shard is a share of a source's documents by a hash of doc_id and text, so a hot source, or rows of one doc_id or none, are spread over many shards and a small source is whole. Only rows that repeat both are in one shard. The driver holds a row for each source, and one task the shards of one source.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small_batches, written

WEIGHTS = (3, 1, 2)
PERCENT = 150
CAP = 2
BLOCK_WORDS = 64
#: A source's shards: one for SMALL_SHARD of its rows and SHARD_BLOCKS blocks of its words up to SHARDS of them, later one for LARGE_SHARD rows.
SMALL_SHARD, SHARD_BLOCKS, SHARDS, LARGE_SHARD = 400, 64, 256, 20_000
SEED = 17


def words(text: Column) -> Column:
    r"""The number of [^\x20\x09-\x0D]+ in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], percent: float = PERCENT, cap: float = CAP) -> list[float]:
    """What each source is to give: the total by weight, at most cap times its size, the excess shared again by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), sum(sizes) * percent / 100
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def sainte_lague(shares: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by highest quotients share / (2k + 1), ties to the earlier one, none above its ``most``.

    The quotients above a threshold q are counted at once (round(share / 2q)); bisection finds a q that gives few seats too few, and these are then given one by one.
    """
    s, top = np.asarray(shares, float), np.asarray(most, np.int64)
    seats = int(min(seats, top[s > 0].sum()))
    if seats <= 0:
        return [0] * len(s)
    given = lambda q: np.where(s > 0, np.minimum(np.floor(s / (2 * q) + 0.5).astype(np.int64), top), 0)
    high, low = s.max() * 2, s.max()
    while given(low).sum() < seats:
        low /= 2
        if low < 1e-300:
            break
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        if given(mid).sum() <= seats:
            high = mid
        else:
            low = mid
    out = given(high)
    heap = [(-s[i] / (2 * out[i] + 1), i) for i in range(len(s)) if s[i] > 0 and out[i] < top[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < top[i]:
            heapq.heappush(heap, (-s[i] / (2 * out[i] + 1), i))
    return [int(x) for x in out]


def quotas(sizes: Sequence[int], words: int, block: int, cap: int) -> list[int]:
    """The words that each shard gives, ``words`` in all where the sizes allow it: whole blocks first, then short ones by the next quotients."""
    blocks = sainte_lague(sizes, words // block, [x * cap // block for x in sizes])
    out = [n * block for n in blocks]
    left = words - sum(out)
    # Either less than a block is left or no shard has room for a whole one.
    for i in sorted(range(len(out)), key=lambda i: (-sizes[i] / (2 * blocks[i] + 1), i)):
        short = min(left, sizes[i] * cap - out[i])
        out[i] += short
        left -= short
    return out


def _quotas(block: int, cap: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        pdf["quota"] = quotas([int(x) for x in pdf["shard_size"]], int(pdf["words"].iloc[0]), block, cap)
        return pdf[["source_no", "shard", "shard_size", "quota"]]

    return run


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, percent: float = PERCENT, cap: int = CAP, block_words: int = BLOCK_WORDS, seed: int = SEED, carried: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, and ``carried`` if given.

    Each source's ``taken`` add up to its target, rounded. A null text has no words; a document without words is taken 0 times. A null source is a source of its own, the last. Repeated rows are documents of their own, in the order of their text's hash. The same rows and seed give the same result, however they are partitioned. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"), (F.lit(0) if carried is None else carried).alias("carried"))
    if carried is None:
        sized = cut(sized)  # narrow rows; what is carried is read again instead
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    sizes, shares = [r["size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))]
    wanted = targets(sizes, shares, percent, cap)
    given = sainte_lague(wanted, round(sum(wanted)), [x * cap for x in sizes])
    shards = [max(1, min(r["n"] // SMALL_SHARD, r["size"] // (SHARD_BLOCKS * block_words), SHARDS), r["n"] // LARGE_SHARD) for r in totals]
    schema = "source string, source_no int, source_size bigint, target double, words bigint, shards bigint"
    # Written, so that the optimizer knows its size.
    sources = written(spark.createDataFrame([(r["source"], i, sizes[i], wanted[i], given[i], shards[i]) for i, r in enumerate(totals)], schema).coalesce(1), "sources")
    placed = sized.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "words")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), F.col("shards")).cast("int"))
    each = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"))
    dealt = each.join(sources.select("source_no", "words"), "source_no").groupBy("source_no").applyInPandas(_quotas(block_words, cap), "source_no int, shard int, shard_size bigint, quota bigint")
    ring = W.partitionBy("source_no", "shard").orderBy("draw", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = placed.withColumn("end", F.sum("size").over(ring)).join(dealt, ["source_no", "shard"])
    around = F.greatest("shard_size", F.lit(1))
    rest, repeats = F.col("quota") % around, F.floor(F.col("quota") / around).cast("long")
    # The run of blocks that the rest is, from the drawn one on; what goes beyond the ring's end goes on at its beginning.
    begin = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.ceil(around / block_words).cast("long")) * block_words
    start = F.col("end") - F.col("size")
    covered = lambda low, high: F.greatest(F.least(F.col("end"), high) - F.greatest(start, low), F.lit(0).cast("long"))
    part = covered(begin, F.least(begin + rest, around)) + covered(F.lit(0).cast("long"), begin + rest - around)
    return laid.select("doc_id", "size", "source_size", "target", (repeats * F.col("size") + part).cast("long").alias("taken"), "source", *([] if carried is None else ["carried"]))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document taken k whole times and w words over gives k rows and one of its first w words, with text and n_chars cut accordingly."""
    rows = mix(docs, carried=F.struct(*(F.col(f"`{c}`") for c in docs.columns)), **options).where("taken > 0")
    full, over = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    # A null stands for a whole copy.
    copies = F.concat(F.array_repeat(F.lit(None).cast("long"), full), F.when(over > 0, F.array(over)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select("carried", F.explode(copies).alias("words"))
    text = F.col("carried.text")
    # Words with the white space after them, from the first word on.
    head = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    parts = F.split(F.substring(text, F.char_length(head) + 1, F.char_length(text)), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    short = F.concat(head, F.rtrim(F.array_join(F.slice(parts, F.lit(1), F.coalesce("words", F.lit(1)).cast("int")), "")))
    out = rows.select(*(F.col(f"carried.`{c}`").alias(c) for c in docs.columns if c != "text"), F.when(F.col("words").isNull(), text).otherwise(short).alias("text"), F.col("words").isNull().alias("whole copy"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("whole copy"), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
