r"""Document fingerprints by improved consistent weighted sampling (Ioffe, 2010), with DataFrame operations only.

A document is a weighted set: its words ([^\x20\x09-\x0D]+) weighted by their counts S. For sample i a term k draws r and c from Gamma(2, 1) and b from U(0, 1), all by hashing (k, i), and takes

    t = floor(ln S / r + b),   ln a = ln c - r * (t - b + 1)

The sample is the (k, t) of the least a. Two documents agree on a sample with probability sum(min S) / sum(max S), the generalised Jaccard similarity.

Within a row, a sample's (a, k, t) is one long: ln a in fixed point above 32 bits of hash(k, t). The fingerprint is then a plain minimum per sample, one hash aggregate over the terms in generated code, and a row's terms stay in the partition of their document, so nothing is shuffled for them.

A term that weighs as much in the edited text as in the text is drawn once for both.

Neighbours in the order of doc_id come from blocks of consecutive identifiers of at most about BLOCK_ROWS rows, cut at quantiles; an identifier (or none) that more rows share is cut further by the hash of their texts. A block gets a copy of the next block's first row, so that the next text and the next fingerprint are found within the block and the texts are shuffled once. The driver holds a few numbers for each block, so eight bytes or so for BLOCK_ROWS whole texts.

Draws come from quantile tables (see ``Draws``), which cut both tails of r and the upper tail of c at a chance of 1 in 2048 each; the tests hold the collision rate against exact similarities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES_RE, text_or_empty

SAMPLES = 64
#: Samples are drawn in chunks, a row for each term and chunk, so that the aggregate's generated code stays small enough for the JVM to compile.
CHUNK = 4
#: Rows of a block: at most about so many, and fewer where each partition would not have BLOCKS_EACH of them; but LEAST_ROWS.
BLOCK_ROWS, BLOCKS_EACH, LEAST_ROWS = 32_768, 16, 24

_LOW32 = 0xFFFFFFFF


#: Bits of a term's hash, and of its count below that; a text of so many words does not fit in a row.
TERM_BITS, COUNT_BITS = 33, 30


def word_hashes(text: Column) -> Column:
    """The hash of each word, in order of the hashes, with room for a count below."""
    words = F.filter(F.split(text, SPACES_RE), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.shiftleft(F.shiftrightunsigned(F.xxhash64(w), 64 - TERM_BITS), COUNT_BITS)))


def beginnings(hashes: str) -> Column:
    """The places in the sorted array column where a run of one term begins, and its end."""
    s, n = F.col(hashes), F.size(hashes)
    begins = F.filter(F.sequence(F.lit(0), n), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
    return F.when(n > 0, begins).otherwise(F.array().cast("array<int>"))


def weighted_terms(hashes: str, begins: str) -> Column:
    """Each distinct term with its count, in one number."""
    s, at = F.col(hashes), F.col(begins)
    return F.transform(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), lambda b, i: F.get(s, b) + (F.get(at, i + 1) - b))


BOTH, TEXT, EDITED = 0, 1, 2


def gamma_quantiles(p: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by bisection."""
    low, high = np.zeros_like(p), np.full_like(p, 64.0)
    for _ in range(80):
        mid = (low + high) / 2
        below = -np.expm1(-mid) - mid * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


class Draws:
    """Inverse transform sampling by tables of 1024 steps, linear between them; the lowest step of ln c, which decides in long texts, has a table of its own. The tables are columns made once, as making one takes a call for each value."""

    STEPS = 1024

    def __init__(self) -> None:
        n = self.STEPS
        p = np.arange(n + 1) / n
        p[0], p[-1] = 0.5 / n, 1 - 0.5 / n
        r = gamma_quantiles(p)
        table = lambda values: F.lit(np.ascontiguousarray(values, np.float64))
        fine = 1 << 12
        self.r, self.r_slope = table(r[:-1]), table(np.diff(r) / fine)
        self.c, self.c_slope = table(np.log(r[:-1])), table(np.diff(np.log(r)) / fine)
        self.lowest = table(np.log(gamma_quantiles((np.arange(n) + 0.5) / n**2)))

    def sample(self, term: Column, log_weight: Column, i: int) -> Column:
        """Sample i of a term as one long; the least of a document's terms is its sample. One hash gives the draws of r, c and b."""
        h = F.xxhash64(term, F.lit(i))
        part = lambda at, bits: F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        drawn = lambda values, slopes, at: F.get(values, part(at + 12, 10).cast("int")) + F.get(slopes, part(at + 12, 10).cast("int")) * part(at, 12)
        r = drawn(self.r, self.r_slope, 42)
        log_c = F.when(part(32, 10) == 0, F.get(self.lowest, part(22, 10).cast("int"))).otherwise(drawn(self.c, self.c_slope, 20))
        b = part(0, 20) / float(1 << 20)
        t = F.floor(log_weight / r + b)
        log_a = log_c - r * (t - b + 1.0)
        # ln a lies between -128 and 8: ln c from -8 to 3, r below 11, and r * t at most ln S + r.
        fixed = ((log_a + 128.0) * float(1 << 23)).cast("long")
        return F.shiftleft(fixed, 32).bitwiseOR(F.hash(term, t).cast("long").bitwiseAND(F.lit(_LOW32).cast("long")))


def blocks(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows with block, place and turn, and a table of edges.

    Blocks are ranges of doc_id, -1 is for null. Within a block, place 0 has the rows of common identifiers; an identifier of more rows than a block's is its block's least and has places of its own, by ranges of turn, 31 bits of the text's hash. Rows go by block, descending, then place, then identifier, descending, then turn. An edge (block, place, doc_id, turn, to_block, to_place) is the first row of a cell and the cell before it, which needs that row too; the last cell is before the first one.
    """
    spark = docs.sparkSession
    n = docs.count()
    rows = max(LEAST_ROWS, min(BLOCK_ROWS, n // (BLOCKS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    many = max(1, -(-n // rows))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)] or [0.5], 10 * many)).first()[0] or []
    bounds = sorted(set(bounds))
    # One literal, whatever the number of blocks; then the number of bounds that do not exceed doc_id, by binary search.
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    steps = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.coalesce(F.get(held, at + step - 1) <= F.col("doc_id"), F.lit(False)), step).otherwise(F.lit(0)))
    block = F.when(F.col("doc_id").isNull(), -1).otherwise(below).cast("int")
    # At most n / rows identifiers have more rows than a block.
    hot = docs.groupBy("doc_id").agg(F.count("*").alias("m")).where(F.col("m") > 2 * rows).select(F.col("doc_id").alias("hot_id"), F.ceil(F.col("m") / rows).cast("long").alias("cells"))
    hot = spark.createDataFrame(hot.collect(), "hot_id bigint, cells bigint")
    turn = F.shiftrightunsigned(F.xxhash64("text"), 33)
    placed = docs.select("*", block.alias("block"), turn.alias("turn")).join(F.broadcast(hot), F.col("doc_id").eqNullSafe(F.col("hot_id")), "left")
    place = F.coalesce(F.shiftright(F.col("turn") * F.col("cells"), 31) + 1, F.lit(0)).cast("int")
    placed = placed.select("doc_id", "text", "block", place.alias("place"), "turn")
    # Of a cell the first row: identifiers fall, turns rise.
    first = F.max(F.struct("doc_id", (-F.col("turn")).alias("turn")))
    cells = sorted(((-r["block"], r["place"], r["first"]) for r in placed.groupBy("block", "place").agg(first.alias("first")).collect()), key=lambda c: c[:2])
    if not cells:
        return placed, None
    edges = [(-b, p, f["doc_id"], -f["turn"], -cells[i - 1][0], cells[i - 1][1]) for i, (b, p, f) in enumerate(cells)]
    return placed, spark.createDataFrame(edges, "in_block int, in_place int, first_id bigint, first_turn bigint, to_block int, to_place int")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last floor(n_chars / 3) code points are replaced by the first as many (or all) of the next document, in descending order of doc_id; the first document follows the last. Null texts count as empty. Rows of one doc_id follow each other by their texts' hashes, null identifiers come last; rows that repeat one doc_id and text are alike and in one block. A text without words has the fingerprint of the empty set: likeness 1 to another empty one, 0 to all others. A single document is its own next one; an empty table gives no rows. Other columns are not read.
    """
    placed, edges = blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    placed = placed.withColumn("ghost", F.lit(False))
    if edges is not None:
        # A row for each cell, as the driver holds them.
        same = (F.col("block") == F.col("in_block")) & (F.col("place") == F.col("in_place")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("turn") == F.col("first_turn"))
        firsts = placed.join(F.broadcast(edges), same).groupBy(F.col("to_block").alias("block"), F.col("to_place").alias("place"), "doc_id", "turn").agg(F.min("text").alias("text"))
        placed = placed.unionByName(firsts.withColumn("ghost", F.lit(True)))
    # Dealt out here, by number: the work is in the terms, so partitions must not be merged for their few bytes.
    placed = placed.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "place")
    order = W.partitionBy("block", "place").orderBy("ghost", F.desc_nulls_last("doc_id"), "turn", "text")
    size, third = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    # What belongs to the document travels as whole numbers, which a hash aggregate keeps in place.
    key = ["block", "place", "at"]
    words = [F.conv(F.substring("edited_sha256", 16 * k + 1, 16), 16, -10).cast("bigint").alias(f"w{k}") for k in range(4)]
    held = ["ghost", "doc_id", "n_chars", *(f"w{k}" for k in range(4))]
    rows = (
        placed.withColumn("at", F.row_number().over(order))
        .withColumn("next_text", F.lead("text").over(order))
        .select(*key, F.col("ghost").cast("int").alias("ghost"), "doc_id", "text", size.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), size - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third)).alias("edited"))
        .select(*key, "ghost", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), word_hashes(F.col("text")).alias("h0"), word_hashes(F.col("edited")).alias("h1"))
        .select(*key, "ghost", "doc_id", "n_chars", *words, "h0", "h1", beginnings("h0").alias("b0"), beginnings("h1").alias("b1"))
        .select(*key, *held, weighted_terms("h0", "b0").alias("t0"), weighted_terms("h1", "b1").alias("t1"))
    )
    # A term that has one count in both texts is drawn once. Of an empty list a row stays, which gives no sample.
    lists = [(BOTH, F.array_intersect("t0", "t1")), (TEXT, F.array_except("t0", "t1")), (EDITED, F.array_except("t1", "t0"))]
    terms = rows.select(*key, *held, F.explode(F.array(*(F.struct(F.lit(of).alias("of"), t.alias("t")) for of, t in lists))).alias("x"))
    terms = terms.select(*key, *held, F.col("x.of").alias("of"), F.explode_outer("x.t").alias("t"))
    weight = F.col("t").bitwiseAND(F.lit((1 << COUNT_BITS) - 1).cast("long"))
    terms = terms.select(*key, *held, "of", F.shiftright("t", COUNT_BITS).alias("term"), F.ln(weight.cast("double")).alias("log_weight"))
    terms = terms.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples // CHUNK - 1))).alias("chunk")).withColumn("drawn", F.xxhash64("term", "chunk"))
    draws = Draws()
    # The document's own columns are keys, since that costs less than to aggregate them; so the code of the innermost loop stays small enough to be compiled.
    drawn = [draws.sample(F.col("drawn"), F.col("log_weight"), i).alias(f"x{i}") for i in range(CHUNK)]
    found = terms.select(*key, *held, "chunk", "of", *drawn).groupBy(*key, *held, "chunk", "of").agg(*(F.min(f"x{i}").alias(f"x{i}") for i in range(CHUNK)))
    least = [F.min(F.when(F.col("of") != other, F.col(f"x{i}"))).alias(f"s{w}_{i}") for i in range(CHUNK) for w, other in ((0, EDITED), (1, TEXT))]
    found = found.groupBy(*key, *held, "chunk").agg(*least)
    bits = lambda w: F.array(*((F.col(f"s{w}_{i}").bitwiseAND(F.lit(_LOW32).cast("long")) - (1 << 31)).cast("int") for i in range(CHUNK)))
    found = found.select(*key, *held, "chunk", bits(0).alias("sig"), bits(1).alias("edited_sig"))
    # A document's chunks in order; they are in one partition already.
    found = found.groupBy(*key, *held).agg(F.sort_array(F.collect_list(F.struct("chunk", "sig", "edited_sig"))).alias("parts"))
    digits = lambda sig: F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(F.coalesce(x.cast("long") + (1 << 31), F.lit(0))), 8, "0")), ""))
    sha = F.lower(F.concat(*(F.lpad(F.hex(f"w{k}"), 16, "0") for k in range(4)))).alias("edited_sha256")
    found = found.select(*key, (F.col("ghost") == 1).alias("ghost"), "doc_id", "n_chars", sha, F.flatten(F.col("parts.sig")).alias("sig"), F.flatten(F.col("parts.edited_sig")).alias("edited_sig"))
    found = found.withColumn("next_sig", F.lead("sig").over(W.partitionBy("block", "place").orderBy("at")))
    near = lambda other: F.aggregate(F.zip_with("sig", other, lambda a, b: a.eqNullSafe(b).cast("int")), F.lit(0), lambda a, v: a + v) / float(samples)
    return found.where("not ghost").select("doc_id", "n_chars", "edited_sha256", digits(F.col("sig")).alias("fingerprint"), digits(F.col("edited_sig")).alias("edited_fingerprint"), near("edited_sig").alias("near_edited"), near("next_sig").alias("near_next"))
