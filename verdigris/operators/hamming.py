"""256-bit perceptual hashes: parsing, Hamming distance, and nearest blocked hash within a threshold.

The join is banded: of 16 bands of 16 bits, two hashes that differ in at most 15 bits agree on one, with at most 31 bits some band differs in one bit at most, and with at most 47 in two. So bands are joined by equality, those of the blocked hashes with their neighbours of up to that many bits; the queries, the side that grows, have 16 rows each whatever the threshold. From 48 bits on every pair is compared: three-bit neighbours would be a sixth of all pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = 16
BITS = 256
#: From this threshold on no band need be within two bits.
BANDED_BELOW = 48
#: Gates of the matcher: quality must exceed the one, distance must not exceed the other.
QUALITY_THRESHOLD = 49
DISTANCE_THRESHOLD = 31


def is_hash(value: Column) -> Column:
    """Exactly 64 hexadecimal digits, in either case."""
    return F.coalesce(value.rlike(r"\A[0-9a-fA-F]{64}\z"), F.lit(False))


def words(value: Column) -> Column:
    """Four 64-bit words of a hash; null for anything else (``conv`` would take it for 0)."""
    each = [F.conv(F.substring(value, 16 * k + 1, 16), 16, -10).cast("bigint") for k in range(4)]
    return F.when(is_hash(value), F.array(*each))


def distance(a: Column, b: Column) -> Column:
    """Bits that differ between two arrays of words."""
    out = F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0))))
    for k in range(1, 4):
        out = out + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    return out


def bands(value: Column) -> Column:
    """The 16 bands of an array of words, each as one number: place above 16 bits of the hash."""
    at = lambda k: F.shiftrightunsigned(F.get(value, F.lit(k // 4)), 48 - 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF).cast("bigint")).cast("int")
    return F.array(*(at(k).bitwiseOR(F.lit(k << 16)) for k in range(BANDS)))


def probes(value: Column, flips: int) -> Column:
    """The bands to look up: as they are, and with up to ``flips`` bits flipped."""
    masks = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(16), n)]
    return F.flatten(F.transform(F.array(*map(F.lit, masks)), lambda m: F.transform(bands(value), lambda b: b.bitwiseXOR(m))))


def nearest(queries: DataFrame, blocked: DataFrame, threshold: int, key: str = "id", value: str = "hash") -> DataFrame:
    """(key, distance) of the queries with a blocked hash within the threshold: the least distance.

    The threshold is between 0 and 256. Rows whose hash cannot be parsed match nothing. Repeated query hashes are looked up once, so a hash that many records share costs as one. Equal hashes are found by a plain join first; only the others are probed. No side is broadcast by force: the optimizer does so where a side's size allows. Bands are never broadcast: an exploded array counts as one row in the optimizer's sizes, so it would take a few hundred times as much for small.
    """
    if not 0 <= threshold <= BITS:
        raise ValueError("threshold must be between 0 and 256")
    parsed = lambda df, name: df.select("*", words(F.col(name)).alias("w")).where("w is not null")
    wanted = parsed(queries.select(F.col(key), F.col(value).alias("hash")), "hash").select(key, "w")
    index = parsed(blocked.select(F.col(value).alias("hash")), "hash").select(F.col("w").alias("x")).distinct()
    each = wanted.select("w").distinct()
    exact = each.join(index, F.col("w") == F.col("x"), "left_semi").select("w", F.lit(0).alias("distance"))
    rest = each.join(index, F.col("w") == F.col("x"), "left_anti")
    if threshold == 0:
        found = exact
    else:
        if threshold < BANDED_BELOW:
            left = rest.select("w", F.explode(bands(F.col("w"))).alias("band"))
            pairs = left.join(index.select("x", F.explode(probes(F.col("x"), threshold // BANDS)).alias("band")).hint("merge"), "band")
        else:
            pairs = rest.join(index, distance(F.col("w"), F.col("x")) <= threshold)
        near = pairs.select("w", distance(F.col("w"), F.col("x")).alias("distance")).where(F.col("distance") <= threshold)
        found = exact.unionByName(near.groupBy("w").agg(F.min("distance").alias("distance")))
    first = F.get("w", F.lit(0))  # nothing is dealt by it yet, so the join deals both sides anew and can split the records of one hash
    return wanted.withColumn("w0", first).join(found.withColumn("w0", first), ["w", "w0"]).select(key, "distance")


def match_signal(hashes: DataFrame, blocked: DataFrame, quality: int = QUALITY_THRESHOLD, threshold: int = DISTANCE_THRESHOLD, key: str = "content_id") -> DataFrame:
    """The signal of the rows (key, hash, quality): quality_accepted, has_comparison, matched, distance (-1 without a match). Rows of low quality are not compared."""
    good = hashes.where(F.col("quality") > quality)
    found = nearest(good.select(key, "hash"), blocked, threshold, key).withColumnRenamed(key, "found_key")
    some = blocked.where(is_hash(F.lower(F.col("hash")))).limit(1).agg((F.count("*") > 0).alias("some"))
    out = hashes.join(found, F.col(key) == F.col("found_key"), "left").join(some)
    accepted = F.coalesce(F.col("quality") > quality, F.lit(False))
    return out.select(key, "hash", "quality", accepted.alias("quality_accepted"), (accepted & F.col("some")).alias("has_comparison"), F.col("distance").isNotNull().alias("matched"), F.coalesce("distance", F.lit(-1)).alias("distance"))


# Further operations on hashes


def bitwise(name: str, a: Column, b: Column | None = None) -> Column:
    """and, or, xor or not of hashes as arrays of words."""
    if name == "not":
        return F.transform(a, F.bitwise_not)
    one = {"and": lambda x, y: x.bitwiseAND(y), "or": lambda x, y: x.bitwiseOR(y), "xor": lambda x, y: x.bitwiseXOR(y)}[name]
    return F.zip_with(a, b, one)


def hexed(value: Column) -> Column:
    """Array of words as 64 lower-case digits."""
    return F.lower(F.array_join(F.transform(value, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def norm(value: Column) -> Column:
    """Bits that are set."""
    return F.aggregate(value, F.lit(0), lambda n, w: n + F.bit_count(w))


def with_bit(value: Column, bit: int, flip: bool = False) -> Column:
    """The hash with one bit (0 is the last digit's lowest) set, or flipped."""
    word, mask = 3 - bit // 64, 1 << (bit % 64)
    mask -= (1 << 64) if mask >= 1 << 63 else 0
    change = lambda w: w.bitwiseXOR(F.lit(mask).cast("bigint")) if flip else w.bitwiseOR(F.lit(mask).cast("bigint"))
    return F.transform(value, lambda w, i: F.when(i == word, change(w)).otherwise(w))


def order_key(value: Column) -> Column:
    """What hashes are ordered by: their 16-bit words as signed numbers, the last word first."""
    word = lambda k: F.shiftright(F.shiftleft(F.get(value, F.lit(k // 4)), 16 * (k % 4)), 48).cast("int")
    return F.array(*(word(k) for k in reversed(range(BANDS))))


def fuzzed(value: Column, flips: int, seed: int = 0) -> Column:
    """The hash with ``flips`` bits flipped one after the other, at places drawn by seed and hash; a place may be drawn twice, and is then as before."""
    bit = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), value), F.lit(BITS))
    mask = lambda i, word: F.when(F.floor(bit(i) / 64) == word, F.expr("1L")).otherwise(F.expr("0L"))
    out = value
    for i in range(flips):
        masks = F.array(*(F.call_function("shiftleft", mask(i, k), F.pmod(bit(i), F.lit(64)).cast("int")) for k in range(4)))
        out = F.zip_with(out, masks, lambda w, m: w.bitwiseXOR(m))
    return out


def printed(value: Column, form: str) -> Column:
    """A hash as ``longs`` (four signed numbers), ``words`` (sixteen of four digits), ``bits`` (sixteen lines of bits, each after a blank) or ``across`` (these in one line)."""
    if form == "longs":
        return F.array_join(F.transform(value, lambda w: w.cast("string")), " ")
    if form == "words":
        return F.trim(F.regexp_replace(hexed(value), "(.{4})", "$1 "))
    digits = F.array_join(F.transform(value, lambda w: F.lpad(F.bin(w), 64, "0")), "")
    spaced = F.regexp_replace(digits, "(.)", " $1")
    return spaced if form == "across" else F.rtrim(F.regexp_replace(spaced, "(.{32})", "$1\n"), F.lit("\n"))
