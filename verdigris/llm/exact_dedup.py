"""Exact deduplication by a log-structured merge index of digests, with DataFrame operations only.

* Memtable: each document gives one entry (digest, best candidate, count). A memtable is a share of the documents by a hash of doc_id and digest, of MEMTABLE entries at most or so, so one group of copies, however large, is spread over all of them, and the partial aggregate leaves one row of it per task.
* Flush: each memtable becomes a run of level 0: digests in order, one row each, with Parquet's Bloom filters and min/max statistics, so that a point lookup of a digest skips runs and row groups.
* Hits: RATIO runs make a group. Each run has a filter, in buckets of 4 KB; each entry probes the filters of the other runs of its group, where it meets them by bucket. An entry that no filter knows is in its run alone.
* Compaction: entries that other runs may hold are merged by digest, the best candidate stays (most code points, then smallest identifier), the others go to the next level unmerged. A group becomes one run of the next level, until one run is left.
* Digests of more than one document receive byte verification: the normalised texts of a digest are compared by their least and greatest, first per digest and salt. A digest whose texts differ is split by its bytes.

Only hits' texts are compared; entries, runs and marks are narrow rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, cut, removed, scratch, text_or_empty

#: Entries of a memtable, and runs of a level that are compacted into one of the next.
MEMTABLE, RATIO = 1 << 22, 8
#: Bits of a filter for each entry of its run, and of a bucket (those of ``bitmap_construct_agg``).
BITS_EACH, BUCKET = 32, 1 << 15
SALTS = 64


def normalised(text: Column) -> Column:
    r"""The text without the characters of [\x20\x09-\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def entries(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    return docs.select("doc_id", digest(normalised(F.col("text"))).alias("digest"), F.char_length(text_or_empty()).alias("n_cp"))


def best_of() -> Column:
    """Of not_id the greatest is the smallest identifier; null loses."""
    return F.max(F.struct("n_cp", F.bitwise_not(F.col("doc_id")).alias("not_id")))


def flush(memtables: DataFrame, path: str, runs: int) -> DataFrame:
    """Writes the sorted runs of level 0 below ``path``, one folder each, and reads them back. A Parquet filter is as large as the digests of one file ask for."""
    best = memtables.groupBy(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(runs)).cast("int").alias("run"), "digest").agg(best_of().alias("best"), F.count("*").alias("n"))
    return _written(best, path, max(64, 2 * memtables.count() // (runs * int(memtables.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def _written(runs: DataFrame, path: str, each: int) -> DataFrame:
    (
        runs.sortWithinPartitions("run", "digest")
        .write.option("parquet.bloom.filter.enabled#digest", "true")
        .option("parquet.bloom.filter.expected.ndv#digest", str(each))
        .partitionBy("run")
        .parquet(path)
    )
    return runs.sparkSession.read.schema("digest binary, best struct<n_cp int, not_id bigint>, n bigint, run int").parquet(path)


def _addressed(runs: DataFrame, each: int) -> DataFrame:
    """The entries with their run's group, the bucket of the filters that they fall in and their two bits there. ``each``: entries of a run, which the filters are sized by."""
    buckets, h = max(1, -(-each * BITS_EACH // BUCKET)), F.xxhash64("digest")
    bit = lambda at: F.shiftrightunsigned(h, at).bitwiseAND(F.lit(BUCKET - 1).cast("bigint")).cast("int")
    return runs.select("*", F.floor(F.col("run") / RATIO).cast("int").alias("group"), F.pmod(F.shiftrightunsigned(h, 30), F.lit(buckets)).alias("bucket"), bit(0).alias("bit0"), bit(15).alias("bit1"))


def probed(runs: DataFrame, each: int) -> DataFrame:
    """The entries (run, digest, best, n, group) with ``maybe``: whether another run of the group may hold the digest, by that run's filter. A filter is a bitmap for each bucket, of two bits for each entry, so it says no to all but a few hundredths of strange digests and yes to all own ones."""
    addressed = _addressed(runs, each)
    both = addressed.select("group", "run", "bucket", F.explode(F.array("bit0", "bit1")).alias("bit")).groupBy("group", "run", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    filters = both.groupBy("group", "bucket").agg(F.collect_list(F.struct("run", "bits")).alias("filters"))
    byte = lambda bits, bit: F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = lambda bits, bit: F.call_function("shiftright", byte(bits, bit), F.pmod(bit, F.lit(8))).bitwiseAND(F.lit(1)) == 1
    told = F.exists("filters", lambda f: (f["run"] != F.col("run")) & has(f["bits"], F.col("bit0")) & has(f["bits"], F.col("bit1")))
    return addressed.join(filters, ["group", "bucket"]).select("run", "digest", "best", "n", "group", told.alias("maybe"))


def compacted(marked: DataFrame) -> DataFrame:
    """The entries (run, digest, best, n) of the next level: those that may be in several runs are merged by digest, the others go on as they are."""
    alone = marked.where("not maybe").select(F.col("group").alias("run"), "digest", "best", "n")
    return alone.unionByName(marked.where("maybe").groupBy(F.col("group").alias("run"), "digest").agg(F.max("best").alias("best"), F.sum("n").alias("n")))


def merged(runs: DataFrame, path: str, many: int, total: int) -> DataFrame:
    """All runs as one level of a single run: (run, digest, best, n). Levels are written below ``path`` until RATIO runs are left."""
    level = 0
    while many > 1:
        marked, many, level = probed(runs, -(-total // many)), -(-many // RATIO), level + 1
        runs = compacted(marked)
        if many > 1:
            runs = _written(runs, f"{path}-{level}", max(64, 2 * total // many))
    return runs


def named(runs: DataFrame) -> DataFrame:
    """digest, keep_id and group_size."""
    return runs.select("digest", F.bitwise_not(F.col("best.not_id")).alias("keep_id"), F.col("n").alias("group_size"))


def lookup(path: str, spark: SparkSession, digests: list[bytes]) -> DataFrame:
    """Point lookup in flushed runs; row groups whose Parquet filter or statistics exclude the digests are not read."""
    found = spark.read.parquet(path).where(F.col("digest").isin([F.lit(x) for x in digests]))
    return named(found.groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("n")))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, memtable: int = MEMTABLE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Two texts are equal when they have the same bytes without ASCII white space. Null texts count as empty, and empty texts are equal to each other. Of equal texts the row with the most code points stays, then the smallest doc_id; a null doc_id loses to any other, and where all are null, keep_id is null and kept is true. Rows that repeat the kept doc_id all have kept = true, since nothing tells them apart. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    memtables = cut(entries(docs, digest))
    # Cut, so that both sides of the join are plain shuffles and a hot digest's partition can be split.
    path, total = scratch(spark, "runs"), memtables.count()
    many = max(RATIO, -(-total // memtable))
    hits = cut(named(merged(flush(memtables, path, many), path, many, total)).where("group_size > 1"))
    for level in range(len(str(many)) + 1):
        removed(spark, f"{path}-{level}" if level else path)
    marks = cut(
        memtables.join(hits, "digest", "left").select(
            "doc_id", "digest", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")
        )
    )
    collided = cut(verify(docs, marks, digest))
    if not collided.isEmpty():
        marks = split_by_bytes(docs, marks, collided, digest)
    hexed = F.lower(F.hex("digest")) if digest is sha256 else F.lit(None).cast("string")
    return marks.select("doc_id", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"), hexed.alias("text_sha256"))


def verify(docs: DataFrame, marks: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The digests that stand for texts of different bytes."""
    # A row without doc_id is known by its digest, which is made for such rows alone before the hits are found.
    known = lambda of: F.coalesce("doc_id", F.xxhash64(of)).alias("known")
    norm = normalised(F.col("text"))
    hits = marks.where("group_size > 1").select(known(F.col("digest")))
    texts = docs.select("doc_id", "text", known(digest(norm))).join(hits, "known", "left_semi").select(digest(norm).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), norm.alias("norm"))
    each = texts.groupBy("digest", "salt").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return each.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("digest")


def split_by_bytes(docs: DataFrame, marks: DataFrame, collided: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The marks, with those of collided digests grouped by digest and bytes instead."""
    rows = docs.select("doc_id", digest(normalised(F.col("text"))).alias("digest"), normalised(F.col("text")).alias("norm"), F.char_length(text_or_empty()).alias("n_cp")).join(collided, "digest", "left_semi")
    groups = rows.groupBy("digest", "norm").agg(best_of().alias("best"), F.count("*").alias("group_size"))
    again = rows.join(groups, ["digest", "norm"]).select("doc_id", "digest", F.bitwise_not(F.col("best.not_id")).alias("keep_id"), "group_size")
    return marks.join(collided, "digest", "left_anti").select("doc_id", "digest", "keep_id", "group_size").unionByName(again)
