"""Stored hashes: the observed ones, appended once each, and versioned snapshots of the blocklist."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OBSERVED = "content_id string, hash string, quality int"


def first_of_each(hashes: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each (content_id, hash): the first by ``order``, else the one of least quality."""
    by = [F.col(order)] if order else []
    at = W.partitionBy("content_id", "hash").orderBy(*by, "quality")
    return hashes.withColumn("row_number", F.row_number().over(at)).where("row_number = 1").drop("row_number")


def new_hashes(hashes: DataFrame, existing: DataFrame | None, order: str | None = None) -> DataFrame:
    """What an insert that leaves stored pairs alone would add."""
    fresh = first_of_each(hashes, order)
    return fresh if existing is None else fresh.join(existing.select("content_id", "hash"), ["content_id", "hash"], "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _claimed(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; false where it is there already, so of several callers one is told true."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file":
        return files.createNewFile(p)
    # Hadoop's local file system looks and then creates, which two writers can do at once.
    local = Path(p.toUri().getPath())
    local.parent.mkdir(parents=True, exist_ok=True)
    try:
        local.touch(exist_ok=False)
    except FileExistsError:
        return False
    return True


def append_observed(hashes: DataFrame, path: str, order: str | None = None) -> None:
    """Adds the pairs that ``path`` does not hold; running it again adds nothing. Hashes of low quality are stored too."""
    spark = hashes.sparkSession
    existing = spark.read.schema(OBSERVED).parquet(path) if _exists(spark, path) else None
    fresh = new_hashes(hashes, existing, order).select("content_id", "hash", F.col("quality").cast("int"), F.current_timestamp().alias("created_at"))
    fresh.write.mode("append").parquet(path)


def observed_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("hash_count"))


class Blocklist:
    """Snapshots of blocked hashes, one folder for each revision. Every write call, whatever it changes, makes the next revision; a reader that holds one is not disturbed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def revision(self) -> int | None:
        """The current revision; null before the first write. A snapshot counts only once its marker is written."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/revisions")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return max((int(f.getPath().getName()) for f in files.listStatus(folder)), default=None) if files.exists(folder) else None

    def write(self, hashes: DataFrame) -> int:
        """Replaces the list by the rows (hash, reason). Writers at the same time get numbers of their own; a number whose writer fails is left out."""
        n = (self.revision() or 0) + 1
        while not _claimed(self.spark, f"{self.path}/claims/{n}"):
            n += 1
        hashes.select(F.lower("hash").alias("hash"), F.coalesce("reason", F.lit("policy_match")).alias("reason") if "reason" in hashes.columns else F.lit("policy_match").alias("reason")).dropDuplicates(["hash"]).write.mode("overwrite").parquet(f"{self.path}/snapshot-{n}")
        _claimed(self.spark, f"{self.path}/revisions/{n}")
        return n

    def read(self, revision: int | None = None) -> DataFrame:
        """(revision, hash): a row for each hash, or one row with a null hash where the list is empty."""
        revision = revision or self.revision()
        if revision is None:
            raise LookupError("the blocklist has no revision")
        rows = self.spark.read.parquet(f"{self.path}/snapshot-{revision}").select("hash")
        return snapshot(self.spark.createDataFrame([(revision,)], "revision bigint"), rows)


def snapshot(revision: DataFrame, blocked: DataFrame) -> DataFrame:
    """The one-row table of the revision, left-joined to every blocked hash: an empty list still tells its revision."""
    return revision.join(blocked.select("hash"), F.lit(True), "left")


def hashes_of(rows: DataFrame) -> DataFrame:
    """The hashes of a snapshot. Rows of several revisions, or no row, are an error."""
    seen = rows.agg(F.count_distinct("revision").alias("n")).first()["n"]
    if seen != 1:
        raise LookupError(f"a snapshot must have one revision, not {seen}")
    return rows.where("hash is not null").select("hash")


class CachedBlocklist:
    """For micro-batches: the hashes are read again only when a newer revision is seen; an older one is an error."""

    def __init__(self, store: Blocklist) -> None:
        self.store, self.held, self.hashes = store, None, None

    def current(self) -> DataFrame:
        seen = self.store.revision()
        if seen is None:
            raise LookupError("the blocklist has no revision")
        if self.held is None or self.held < seen:
            self.hashes, self.held = hashes_of(self.store.read(seen)), seen
        elif self.held > seen:
            raise LookupError(f"revision went back from {self.held} to {seen}")
        return self.hashes
