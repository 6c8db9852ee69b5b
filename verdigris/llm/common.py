"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.session import small_batches as small_batches

#: The characters of [\x20\x09-\x0D], which part words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = r"[\x20\x09-\x0D]+"


class Kept(dict):
    """What ``make`` gives for each word, kept for up to ``most`` words and as many before them. Words asked for again stay, so common ones do; words over LONGEST are made each time."""

    LONGEST = 64

    def __init__(self, make: Callable, most: int = 1 << 17) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if (value := self.old.get(word)) is None:
            value = self.make(word)
        if len(word) <= self.LONGEST:
            self[word] = value
        return value


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder takes its place in local mode, where one machine does all; on a cluster that is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="verdigris-"))
        return context._jsc.sc().getCheckpointDir().get()
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder. Spark removes the files with the last reference where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidied(spark: SparkSession) -> None:
    """Has the driver collect garbage, so that Spark removes the files of shuffles and checkpoints that nothing refers to now, and not some time later. For operators of many steps, whose files would add up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, so that the optimizer knows its size."""
    df.write.parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what ``scratch`` named, on whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
