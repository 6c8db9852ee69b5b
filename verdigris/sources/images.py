"""Images: what their headers say, before anything is decoded, and their pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from verdigris.session import shared_folder, small_batches

MOST_BYTES = 10 * 1024 * 1024
MOST_PIXELS = 40_000_000

HEADER = StructType([StructField("format", StringType()), *(StructField(n, IntegerType()) for n in ("width", "height", "frames"))])


def header(data: bytes) -> tuple[str | None, int | None, int | None, int | None]:
    """Format, width, height and number of frames, from the content alone; nulls where it is none of JPEG, PNG and GIF, or broken."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return ("png", *struct.unpack(">II", data[16:24]), 1)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("gif", *struct.unpack("<HH", data[6:10]), _gif_frames(data))
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
    except (struct.error, IndexError):
        pass
    return None, None, None, None


def _jpeg(data: bytes) -> tuple:
    at = 2
    while data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        # Start-of-frame segments have the size; C4, C8 and CC are other segments of that range.
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return "jpeg", width, height, 1
        at += 2 if kind == 0x01 or 0xD0 <= kind <= 0xD8 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None, None, None, None


def _gif_frames(data: bytes) -> int:
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    at, frames = 13 + table(data[10]), 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x2C:
            frames += 1
            at += 10 + table(data[at + 9]) + 1
        elif data[at] == 0x21:
            at += 2
        else:
            raise IndexError("no GIF block")
        while data[at]:
            at += 1 + data[at]
        at += 1
    return frames


def _headers(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header(bytes(c)) if c is not None else (None,) * 4 for c in contents], columns=HEADER.names).astype({"width": "Int32", "height": "Int32", "frames": "Int32"})


image_header = F.pandas_udf(_headers, HEADER)


def header_fault(h: Column, most_pixels: int = MOST_PIXELS) -> Column:
    """Why an image of that header must not be decoded; null where it may."""
    pixels = h["width"].cast("long") * h["height"]
    return (
        F.when(h["format"].isNull(), "unsupported or invalid image")
        .when((h["width"] <= 0) | (h["height"] <= 0), "invalid or unsafe image")
        .when(pixels > most_pixels, "image exceeds pixel limit")
        .when((h["format"] == "gif") & (h["frames"] > 1), "animated images are not supported")
    )


def judged(images: DataFrame, content: str = "content", size: str = "size") -> DataFrame:
    """The rows with header and fault: emptiness, size, then what the header says. Contents beyond the size limit are not looked at."""
    fits = F.col(size) <= MOST_BYTES
    with_header = images.withColumn("header", image_header(F.when(fits, F.col(content))))
    return with_header.withColumn("fault", F.when(F.col(size) == 0, "empty image").when(~fits, "image exceeds size limit").otherwise(header_fault(F.col("header"))))


def _binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, content) of the files below a path (Spark's source passes over files of no bytes). Of files beyond the size limit the content is null and is not read."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= MOST_BYTES).select("path", F.col("length").alias("size"), "content")
    return small.unionByName(files.where(F.col("length") > MOST_BYTES).select("path", F.col("length").alias("size"), F.lit(None).cast("binary").alias("content")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, header, fault) of the files below a path."""
    return judged(_binary(spark, path)).select("path", "size", "header", "fault")


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, nChannels, data) of the files that may be decoded and can be."""
    return decoded(judged(_binary(spark, path)), "path")


def _stage(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        for pdf in batches:
            for digest, content in zip(pdf["digest"], pdf["content"], strict=True):
                with files.open_output_stream(f"{base}/{digest}", compression=None) as out:
                    out.write(content)
            yield pdf[["digest"]]

    return run


def decoded(images: DataFrame, key: str) -> DataFrame:
    """(key, height, width, nChannels, data) of the judged rows (key, content, fault) that may be decoded and can be.

    Only what has passed the gates is given to the decoder: it is put, each content once and named by its digest, into a new folder of the shared ones, which Spark's image source reads. A task that runs again writes the same files.
    """
    spark = images.sparkSession
    good = images.where("fault is null").select(key, F.sha2("content", 256).alias("digest"), "content")
    folder = shared_folder(spark, "images")
    small_batches(spark, MOST_BYTES)
    staged = good.select("digest", "content").dropDuplicates(["digest"]).mapInPandas(_stage(folder), "digest string").count()
    kind = images.schema[key].dataType.simpleString()
    if not staged:
        return spark.createDataFrame([], f"{key} {kind}, height int, width int, nChannels int, data binary")
    pixels = spark.read.format("image").load(folder).where("image.height > 0")
    pixels = pixels.select(F.element_at(F.split("image.origin", "/"), -1).alias("digest"), "image.height", "image.width", "image.nChannels", "image.data")
    return good.select(key, "digest").join(pixels, "digest").drop("digest")
