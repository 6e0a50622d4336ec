"""Image files to rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fissura.functions import names
from fissura.storage import few_listers, literal


def identity() -> dict[str, Column]:
    """What is known of a file before it is opened."""
    meta = "_metadata."
    path, length = F.col(meta + "file_path"), F.col(meta + "file_size")
    modified = F.unix_micros(meta + "file_modification_time")
    return {
        "image_id": F.xxhash64(path, modified, length).alias("image_id"),
        "path": path.alias("path"),
        "upload_key": names.identity_key(path, modified, length).alias("upload_key"),
        "length": length.alias("length"),
    }


def normalise(raw: DataFrame) -> DataFrame:
    """Spark's image struct plus file metadata in the ``images`` layout.

    Undecodable files stay, with a height of -1. ``image_id`` is a hash of
    path, time and size, the same in every attempt of a task; it is 64 bits, so
    check very large scans with ``output_collisions(images, "image_id")``.
    """
    known = identity()
    return raw.select(
        known["image_id"],
        known["path"],
        known["upload_key"],
        known["length"],
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("data"),
    )


def scan_images(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Decode all accepted files under ``path``.

    Type and size are checked on the listing, before a file is opened; no
    ``max_bytes``, no size check. What a scan leaves out (other types, larger
    files, empty ones) ``validation.input_report`` lists with its reason.
    """
    raw = (
        spark.read.format("image")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", names.listing_glob())
        .option("dropInvalid", "false")
        .load(path)
    )
    if max_bytes is not None:
        raw = raw.filter(F.col("_metadata.file_size") <= max_bytes)
    return normalise(raw)


def scan_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Decode the files at ``paths``, whose names are not patterns."""
    with few_listers(spark):
        raw = spark.read.format("image").option("dropInvalid", "false").load([literal(p) for p in paths])
    return normalise(raw)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, filename, length`` of every file, contents unread, for upload checks."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "length")
    )
