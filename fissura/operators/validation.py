"""Upload checks: allow-list, size cap, reject routing, naming, collisions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissura.functions import names

# User-facing messages.
MISSING_MESSAGE = "Please choose an image file to upload."
UNSUPPORTED_MESSAGE = (
    "Unsupported file type. Please upload a JPG, PNG, BMP, TIF, or WEBP image."
)
TOO_LARGE_MESSAGE = "File exceeds the 16 MB upload limit."
EMPTY_MESSAGE = "Inference failed: file is empty"
ABSENT_MESSAGE = "Inference failed: file was not found"


def check_uploads(
    uploads: DataFrame, max_bytes: int | None = names.MAX_UPLOAD_BYTES
) -> DataFrame:
    """Add ``ext``, ``reject_reason`` and ``reject_message`` (NULL when accepted).

    Without ``max_bytes`` no size is too large.
    """
    name = F.col("filename")
    too_large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    reason = (
        F.when(too_large, "too_large")
        .when(name.isNull() | (name == ""), "missing")
        .when(~names.is_allowed(name), "unsupported_type")
    )
    message = (
        F.when(F.col("reject_reason") == "too_large", TOO_LARGE_MESSAGE)
        .when(F.col("reject_reason") == "missing", MISSING_MESSAGE)
        .when(F.col("reject_reason") == "unsupported_type", UNSUPPORTED_MESSAGE)
    )
    return uploads.withColumns({"ext": names.suffix(name), "reject_reason": reason}).withColumn(
        "reject_message", message
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull()).drop("reject_reason", "reject_message")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull())


def name_uploads(uploads: DataFrame, *identity: str) -> DataFrame:
    """Add the unique ``upload_name`` and ``result_name`` of each upload."""
    key = names.identity_key(*(F.col(c) for c in identity))
    return uploads.withColumns(
        {
            "upload_name": names.upload_name(key, F.col("filename")),
            "result_name": names.result_name(key),
        }
    )


def output_collisions(results: DataFrame, column: str = "out_path") -> DataFrame:
    """Result paths that more than one input would write."""
    return (
        results.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_inputs"))
        .filter(F.col("n_inputs") > 1)
    )


def input_report(
    inputs: DataFrame, report: DataFrame, max_bytes: int | None = names.MAX_UPLOAD_BYTES
) -> DataFrame:
    """One row per listed input, with what became of it.

    ``inputs`` is ``path, filename, length`` of everything handed in, ``report``
    the rows of the images that were processed (``path, status, message``).
    Inputs that fail a check carry its reason; accepted ones that no scan
    returned are ``empty`` or ``absent``.
    """
    done = report.select("path", F.col("status").alias("done"), F.col("message").alias("said"))
    checked = check_uploads(inputs, max_bytes).join(done, "path", "left")
    reason, empty = F.col("reject_reason"), F.coalesce(F.col("length") == 0, F.lit(False))
    status = (
        F.when(reason.isNotNull(), reason)
        .when(F.col("done").isNotNull(), F.col("done"))
        .otherwise(F.when(empty, "empty").otherwise("absent"))
    )
    message = (
        F.when(reason.isNotNull(), F.col("reject_message"))
        .when(F.col("done").isNotNull(), F.col("said"))
        .otherwise(F.when(empty, EMPTY_MESSAGE).otherwise(ABSENT_MESSAGE))
    )
    return checked.select("path", "filename", "length", status.alias("status"), message.alias("message"))


def not_scanned(manifest: DataFrame, scanned: DataFrame) -> DataFrame:
    """Manifest entries no scan returned: absent files, and empty files,
    which Spark's file sources skip."""
    return manifest.join(scanned.select("path"), "path", "left_anti")
