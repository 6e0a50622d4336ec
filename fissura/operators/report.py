"""One report row per input image."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fissura.operators.masks import count_instances


# User-facing messages.
FOUND, INSTANCE, NOTHING = "Found ", " crack instance", "No cracks detected"
DETECTED, SAVED = "Detected ", " crack instance(s). Saved: "


def page_message(n: Column) -> Column:
    plural = F.when(n == 1, "").otherwise("s")
    found = F.concat(F.lit(FOUND), n.cast("string"), F.lit(INSTANCE), plural)
    return F.when(n > 0, found).otherwise(NOTHING)


def console_message(n: Column, out_path: Column) -> Column:
    found = F.concat(F.lit(DETECTED), n.cast("string"), F.lit(SAVED), out_path)
    none = F.concat(F.lit(NOTHING + "; the original is stored as it is: "), out_path)
    return F.when(n > 0, found).otherwise(none)


def report(images: DataFrame, detections: DataFrame, errors: DataFrame) -> DataFrame:
    """Count, result path, message and status of every image.

    ``images`` carries ``out_path`` and any parameters to echo. A failed image
    has no count and no result path.
    """
    kept = [c for c in images.columns if c not in ("data", "out_path")]
    n, failed = F.col("num_instances"), F.col("error").isNotNull()
    # A failed image wrote nothing, so it has at most one error row.
    joined = count_instances(images.select(*kept, "out_path"), detections).join(
        errors.groupBy("image_id").agg(F.min("error").alias("error")), "image_id", "left"
    )
    return joined.select(
        *kept,
        F.when(~failed, n).alias("num_instances"),
        F.when(~failed, F.col("out_path")).alias("out_path"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(failed, F.col("error")).otherwise(page_message(n)).alias("message"),
        "error",
    )


def pair_with_results(images: DataFrame, results: DataFrame) -> DataFrame:
    """Original and result side by side; images without a result stay."""
    return images.select("image_id", F.col("path").alias("original_path")).join(
        results.select("image_id", F.col("out_path").alias("result_path")), "image_id", "left"
    )
