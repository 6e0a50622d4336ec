"""Images, detections and uploads derived by Spark from the driver's tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8  # embeddings have 64 values: one 8x8 mask each

# Raw texts the parameter queries cycle through.
UPLOAD_EXTENSIONS = (
    ".jpg", ".JPEG", ".png", ".bmp", ".tif", ".TIFF", ".webp", ".gif", ".tar.gz", ".txt", "", ".",
)
CONF_TEXTS = (
    None, "", "abc", "0.25", " 0.3 ", "1e-1", "nan", "inf", "-inf", "0.5f", "0x1p3", "2", "-1",
    "1_0.5", "0.9", "0.35", ".5", "5.", "+.25",
)
ALPHA_TEXTS = (None, "0.5", "0.25", "1", "-4", "99", "0.75")
OUTLINE_TEXTS = (None, "2", "2.5", "+4", "-4", "99", "99999999999", " 3 ", "0", "1_0", "7")
STRICT_CONF_TEXTS = (None, "0.25", " 0.3 ", "2.5", "-1", "1e-1", "+.25", "abc")
STRICT_ALPHA_TEXTS = (None, "0.5", "-4", "99", "1.", "", "7")
STRICT_OUTLINE_TEXTS = (None, "2", "-4", "99", " 3 ", "99999999999", "-99999999999", "2.5", "0")
COLOUR_TEXTS = (
    None, "0,0,255", " 1 , 2 , 3 ", "300,-5,0", "1,2", "1,2,3,4", "a,b,c", "", "1,2,", "1.5,2,3",
    "+7,08,9",
)


# Layout of the driver's tables used here, so that no file is opened to plan.
TABLES = {
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
    " props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def pick(texts: tuple, index: Column) -> Column:
    values = F.array(*(F.lit(t).cast("string") for t in texts))
    return F.get(values, (index % len(texts)).cast("int"))


def _detections(spark, sf_dir, image_id: Column) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        image_id.cast("bigint").alias("image_id"),
        F.col("vec_id").alias("instance_id"),
        F.array_max("embedding").alias("conf"),
        F.lit(SIDE).alias("mask_h"),
        F.lit(SIDE).alias("mask_w"),
        F.col("embedding").alias("scores"),
    )


def site_detections(spark, sf_dir) -> DataFrame:
    """Few images with very many instances: one image per label."""
    return _detections(spark, sf_dir, F.col("label"))


def site_images(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("label").cast("bigint").alias("image_id"))
        .distinct()
    )


def frame_detections(spark, sf_dir) -> DataFrame:
    """Many images with few instances: four embeddings to an image."""
    return _detections(spark, sf_dir, F.expr("vec_id div 4"))


def frame_images(spark, sf_dir) -> DataFrame:
    """Images of varying size, with pixels by formula and their own parameters."""
    i = F.col("image_id")
    byte = (
        "lpad(hex((image_id * 31 + (k div (width * 3)) * 7 + ((k div 3) % width) * 3"
        " + (k % 3) * 11) % 256), 2, '0')"
    )
    pixels = f"transform(sequence(0, height * width * 3 - 1), k -> {byte})"
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.expr("vec_id div 4").alias("image_id"))
        # The ids are few bytes and the pixels many: the tasks that make them follow the
        # cores, or Spark would make all in one.
        .repartition(2 * spark.sparkContext.defaultParallelism, "image_id")
        .distinct()
        .withColumns(
            {
                "path": F.concat(F.lit("frames/frame_"), i.cast("string"), F.lit(".bmp")),
                "height": (i % 16 + 5).cast("int"),
                "width": (i % 8 + 13).cast("int"),
                "n_channels": F.lit(3),
                "alpha": (i % 5) / 4.0,
                "outline": (i % 5).cast("int"),
                "colour": F.struct(
                    *(((i * k) % 256).cast("int").alias(n) for n, k in zip("bgr", (37, 91, 53)))
                ),
            }
        )
        .withColumn("data", F.unhex(F.expr(f"array_join({pixels}, '')")))
    )


def planes(spark, sf_dir) -> DataFrame:
    """One 8x8 image per embedding, its values as pixel bytes."""
    byte = "lpad(hex((cast(floor(abs(cast(v as double)) * 1000) as int) + c * 11) % 256), 2, '0')"
    pixels = f"transform(embedding, v -> concat_ws('', transform(array(0, 1, 2), c -> {byte})))"
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.concat(F.lit("planes/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"),
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
        F.lit(3).alias("n_channels"),
        F.unhex(F.expr(f"array_join({pixels}, '')")).alias("data"),
    )


def plate_runs(spark, sf_dir) -> DataFrame:
    """Instance runs of long narrow images, one image per part."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("image_id"),
        (F.col("l_linenumber") - 1).alias("y"),
        (F.col("l_orderkey") % 480).cast("int").alias("x0"),
        (F.col("l_orderkey") % 480 + F.col("l_quantity")).cast("int").alias("x1"),
    )


def speckle_runs(spark, sf_dir) -> DataFrame:
    """Instance runs of dense 24x64 masks full of holes, one image per supplier."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image_id"),
        F.lit(24).alias("height"),
        F.lit(64).alias("width"),
        (F.col("l_partkey") % 24).cast("int").alias("y"),
        (F.col("l_orderkey") % 60).cast("int").alias("x0"),
        (F.col("l_orderkey") % 60 + 1 + F.col("l_linenumber") % 4).cast("int").alias("x1"),
    )


def uploads(spark, sf_dir) -> DataFrame:
    """Upload requests: names from document ids, sizes from text lengths."""
    i = F.col("doc_id")
    name = F.concat(F.lit("doc_"), i.cast("string"), pick(UPLOAD_EXTENSIONS, i))
    return table(spark, sf_dir, "documents").select(
        i.cast("string").alias("upload_id"),
        F.when(i % 37 == 5, None).when(i % 41 == 5, "").otherwise(name).alias("filename"),
        (F.col("n_chars") * 1000).alias("length"),
    )


def site_photos(spark, sf_dir) -> DataFrame:
    """Paths whose stems repeat across file types."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(
            F.col("source"),
            F.lit("/photo."),
            F.expr("doc_id div 3").cast("string"),
            pick(UPLOAD_EXTENSIONS, i),
        ).alias("path")
    )


def raw_params(spark, sf_dir, conf=CONF_TEXTS, alpha=ALPHA_TEXTS, outline=OUTLINE_TEXTS):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        pick(conf, i).alias("conf_raw"),
        pick(alpha, i).alias("alpha_raw"),
        pick(outline, i).alias("outline_raw"),
    )
