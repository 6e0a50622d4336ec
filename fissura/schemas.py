"""Fixed table layouts. Nothing in the package infers a schema."""

from pyspark.sql import types as T

COLOUR = T.StructType(
    [
        T.StructField("b", T.IntegerType()),
        T.StructField("g", T.IntegerType()),
        T.StructField("r", T.IntegerType()),
    ]
)

UPLOADS = T.StructType(
    [
        T.StructField("upload_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("conf_raw", T.StringType()),
        T.StructField("alpha_raw", T.StringType()),
        T.StructField("outline_raw", T.StringType()),
    ]
)

IMAGES = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("n_channels", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)

DETECTIONS = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("instance_id", T.LongType()),
        T.StructField("conf", T.FloatType()),
        T.StructField("mask_h", T.IntegerType()),
        T.StructField("mask_w", T.IntegerType()),
        T.StructField("scores", T.ArrayType(T.FloatType())),
    ]
)

# What the scorer emits: per image one row with its size and perhaps an error
# (`instance_id` is NULL), and one row per detection.
SCORED = T.StructType(
    [
        *DETECTIONS.fields,
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)

# The same with masks packed where they are made: of every word that is not
# empty, its place (row * words in a row + word) and its bits.
PACKED = T.StructType(
    [
        *[f for f in SCORED.fields if f.name in ("image_id", "instance_id", "conf", "mask_h", "mask_w")],
        T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("bits", T.ArrayType(T.LongType())),
        *SCORED.fields[-3:],
    ]
)

RUN = T.StructType(
    [T.StructField("x0", T.IntegerType()), T.StructField("x1", T.IntegerType())]
)

MASK_RUNS = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("y", T.IntegerType()),
        *RUN.fields,
    ]
)

# The layout of Spark's own image source, needed to open it as a stream.
IMAGE_SOURCE = T.StructType(
    [
        T.StructField(
            "image",
            T.StructType(
                [
                    T.StructField("origin", T.StringType()),
                    T.StructField("height", T.IntegerType()),
                    T.StructField("width", T.IntegerType()),
                    T.StructField("nChannels", T.IntegerType()),
                    T.StructField("mode", T.IntegerType()),
                    T.StructField("data", T.BinaryType()),
                ]
            ),
        )
    ]
)

BINARY_SOURCE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
