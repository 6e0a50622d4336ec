"""Painting: alpha-blended fill inside the mask, opaque outline over it.

Pixels stay in the task that decoded them. The runs, which are few, are
brought to them: shuffled once, written by bucket of image ids, and looked up
by the tasks that hold the images. Spark has no byte-wise array arithmetic on
binary columns, so the arithmetic is one vectorised pass over each image.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fissura.storage import durable, new_dir, uri


def scanlines(images: DataFrame) -> DataFrame:
    """One row per scanline of each image, other columns kept.

    Cut in generated code, which reads ``data`` once per image. Shuffle the
    result before passing it to Python: fused with a Python stage, each row would
    be buffered with the whole image.
    """
    kept = [c for c in images.columns if c not in ("data", "y", "line")]
    stride = F.col("width") * F.col("n_channels")
    return (
        images.filter("height > 0")
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
        .select(*kept, "y", F.substring("data", F.col("y") * stride + 1, stride).alias("line"))
    )


def paint_pixels(
    image: np.ndarray, fill: np.ndarray, drawn: np.ndarray, alpha: float, colour: tuple[int, int, int]
) -> np.ndarray:
    """One image with its runs painted; ``fill`` and ``drawn`` are rows of y, x0, x1."""
    height, width = image.shape[:2]
    source = np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image[:, :, :3]
    painted = np.array(source).reshape(-1, 3)
    c = np.array(colour, np.float64)

    def pixels(runs: np.ndarray) -> np.ndarray:
        length = runs[:, 2] - runs[:, 1]
        before = np.cumsum(length) - length
        return np.arange(length.sum()) + np.repeat(runs[:, 0] * width + runs[:, 1] - before, length)

    inside = pixels(fill)
    # Rounds half to even and saturates, in double precision.
    mixed = np.rint(painted[inside] * (1 - alpha) + c * alpha)
    painted[inside] = np.clip(np.nan_to_num(mixed), 0, 255).astype(np.uint8)
    painted[pixels(drawn)] = c.astype(np.uint8)
    return painted


#: Images whose runs share a bucket of the index, about; and runs in a row of it.
BUCKET = 4096
_STRIPE = 1 << 16
_INDEX = "image_id bigint, skip boolean, y array<int>, x0 array<int>, x1 array<int>, drawn boolean"


@dataclass(frozen=True)
class RunIndex:
    """Runs on shared storage, by bucket of images, for tasks that hold the pixels."""

    path: str
    buckets: int


def index_runs(
    fill: DataFrame, drawn: DataFrame, skipped: DataFrame | None = None, bucket: int = BUCKET
) -> RunIndex:
    """Bring the runs of an image together and write them by bucket.

    Only runs are shuffled here. An image's runs come in rows of limited length,
    by bands of scanlines. ``skipped`` images are marked.
    """
    spark = fill.sparkSession
    run = ("image_id", "y", "x0", "x1")
    runs = fill.select(*run, F.lit(False).alias("drawn")).unionByName(drawn.select(*run, F.lit(True).alias("drawn")))
    banded = runs.groupBy("image_id", "drawn", F.expr(f"y div {_STRIPE // 64}").alias("band")).agg(
        *(F.collect_list(c).alias(c) for c in ("y", "x0", "x1"))
    )
    rows = banded.select("image_id", F.lit(False).alias("skip"), "y", "x0", "x1", "drawn")
    if skipped is not None:
        none = F.array().cast("array<int>")
        rows = rows.unionByName(
            skipped.select("image_id", F.lit(True).alias("skip"), *(none.alias(c) for c in ("y", "x0", "x1")), F.lit(False).alias("drawn"))
        )
    rows = durable(rows, "runs")
    n = rows.agg(F.approx_count_distinct("image_id")).first()[0]
    buckets = max(1, -(-n // bucket))
    path = new_dir(spark, "run-index")
    # Small row groups in the order of ids: a task reads those of its images only.
    (
        rows.withColumn("bucket", bucket_of(buckets))
        .repartition(min(buckets, 10_000), "bucket")
        .sortWithinPartitions("bucket", "image_id")
        .write.partitionBy("bucket")
        .option("parquet.block.size", 1 << 20)
        .parquet(path)
    )
    return RunIndex(uri(spark, path), buckets)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("image_id"), F.lit(buckets).cast("bigint"))


class _Runs:
    """Looks up the runs of images in the index."""

    def __init__(self, index: RunIndex):
        self.store, self.root = fs.FileSystem.from_uri(index.path)

    def of(self, bucket: int, ids: list[int]) -> dict[int, dict]:
        folder = f"{self.root}/bucket={bucket}"
        if self.store.get_file_info(folder).type == fs.FileType.NotFound:
            return {}
        files = [f.path for f in self.store.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-")]
        found: dict[int, dict] = {}
        for file in files:
            table = parquet.read_table(file, filesystem=self.store, filters=[("image_id", "in", ids)], partitioning=None)
            for row in table.to_pylist():
                one = found.setdefault(row["image_id"], {"skip": False, False: [], True: []})
                one["skip"] |= row["skip"]
                one[row["drawn"]].append(np.array([row["y"], row["x0"], row["x1"]], np.int64).T)
        return found


_NO_RUNS = np.zeros((0, 3), np.int64)


def paint(images: DataFrame, index: RunIndex, carry: tuple[str, ...] = ()) -> DataFrame:
    """Painted images: ``image_id, height, width, n_channels, data``, and the columns in ``carry``.

    ``images`` carries ``alpha`` and ``colour``. Pixels stay in the task that
    decoded them: it looks up the runs of its images, so no image is shuffled, and
    one without runs costs a look into the index. Undecodable and skipped images are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(index)
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            for bucket in np.unique(buckets).tolist():
                mine = np.flatnonzero(buckets == bucket)
                found = runs.of(bucket, batch.column("image_id").take(pa.array(mine)).to_pylist())
                for i in mine.tolist():
                    row = batch.slice(i, 1).to_pylist()[0]
                    one = found.get(row["image_id"], {"skip": False, False: [], True: []})
                    if one["skip"]:
                        continue
                    image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["n_channels"])
                    fill, drawn = (np.concatenate(one[k]) if one[k] else _NO_RUNS for k in (False, True))
                    colour = row["colour"]
                    painted = paint_pixels(image, fill, drawn, row["alpha"], (colour["b"], colour["g"], colour["r"]))
                    new = pa.RecordBatch.from_arrays(
                        [pa.array([3], pa.int32()), pa.array([painted.tobytes()], pa.binary())], names=["n_channels", "data"]
                    )
                    own = batch.slice(i, 1)
                    columns = [new.column(c) if c in new.schema.names else own.column(c) for c in layout.names]
                    yield pa.RecordBatch.from_arrays(columns, layout.names)

    kept = ("image_id", "height", "width", "n_channels", "alpha", "colour", "data", *carry)
    there = images.filter("height > 0").select(*kept, bucket_of(index.buckets).alias("bucket"))
    layout = T.StructType(
        [f for f in there.schema if f.name not in ("alpha", "colour", "bucket") and f.name not in ("n_channels", "data")]
        + [T.StructField("n_channels", T.IntegerType()), T.StructField("data", T.BinaryType())]
    )
    return there.mapInArrow(run, layout)


def explode_pixels(lines: DataFrame) -> DataFrame:
    """``image_id, y, x, b, g, r`` for inspection and tests."""

    def channel(k):
        byte = F.substring("bgr", F.col("x") * 3 + (k + 1), F.lit(1))
        return F.conv(F.hex(byte), 16, 10).cast("int")

    return lines.withColumn(
        "x", F.explode(F.sequence(F.lit(0), (F.octet_length("bgr") / 3).cast("int") - 1))
    ).select(
        "image_id", "y", "x", channel(0).alias("b"), channel(1).alias("g"), channel(2).alias("r")
    )


def assemble(lines: DataFrame, images: DataFrame) -> DataFrame:
    """Scanlines back to one row per image, in the layout of ``images``."""
    whole = lines.groupBy("image_id").agg(
        F.expr("listagg(bgr) within group (order by y)").alias("data")
    )
    return images.select("image_id", "path", "height", "width").join(whole, "image_id").select(
        "image_id", "path", "height", "width", F.lit(3).alias("n_channels"), "data"
    )
