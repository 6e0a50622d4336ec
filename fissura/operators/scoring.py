"""Distributed scoring with a user-supplied segmentation model.

The network is the caller's: ``load(weights)`` returns a function
``model(image, conf, imgsz) -> iterable of (confidence, mask)`` where ``image``
is ``height x width x 3`` B,G,R bytes and ``mask`` a 2-D array of scores.
"""

import hashlib
import os
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.ml.functions import predict_batch_udf
from pyspark.resource import ResourceProfile
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fissura.functions.params import DEFAULT_CONF
from fissura.operators.masks import WORD, float_lit
from fissura.schemas import PACKED, SCORED
from fissura.storage import new_dir

# Inference size in pixels, error text.
DEFAULT_IMGSZ = 640
FAILED = "Inference failed: "

# Score values a task holds back before it hands a batch on.
_OUTPUT_CELLS = 1 << 24
_OUTPUT_ROWS = 10_000

# Pixel bytes that a task holds for one call of a model that takes batches.
BATCH_BYTES = 1 << 27

_SCORED_TYPES = (
    *(pa.int64(), pa.int64(), pa.float32(), pa.int32(), pa.int32(), pa.list_(pa.float32())),
    *(pa.int32(), pa.int32(), pa.string()),
)

_PACKED_TYPES = (
    *_SCORED_TYPES[:5], pa.list_(pa.int32()), pa.list_(pa.int64()), *_SCORED_TYPES[6:]
)

# Copies of weights by application and name: Spark knows a file's name by one path only.
_COPIES: dict[tuple[str, str], str] = {}
_COPYING = threading.Lock()

# Of this worker, by the token the driver gave to a loader and its weights.
_MODELS: dict[str, Callable] = {}


@dataclass(frozen=True)
class Shipped:
    """Weights as executors know them; ``token`` changes with loader, file and version."""

    token: str
    name: str


def ship_weights(spark: SparkSession, weights: str, load: Callable | None = None) -> Shipped:
    """Check that the weights exist and hand them to every executor.

    The file travels under a name of its own, so that neither a file of the same
    base name nor an older version of the file is taken for it. A version is copied
    once, however often it is shipped, as by each batch of a stream.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(weights)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        raise FileNotFoundError(f"Weights not found: {weights}")
    status = store.getFileStatus(path)
    version = (weights, status.getModificationTime(), status.getLen())
    name = f"{hashlib.sha256(repr(version).encode()).hexdigest()[:16]}-{os.path.basename(weights)}"
    known = (spark.sparkContext.applicationId, name)
    with _COPYING:
        if known not in _COPIES:
            copy = spark._jvm.org.apache.hadoop.fs.Path(f"{new_dir(spark, 'weights')}/{name}")
            conf = spark._jsc.hadoopConfiguration()
            to = copy.getFileSystem(conf)
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store, path, to, copy, False, conf)
            _COPIES[known] = copy.toString()
        # Again in any case: a stream's session has files of its own.
        spark.sparkContext.addFile(_COPIES[known])
    return Shipped(f"{_identity(load)}:{name}", name)


def _identity(load: Callable | None) -> str:
    """The loader by what it does: its code and all it refers to, as it is shipped."""
    return hashlib.sha256(CloudPickleSerializer().dumps(load)).hexdigest()


def model_of(load: Callable, weights: Shipped | str, token: str):
    """The model, loaded once per Python worker and token."""
    if token not in _MODELS:
        path = SparkFiles.get(weights.name) if isinstance(weights, Shipped) else weights
        _MODELS[token] = load(path)
    return _MODELS[token]


def _as_bgr(data: bytes, height: int, width: int, n_channels: int, error: str | None = None) -> np.ndarray:
    if height <= 0 or width <= 0:
        raise ValueError(error or "image could not be decoded")
    image = np.frombuffer(data, np.uint8).reshape(height, width, n_channels)
    return np.repeat(image, 3, axis=2) if n_channels == 1 else image[:, :, :3]


def score_tensors(
    column: str, make_predict: Callable, shape: list[int], kind: T.DataType, batch_size: int = 1024
) -> Column:
    """Score a column of equally shaped tensors in batches.

    ``make_predict()`` loads the model, once per Python worker, and returns a
    function of a ``batch x shape`` array. For images of varying shape, or
    failures to be caught one by one, see ``score_images``.
    """
    score = predict_batch_udf(
        make_predict, return_type=kind, batch_size=batch_size, input_tensor_shapes=[shape]
    )
    return score(column)


def _batch(rows: list[tuple], layout: T.StructType) -> pa.RecordBatch:
    kinds = _SCORED_TYPES if "scores" in layout.names else _PACKED_TYPES
    columns = [list(c) for c in zip(*rows)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)], [f.name for f in layout]
    )


def packed(mask: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and bits of the words of a mask that have a pixel above the threshold."""
    above = np.zeros((len(mask), -(-mask.shape[1] // WORD) * WORD), bool)
    above[:, : mask.shape[1]] = mask > np.float32(threshold)  # NaN is not
    words = np.packbits(above, axis=1, bitorder="little").view("<u4").ravel()
    places = np.flatnonzero(words)
    return places.astype(np.int32), words[places].astype(np.int64)


def score_images(
    images: DataFrame,
    load: Callable,
    weights: Shipped | str,
    conf: float = DEFAULT_CONF,
    imgsz: int = DEFAULT_IMGSZ,
    threshold: float | None = None,
    batch: int | None = None,
    batch_bytes: int = BATCH_BYTES,
    profile: ResourceProfile | None = None,
    barrier: bool = False,
) -> DataFrame:
    """Detections of every image, and one row per image with its size.

    With ``batch``, the model takes lists: ``model(images, confs, imgsz)`` gets up to
    ``batch`` images of one shape and gives as many lists of detections. The
    images of a partition are sorted by shape, without a shuffle, and held up to
    ``batch_bytes``. A call that fails, or gives another number of lists, is made
    again on either half, so one bad image costs a few calls and fails alone.

    With a ``threshold``, masks are binarised and packed before they leave the
    worker, and only detections at or above the image's confidence come out: the
    ``PACKED`` layout, about a thirty-second of the scores.

    A ``conf`` column in ``images`` overrides the argument image by image.
    Failures are caught per image and land in the ``error`` of its row: what the
    model raises, and masks that are not two-dimensional or differ in shape. So
    one bad file never fails a task.

    ``profile`` holds the resources of the scoring stage alone, such as
    accelerators and memory; the stages before and after keep the session's.
    ``barrier`` starts the stage's tasks together, for models that span tasks:
    there must be a slot for each partition. ``weights`` is what ``ship_weights`` gave,
    or a path that every node can open.
    """
    limit = F.col("conf") if "conf" in images.columns else F.lit(conf)
    layout = SCORED if threshold is None else PACKED
    blank = (None,) * (len(layout) - 4)
    token = weights.token if isinstance(weights, Shipped) else f"{_identity(load)}:{weights}"

    def image_of(row: dict) -> np.ndarray:
        return _as_bgr(row["data"], row["height"], row["width"], row["n_channels"], row.get("decode_error"))

    def checked(detected) -> list[tuple[float, np.ndarray]]:
        found = [(float(c), np.asarray(m, np.float32)) for c, m in detected]
        shapes = {m.shape for _, m in found}
        if any(len(s) != 2 or 0 in s for s in shapes):
            raise ValueError("a mask is not two-dimensional")
        if len(shapes) > 1:
            raise ValueError("masks of one image differ in shape")
        return found

    def alone(row: dict) -> list | Exception:
        try:
            return checked(model_of(load, weights, token)(image_of(row), row["conf"], imgsz))
        except Exception as exc:
            return exc

    def together(rows: list[dict]) -> list[list | Exception]:
        """What each image gives, or why it failed."""
        try:
            images = [image_of(r) for r in rows]
            found = list(model_of(load, weights, token)(images, [r["conf"] for r in rows], imgsz))
            if len(found) != len(rows):
                raise ValueError("the model gave another number of results than images")
            return [checked(f) for f in found]
        except Exception as exc:
            if len(rows) == 1:
                return [exc]
            half = len(rows) // 2
            return together(rows[:half]) + together(rows[half:])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list | Exception]]:
        waiting, held = [], 0
        for incoming in batches:
            for i in range(incoming.num_rows):
                row = incoming.slice(i, 1).to_pylist()[0]
                if batch is None:
                    yield row, alone(row)
                    continue
                same = not waiting or all(row[c] == waiting[0][c] for c in ("height", "width", "n_channels"))
                if waiting and (not same or len(waiting) >= batch or held >= batch_bytes):
                    yield from zip(waiting, together(waiting))
                    waiting, held = [], 0
                waiting.append(row)
                held += len(row["data"] or b"")
        if waiting:
            yield from zip(waiting, together(waiting))

    def rows_of(row: dict, found: list | Exception) -> Iterator[tuple]:
        size = (row["height"], row["width"])
        if isinstance(found, Exception):
            yield (row["image_id"], *blank, *size, f"{FAILED}{found}")
            return
        yield (row["image_id"], *blank, *size, None)
        for i, (c, m) in enumerate(found):
            if threshold is None:
                yield (row["image_id"], i, c, *m.shape, m.ravel(), *size, None)
            elif np.float32(c) >= np.float32(row["conf"]):
                yield (row["image_id"], i, c, *m.shape, *packed(m, threshold), *size, None)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cells = [], 0
        for row, found in results(batches):
            for one in rows_of(row, found):
                rows.append(one)
                cells += 0 if one[5] is None else len(one[5])
                if cells > _OUTPUT_CELLS or len(rows) >= _OUTPUT_ROWS:  # also within one image
                    yield _batch(rows, layout)
                    rows, cells = [], 0
        if rows:
            yield _batch(rows, layout)

    known = [c for c in ("decode_error",) if c in images.columns]
    given = images.select("image_id", "height", "width", "n_channels", "data", limit.alias("conf"), *known)
    if batch is not None:
        given = given.sortWithinPartitions("height", "width", "n_channels")
    return given.mapInArrow(score, layout, barrier=barrier, profile=profile)


def detections_of(scored: DataFrame) -> DataFrame:
    """The detections. Like the other readers of ``scored``, give it a written
    table, so that the model runs once."""
    return scored.filter("instance_id is not null").drop("height", "width", "error")


def sizes_of(scored: DataFrame) -> DataFrame:
    """``image_id, height, width`` of every image, known without decoding again."""
    return scored.filter("instance_id is null").select("image_id", "height", "width")


def errors_of(scored: DataFrame) -> DataFrame:
    return scored.filter("error is not null").select("image_id", "error")


def confident(detections: DataFrame, conf: float | DataFrame = DEFAULT_CONF) -> DataFrame:
    """Detections at or above the confidence, given once or per ``image_id``.

    Spark orders NaN highest; here a NaN on either side never passes. The join
    with limits per image is followed by a shuffle of its own: it frees Spark
    to split an image with very many detections over several tasks, and spreads
    them before they are counted or united.
    """
    known = detections.filter(~F.isnan("conf"))
    if isinstance(conf, DataFrame):
        limits = conf.select("image_id", F.col("conf").cast("float").alias("least_conf"))
        return (
            known.join(limits.filter(~F.isnan("least_conf")), "image_id")
            .filter(F.col("conf") >= F.col("least_conf"))
            .drop("least_conf")
            .repartition("image_id", "instance_id")
        )
    return known.filter("false" if np.isnan(conf) else F.col("conf") >= float_lit(conf))
