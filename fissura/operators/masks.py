"""Mask algebra: binarise, union, fit to image, thicken.

A mask travels in one of two forms, both far smaller than its pixels:

* words: one row per 32 pixels of a scanline that has any pixel set, the
  pixels packed in the low 32 bits of a bigint ``bits``;
* runs: half-open spans ``[x0, x1)`` of a scanline, maximal and disjoint.

Words make the union of any number of instances a plain ``bit_or``. It combines
on the map side, so an image that holds a third of all detections still sends
at most one row per word and task through the shuffle, and no group is larger
than the image itself. Runs are what geometry (scaling, outlines, painting)
wants; a scanline has at most ``width / 2`` of them.
"""

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 32
FULL_WORD = (1 << WORD) - 1

# Fixed value: a mask pixel is set above this score.
MASK_THRESHOLD = 0.5

# Identifies an image and its size; constant per image, so grouping on all of
# them costs nothing and saves joining the size back.
IMAGE = ("image_id", "height", "width")
IMAGE_AND_OUTLINE = (*IMAGE, "outline")
_OF_IMAGE = ("height", "width", "outline")


def float_lit(value: float) -> Column:
    """Literal in float precision, as scores and confidences are compared."""
    return F.lit(value).cast("float")


def _is_set(score: Column, threshold: float) -> Column:
    # Spark orders NaN above every number; a NaN score sets no pixel.
    return (score > float_lit(threshold)) & ~F.isnan(score)


def well_formed() -> Column:
    return F.size("scores") == F.col("mask_h") * F.col("mask_w")


def malformed(detections: DataFrame) -> DataFrame:
    """Error rows, in the layout ``report`` takes, for masks of the wrong size."""
    return detections.filter(~well_formed()).select(
        "image_id", F.lit("Inference failed: mask size and scores differ").alias("error")
    )


def score_words(
    detections: DataFrame,
    threshold: float = MASK_THRESHOLD,
    keys: Sequence[str] = ("image_id",),
) -> DataFrame:
    """Words of the union, over ``keys``, of all instance masks.

    Pixels are unpacked, tested and packed again inside one stage; only words
    are shuffled. Instances of one image share a mask shape.
    """
    pixels = (
        detections.select(*keys, "mask_h", "mask_w", F.posexplode("scores").alias("p", "score"))
        .filter(_is_set(F.col("score"), threshold))
        .withColumn("x", F.col("p") % F.col("mask_w"))
    )
    return pixels.groupBy(
        *keys,
        "mask_h",
        "mask_w",
        F.expr("p div mask_w").cast("int").alias("y"),
        F.expr(f"x div {WORD}").cast("int").alias("w"),
    ).agg(F.expr(f"bit_or(shiftleft(1L, int(x % {WORD})))").alias("bits"))


def packed_words(packed: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Words of the union, over ``keys``, of masks that the scorer has packed."""
    in_row = f"((mask_w + {WORD - 1}) div {WORD})"
    words = packed.select(
        *keys, "mask_h", "mask_w", F.explode(F.arrays_zip("places", "bits")).alias("word")
    ).selectExpr(
        *keys, "mask_h", "mask_w", f"int(word.places div {in_row}) AS y",
        f"int(word.places % {in_row}) AS w", "word.bits AS bits",
    )
    return union_words(words, [*keys, "mask_h", "mask_w"])


def instance_runs(
    detections: DataFrame,
    threshold: float = MASK_THRESHOLD,
    keys: Sequence[str] = ("image_id", "instance_id"),
) -> DataFrame:
    """Runs of each instance mask on its own."""
    return merge_pieces(words_to_pieces(score_words(detections, threshold, keys)), keys)


def union_words(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    return words.groupBy(*keys, "y", "w").agg(F.bit_or("bits").alias("bits"))


def words_to_pieces(words: DataFrame) -> DataFrame:
    """Runs cut at word borders. Replaces ``w, bits`` by ``x0, x1``."""
    others = [c for c in words.columns if c not in ("w", "bits")]
    rest = "shiftright(bits, i)"
    return (
        words.selectExpr("*", f"explode(sequence(0, {WORD - 1})) AS i")
        # bits i-1 and i of the word: 0 then 1
        .filter("(shiftright(bits * 2, i) & 3) = 2")
        .selectExpr(
            *others,
            f"int(w * {WORD} + i) AS x0",
            # as many pixels as there are ones from bit i on
            f"int(w * {WORD} + i + bit_count({rest} ^ ({rest} + 1)) - 1) AS x1",
        )
    )


def runs_to_words(runs: DataFrame) -> DataFrame:
    """Words covered by runs. Replaces ``x0, x1`` by ``w, bits``; words of
    different runs may share a place and need ``union_words``."""
    others = [c for c in runs.columns if c not in ("x0", "x1")]
    low, high = f"greatest(x0 - w * {WORD}, 0)", f"least(x1 - w * {WORD}, {WORD})"
    return runs.selectExpr(
        "*", f"explode(sequence(int(x0 div {WORD}), int((x1 - 1) div {WORD}))) AS w"
    ).selectExpr(*others, "w", f"shiftleft(1L, {high}) - shiftleft(1L, {low}) AS bits")


def merge_pieces(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join disjoint pieces that touch into maximal runs, per key and scanline."""
    # What depends on the image alone need not take part in the sort.
    identity = [k for k in keys if k not in _OF_IMAGE]
    scanline = Window.partitionBy(*identity, "y").orderBy("x0")
    touches = F.lag("x1").over(scanline) == F.col("x0")
    return (
        pieces.withColumn("new", F.when(touches, 0).otherwise(1))
        .withColumn("run", F.sum("new").over(scanline.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "y", "run")
        .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
        .drop("run")
    )


def merge_overlapping(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join runs of a scanline that overlap or touch, without packing them to words."""
    identity = [k for k in keys if k not in _OF_IMAGE]
    scanline = Window.partitionBy(*identity, "y").orderBy("x0", "x1")
    reached = F.max("x1").over(scanline.rowsBetween(Window.unboundedPreceding, -1))
    return (
        runs.withColumn("new", F.when(reached >= F.col("x0"), 0).otherwise(1))
        .withColumn("run", F.sum("new").over(scanline.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "y", "run")
        .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
        .drop("run")
    )


def union_runs(runs: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Merge runs that overlap or touch, such as those of several instances."""
    words = union_words(runs_to_words(runs.select(*keys, "y", "x0", "x1")), keys)
    return merge_pieces(words_to_pieces(words), keys)


def fit_runs(words: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Runs of a union mask scaled from ``mask_h x mask_w`` to ``height x width``.

    Nearest neighbour: target column ``x`` shows source column
    ``floor(x * mask_w / width)``, rows alike. Columns are scaled before the
    pieces are merged and rows are repeated after. Masks of one image may differ
    in shape: each shape is merged and scaled on its own, and the few runs that
    result are united.
    """
    scaled = words_to_pieces(words).withColumns(
        {
            c: F.expr(f"(cast({c} as bigint) * width + mask_w - 1) div mask_w").cast("int")
            for c in ("x0", "x1")
        }
    )
    merged = merge_pieces(scaled.filter("x0 < x1"), [*keys, "mask_h", "mask_w"])
    first = "int((cast(y as bigint) * height + mask_h - 1) div mask_h)"
    after = "int((cast(y + 1 as bigint) * height + mask_h - 1) div mask_h)"
    fitted = (
        merged.filter(f"{first} < {after}")
        .withColumn("y", F.explode(F.expr(f"sequence({first}, {after} - 1)")))
        .select(*keys, "y", "x0", "x1")
    )
    return merge_overlapping(fitted, keys)


#: Pixels of a strip that a task thickens at a time, without the rows around it that reach into it.
THICK_PIXELS = 1 << 22


def thicken_runs(pieces: DataFrame, keys: Sequence[str], strip_pixels: int = THICK_PIXELS) -> DataFrame:
    """Grow runs by a disc of diameter ``outline`` (a column), clipped to the image.

    Every pixel within ``outline / 2`` of a run pixel is set; 1 changes nothing.
    Images are cut into strips of scanlines; a run goes to the strips that it
    reaches, which is one or two unless the width is beyond a strip. A strip is a
    distance transform in two steps, so the work does not grow with the width.
    """
    rows = f"int(greatest(1, {strip_pixels} div width))"
    radius = "least(outline div 2, height)"
    first = f"int(greatest(y - {radius}, 0) div {rows})"
    last = f"int(least(y + {radius}, height - 1) div {rows})"
    strips = pieces.selectExpr(
        *keys, "y", "x0", "x1", f"explode(sequence({first}, {last})) AS strip", f"{rows} AS rows"
    )
    layout = pieces.select(*keys, "y", "x0", "x1").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for strip in by_group(batches, ("image_id", "strip")):
            yield from _thick_strip(strip, layout.names)

    return (
        strips.repartition("image_id", "strip").sortWithinPartitions("image_id", "strip").mapInArrow(run, layout)
    )


def by_group(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by ``keys``, one after the other."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for begin, end in zip(bounds, bounds[1:]):
            if held and key(held[0], 0) != key(batch, begin):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def disc_reach(width: int, rows: int) -> np.ndarray:
    """How far a disc of diameter ``width`` reaches sideways, for each distance in rows up to ``rows``; -1: not at all."""
    return np.array([math.isqrt((width * width - 4 * d * d) // 4) if 2 * d <= width else -1 for d in range(rows + 1)])


def _thick_strip(strip: pa.Table, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    one = {c: strip.column(c)[0].as_py() for c in ("height", "width", "outline", "strip", "rows")}
    height, width, thickness = one["height"], one["width"], one["outline"]
    radius = min(thickness // 2, height)
    low = one["strip"] * one["rows"]
    high = min(low + one["rows"], height)
    y, x0, x1 = (strip.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
    # Only columns that runs reach, and scanlines of the strip that are near one.
    left, right = max(int(x0.min()) - thickness // 2, 0), min(int(x1.max()) + thickness // 2, width)
    low, high = max(low, int(y.min()) - radius), min(high, int(y.max()) + radius + 1)
    top, bottom = int(y.min()), int(y.max()) + 1
    edges = np.zeros((bottom - top, right - left + 1), np.int32)
    np.add.at(edges, (y - top, x0 - left), 1)
    np.add.at(edges, (y - top, x1 - left), -1)
    hit = np.cumsum(edges[:, :-1], axis=1) > 0
    # Step one, down the columns: rows to the nearest pixel, above or below.
    far = np.int32(2 * radius + height + 1)
    at = np.arange(top, bottom, dtype=np.int32)[:, None]
    above = np.maximum.accumulate(np.where(hit, at, np.int32(top - far)), axis=0)
    below = np.minimum.accumulate(np.where(hit, at, np.int32(bottom + far))[::-1], axis=0)[::-1]
    reach = disc_reach(thickness, radius)
    lines = np.arange(low, high)
    for begin in range(0, len(lines), 256):
        some = lines[begin : begin + 256]
        # Scanlines beyond all runs look at the first or last one that has any.
        up = above[np.clip(some - top, 0, bottom - top - 1)]
        down = below[np.clip(some - top, 0, bottom - top - 1)]
        up = np.where(some[:, None] >= top, up, top - far)
        down = np.where(some[:, None] < bottom, down, bottom + far)
        distance = np.minimum(some[:, None] - up, down - some[:, None])
        # Step two, along the scanline: every column covers as far as its distance leaves.
        row, column = np.nonzero(distance <= radius)
        k = reach[distance[row, column]]
        row, column, k = row[k >= 0], column[k >= 0], k[k >= 0]
        cover = np.zeros((len(some), right - left + 1), np.int32)
        np.add.at(cover, (row, np.maximum(column - k, 0)), 1)
        np.add.at(cover, (row, np.minimum(column + k + 1, right - left)), -1)
        inside = np.zeros((len(some), right - left + 2), np.int8)
        inside[:, 1:-1] = np.cumsum(cover[:, :-1], axis=1) > 0
        step = np.diff(inside, axis=1)
        starts, ends = np.nonzero(step == 1), np.nonzero(step == -1)
        n = len(starts[0])
        if n:
            made = {"y": some[starts[0]], "x0": starts[1] + left, "x1": ends[1] + left}
            columns = [
                pa.array(made[c], pa.int32()) if c in made else pa.repeat(strip.column(c)[0], n) for c in names
            ]
            yield pa.RecordBatch.from_arrays(columns, list(names))


def count_instances(images: DataFrame, detections: DataFrame) -> DataFrame:
    """Instances per image, zero where nothing was detected."""
    counts = detections.groupBy("image_id").agg(F.count(F.lit(1)).alias("num_instances"))
    return images.join(counts, "image_id", "left").withColumn(
        "num_instances", F.coalesce("num_instances", F.lit(0).cast("bigint"))
    )


def mask_areas(runs: DataFrame) -> DataFrame:
    return runs.groupBy("image_id").agg(
        F.sum((F.col("x1") - F.col("x0")).cast("bigint")).alias("mask_area")
    )
