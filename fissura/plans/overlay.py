"""The whole job: images and detections to overlay scanlines and a report."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fissura.functions import names
from fissura.functions import params as P
from fissura.operators import masks, outline, paint, report, scoring
from fissura.operators.validation import output_collisions
from fissura.sources.sinks import write_image_files, write_scanlines
from fissura.storage import discard, durable, new_dir


@dataclass(frozen=True)
class OverlayParams:
    conf: float = P.DEFAULT_CONF
    alpha: float = P.DEFAULT_ALPHA
    outline: int = P.DEFAULT_OUTLINE
    colour: tuple[int, int, int] = P.DEFAULT_COLOUR
    threshold: float = masks.MASK_THRESHOLD
    imgsz: int = scoring.DEFAULT_IMGSZ


@dataclass(frozen=True)
class Overlay:
    """``images``: painted ones, whole; ``lines``: their scanlines ``image_id, y, bgr``."""

    images: DataFrame
    lines: DataFrame
    fill: DataFrame
    outline: DataFrame


def overlay_lines(images: DataFrame) -> DataFrame:
    return paint.scanlines(images).select("image_id", "y", F.col("line").alias("bgr"))


def with_params(images: DataFrame, params: OverlayParams) -> DataFrame:
    """Fill in the parameters that ``images`` does not bring, column by column and row by row."""
    colour = F.struct(*(F.lit(v).alias(n) for n, v in zip("bgr", params.colour)))
    constants = {"alpha": F.lit(params.alpha), "outline": F.lit(params.outline), "colour": colour}
    if "conf" in images.columns:
        constants["conf"] = F.lit(params.conf)
    return images.withColumns(
        {k: F.coalesce(F.col(k), v) if k in images.columns else v for k, v in constants.items()}
    )


def mask_words(images: DataFrame, detections: DataFrame, params: OverlayParams) -> DataFrame:
    """Union mask of each image's confident detections, as words.

    Masks that come packed from the scorer have passed it already. With one confidence for all, the filter sits below the unpacking of masks.
    With one per image, each instance is packed first, so that the join on
    ``image_id`` moves bits and not the scores they came from.
    """
    if "bits" in detections.columns:
        return masks.packed_words(detections)
    whole = detections.filter(masks.well_formed())
    if "conf" not in images.columns:
        return masks.score_words(scoring.confident(whole, params.conf), params.threshold)
    packed = masks.score_words(whole, params.threshold, ("image_id", "instance_id", "conf"))
    return masks.union_words(
        scoring.confident(packed, images.select("image_id", "conf")),
        ("image_id", "mask_h", "mask_w"),
    )


def fitted_mask(images: DataFrame, detections: DataFrame, params: OverlayParams) -> DataFrame:
    """Union mask in image coordinates, as runs keyed by image, size and outline."""
    sizes = images.filter("height > 0").select(*masks.IMAGE_AND_OUTLINE)
    words = mask_words(images, detections, params).join(sizes, "image_id")
    return masks.fit_runs(words, masks.IMAGE_AND_OUTLINE)


def overlay(
    images: DataFrame,
    detections: DataFrame,
    params: OverlayParams = OverlayParams(),
    sizes: DataFrame | None = None,
    failed: DataFrame | None = None,
    carry: tuple[str, ...] = (),
) -> Overlay:
    """Overlay of every decodable image, damaged or not.

    ``images`` may carry ``conf``, ``alpha``, ``outline`` and ``colour``
    columns; ``params`` stands in for those it lacks. ``sizes`` spares decoding
    the images for their size, and images in ``failed`` get no overlay.

    The mask and the index of runs are written to shared storage when this is
    called; they are a small part of the scores they come from. The images are
    read once, where the result is asked for, and are not shuffled.
    """
    images = with_params(images, params)
    known = images
    if sizes is not None:
        known = images.drop("height", "width", "n_channels", "data").join(sizes, "image_id")
    fill = durable(fitted_mask(known, detections, params), "mask")
    edge = outline.thick_outline_runs(fill)
    skipped = None if failed is None else failed.select("image_id").distinct()
    painted = paint.paint(images, paint.index_runs(fill, edge, skipped), carry)
    return Overlay(painted, overlay_lines(painted), fill, edge)


def selected(images: DataFrame, detections: DataFrame, params: OverlayParams) -> DataFrame:
    """The detections that count: whole masks at or above the image's confidence."""
    if "bits" in detections.columns:
        return detections
    limit = images.select("image_id", "conf") if "conf" in images.columns else params.conf
    return scoring.confident(detections.filter(masks.well_formed()), limit)


def _png_name(out_path: Column) -> Column:
    """The last part of the result path, with the suffix of what is written."""
    base = F.regexp_extract(out_path, names.BASENAME_PATTERN, 1)
    return F.concat(names.stem(base), F.lit(".png"))


def _clashes(images: DataFrame, column: str) -> DataFrame:
    """Error rows of the images that share a value which must be their own."""
    shared = output_collisions(images, column).select(column)
    message = F.lit(f"{scoring.FAILED}{column} is not unique")
    return images.join(shared, column, "left_semi").select("image_id", message.alias("error"))


def _unnamed(images: DataFrame) -> DataFrame:
    message = F.lit(f"{scoring.FAILED}no result path")
    return images.filter("file is null").select("image_id", message.alias("error"))


def run(
    images: DataFrame,
    load: Callable,
    weights: str,
    out_dir: str,
    params: OverlayParams = OverlayParams(),
    batch: int | None = None,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Score, paint and report ``images`` (with ``out_path``); returns the report.

    Every image without a failure, damaged or not, becomes a PNG file in
    ``out_dir/images``, named after its ``out_path``; the report names that
    file, and echoes the parameters. Scanlines are also kept as a table.

    Images are decoded twice: to score them and to paint them. Painted pixels
    are written once, and deleted when the files and the scanlines are there; pixels are
    never shuffled. Packed masks are written once to shared storage, every later
    branch reads that table, and it is deleted at the end. The files appear all together. Failed images
    get a report row and no overlay: those the model failed on or gave malformed
    masks for, those without an ``out_path``, and those that share one. Images that share an ``image_id`` cannot be told apart and end
    the job. ``batch`` and ``profile`` are those of ``score_images``.
    """
    spark = images.sparkSession
    if not output_collisions(images, "image_id").isEmpty():
        raise ValueError("image_id is not unique")
    shipped = scoring.ship_weights(spark, weights, load)
    named = images.withColumn("file", _png_name(F.col("out_path")))
    conf = F.col("conf") if "conf" in images.columns else F.lit(params.conf)
    filled = with_params(named.withColumn("conf", conf), params)
    path = new_dir(spark, "scored")
    scored = durable(
        scoring.score_images(
            filled, load, shipped, params.conf, params.imgsz, params.threshold, batch, profile=profile
        ),
        "scored",
        path,
    )
    detections = scoring.detections_of(scored)
    listed = filled.drop("height", "width", "n_channels", "data")
    errors = durable(
        scoring.errors_of(scored)
        .unionByName(_clashes(listed.filter("file is not null"), "file"))
        .unionByName(_unnamed(listed))
        .groupBy("image_id")
        .agg(F.min("error").alias("error")),
        "errors",
    )
    sizes = scoring.sizes_of(scored)
    # The name of an image's file is a value of its row, so it needs no join either.
    painted = overlay(filled, detections, params, sizes, errors, carry=("file",)).images
    pixels = new_dir(spark, "painted")
    painted = durable(painted, "painted", pixels)
    write_scanlines(overlay_lines(painted), f"{out_dir}/overlay")
    write_image_files(painted, f"{out_dir}/images", "file", "png")
    discard(spark, pixels)
    target = F.concat(F.lit(f"{out_dir}/images/"), F.col("file"))
    rows = report.report(
        listed.withColumn("out_path", target).drop("file"), selected(filled, detections, params), errors
    )
    rows.write.mode("overwrite").parquet(f"{out_dir}/report")
    discard(spark, path)
    return spark.read.schema(rows.schema).parquet(f"{out_dir}/report")
