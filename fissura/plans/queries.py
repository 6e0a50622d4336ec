"""Registered queries, one or more per operator, over the driver's tables."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fissura.functions import names, params
from fissura.operators import masks, outline, paint, report, scoring, validation
from fissura.plans import fixtures as fx
from fissura.plans.overlay import OverlayParams, fitted_mask, overlay, run
from fissura.sources.decoders import Decoder, decode_others
from fissura.sources.images import scan_images
from fissura.sources.sinks import write_files, write_image_files, write_scanlines
from fissura.storage import durable, new_dir
from fissura.streaming.ingest import image_stream, ingest
from fissura.streaming.job import published, run_stream

SITE = OverlayParams(conf=0.35, threshold=0.1)
FRAME = OverlayParams(conf=0.2, threshold=0.1)


def _pixels(runs: DataFrame) -> DataFrame:
    return runs.select("image_id", "y", F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"))


def _site_runs(spark, sf_dir) -> DataFrame:
    detections = scoring.confident(fx.site_detections(spark, sf_dir), SITE.conf)
    words = masks.score_words(detections, SITE.threshold)
    return masks.merge_pieces(masks.words_to_pieces(words), ["image_id"])


def masked_area(spark, sf_dir):
    """Flagship: instances and union area of every image, damaged or not."""
    detections = scoring.confident(fx.site_detections(spark, sf_dir), SITE.conf)
    counted = masks.count_instances(fx.site_images(spark, sf_dir), detections)
    areas = masks.mask_areas(_site_runs(spark, sf_dir))
    return counted.join(areas, "image_id", "left").select(
        "image_id",
        "num_instances",
        F.coalesce("mask_area", F.lit(0).cast("bigint")).alias("mask_area"),
    )


def upload_validation(spark, sf_dir):
    checked = validation.check_uploads(fx.uploads(spark, sf_dir))
    return checked.select("upload_id", "filename", "ext", "reject_reason", "reject_message")


def upload_naming(spark, sf_dir):
    kept = validation.accepted(validation.check_uploads(fx.uploads(spark, sf_dir)))
    return validation.name_uploads(kept, "upload_id", "filename", "length").select(
        "upload_id", "upload_name", "result_name"
    )


def output_name_collisions(spark, sf_dir):
    paths = fx.site_photos(spark, sf_dir).select(names.beside_input(F.col("path")).alias("out_path"))
    return validation.output_collisions(paths)


def upload_report(spark, sf_dir):
    """What became of every upload: rejected, empty, absent, failed or done."""
    inputs = fx.uploads(spark, sf_dir).withColumn("path", F.col("upload_id"))
    taken = validation.accepted(validation.check_uploads(inputs)).filter("length > 0")
    i = F.col("upload_id").cast("long")
    done = taken.filter(i % 13 != 3).select(
        "path",
        F.when(i % 7 == 1, "error").otherwise("ok").alias("status"),
        F.when(i % 7 == 1, "Inference failed: x").otherwise(report.page_message(i % 4)).alias("message"),
    )
    return validation.input_report(inputs, done)


def _params(df: DataFrame, *texts: str) -> DataFrame:
    # NaN as a flag, so that engines need not agree on how to print it.
    nan = F.isnan("conf")
    return df.select(
        "event_id",
        *texts,
        F.when(~nan, F.col("conf")).alias("conf"),
        nan.alias("conf_is_nan"),
        "alpha",
        "outline",
    )


def param_parse_clamp(spark, sf_dir):
    return _params(params.normalise_params(fx.raw_params(spark, sf_dir)))


def param_strict(spark, sf_dir):
    raw = fx.raw_params(
        spark, sf_dir, fx.STRICT_CONF_TEXTS, fx.STRICT_ALPHA_TEXTS, fx.STRICT_OUTLINE_TEXTS
    )
    return _params(params.normalise_params(raw, "strict"), "error")


def colour_parse(spark, sf_dir):
    raw = fx.pick(fx.COLOUR_TEXTS, F.col("event_id"))
    return (
        fx.table(spark, sf_dir, "events")
        .select("event_id", params.parse_colour(raw).alias("colour"))
        .select("event_id", "colour.b", "colour.g", "colour.r")
    )


def _linear_model():
    weights = np.arange(1, 65) / 64.0
    return lambda batch: batch.astype(np.float64) @ weights


def colour_strict(spark, sf_dir):
    """A bad colour is the error of its row; the others keep theirs."""
    raw = fx.table(spark, sf_dir, "events").select(
        "event_id", fx.pick(fx.COLOUR_TEXTS, F.col("event_id")).alias("colour_raw")
    )
    typed = params.normalise_colour(raw, "strict")
    return typed.select("event_id", "colour.b", "colour.g", "colour.r", "error")


def linear_scores(spark, sf_dir):
    score = scoring.score_tensors("embedding", _linear_model, [64], T.DoubleType())
    return fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.round(score, 4).alias("score")
    )


def conf_filter_count(spark, sf_dir):
    detections = scoring.confident(fx.site_detections(spark, sf_dir), 0.42)
    return masks.count_instances(fx.site_images(spark, sf_dir), detections)


def mask_binarise_runs(spark, sf_dir):
    return masks.instance_runs(fx.site_detections(spark, sf_dir), SITE.threshold)


def mask_default_threshold(spark, sf_dir):
    return masks.instance_runs(fx.site_detections(spark, sf_dir))


def mask_union_runs(spark, sf_dir):
    return _site_runs(spark, sf_dir)


def instance_run_union(spark, sf_dir):
    return masks.union_runs(fx.plate_runs(spark, sf_dir))


def mask_resize_runs(spark, sf_dir):
    images = fx.frame_images(spark, sf_dir)
    runs = fitted_mask(images, fx.frame_detections(spark, sf_dir), FRAME)
    return runs.select("image_id", "y", "x0", "x1")


def blend_pixels(spark, sf_dir):
    images = fx.frame_images(spark, sf_dir).withColumn("outline", F.lit(0))
    return paint.explode_pixels(overlay(images, fx.frame_detections(spark, sf_dir), FRAME).lines)


def outline_pixels(spark, sf_dir):
    images = fx.frame_images(spark, sf_dir)
    runs = fitted_mask(images, fx.frame_detections(spark, sf_dir), FRAME)
    return _pixels(outline.outline_runs(runs))


def outline_speckle(spark, sf_dir):
    runs = masks.union_runs(fx.speckle_runs(spark, sf_dir), masks.IMAGE)
    return outline.outline_runs(runs).select("image_id", "y", "x0", "x1")


def outline_strips(spark, sf_dir):
    """The speckles in strips of seven scanlines, linked across their borders."""
    runs = masks.union_runs(fx.speckle_runs(spark, sf_dir), masks.IMAGE)
    return outline.outline_runs(runs, strip_pixels=7 * 64).select("image_id", "y", "x0", "x1")


def outline_thick(spark, sf_dir):
    images = fx.frame_images(spark, sf_dir)
    runs = fitted_mask(images, fx.frame_detections(spark, sf_dir), FRAME)
    return _pixels(outline.thick_outline_runs(runs))


def outline_thick_wide(spark, sf_dir):
    """Widths up to several times the image."""
    images = fx.frame_images(spark, sf_dir).withColumn("outline", (F.col("image_id") * 7 % 60).cast("int"))
    runs = fitted_mask(images, fx.frame_detections(spark, sf_dir), FRAME)
    return _pixels(outline.thick_outline_runs(runs))


def _frames_with_conf(spark, sf_dir):
    return fx.frame_images(spark, sf_dir).withColumn(
        "conf", (F.col("image_id") % 4 * 5 + 20) / 100.0
    )


def overlay_pixels(spark, sf_dir):
    images = _frames_with_conf(spark, sf_dir)
    return paint.explode_pixels(overlay(images, fx.frame_detections(spark, sf_dir), FRAME).lines)


def _channel_model(weights: str):
    """Reads each colour plane as one instance; refuses some images."""

    def model(image, conf, imgsz):
        if image[0, 0, 0] % 10 == 7:
            raise ValueError("forced failure")
        planes = np.moveaxis(image, 2, 0).astype(np.float32) / np.float32(255)
        return [(plane.max(), plane) for plane in planes]

    return model


def detection_report(spark, sf_dir):
    images = fx.planes(spark, sf_dir).withColumn(
        "out_path", names.beside_input(F.col("path"))
    )
    scored = scoring.score_images(images, _channel_model, "none", 0.8)
    scored = durable(scored, "scored")
    rows = report.report(
        images.select("image_id", "path", "out_path"),
        scoring.confident(scoring.detections_of(scored), 0.8),
        scoring.errors_of(scored),
    )
    return rows.select("image_id", "num_instances", "out_path", "status", "message", "error")


def scored_masks(spark, sf_dir):
    scored = scoring.score_images(fx.planes(spark, sf_dir), _channel_model, "none", 0.8)
    return masks.instance_runs(scoring.confident(scoring.detections_of(scored), 0.8))


def scored_words(spark, sf_dir):
    """Masks packed by the scorer; some scores lie exactly at the threshold."""
    images = fx.planes(spark, sf_dir)
    scored = scoring.score_images(images, _channel_model, "none", 0.8, threshold=128 / 255)
    words = masks.packed_words(scoring.detections_of(scored), ("image_id", "instance_id"))
    runs = masks.words_to_pieces(words)
    return masks.merge_pieces(runs, ("image_id", "instance_id"))


def _batched_bright_model(weights: str):
    """As ``_bright_model``, for lists of images of one shape; refuses some images."""

    def model(images, confs, imgsz):
        stack = np.stack(images)
        if (stack[:, 0, 0, 0] % 10 == 7).any():
            raise ValueError("forced failure")
        marks = [stack[..., 0] > 127, stack[..., 1] > 200]
        return [[(0.75, m[i].astype(np.float32)) for m in marks if m[i].any()] for i in range(len(stack))]

    return model


def scored_batches(spark, sf_dir):
    """Images of many shapes, scored many to a call; a refused one fails alone."""
    images = fx.frame_images(spark, sf_dir)
    scored = scoring.score_images(images, _batched_bright_model, "none", 0.5, threshold=0.5, batch=32)
    scored = durable(scored, "scored")
    words = masks.packed_words(scoring.detections_of(scored))
    areas = masks.mask_areas(masks.merge_pieces(masks.words_to_pieces(words), ["image_id"]))
    counted = masks.count_instances(images.select("image_id"), scoring.detections_of(scored))
    failed = scoring.errors_of(scored)
    return counted.join(areas, "image_id", "left").join(failed, "image_id", "left").select(
        "image_id", "num_instances", F.coalesce("mask_area", F.lit(0).cast("bigint")).alias("mask_area"), "error"
    )


def result_pairs(spark, sf_dir):
    images = fx.frame_images(spark, sf_dir)
    found = scoring.confident(fx.frame_detections(spark, sf_dir), 0.35)
    results = (
        images.join(found, "image_id", "left_semi")
        .select("image_id", names.beside_input(F.col("path")).alias("out_path"))
    )
    return report.pair_with_results(images, results)


def _frame_files(spark, sf_dir) -> str:
    directory = new_dir(spark, "frames")
    frames = fx.frame_images(spark, sf_dir)
    write_image_files(frames.withColumn("name", F.substring_index("path", "/", -1)), directory)
    return directory


def _file_name(path: str):
    return F.substring_index(path, "/", -1).alias("file")


def image_scan(spark, sf_dir):
    images = scan_images(spark, _frame_files(spark, sf_dir))
    lines = paint.scanlines(images).select(
        _file_name("path"), "height", "width", "n_channels", "y", F.col("line").alias("bgr"),
        F.col("image_id"),
    )
    keys = ["file", "height", "width", "n_channels"]
    pixels = lines.select(
        *keys, F.explode(F.split(F.regexp_replace(F.hex("bgr"), "(..)(?!$)", "$1,"), ",")).alias("v")
    )
    return pixels.groupBy(*keys).agg(F.sum(F.conv("v", 16, 10).cast("bigint")).alias("byte_sum"))


def _raw_pixels(content: bytes) -> np.ndarray:
    height, width = np.frombuffer(content[4:12], ">u4")
    return np.frombuffer(content, np.uint8, offset=12).reshape(height, width, 3)


#: A format without compression: a mark, height and width, B,G,R bytes.
RAW = Decoder(
    "raw", ((0, b"RAWF"),), _raw_pixels, lambda head: (*(int(v) for v in np.frombuffer(head[4:12], ">u4")), 3)
)


def decoded_scan(spark, sf_dir):
    """Files of a format of the caller's beside BMP under the wrong name, junk and a huge picture."""
    i, number = F.col("image_id"), lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    frames = fx.frame_images(spark, sf_dir).withColumn("stem", F.concat(F.lit("frame_"), i.cast("string")))
    told = F.when(i % 7 == 3, F.lit(1 << 20)).otherwise(F.col("height"))
    raw = F.concat(F.lit("RAWF").cast("binary"), number(told), number("width"), F.col("data"))
    content = F.when(i % 7 == 5, F.lit("junk").cast("binary")).otherwise(raw)
    directory = new_dir(spark, "formats")
    write_files(
        frames.filter("image_id % 2 = 1").select(F.concat("stem", F.lit(".webp")).alias("name"), content.alias("content")),
        f"{directory}/raw",
    )
    write_image_files(
        frames.filter("image_id % 2 = 0").withColumn("name", F.concat("stem", F.lit(".tiff"))), f"{directory}/bmp"
    )
    images = decode_others(scan_images(spark, f"{directory}/*"), [RAW], most_bytes=1 << 20)
    values = F.split(F.regexp_replace(F.hex("data"), "(..)(?!$)", "$1,"), ",")
    total = F.aggregate(values, F.lit(0).cast("bigint"), lambda s, v: s + F.conv(v, 16, 10).cast("bigint"))
    there = lambda c: F.when(F.col("height") > 0, c)
    return images.select(
        _file_name("path"), there(F.col("height")).alias("height"), there(F.col("width")).alias("width"),
        there(F.col("n_channels")).alias("n_channels"), there(total).alias("byte_sum"), "decode_error",
    )


def overlay_sink(spark, sf_dir):
    images = _frames_with_conf(spark, sf_dir)
    lines = overlay(images, fx.frame_detections(spark, sf_dir), FRAME).lines
    directory = new_dir(spark, "overlay")
    write_scanlines(lines, directory)
    stored = spark.read.schema(lines.schema).parquet(directory)
    whole = paint.assemble(stored, images)
    return paint.explode_pixels(
        paint.scanlines(whole).select("image_id", "y", F.col("line").alias("bgr"))
    )


def file_manifest(spark, sf_dir):
    """What a committed write has made of every row, also of those without a usable name."""
    i = F.col("image_id")
    name = F.when(i % 7 == 0, None).when(i % 11 == 0, F.col("path")).otherwise(F.substring_index("path", "/", -1))
    directory = new_dir(spark, "committed")
    frames = fx.frame_images(spark, sf_dir).withColumn("name", name)
    written = write_image_files(frames, directory)
    files = spark.read.format("binaryFile").load(directory).select(_file_name("path"), "length")
    return written.join(files, F.col("name") == F.col("file"), "left").select("name", "size", "error", "length")


def stream_ingest(spark, sf_dir):
    sink, checkpoint = new_dir(spark, "ingested"), new_dir(spark, "ingest-state")
    ingest(image_stream(spark, _frame_files(spark, sf_dir), files_per_batch=1000), sink, checkpoint)
    return spark.read.parquet(sink).select(_file_name("path"), "height", "width", "error")


def result_files(spark, sf_dir):
    """The whole job, read back through the paths that its report names."""
    out = new_dir(spark, "results")
    weights = new_dir(spark, "model")
    content = F.encode(F.lit("channels"), "utf-8").alias("content")
    write_files(spark.range(1).select(F.lit("model.txt").alias("name"), content), weights)
    images = fx.planes(spark, sf_dir).withColumn("out_path", names.beside_input(F.col("path")))
    rows = run(images, _channel_model, f"{weights}/model.txt", out, OverlayParams(conf=0.8, outline=1))
    files = scan_images(spark, f"{out}/images").select(_file_name("path"), "height", "width", "n_channels", "data")
    ok = rows.filter("status = 'ok'").select("image_id", "num_instances", _file_name("out_path"))
    lines = paint.scanlines(files.join(ok, "file").select("image_id", "height", "width", "n_channels", "data"))
    return paint.explode_pixels(lines.select("image_id", "y", F.col("line").alias("bgr")))


def stream_detect(spark, sf_dir):
    """Images scored, painted and counted as they arrive, in batches of a few files."""
    sink, checkpoint = new_dir(spark, "detected"), new_dir(spark, "detect-state")

    def step(images):
        scored = durable(scoring.score_images(images, _bright_model, "none", 0.5), "scored")
        found = scoring.confident(scoring.detections_of(scored), 0.5)
        runs = masks.merge_pieces(masks.words_to_pieces(masks.score_words(found, 0.5)), ["image_id"])
        counted = masks.count_instances(images.select("image_id", "path", "upload_key"), found)
        return counted.join(masks.mask_areas(runs), "image_id", "left")

    directory = _frame_files(spark, sf_dir)
    n = spark.read.format("binaryFile").load(directory).select("path").count()
    ingest(image_stream(spark, directory, files_per_batch=-(-n // 3)), sink, checkpoint, step)
    return spark.read.parquet(sink).select(
        _file_name("path"), "num_instances", F.coalesce("mask_area", F.lit(0).cast("bigint")).alias("mask_area")
    )


def _bright_model(weights: str):
    """Blue above 127 is one instance, and green above 200 another."""

    def model(image, conf, imgsz):
        marks = [image[:, :, 0] > 127, image[:, :, 1] > 200]
        return [(0.75, m.astype(np.float32)) for m in marks if m.any()]

    return model


def _refusing_bright_model(weights: str):
    """As ``_bright_model``; refuses some images."""
    bright = _bright_model(weights)

    def model(image, conf, imgsz):
        if image[0, 0, 0] % 10 == 7:
            raise ValueError("forced failure")
        return bright(image, conf, imgsz)

    return model


def stream_results(spark, sf_dir):
    """The whole job as files arrive, in three batches: reports, and the sizes of the files they name."""
    sink, checkpoint = new_dir(spark, "published"), new_dir(spark, "published-state")
    weights = new_dir(spark, "model")
    content = F.encode(F.lit("bright"), "utf-8").alias("content")
    write_files(spark.range(1).select(F.lit("model.txt").alias("name"), content), weights)
    directory = _frame_files(spark, sf_dir)
    n = spark.read.format("binaryFile").load(directory).select("path").count()
    model = f"{weights}/model.txt"
    params = OverlayParams(conf=0.5, outline=1)
    run_stream(
        spark, directory, _refusing_bright_model, model, sink, checkpoint, params, files_per_batch=-(-n // 3)
    )
    rows = published(spark, sink).select(
        _file_name("path"), "num_instances", "status", "message", F.substring_index("out_path", "/", -1).alias("name")
    )
    files = scan_images(spark, f"{sink}/stream=*/batch_id=*/images").select(
        F.substring_index("path", "/", -1).alias("name"), "height", "width"
    )
    return rows.join(files, "name", "left").drop("name")


ALL = {
    f.__name__: f
    for f in (
        masked_area,
        upload_validation,
        upload_report,
        upload_naming,
        output_name_collisions,
        param_parse_clamp,
        param_strict,
        colour_parse,
        colour_strict,
        linear_scores,
        conf_filter_count,
        mask_binarise_runs,
        mask_default_threshold,
        mask_union_runs,
        instance_run_union,
        mask_resize_runs,
        blend_pixels,
        outline_pixels,
        outline_speckle,
        outline_strips,
        outline_thick,
        outline_thick_wide,
        overlay_pixels,
        detection_report,
        scored_masks,
        scored_words,
        scored_batches,
        result_pairs,
        image_scan,
        decoded_scan,
        overlay_sink,
        file_manifest,
        stream_ingest,
        result_files,
        stream_detect,
        stream_results,
    )
}
