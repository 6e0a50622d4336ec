"""Decoders of the caller's, and resources of the scoring stage."""

import numpy as np
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import functions as F

from fissura.operators import scoring
from fissura.schemas import IMAGES
from fissura.sources.decoders import NOT_AN_IMAGE, Decoder, decode_others
from fissura.sources.images import scan_images
from tests.test_files import by_name, png


def _webp(content):
    """Stands in for a real decoder: shape after the mark, then pixels."""
    h, w, c = content[12:15]
    return np.frombuffer(content, np.uint8, offset=15).reshape(h, w, c)


WEBP = Decoder("webp", ((0, b"RIFF"), (8, b"WEBP")), _webp, lambda head: tuple(head[12:15]))


def webp(pixels):
    return b"RIFF....WEBP" + bytes(pixels.shape) + pixels.tobytes()


def test_decoded_by_content_whatever_the_name(spark, tmp_path):
    rng = np.random.default_rng(2)
    bgr = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    grey = rng.integers(0, 256, (2, 3, 1), dtype=np.uint8)
    (tmp_path / "right.webp").write_bytes(webp(bgr))
    (tmp_path / "wrong name é.png").write_bytes(webp(grey))
    (tmp_path / "spark.jpg").write_bytes(png(bgr[:, :, ::-1]))
    (tmp_path / "huge.webp").write_bytes(b"RIFF....WEBP" + bytes([200, 200, 4]) + bytes(9))
    (tmp_path / "short.webp").write_bytes(b"RIFF....WEBP" + bytes([9, 9, 3]) + bytes(9))
    (tmp_path / "odd.webp").write_bytes(b"RIFF....WEBP" + bytes([2, 2, 2]) + bytes(8))
    (tmp_path / "tiny.bmp").write_bytes(b"R")
    images = decode_others(scan_images(spark, str(tmp_path)), [WEBP], most_bytes=10_000)
    found = by_name(images.withColumn("path", F.concat(F.lit("/"), F.url_decode(F.substring_index("path", "/", -1)))))
    for name, pixels in (("right.webp", bgr), ("wrong name é.png", grey), ("spark.jpg", bgr)):
        row = found[name]
        assert (row["height"], row["width"], row["n_channels"]) == pixels.shape
        assert bytes(row["data"]) == pixels.tobytes() and row["decode_error"] is None
    assert found["huge.webp"]["decode_error"] == "webp: more than 10000 bytes of pixels"
    assert "reshape" in found["short.webp"]["decode_error"]
    assert found["odd.webp"]["decode_error"] == "webp: not rows x columns x 1, 3 or 4"
    assert found["tiny.bmp"]["decode_error"] == NOT_AN_IMAGE
    assert all(found[n]["height"] == -1 for n in ("huge.webp", "short.webp", "odd.webp", "tiny.bmp"))
    assert len(found) == 7
    assert "Exchange" not in images._jdf.queryExecution().executedPlan().toString()


def test_nothing_to_decode(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(np.zeros((2, 2, 3), np.uint8)))
    scanned = scan_images(spark, str(tmp_path))
    assert decode_others(scanned.limit(0), [WEBP]).count() == 0
    assert decode_others(scanned, []).first()["decode_error"] is None


def test_the_reason_reaches_the_scores(spark):
    images = spark.createDataFrame([(1, "p", -1, -1, -1, b"")], IMAGES).withColumn("decode_error", F.lit("webp: bad"))
    scored = scoring.score_images(images, lambda w: lambda image, conf, imgsz: [], "w")
    assert scored.first()["error"] == "Inference failed: webp: bad"


def test_only_the_scoring_stage_has_its_resources(spark):
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build
    images = spark.createDataFrame([(i, "p", 2, 2, 3, bytes(12)) for i in range(4)], IMAGES)
    load = lambda w: lambda image, conf, imgsz: []
    scored = scoring.score_images(images, load, "w", profile=profile)
    later = scored.groupBy("error").count()._jdf.queryExecution().analyzed()
    nodes = [later]
    with_profile = []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "MapInArrow" and node.profile().isDefined():
            with_profile.append(node.profile().get().id())
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    assert with_profile == [profile.id]  # the default one has no place in a plan


def test_tasks_of_a_model_that_spans_them_start_together(spark):
    def load(weights):
        from pyspark import BarrierTaskContext

        peers = len(BarrierTaskContext.get().getTaskInfos())
        return lambda image, conf, imgsz: [(peers / 10, np.ones((1, 1)))]

    images = spark.createDataFrame([(i, "p", 2, 2, 3, bytes(12)) for i in range(8)], IMAGES).repartition(2)
    scored = scoring.score_images(images, load, "w", barrier=True)
    assert {round(r["conf"], 3) for r in scoring.detections_of(scored).collect()} == {0.2}
