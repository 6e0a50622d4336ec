import numpy as np
import pytest
from pyspark.sql import functions as F

from fissura.operators import masks, paint, report, scoring, validation
from fissura.plans import overlay as plan
from fissura.plans.overlay import OverlayParams
from fissura.schemas import DETECTIONS, IMAGES
from fissura.sources.images import scan_images
from fissura.storage import durable
from tests import brute

SIZES = [(9, 11), (16, 16), (7, 40), (30, 5)]


def collect_images(lines):
    """Scanlines to one array per image."""
    out = {}
    for r in lines.collect():
        out.setdefault(r["image_id"], {})[r["y"]] = np.frombuffer(bytes(r["bgr"]), np.uint8)
    return {i: np.stack([v[y] for y in sorted(v)]).reshape(len(v), -1, 3) for i, v in out.items()}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    images, grids = [], {}
    for i in range(16):
        h, w = SIZES[i % 4]
        images.append(rng.integers(0, 256, (h, w, 3), dtype=np.uint8))
        mask_shape = (h, w) if i % 3 else (8, 8)
        n = i % 4
        grids[i] = (rng.random((n, *mask_shape)) < 0.4, rng.random(n).astype(np.float32))
    image_rows = [
        (i, f"a/{i}.png", *m.shape, m.tobytes()) for i, m in enumerate(images)
    ]
    detection_rows = [
        (i, k, float(c), *m.shape, [0.9 if v else 0.2 for v in m.ravel()])
        for i, (ms, cs) in grids.items()
        for k, (m, c) in enumerate(zip(ms, cs))
    ]
    return (
        spark.createDataFrame(image_rows, IMAGES),
        spark.createDataFrame(detection_rows, DETECTIONS),
        images,
        grids,
    )


def expected(image, masks_, confs, conf, alpha, outline, colour):
    keep = [m for m, c in zip(masks_, confs) if c >= np.float32(conf)]
    if not keep:
        return image
    h, w = image.shape[:2]
    union = brute.fit(np.any(keep, axis=0), h, w)
    drawn = brute.thicken(brute.outline(union), outline, h, w) if outline > 0 else set()
    return brute.blend(image, union, drawn, alpha, colour)


@pytest.mark.parametrize(
    "params",
    [
        OverlayParams(),
        OverlayParams(alpha=0.0, outline=0),
        OverlayParams(alpha=1.0, outline=1, colour=(12, 200, 7)),
        OverlayParams(conf=0.9, alpha=0.3, outline=5),
        OverlayParams(conf=2.0),
    ],
)
def test_overlay_matches_brute_force(corpus, params):
    images, detections, arrays, grids = corpus
    found = collect_images(plan.overlay(images, detections, params).lines)
    assert set(found) == set(range(len(arrays)))
    for i, image in enumerate(arrays):
        want = expected(
            image, *grids[i], params.conf, params.alpha, params.outline, params.colour
        )
        assert np.array_equal(found[i], want), i
    if params.alpha == 0.0:
        assert all(np.array_equal(found[i], a) for i, a in enumerate(arrays))


def test_parameters_per_image(corpus):
    images, detections, arrays, grids = corpus
    i = F.col("image_id")
    own = images.withColumns(
        {
            "conf": (i % 3) * 0.3,
            "alpha": (i % 5) / 4.0,
            "outline": (i % 4).cast("int"),
            "colour": F.struct(
                F.lit(1).alias("b"), F.lit(2).alias("g"), i.cast("int").alias("r")
            ),
        }
    )
    found = collect_images(plan.overlay(own, detections).lines)
    for k, image in enumerate(arrays):
        want = expected(image, *grids[k], (k % 3) * 0.3, (k % 5) / 4.0, k % 4, (1, 2, k))
        assert np.array_equal(found[k], want), k


def test_result_does_not_depend_on_partitioning(corpus):
    images, detections, *_ = corpus
    one = plan.overlay(images.coalesce(1), detections.coalesce(1)).lines
    many = plan.overlay(images.repartition(7), detections.repartition(11)).lines
    assert sorted(one.collect()) == sorted(many.collect())


def test_grey_and_alpha_images_become_bgr(spark):
    rng = np.random.default_rng(4)
    grey = rng.integers(0, 256, (3, 4, 1), dtype=np.uint8)
    rgba = rng.integers(0, 256, (2, 5, 4), dtype=np.uint8)
    rows = [(i, "p", *m.shape, m.tobytes()) for i, m in enumerate((grey, rgba))]
    rows.append((2, "p", -1, -1, -1, b""))
    images = spark.createDataFrame(rows, IMAGES)
    none = spark.createDataFrame([], DETECTIONS)
    found = collect_images(plan.overlay(images, none).lines)
    assert np.array_equal(found[0], np.repeat(grey, 3, axis=2))
    assert np.array_equal(found[1], rgba[:, :, :3])
    assert set(found) == {0, 1}


def test_assemble_restores_images(corpus):
    images, *_ = corpus
    lines = paint.scanlines(images).select("image_id", "y", F.col("line").alias("bgr"))
    whole = paint.assemble(lines.repartition(5, "y"), images)
    assert sorted(map(str, whole.collect())) == sorted(map(str, images.collect()))


def test_confidence_never_passes_nan(spark):
    rows = [(1, 1, float("nan")), (1, 2, 0.5), (2, 3, 0.5)]
    df = spark.createDataFrame(rows, "image_id bigint, instance_id bigint, conf float")
    assert [r[1] for r in scoring.confident(df, 0.5).orderBy("instance_id").collect()] == [2, 3]
    assert scoring.confident(df, float("nan")).count() == 0
    limits = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "image_id bigint, conf double")
    assert [r[1] for r in scoring.confident(df, limits).collect()] == [3]


LOADS = []


def load_thresholder(weights):
    with open(weights) as f:
        level = int(f.read())

    def model(image, conf, imgsz):
        if image.shape[1] == 5:
            raise RuntimeError("five wide")
        return [(0.75, (image[:, :, k] > level).astype(np.float32)) for k in range(2)]

    return model


def test_run_end_to_end(spark, corpus, tmp_path):
    images, _, arrays, _ = corpus
    weights = tmp_path / "weights.txt"
    weights.write_text("200")
    broken = spark.createDataFrame([(99, "a/99.png", -1, -1, -1, b"")], IMAGES)
    source = images.unionByName(broken).withColumn(
        "out_path", F.concat(F.lit("out/"), F.col("image_id").cast("string"))
    )
    rows = plan.run(source, load_thresholder, str(weights), str(tmp_path / "out"))
    found = {r["image_id"]: r for r in rows.collect()}
    assert all(r["alpha"] == 0.5 and r["outline"] == 2 and r["conf"] == 0.25 for r in found.values())
    written = {str(p) for p in (tmp_path / "out" / "images").glob("*.png")}
    assert written == {r["out_path"] for r in found.values() if r["status"] == "ok"}
    read = {
        r["path"].rsplit("/", 1)[1]: np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["height"], r["width"], 3)
        for r in scan_images(spark, str(tmp_path / "out" / "images")).collect()
    }
    assert len(found) == len(arrays) + 1
    assert found[99]["message"] == "Inference failed: image could not be decoded"
    painted = collect_images(spark.read.parquet(str(tmp_path / "out" / "overlay")))
    for i, image in enumerate(arrays):
        if image.shape[1] == 5:
            assert found[i]["status"] == "error" and "five wide" in found[i]["error"]
            assert i not in painted and found[i]["num_instances"] is None
            continue
        assert found[i]["num_instances"] == 2 and found[i]["status"] == "ok"
        planes = [image[:, :, k] > 200 for k in range(2)]
        want = expected(image, planes, [0.75] * 2, 0.25, 0.5, 2, (0, 0, 255))
        assert np.array_equal(painted[i], want) and np.array_equal(read[f"{i}.png"], want)


def test_missing_weights_and_clashing_paths(spark, corpus, tmp_path):
    images = corpus[0].withColumn("out_path", F.lit("same"))
    with pytest.raises(FileNotFoundError, match="Weights not found"):
        scoring.ship_weights(spark, str(tmp_path / "absent.pt"))
    weights = tmp_path / "w0.txt"
    weights.write_text("200")
    rows = plan.run(images, load_thresholder, str(weights), str(tmp_path / "clash")).collect()
    assert len(rows) == 16 and {r["status"] for r in rows} == {"error"}
    again = images.withColumn("image_id", F.lit(1).cast("bigint"))
    with pytest.raises(ValueError, match="image_id is not unique"):
        plan.run(again, load_thresholder, str(weights), str(tmp_path))


def faulty(kind):
    ones = np.ones((4, 4), np.float32)
    return {
        0: [(0.9, ones[0])], 1: [(0.9, ones[None])], 2: [(0.9, ones), (0.9, np.ones((2, 2), np.float32))],
        3: [(0.9, ones * np.nan)], 4: [(float("nan"), ones)], 5: [("x", ones)],
    }.get(kind, [(0.9, ones)])


def test_faulty_masks_and_parameters_stay_with_their_image(spark, tmp_path):
    weights = tmp_path / "f.txt"
    weights.write_text("")
    rows = [(i, "p", 4, 4, 3, bytes([i] * 48)) for i in range(9)]
    images = spark.createDataFrame(rows, IMAGES).withColumns(
        {
            "out_path": F.concat(F.lit("f"), F.col("image_id").cast("string")),
            "alpha": F.when(F.col("image_id") != 6, 0.5),
            "colour": F.when(F.col("image_id") != 7, F.struct(*(F.lit(9).alias(n) for n in "bgr"))),
            "outline": F.when(F.col("image_id") == 8, 2147483647).otherwise(1),
        }
    )

    def load(path):
        return lambda image, conf, imgsz: faulty(int(image[0, 0, 0]))

    report = {r["image_id"]: r for r in plan.run(images, load, str(weights), str(tmp_path / "o")).collect()}
    assert [report[i]["status"] for i in range(9)] == ["error"] * 3 + ["ok"] * 2 + ["error"] + ["ok"] * 3
    assert [report[i]["num_instances"] for i in (3, 4, 6, 7, 8)] == [1, 0, 1, 1, 1]
    painted = collect_images(spark.read.parquet(str(tmp_path / "o" / "overlay")))
    assert set(painted) == {3, 4, 6, 7, 8} and (painted[3] == 3).all()
    assert painted[7][1, 1].tolist() == [4, 4, 131] and (painted[8] == 9).all()


def test_mixed_mask_shapes_are_united(spark):
    rng = np.random.default_rng(2)
    grids = [rng.random(s) < 0.4 for s in ((8, 8), (2, 2), (3, 5))]
    rows = [(1, k, 0.9, *g.shape, [0.9 if v else 0.1 for v in g.ravel()]) for k, g in enumerate(grids)]
    images = spark.createDataFrame([(1, "p", 8, 8, 3, bytes(192))], IMAGES)
    fill = plan.overlay(images, spark.createDataFrame(rows, DETECTIONS)).fill.collect()
    want = np.any([brute.fit(g, 8, 8) for g in grids], axis=0)
    assert brute.pixels(fill) == brute.set_pixels(want)
    assert sum(r["x1"] - r["x0"] for r in fill) == want.sum()


def test_two_loaders_of_one_file_are_two_models(spark, corpus, tmp_path):
    weights = tmp_path / "same.txt"
    weights.write_text("200")
    images = corpus[0].limit(1).coalesce(1)

    def loader(n):
        return lambda path: lambda image, conf, imgsz: [(0.5, np.ones((2, 2)))] * n

    counts = []
    for n in (2, 0):
        load = loader(n)
        shipped = scoring.ship_weights(spark, str(weights), load)
        counts.append(scoring.detections_of(scoring.score_images(images, load, shipped)).count())
    assert counts == [2, 0]


def test_model_loads_once_per_worker(spark, corpus, tmp_path):
    log = tmp_path / "loads"
    log.mkdir()
    weights = tmp_path / "w2.txt"
    weights.write_text("200")

    def load(path):
        import os
        import uuid

        (log / f"{os.getpid()}-{uuid.uuid4().hex}").write_text("")
        return lambda image, conf, imgsz: []

    scoring.score_images(corpus[0].repartition(8), load, str(weights)).collect()
    scoring.score_images(corpus[0].repartition(8), load, str(weights)).collect()
    pids = [p.name.split("-")[0] for p in log.iterdir()]
    assert pids and len(pids) == len(set(pids))


def test_malformed_masks_are_reported_and_left_out(corpus, spark):
    images, *_ = corpus
    bad = spark.createDataFrame([(1, 7, 0.9, 4, 4, [0.9] * 9)], DETECTIONS)
    assert [r["image_id"] for r in masks.malformed(bad).collect()] == [1]
    assert plan.overlay(images, bad).fill.count() == 0


def test_report_messages(spark):
    images = spark.createDataFrame(
        [(i, f"o{i}", 0.25) for i in range(4)], "image_id bigint, out_path string, conf double"
    )
    detections = spark.createDataFrame([(1,), (2,), (2,)], "image_id bigint")
    errors = spark.createDataFrame([(3, "Inference failed: x")], "image_id bigint, error string")
    rows = {r["image_id"]: r for r in report.report(images, detections, errors).collect()}
    assert [rows[i]["message"] for i in range(4)] == [
        "No cracks detected", "Found 1 crack instance", "Found 2 crack instances", "Inference failed: x",
    ]
    assert rows[0]["out_path"] == "o0" and rows[3]["out_path"] is None and rows[0]["conf"] == 0.25
    said = [
        r[0]
        for r in images.select(report.console_message(F.col("image_id"), F.col("out_path"))).collect()
    ]
    assert said[2] == "Detected 2 crack instance(s). Saved: o2" and said[0].startswith("No cracks")


def test_upload_checks_at_the_boundary(spark):
    cap = 16 * 1024 * 1024
    rows = [
        ("1", "a.jpg", cap - 1), ("2", "a.jpg", cap), ("3", "a.jpg", cap + 1), ("4", "a.jpg", 0),
        ("5", None, 5), ("6", "", 5), ("7", "a.gif", 5), ("8", "", cap + 1), ("9", "a.webp", None),
    ]
    df = spark.createDataFrame(rows, "upload_id string, filename string, length bigint")
    checked = validation.check_uploads(df)
    found = {r["upload_id"]: r["reject_reason"] for r in checked.collect()}
    assert found == {
        "1": None, "2": None, "3": "too_large", "4": None, "5": "missing", "6": "missing",
        "7": "unsupported_type", "8": "too_large", "9": None,
    }
    assert validation.accepted(checked).count() + validation.rejected(checked).count() == len(rows)


def test_durable_runs_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    stored = durable(spark.range(50).mapInArrow(count, "id bigint"), "test")
    assert stored.count() == 50 and stored.agg(F.sum("id")).first()[0] == 1225 and seen.value == 50


def test_raw_request_texts_steer_the_overlay(corpus):
    from fissura.functions.params import normalise_params, parse_colour

    images, detections, arrays, grids = corpus
    texts = [("0.4", "1", "3"), ("abc", "1", "3"), (None, "-2", "0"), ("0.1", None, "99")]
    pick = {
        name: F.element_at(F.array(*(F.lit(t[k]) for t in texts)), (F.col("image_id") % 4 + 1).cast("int"))
        for k, name in enumerate(("conf_raw", "alpha_raw", "outline_raw"))
    }
    own = normalise_params(images.withColumns(pick)).withColumn(
        "colour", parse_colour(F.lit(" 5, 300 ,-1"))
    )
    found = collect_images(plan.overlay(own, detections).lines)
    meant = [(0.4, 1.0, 3), (0.25, 0.5, 2), (0.25, 0.0, 0), (0.1, 0.5, 10)]
    for i, image in enumerate(arrays):
        want = expected(image, *grids[i], *meant[i % 4], (5, 255, 0))
        assert np.array_equal(found[i], want), i


def test_one_image_with_most_of_the_instances(spark):
    rng = np.random.default_rng(9)
    many = [(0, k, 0.9, 6, 40, rng.random(240).astype(np.float32).tolist()) for k in range(300)]
    few = [(i, 0, 0.9, 6, 40, rng.random(240).astype(np.float32).tolist()) for i in range(1, 20)]
    detections = spark.createDataFrame(many + few, DETECTIONS).repartition(6)
    union = np.any([np.array(r[5], np.float32) > np.float32(0.995) for r in many], axis=0)
    runs = masks.merge_pieces(
        masks.words_to_pieces(masks.score_words(detections, 0.995)), ["image_id"]
    )
    found = brute.pixels(runs.filter("image_id = 0").collect())
    assert found == brute.set_pixels(union.reshape(6, 40))


def test_batches_give_what_single_images_give(spark, tmp_path):
    """Shapes mixed, one image poisoned, one malformed, one undecodable, and a call that loses a result."""
    rng = np.random.default_rng(21)
    shapes = [(4, 6), (5, 5), (4, 6), (9, 3)]
    rows = [(i, "p", *s, 3, rng.integers(0, 200, (*s, 3), dtype=np.uint8).tobytes()) for i in range(60) for s in [shapes[i % 4]]]
    poison, short, bad = 17, 30, 41
    for i, value in ((poison, 250), (short, 251), (bad, 252)):
        data = bytes([value]) + rows[i][5][1:]
        rows[i] = (*rows[i][:5], data)
    rows.append((99, "p", -1, -1, -1, b""))
    images = spark.createDataFrame(rows, IMAGES).repartition(3)
    calls = tmp_path / "calls"
    calls.mkdir()

    def one(image, conf, imgsz):
        first = image[0, 0, 0]
        if first == 250:
            raise RuntimeError("poison")
        if first == 252:
            return [(0.9, np.ones(3))]
        return [(0.5 + k / 4, (image[:, :, k] > 100).astype(np.float32)) for k in range(2)]

    def load_one(path):
        return one

    def load_many(path):
        import os
        import uuid

        def model(images, confs, imgsz):
            (calls / f"{os.getpid()}-{uuid.uuid4().hex}").write_text(str(len(images)))
            assert len({i.shape for i in images}) == 1 and len(confs) == len(images)
            found = [one(i, c, imgsz) for i, c in zip(images, confs)]
            return found[1:] if any(i[0, 0, 0] == 251 for i in images) else found

        return model

    def rows_of(scored):
        return sorted(str(r) for r in scored.collect() if r["image_id"] != short)

    for kind in ({}, {"threshold": 0.5}):
        want = scoring.score_images(images, load_one, "a", 0.6, **kind)
        got = scoring.score_images(images, load_many, "b", 0.6, **kind, batch=8)
        assert rows_of(got) == rows_of(want)
    sizes = [int(p.read_text()) for p in calls.iterdir()]
    assert max(sizes) > 4
    errors = {r["image_id"]: r["error"] for r in scoring.errors_of(got).collect()}
    assert set(errors) == {poison, short, bad, 99} and "poison" in errors[poison]
    assert "another number of results" in errors[short] and "two-dimensional" in errors[bad]
    plan_text = got._jdf.queryExecution().executedPlan().toString()
    assert plan_text.split("Initial Plan")[-1].count("Exchange") == 1  # the test's own repartition
