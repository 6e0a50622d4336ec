"""Image files: scanning, writing and incremental ingestion."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fissura.functions import names
from fissura.operators import paint, validation
from fissura.schemas import IMAGES
from fissura.sources import images as source
from fissura.sources import sinks
from fissura.streaming import ingest


def png(pixels):
    """PNG bytes of an RGB or RGBA array."""
    h, w, c = pixels.shape

    def chunk(kind, body):
        data = kind + body
        return struct.pack(">I", len(body)) + data + struct.pack(">I", zlib.crc32(data))

    head = struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[c], 0, 0, 0)
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", head)
        + chunk(b"IDAT", zlib.compress(lines))
        + chunk(b"IEND", b"")
    )


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(5)
    rgb = rng.integers(0, 256, (4, 6, 3), dtype=np.uint8)
    rgba = rng.integers(0, 256, (3, 5, 4), dtype=np.uint8)
    (root / "sub").mkdir()
    (root / "a.PNG").write_bytes(png(rgb))
    (root / "sub" / "b.png").write_bytes(png(rgba))
    (root / "junk.jpg").write_bytes(b"no image")
    (root / "page.webp").write_bytes(b"RIFF....WEBP")
    (root / "empty.png").write_bytes(b"")
    (root / "notes.txt").write_bytes(b"text")
    (root / "huge.bmp").write_bytes(b"x" * 5000)
    return root, rgb, rgba


def by_name(df):
    return {r["path"].rsplit("/", 1)[1]: r for r in df.collect()}


def test_scan(spark, folder):
    root, rgb, rgba = folder
    images = source.scan_images(spark, str(root), max_bytes=4000)
    found = by_name(images)
    assert set(found) == {"a.PNG", "b.png", "junk.jpg", "page.webp"}
    assert (found["a.PNG"]["height"], found["a.PNG"]["width"]) == (4, 6)
    assert bytes(found["a.PNG"]["data"]) == rgb[:, :, ::-1].tobytes()
    assert found["b.png"]["n_channels"] == 4
    assert found["junk.jpg"]["height"] == found["page.webp"]["height"] == -1
    again = by_name(source.scan_images(spark, str(root), max_bytes=4000))
    assert all(found[n]["image_id"] == again[n]["image_id"] for n in found)
    assert validation.output_collisions(images, "image_id").isEmpty()


def test_size_cap_and_type_act_on_the_listing(spark, folder):
    images = source.scan_images(spark, str(folder[0]), max_bytes=4000).select("path")
    images.collect()
    plan = images._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() == 4


def test_listing_columns_decode_nothing(spark, folder):
    ids = source.scan_images(spark, str(folder[0])).select("image_id", "path", "upload_key")
    assert "ReadSchema: struct<>" in ids._jdf.queryExecution().executedPlan().toString()


def test_empty_files_are_found_by_manifest(spark, folder):
    root = folder[0]
    listed = source.list_files(spark, str(root))
    assert "empty.png" not in by_name(listed)
    paths = [(p.resolve().as_uri().replace("file:///", "file:/"),) for p in root.rglob("*.*")]
    manifest = spark.createDataFrame(paths, "path string")
    missing = by_name(validation.not_scanned(manifest, listed))
    assert set(missing) == {"empty.png"}
    checked = {r["filename"]: r["reject_reason"] for r in validation.check_uploads(listed).collect()}
    assert checked["notes.txt"] == "unsupported_type" and checked["junk.jpg"] is None


def test_listing_glob_takes_any_case(spark, tmp_path):
    for n in ("A.JPG", "b.JpEg", "c.Tiff", "d.gif"):
        (tmp_path / n).write_bytes(b"x")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", names.listing_glob())
    assert set(by_name(reader.load(str(tmp_path)))) == {"A.JPG", "b.JpEg", "c.Tiff"}


def test_written_images_scan_back(spark, tmp_path):
    rng = np.random.default_rng(6)
    arrays = [rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for h, w in ((1, 1), (4, 5), (7, 10))]
    rows = [(i, f"{i}.bmp", *a.shape, a.tobytes()) for i, a in enumerate(arrays)]
    images = spark.createDataFrame(rows, IMAGES)
    target = str(tmp_path / "out")
    for _ in range(2):  # a second attempt replaces the files
        sinks.write_image_files(images, target, "path")
    found = by_name(source.scan_images(spark, target))
    assert len(found) == 3 and len(list((tmp_path / "out").iterdir())) == 3
    for i, a in enumerate(arrays):
        assert bytes(found[f"{i}.bmp"]["data"]) == a.tobytes()


def test_scanline_sink_round_trip(spark, tmp_path):
    rows = [(1, y, bytes([y] * 6)) for y in range(5)]
    lines = spark.createDataFrame(rows, "image_id bigint, y int, bgr binary")
    target = str(tmp_path / "lines")
    sinks.write_scanlines(lines, target, ("image_id",))
    assert sorted(map(str, spark.read.parquet(target).select(*lines.columns).collect())) == sorted(
        map(str, lines.collect())
    )


def test_stream_takes_each_file_once(spark, tmp_path):
    inbox, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    rng = np.random.default_rng(8)

    def arrive(name):
        (inbox / name).write_bytes(png(rng.integers(0, 256, (3, 4, 3), dtype=np.uint8)))

    def step():
        ingest.ingest(ingest.image_stream(spark, str(inbox)), sink, state)
        return spark.read.parquet(sink)

    arrive("a.png"), arrive("b.PNG"), arrive("skip.txt")
    (inbox / "bad.jpg").write_bytes(b"junk")
    first = by_name(step())
    assert set(first) == {"a.png", "b.PNG", "bad.jpg"}
    assert first["bad.jpg"]["error"].startswith("Inference failed: ")
    assert first["a.png"]["error"] is None
    assert len(by_name(step())) == 3
    arrive("c.png")
    second = step()
    assert second.count() == 4 and second.select("upload_key").distinct().count() == 4


def test_replayed_batch_changes_nothing(spark, tmp_path):
    sink = str(tmp_path / "out")
    batch = spark.range(5).withColumnRenamed("id", "image_id")
    for n in (0, 1, 1):
        ingest.write_batch(batch.withColumn("n", F.lit(n)), sink, n)
    assert spark.read.parquet(sink).count() == 10


def test_a_new_stream_keeps_what_an_old_one_stored(spark, tmp_path):
    inbox, sink = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for name in ("a.png", "b.png", "c.png"):
        (inbox / name).write_bytes(png(np.zeros((2, 2, 3), np.uint8)))
    for state in ("one", "two"):
        stream = ingest.image_stream(spark, str(inbox), files_per_batch=1)
        ingest.ingest(stream, sink, str(tmp_path / state))
        (inbox / f"{state}.png").write_bytes(png(np.zeros((2, 2, 3), np.uint8)))
    stored = by_name(spark.read.parquet(sink))
    assert set(stored) == {"a.png", "b.png", "c.png", "one.png"}
    assert spark.read.parquet(sink).count() == 4


def test_every_input_is_reported(spark, folder):
    root = folder[0]
    paths = [(p.resolve().as_uri().replace("file:///", "file:/"), p.name, p.stat().st_size) for p in root.rglob("*.*")]
    inputs = spark.createDataFrame([*paths, ("file:/gone.png", "gone.png", 9)], "path string, filename string, length bigint")
    images = source.scan_images(spark, str(root), 4000)
    decoded = F.col("height") > 0
    path = F.regexp_replace("path", "^file:///", "file:/")
    report = images.select(path.alias("path"), F.when(decoded, "ok").otherwise("error").alias("status"), F.lit("m").alias("message"))
    found = {r["filename"]: r["status"] for r in validation.input_report(inputs, report, 4000).collect()}
    assert found == {
        "a.PNG": "ok", "b.png": "ok", "junk.jpg": "error", "page.webp": "error", "empty.png": "empty",
        "notes.txt": "unsupported_type", "huge.bmp": "too_large", "gone.png": "absent",
    }


def test_stream_runs_whole_operators(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.png").write_bytes(png(np.zeros((3, 4, 3), np.uint8)))

    def lines(images):
        return paint.scanlines(images).select("image_id", "y", "line")

    ingest.ingest(
        ingest.image_stream(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "state"), lines
    )
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_jpeg_and_tiff_decode(spark, tmp_path):
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(6, 4, 5)
    for y in range(4):
        for x in range(6):
            picture.setRGB(x, y, 0x0A7832)  # one colour survives JPEG coding nearly unchanged
    for kind in ("jpg", "tiff", "bmp", "png"):
        target = jvm.java.io.File(str(tmp_path / f"p.{kind.upper()}"))
        assert jvm.javax.imageio.ImageIO.write(picture, kind, target)
    found = by_name(source.scan_images(spark, str(tmp_path)))
    assert len(found) == 4
    for name, r in found.items():
        assert (r["height"], r["width"], r["n_channels"]) == (4, 6, 3), name
        pixels = np.frombuffer(bytes(r["data"]), np.uint8).reshape(-1, 3).astype(int)
        assert np.abs(pixels - (0x32, 0x78, 0x0A)).max() <= (3 if name == "p.JPG" else 0), name


def written(spark, rows, target):
    return sinks.write_files(spark.createDataFrame(rows, "name string, content binary"), target)


def test_files_appear_together_or_not_at_all(spark, tmp_path):
    target = str(tmp_path / "out")
    assert sinks.read_manifest(spark, target).count() == 0
    manifest = written(spark, [("a", b"1"), ("b", b"22")], target)
    assert sorted(tuple(r) for r in manifest.collect()) == [("a", 1, None), ("b", 2, None)]

    def fail(batches):
        for batch in batches:
            yield batch
        raise RuntimeError("killed")

    broken = spark.createDataFrame([(f"n{i}", b"x") for i in range(40)], "name string, content binary").repartition(4)
    with pytest.raises(Exception, match="killed"):
        sinks.write_files(broken.mapInPandas(fail, "name string, content binary"), target)
    # The earlier files and manifest stand, and nothing is left beside them.
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"a": b"1", "b": b"22"}
    assert sinks.read_manifest(spark, target).count() == 2
    assert {p.name for p in tmp_path.iterdir()} == {"out", "_out.manifest"}
    written(spark, [("c", b"333")], target)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["c"]
    assert {p.name for p in tmp_path.iterdir()} == {"out", "_out.manifest"}


def test_rows_without_a_file_name_are_error_rows(spark, tmp_path):
    rows = [(None, b"1"), (None, b"2"), ("", b"3"), ("x/y", b"4"), ("..", b"5"), ("a.png", None), ("b.png", b"")]
    manifest = written(spark, rows, str(tmp_path / "out")).collect()
    assert len(manifest) == len(rows)
    assert {(r["name"], r["error"]) for r in manifest} == {
        (None, "no name"), ("", "not a file name"), ("x/y", "not a file name"), ("..", "not a file name"),
        ("a.png", "no content"), ("b.png", None),
    }
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["b.png"]
    assert written(spark, [], str(tmp_path / "none")).count() == 0


def test_lost_attempts_leave_nothing(tmp_path):
    """Two attempts of one task: one dies in the middle of a file, one after its files."""
    import pyarrow as pa

    def batch(*rows):
        return pa.RecordBatch.from_pydict({"name": [r[0] for r in rows], "content": [r[1] for r in rows]})

    def dying(*rows):
        yield batch(*rows)
        raise OSError("lost")

    writer = sinks._FilesWriter(f"file://{tmp_path}/out")
    with pytest.raises(OSError):
        writer.write(dying(("a", b"old")))
    lost = writer.write(iter([batch(("a", b"old"), ("b", b"old"))]))  # its message never arrives
    kept = [writer.write(iter([batch(("a", b"1"), ("b", b"2"))])), writer.write(iter([batch(("c", b"3"))]))]
    assert lost.part not in {m.part for m in kept} and not (tmp_path / "out").exists()
    writer.commit([*kept, None])
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"a": b"1", "b": b"2", "c": b"3"}
    assert {p.name for p in (tmp_path / "_out.manifest").iterdir()} == {m.part for m in kept}
    other = sinks._FilesWriter(f"file://{tmp_path}/out")
    other.abort([other.write(iter([batch(("z", b"9"))]))])
    assert {p.name for p in tmp_path.iterdir()} == {"out", "_out.manifest"}


def test_images_without_a_result_path_are_errors(spark, tmp_path):
    from pyspark.sql import functions as F

    from fissura.plans import overlay as plan

    weights = tmp_path / "w.txt"
    weights.write_text("")
    images = spark.createDataFrame([(i, "p", 2, 2, 3, bytes(12)) for i in range(4)], IMAGES)
    images = images.withColumn("out_path", F.when(F.col("image_id") > 1, F.concat(F.lit("r"), F.col("image_id").cast("string"))))
    report = plan.run(images, lambda path: lambda image, conf, imgsz: [], str(weights), str(tmp_path / "o"))
    found = {r["image_id"]: (r["status"], r["error"]) for r in report.collect()}
    assert found == {i: ("ok", None) if i > 1 else ("error", "Inference failed: no result path") for i in range(4)}
    assert sorted(p.name for p in (tmp_path / "o" / "images").iterdir()) == ["r2.png", "r3.png"]
