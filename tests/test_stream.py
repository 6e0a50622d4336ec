"""The whole job as images arrive."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fissura.operators import scoring
from fissura.plans import fixtures
from fissura.plans.overlay import run
from fissura.plans.queries import _refusing_bright_model
from fissura.sources.images import scan_images
from fissura.streaming import ingest, job
from tests.test_files import png


def arrive(inbox, *names, seed=1):
    rng = np.random.default_rng(seed)
    inbox.mkdir(exist_ok=True)
    for name in names:
        pixels = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
        pixels[0, 0, 2] = 7 if "bad" in name else 1  # blue comes last in the file
        (inbox / name).write_bytes(png(pixels))


@pytest.fixture
def place(tmp_path):
    weights = tmp_path / "model.txt"
    weights.write_text("bright")
    return tmp_path, tmp_path / "in", str(tmp_path / "out"), str(weights)


def stream(spark, place, state="state", **more):
    root, inbox, sink, weights = place
    return job.run_stream(
        spark, str(inbox), _refusing_bright_model, weights, sink, str(root / state), **more
    )


SAME = ["upload_key", "num_instances", "status", "message"]


def rows(df):
    return sorted(map(tuple, df.select(*SAME).collect()))


def pixels(spark, report):
    """What the files hold that a report names, by upload key."""
    named = {r["out_path"]: r["upload_key"] for r in report.filter("status = 'ok'").collect()}
    files = spark.read.format("image").load(list(named)).select("image.origin", "image.data").collect()
    return {named[r["origin"].replace("file://", "")]: bytes(r["data"]) for r in files}


def batch_job(spark, place):
    root, inbox, _, weights = place
    images = job.named_by_key(scan_images(spark, str(inbox)))
    return run(images, _refusing_bright_model, weights, str(root / "whole"))


@pytest.mark.parametrize("where", ["inside", "after the job", "after the keys"])
def test_a_stream_that_dies_between_writes_ends_as_the_batch_job(spark, place, monkeypatch, where):
    inbox, sink = place[1], place[2]
    arrive(inbox, "a.png", "b [1].png", "c{x}.png", "bad.png", "e.png")
    (inbox / "junk.jpg").write_bytes(b"no image")
    whole, mark, calls = job.run, job._mark, []

    def dies(step):
        def wrapped(*args, **kwargs):
            calls.append(1)
            step(*args, **kwargs)
            if len(calls) == 2:
                raise RuntimeError("lost")

        return wrapped

    if where == "inside":
        from fissura.plans import overlay

        monkeypatch.setattr(overlay, "write_image_files", dies(overlay.write_image_files))
    elif where == "after the keys":
        monkeypatch.setattr(job, "_mark", dies(mark))
    else:
        monkeypatch.setattr(job, "run", dies(whole))
    with pytest.raises(Exception, match="lost"):
        stream(spark, place, files_per_batch=2)
    seen = job.published(spark, sink).count()
    assert seen == (4 if where == "after the keys" else 2)  # whole batches only
    monkeypatch.undo()
    stream(spark, place, files_per_batch=2)
    found, want = job.published(spark, sink), batch_job(spark, place)
    assert rows(found) == rows(want) and found.count() == 6
    assert pixels(spark, found) == pixels(spark, want)
    assert {r["status"] for r in found.collect()} == {"ok", "error"}


def test_what_a_batch_reads_does_not_grow(spark, place):
    """Every file and every stored key is read once, by any number of batches."""
    inbox, sink = place[1], place[2]
    arrive(inbox, *(f"{i}.png" for i in range(6)))
    query = stream(spark, place, files_per_batch=2)
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(read) >= 3 and max(read) <= 4
    provider = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress]
    assert any(k.startswith("rocksdb") for k in provider[0])
    assert job.published(spark, sink).count() == 6
    again = stream(spark, place, "other", files_per_batch=20)  # a new stream, all published
    assert sum(p["numInputRows"] for p in again.recentProgress) == 12
    arrive(inbox, "late.png", seed=2)
    stream(spark, place, "other")
    stream(spark, place)
    found = job.published(spark, sink)
    assert found.count() == 7 and found.select("out_path").distinct().count() == 7


def test_a_file_that_is_gone_is_reported(spark, place, monkeypatch):
    inbox, sink = place[1], place[2]
    arrive(inbox, "a.png", "b.png")
    real = job.exists
    monkeypatch.setattr(job, "exists", lambda s, p: "b.png" not in p and real(s, p))
    stream(spark, place)
    found = {r["path"].rsplit("/", 1)[1]: r for r in job.published(spark, sink).collect()}
    assert found["a.png"]["status"] == "ok"
    assert (found["b.png"]["status"], found["b.png"]["message"]) == ("absent", job.GONE)


def test_weights_are_one_file_for_all_batches(spark, place):
    """On a cluster, Spark refuses a file's name under a second path."""
    weights = place[3]
    names = {scoring.ship_weights(spark, weights, _refusing_bright_model).name for _ in range(3)}
    assert len(names) == 1
    name = names.pop()
    assert len([f for f in spark.sparkContext.listFiles if f.endswith(name)]) == 1
    (place[0] / "model.txt").write_text("bright, second version")
    assert scoring.ship_weights(spark, weights, _refusing_bright_model).name != name


def test_a_batch_stores_its_keys_in_one_file_and_lists_by_few_tasks(spark, tmp_path):
    """Later batches open every file of the ledger, so these must not follow a batch's tasks."""
    inbox, sink = tmp_path / "in", tmp_path / "out"
    arrive(inbox, *(f"{i}.png" for i in range(12)))
    listers, option = [], "spark.sql.sources.parallelPartitionDiscovery.parallelism"

    def step(images):
        listers.append(spark.conf.get(option))
        return ingest.received(images)

    for state in ("first", "second"):  # the second finds all stored
        images = ingest.image_stream(spark, str(inbox), files_per_batch=6)
        ingest.ingest(images, str(sink), str(tmp_path / state), step)
    assert len(list((sink / "_ledger").glob("*/*/*.parquet"))) == 4
    stored = spark.read.parquet(str(sink))
    assert stored.count() == stored.select("upload_key").distinct().count() == 12
    assert spark.read.parquet(str(sink / "_ledger")).count() == 12
    assert {int(n) for n in listers} == {4 * spark.sparkContext.defaultParallelism}
    assert spark.conf.get(option, None) is None


def test_frames_are_made_by_all_cores(spark, tmp_path):
    rows = spark.range(400).select(
        F.col("id").alias("vec_id"), F.array(F.lit(0.5).cast("float")).alias("embedding"), F.lit(1).alias("label")
    )
    rows.unionAll(rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    frames = fixtures.frame_images(spark, str(tmp_path))
    frames.write.parquet(str(tmp_path / "frames"))
    assert frames.count() == 100
    assert len(list((tmp_path / "frames").glob("part-*"))) >= spark.sparkContext.defaultParallelism


def test_first_arrivals_of_listing_read_no_contents(spark, place):
    inbox = place[1]
    arrive(inbox, "a.png")
    listed = job.arrivals(spark, str(inbox), 10**6, 5)
    assert listed.columns == ["upload_key", "path"]
    plan = spark.read.format("binaryFile").load(str(inbox)).select(F.col("_metadata.file_path"))
    assert "content" not in plan._jdf.queryExecution().executedPlan().toString()
