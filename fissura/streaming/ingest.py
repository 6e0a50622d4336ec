"""Incremental ingestion: every new image file is processed once.

The stream's checkpoint remembers the files it has handed out. Results lie
under the stream's name, made from its checkpoint, and the batch number, so a
batch that is replayed after a failure writes its own directory again. A ledger
of upload keys lies beside them: a new stream on an old sink keeps the earlier
results and processes only what no other stream has stored.
"""

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fissura.functions import names
from fissura.schemas import IMAGE_SOURCE
from fissura.sources.images import normalise
from fissura.storage import discard, durable, exists, few_listers, new_dir


def image_stream(
    spark: SparkSession,
    path: str,
    max_bytes: int | None = None,
    files_per_batch: int | None = 1000,
) -> DataFrame:
    """New files under ``path``; batches are bounded by ``files_per_batch``."""
    reader = (
        spark.readStream.format("image")
        .schema(IMAGE_SOURCE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", names.listing_glob())
        .option("dropInvalid", "false")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.load(path)
    if max_bytes is not None:
        raw = raw.filter(F.col("_metadata.file_size") <= max_bytes)
    return normalise(raw)


def received(images: DataFrame) -> DataFrame:
    """The default step: one row per file, decodable or not."""
    return images.select(
        "image_id",
        "path",
        "upload_key",
        "length",
        "height",
        "width",
        F.when(F.col("height") < 0, "Inference failed: image could not be decoded").alias("error"),
    )


LEDGER = "_ledger"  # hidden from readers of the sink
LEDGER_LAYOUT = "upload_key string, stream string, batch_id bigint"
KEYS_PER_FILE = 100_000


def stream_name(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def write_batch(result: DataFrame, sink: str, batch_id: int, stream: str = "0") -> None:
    result.write.mode("overwrite").parquet(f"{sink}/stream={stream}/batch_id={batch_id}")


def seen_elsewhere(keys: DataFrame, sink: str, batch_id: int, stream: str) -> DataFrame | None:
    """Of a batch's keys those that another batch has stored; None where there is no ledger.
    A batch's own keys in the ledger do not count: it may be a replay."""
    spark = keys.sparkSession
    if not exists(spark, f"{sink}/{LEDGER}"):
        return None
    ledger = spark.read.schema(LEDGER_LAYOUT).parquet(f"{sink}/{LEDGER}")
    mine = (F.col("stream") == stream) & (F.col("batch_id") == batch_id)
    return ledger.filter(~mine).select("upload_key").join(keys, "upload_key", "left_semi").distinct()


def ingest(
    images: DataFrame,
    sink: str,
    checkpoint: str,
    step: Callable[[DataFrame], DataFrame] = received,
) -> None:
    """Process what has arrived and stop. ``step`` maps a batch of images to
    the rows to store, and may use any operator of this package."""
    stream = stream_name(checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        listed, known = new_dir(spark, "keys"), new_dir(spark, "seen")
        # Written down, so that neither the ledger nor the files are opened again for keys.
        keys = durable(batch.select("upload_key"), "keys", listed)
        seen = seen_elsewhere(keys, sink, batch_id, stream)
        fresh = batch
        if seen is not None and not (seen := durable(seen, "seen", known)).isEmpty():
            fresh, keys = (df.join(seen, "upload_key", "left_anti") for df in (batch, keys))
        write_batch(step(fresh.select(batch.columns)), sink, batch_id, stream)
        # Few files, as later batches open all of them.
        few = keys.coalesce(1 + keys.count() // KEYS_PER_FILE)
        few.write.mode("overwrite").parquet(f"{sink}/{LEDGER}/stream={stream}/batch_id={batch_id}")
        discard(spark, listed)
        discard(spark, known)

    writer = images.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    with few_listers(images.sparkSession):
        writer.trigger(availableNow=True).start().awaitTermination()
