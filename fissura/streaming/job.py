"""The whole job as images arrive: once per upload, published batch by batch.

What has been seen is told by keyed state, not by reading the past: the stream
reads the listing of new files, without their contents, and the new files of the
ledger, each of them once. State lies in RocksDB, so a batch reads and writes
what it touches, however long the history.

A batch is published in two phases. Images, scanlines and report are written to the
batch's own folder first; its upload keys go to the ledger last, as one file.
Readers take from the folders what the ledger names, so they see all of a batch
or nothing. A batch that is replayed before its keys are there writes its folder
again, and one that is replayed later does nothing.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fissura.functions import names
from fissura.plans.overlay import OverlayParams, run
from fissura.schemas import BINARY_SOURCE
from fissura.sources.images import identity, scan_files
from fissura.sources.sinks import FilesSource
from fissura.storage import exists, few_listers, literal, make_dir
from fissura.streaming.ingest import LEDGER, stream_name

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PUBLISHED_LAYOUT = "upload_key string, path string, stream string, batch_id bigint"

# Fixed value: the message of a file that was listed and then gone.
GONE = "File is no longer there"


def arrivals(spark: SparkSession, inbox: str, max_bytes: int | None, files_per_batch: int) -> DataFrame:
    """``upload_key, path`` of new files under ``inbox``; contents stay unread. The
    path is as it is opened, not as an address with escapes like that of ``images``."""
    listed = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SOURCE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", names.listing_glob())
        .option("maxFilesPerTrigger", files_per_batch)
        .load(inbox)
    )
    if max_bytes is not None:
        listed = listed.filter(F.col("_metadata.file_size") <= max_bytes)
    return listed.select(identity()["upload_key"], "path")


def stored_keys(spark: SparkSession, sink: str) -> DataFrame:
    """New upload keys of the ledger, of any stream. A file of it that another
    stream has replaced meanwhile is passed over: the new one follows."""
    return (
        spark.readStream.schema(PUBLISHED_LAYOUT)
        .option("ignoreMissingFiles", "true")
        .parquet(f"{sink}/{LEDGER}")
        .select("upload_key")
    )


def first_arrivals(arrived: DataFrame, stored: DataFrame) -> DataFrame:
    """Of the arrived files those whose key has come up in no earlier batch and
    is not among the stored ones, also those that come in the same batch.

    All rows of a batch have its time, which replays keep. So a key is new if its
    first time is its last.
    """
    now = F.current_timestamp()
    rows = arrived.select("upload_key", "path", F.lit(False).alias("old"), now.alias("at")).unionByName(
        stored.select(
            "upload_key", F.lit(None).cast("string").alias("path"), F.lit(True).alias("old"), now.alias("at")
        )
    )
    seen = rows.groupBy("upload_key").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.max("old").alias("old"), F.min("path").alias("path")
    )
    return seen.filter((F.col("first") == F.col("last")) & ~F.col("old")).select("upload_key", "path")


def named_by_key(images: DataFrame) -> DataFrame:
    """The default preparation: results are named after upload keys."""
    return images.withColumn("out_path", names.result_name(F.col("upload_key")))


def _mark(spark: SparkSession, rows: list, folder: str) -> None:
    """The batch's keys, as one file: from here on the batch is published."""
    keys = spark.createDataFrame(rows, "upload_key string, path string")
    keys.coalesce(1).write.mode("overwrite").parquet(folder)


def run_stream(
    spark: SparkSession,
    inbox: str,
    load: Callable,
    weights: str,
    sink: str,
    checkpoint: str,
    params: OverlayParams = OverlayParams(),
    prepare: Callable[[DataFrame], DataFrame] = named_by_key,
    max_bytes: int | None = None,
    files_per_batch: int = 1000,
    trigger: dict | None = None,
):
    """Score, paint and report every image that arrives, each upload once.

    ``prepare`` adds ``out_path`` and perhaps parameters to a batch of images.
    The paths of a batch, ``files_per_batch`` at most, pass through the driver;
    nothing else does. Without a ``trigger`` what has arrived is processed and the
    finished query returned; with one, the running query. Several streams may
    share a sink: each passes over what others had published when its batch began.
    """
    stream = stream_name(checkpoint)
    make_dir(spark, f"{sink}/{LEDGER}")

    def store(batch: DataFrame, batch_id: int) -> None:
        part = f"stream={stream}/batch_id={batch_id}"
        ledger = f"{sink}/{LEDGER}/{part}"
        # Read in any case: a batch's state is stored by the tasks that make its rows.
        rows = batch.select("upload_key", "path").collect()
        if exists(spark, f"{ledger}/_SUCCESS"):
            return
        there = [r["path"] for r in rows if exists(spark, literal(r["path"]))]
        if there:
            run(prepare(scan_files(spark, there)), load, weights, f"{sink}/{part}", params)
        _mark(spark, rows, ledger)

    fresh = first_arrivals(arrivals(spark, inbox, max_bytes, files_per_batch), stored_keys(spark, sink))
    writer = (
        fresh.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    # The query takes a copy of the session when it starts, settings and sources.
    spark.dataSource.register(FilesSource)
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        query = writer.start()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
    if trigger is None:
        with few_listers(spark):
            query.awaitTermination()
    return query


def published(spark: SparkSession, sink: str) -> DataFrame:
    """The report of all published batches, one row per upload key. Files of batches
    that are being written may come and go meanwhile; those of published ones stay.

    Where two streams have published a key, the one that reads smaller by batch
    and name counts. A file that was gone or replaced when its batch ran has the
    status ``absent``.
    """
    ledger = spark.read.schema(PUBLISHED_LAYOUT).parquet(f"{sink}/{LEDGER}").filter("path is not null")
    once = ledger.groupBy("upload_key").agg(
        F.min_by(F.struct("stream", "batch_id", "path"), F.struct("batch_id", "stream")).alias("at")
    )
    once = once.select("upload_key", "at.stream", "at.batch_id", F.col("at.path").alias("listed"))
    keys = ["upload_key", "stream", "batch_id"]
    folders = f"{sink}/stream=*/batch_id=*/report"
    if not exists(spark, folders):
        return once.select(
            *keys, F.col("listed").alias("path"), F.lit("absent").alias("status"), F.lit(GONE).alias("message")
        )
    reports = spark.read.option("basePath", sink).option("ignoreMissingFiles", "true").parquet(folders)
    joined = once.join(reports, keys, "left")
    gone = F.col("status").isNull()
    return joined.withColumns(
        {
            "path": F.coalesce("path", "listed"),
            "message": F.when(gone, GONE).otherwise(F.col("message")),
            "status": F.coalesce("status", F.lit("absent")),
        }
    ).drop("listed")
