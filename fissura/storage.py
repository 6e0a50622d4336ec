"""Shared storage for results that must outlive the executors that made them."""

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def shared_dir(spark: SparkSession) -> str:
    """The folder every node can reach: ``spark.checkpoint.dir``, or what
    ``SparkContext.setCheckpointDir`` was given.

    On a local master with neither, one folder is made for the session and set.
    """
    configured = spark.conf.get(_FOLDER, None)
    if configured:
        return configured.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_FOLDER} to a folder all nodes share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fissura-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/fissura/{label}-{uuid.uuid4().hex}"


def uri(spark: SparkSession, directory: str) -> str:
    """``directory`` with its scheme, as Arrow reads it on any node."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    target = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if target.startswith("file:"):
        target = "file://" + target.removeprefix("file:").replace("//", "/")
    return target


@contextmanager
def few_listers(spark: SparkSession) -> Iterator[None]:
    """Listings of many paths take some tasks a core, and not one for each path.

    What reads a list of files, such as a stream's batch, asks Spark for each of them
    first. A number the caller has set stays.
    """
    if spark.conf.get(_LISTING, None) is not None:
        yield
        return
    spark.conf.set(_LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(_LISTING)


def durable(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to shared storage once and return a scan of it.

    Used where several branches read the output of a costly step (model
    scoring): the step runs once, a lost executor costs no recomputation of
    it, and each branch prunes columns on the written table.
    """
    path = path or new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that ``durable`` has written to ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, or any that a pattern fits."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found)


def literal(path: str) -> str:
    """``path`` as a pattern that fits nothing else."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def make_dir(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
