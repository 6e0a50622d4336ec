"""Result sinks: scanline tables and image files."""

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.functions import arrow_udf

from fissura.storage import uri


def write_scanlines(lines: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Overlay scanlines as Parquet, the bulk form of the result images."""
    lines.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


@arrow_udf(T.BinaryType())
def bmp_bytes(data: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
    """B,G,R pixels as an uncompressed 24-bit BMP file."""
    files = []
    for raw, h, w in zip(data.to_pylist(), height.to_pylist(), width.to_pylist()):
        rows = np.frombuffer(raw, np.uint8).reshape(h, w * 3)[::-1]
        body = np.pad(rows, ((0, 0), (0, -w * 3 % 4))).tobytes()
        head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
        info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0)
        files.append(head + info + body)
    return pa.array(files, pa.binary())


def _png(raw: bytes, height: int, width: int) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        data = kind + body
        return struct.pack(">I", len(body)) + data + struct.pack(">I", zlib.crc32(data))

    pixels = np.frombuffer(raw, np.uint8).reshape(height, width, 3)[:, :, ::-1]
    lines = np.zeros((height, width * 3 + 1), np.uint8)  # each begins with filter type 0
    lines[:, 1:] = pixels.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    body = chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")
    return b"\x89PNG\r\n\x1a\n" + body


@arrow_udf(T.BinaryType())
def png_bytes(data: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
    """B,G,R pixels as a lossless PNG file."""
    rows = zip(data.to_pylist(), height.to_pylist(), width.to_pylist())
    return pa.array([_png(*row) for row in rows], pa.binary())


MANIFEST_LAYOUT = "name string, size bigint, error string"
_MANIFEST = "_manifest"
_PARTS = "_parts"


@dataclass
class _Written(WriterCommitMessage):
    """A task's part of the manifest; its rows stay in storage."""

    part: str


class _FilesWriter(DataSourceArrowWriter):
    """Files appear together or not at all.

    Tasks write into a folder beside the target, hidden from readers: each file
    under a name of the attempt's own first, then moved to its name, so that a
    retry replaces what a lost attempt has left. The commit drops what belongs
    to no committed attempt and moves the folder into the target's place; an abort
    drops the folder. The driver sees one message a task, whatever the number of files.
    """

    def __init__(self, target: str):
        self.target = target.rstrip("/")
        parent, base = self.target.rsplit("/", 1)
        self.pending = f"{parent}/.{base}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = fs.FileSystem.from_uri(self.pending)
        attempt = uuid.uuid4().hex
        own = f"{root}/{_PARTS}/{attempt}"
        store.create_dir(own)
        names, sizes, errors = [], [], []
        for batch in iterator:
            columns = (batch.column(batch.schema.get_field_index(c)) for c in ("name", "content"))
            for name, content in zip(*(c.to_pylist() for c in columns)):
                error = _refusal(name, content)
                if error is None:
                    with store.open_output_stream(f"{own}/{name}") as out:
                        out.write(content)
                    store.move(f"{own}/{name}", f"{root}/{name}")
                names.append(name)
                sizes.append(None if error else len(content))
                errors.append(error)
        rows = pa.table([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())],
                        names=["name", "size", "error"])
        part = f"part-{attempt}.parquet"
        store.create_dir(f"{root}/{_MANIFEST}")
        with store.open_output_stream(f"{root}/{_MANIFEST}/{part}") as out:
            parquet.write_table(rows, out)
        return _Written(part)

    def commit(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.pending)
        _, target = fs.FileSystem.from_uri(self.target)
        kept = {m.part for m in messages if m is not None}
        store.create_dir(f"{root}/{_MANIFEST}")
        for found in store.get_file_info(fs.FileSelector(f"{root}/{_MANIFEST}")):
            if found.base_name not in kept:
                store.delete_file(found.path)
        _drop(store, f"{root}/{_PARTS}")
        # The manifest goes first and comes last: where there is one, all its files are there.
        manifest, before = manifest_of(target), f"{root}.before"
        _drop(store, manifest)
        store.move(f"{root}/{_MANIFEST}", f"{root}.manifest")
        if store.get_file_info(target).type != fs.FileType.NotFound:
            store.move(target, before)
        store.move(root, target)
        store.move(f"{root}.manifest", manifest)
        _drop(store, before)

    def abort(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.pending)
        _drop(store, root)


def _drop(store: fs.FileSystem, path: str) -> None:
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_dir(path)


def manifest_of(directory: str) -> str:
    """Where the manifest of a folder lies: beside it, hidden from readers of files."""
    parent, base = directory.rstrip("/").rsplit("/", 1)
    return f"{parent}/_{base}.manifest"


def _refusal(name: str | None, content: bytes | None) -> str | None:
    """Why a row becomes no file."""
    if name is None:
        return "no name"
    if name in ("", ".", "..", _MANIFEST, _PARTS) or "/" in name or "\0" in name:
        return "not a file name"
    return "no content" if content is None else None


class FilesSource(DataSource):
    """Spark data source ``fissura_files``: writes ``name, content`` rows as files."""

    @classmethod
    def name(cls) -> str:
        return "fissura_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> _FilesWriter:
        if not overwrite:
            raise ValueError("fissura_files replaces its folder: write with mode 'overwrite'")
        return _FilesWriter(self.options["path"])


def write_files(files: DataFrame, directory: str) -> DataFrame:
    """Write each ``name, content`` row as a file; returns the manifest.

    ``directory`` is replaced as a whole when all tasks are done: a reader finds
    the old files, none for the moment of the exchange, or all new ones. Rows without a
    name, without content, or with a name that is a path become no file but a row
    with an ``error``. Of rows that share a name one stays. The store must be able to move
    folders, and be known to Arrow on every node.
    """
    spark = files.sparkSession
    spark.dataSource.register(FilesSource)
    target = uri(spark, directory)
    rows = files.select(F.col("name").cast("string"), F.col("content").cast("binary"))
    rows.write.format("fissura_files").mode("overwrite").option("path", target).save()
    return read_manifest(spark, directory)


def read_manifest(spark: SparkSession, directory: str) -> DataFrame:
    """``name, size, error`` of every row of the last complete write to ``directory``."""
    at = manifest_of(uri(spark, directory))
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST_LAYOUT)
    return spark.read.schema(MANIFEST_LAYOUT).parquet(at)


def write_image_files(
    images: DataFrame, directory: str, name: str = "name", kind: str = "bmp"
) -> DataFrame:
    """Write each image of ``images`` as ``<name>``, in BMP or PNG format."""
    encoded = {"bmp": bmp_bytes, "png": png_bytes}[kind]("data", "height", "width")
    return write_files(images.select(F.col(name).alias("name"), encoded.alias("content")), directory)
