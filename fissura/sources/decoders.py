"""Image formats that Spark's image source does not read, by decoders of the caller's."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes at the start of a file that signatures are looked for in.
HEAD = 64
#: Pixel bytes of one image at most: what a record of the image source can hold, too.
MOST_BYTES = 1 << 28

NOT_AN_IMAGE = "image could not be decoded"


@dataclass(frozen=True)
class Decoder:
    """A format: what its files begin with, and how they become pixels.

    ``signature`` lists ``(place, bytes)`` pairs, all of which must be there.
    ``decode(content)`` gives rows x columns x 1, 3 or 4 bytes in B,G,R(,A) order.
    ``size(head)``, if given, tells ``(height, width, channels)`` from the first
    ``HEAD`` bytes, so that a huge picture is refused before it is read.
    """

    name: str
    signature: tuple[tuple[int, bytes], ...]
    decode: Callable[[bytes], np.ndarray]
    size: Callable[[bytes], tuple[int, int, int]] | None = None

    def fits(self, head: bytes) -> bool:
        return all(head[at : at + len(mark)] == mark for at, mark in self.signature)


def _open(path: str):
    # Spark leaves letters beyond ASCII as they are; all else is escaped already.
    store, at = fs.FileSystem.from_uri("".join(c if c.isascii() else quote(c) for c in path))
    return store.open_input_file(at)


def _decoded(path: str, length: int, decoders: tuple[Decoder, ...], most_bytes: int) -> np.ndarray:
    with _open(path) as file:
        head = file.read_at(min(HEAD, length), 0)
        decoder = next((d for d in decoders if d.fits(head)), None)
        if decoder is None:
            raise ValueError(NOT_AN_IMAGE)
        if length > most_bytes:
            raise ValueError(f"{decoder.name}: more than {most_bytes} bytes")
        if decoder.size and int(np.prod(np.array(decoder.size(head), object))) > most_bytes:
            raise ValueError(f"{decoder.name}: more than {most_bytes} bytes of pixels")
        content = file.read_at(length, 0)
    pixels = np.ascontiguousarray(decoder.decode(content), np.uint8)
    if pixels.ndim == 2:
        pixels = pixels[:, :, None]
    if pixels.ndim != 3 or 0 in pixels.shape or pixels.shape[2] not in (1, 3, 4):
        raise ValueError(f"{decoder.name}: not rows x columns x 1, 3 or 4")
    if pixels.nbytes > most_bytes:
        raise ValueError(f"{decoder.name}: more than {most_bytes} bytes of pixels")
    return pixels


def decode_others(images: DataFrame, decoders: list[Decoder], most_bytes: int = MOST_BYTES) -> DataFrame:
    """``images``, as scanned, with what Spark could not decode given to ``decoders``.

    A file goes to the first decoder whose signature it bears, whatever its name.
    Rows gain ``decode_error``: null for a decoded image, else why there is none;
    no file fails a task. One pass without a shuffle: decoded images go by as
    they are, and only the other files are opened again, one at a time and no
    more than ``most_bytes`` of file or pixels. The store must be one that Arrow
    knows on every node, else the error says so.
    """
    chosen = tuple(decoders)
    out = T.StructType([*images.schema.fields, T.StructField("decode_error", T.StringType())])

    def mended(row: pa.RecordBatch) -> pa.RecordBatch:
        """One undecoded row, with its pixels or the reason."""
        values = {c: row.column(c) for c in row.schema.names}
        path, length = values["path"][0].as_py(), values["length"][0].as_py()
        try:
            pixels = _decoded(path, length, chosen, most_bytes)
            shape = dict(zip(("height", "width", "n_channels"), pixels.shape))
            values |= {c: pa.array([v], values[c].type) for c, v in shape.items()}
            values["data"] = pa.array([pixels.tobytes()], values["data"].type)
            error = None
        except Exception as exc:
            error = str(exc)
        return pa.RecordBatch.from_arrays([*values.values(), pa.array([error], pa.string())], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = pc.fill_null(pc.greater(batch.column("height"), 0), False)
            rest = batch.filter(pc.invert(fine))
            if rest.num_rows < batch.num_rows:
                good = batch.filter(fine) if rest.num_rows else batch
                none = pa.nulls(good.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([*good.columns, none], names=out.names)
            for i in range(rest.num_rows):
                yield mended(rest.slice(i, 1))

    return images.mapInArrow(run, out)
