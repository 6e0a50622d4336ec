"""Storage, batches and character classes that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fissura.storage import shared_dir

#: Characters of text that a task works on at a time.
BLOCK_CHARS = 2_000_000


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the folder all nodes share, and a scan of it."""
    path = f"{shared_dir(df.sparkSession)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_file(spark: SparkSession, name: str, content: bytes) -> str:
    """Store ``content`` in the shared folder, for executors to fetch; its name on them."""
    local = f"{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/llm/{local}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return local


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """The two columns that text operators read, a null text as empty; and ``row``, if asked for."""
    return df.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry
    )


def map_blocks(
    df: DataFrame,
    work: Callable[[], Callable[[list, list], dict[str, list]]],
    schema: str,
    chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``work()`` gives, once per task, a function of (ids, texts) that returns columns.

    The first two columns of ``df`` are ids and texts; any others come after the
    new columns as they are. The function is called with at most ``chars``
    characters at a time, or one longer text.
    """
    made = arrow_schema(schema)
    # As types, not text: names inside structs may be anything.
    out = T.StructType([*T.StructType.fromDDL(schema).fields, *df.schema.fields[2:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for begin, end in blocks(texts, chars):
                new = each(ids[begin:end], texts.slice(begin, end - begin).to_pylist())
                new = pa.RecordBatch.from_pydict(new, schema=made)
                old = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [*new.columns, *old.columns[2:]], names=[*new.schema.names, *old.schema.names[2:]]
                )

    return df.mapInArrow(run, out)


def add_blocks(
    df: DataFrame,
    work: Callable[[], Callable[[list, list], dict[str, list]]],
    schema: str,
    chars: int = BLOCK_CHARS,
) -> DataFrame:
    """What ``map_blocks`` gives; columns after the first two stay with Spark.

    Rows that carry their own columns along hold their text once more. Here only
    ids and texts go to Python and only the new columns come back, so that a
    batch, its copies outside the heap and the workers hold each text once.
    """
    if len(df.columns) == 2:
        return map_blocks(df, work, schema, chars)
    made = arrow_schema(schema)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        each = work()
        for ids, texts in batches:
            for begin, end in blocks(texts, chars):
                some = ids.slice(begin, end - begin).to_pylist(), texts.slice(begin, end - begin).to_pylist()
                yield pa.RecordBatch.from_pydict(each(*some), schema=made).to_struct_array()

    # Said not to be deterministic, so that Spark never runs it twice for a filter and what follows.
    add = F.arrow_udf(run, T.StructType.fromDDL(schema)).asNondeterministic()
    ids, texts, *others = df.columns
    return df.select(add(ids, texts).alias("made"), *others).select("made.*", *others)


def beside(df: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the columns of ``operator`` added as ``new.<name>``, in the same pass.

    The operator is given ids and texts, and carries the rows' own columns along
    as one struct, so nothing is joined and no name can clash.
    """
    rows = df.select("doc_id", "text", F.struct("*").alias("row"))
    found = operator(rows)
    new = [c for c in found.columns if c != "row"]
    return found.select("row", F.struct(*new).alias("new"))


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow's form of a flat DDL schema."""
    kinds = {
        "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
        "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32(),
        "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32()),
        "array<int>": pa.list_(pa.int32()),
    }
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def blocks(texts: pa.Array, chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``chars`` bytes each, or of one longer text."""
    import numpy as np
    import pyarrow.compute as pc

    if not len(texts):
        return
    total = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + chars, side="right")))
        yield begin, end
        begin = end


class Bounded(dict):
    """A memo that computes what it lacks and keeps what was used of late.

    ``trim``, called between blocks, makes a full memo the old one and begins
    anew; what is looked up again comes back from the old one. So a lookup never
    loses what the same block has put in, and at most about twice ``bound``
    entries are held.
    """

    def __init__(self, compute: Callable, bound: int):
        super().__init__()
        self.compute, self.bound, self.old = compute, bound, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()
