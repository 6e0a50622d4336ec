"""Sources mixed to target weights by a low-discrepancy schedule of equal blocks.

A source's documents, in an order drawn from their hashes, make a stream of
words, read up to three times and cut into blocks of ``BLOCK`` words. A source
owns as many slots of the schedule as its target has blocks. All slots together
are numbered 0 to N - 1, source after source; the van der Corput points put number
``v`` at the time that has the bits of ``v`` reversed, so every source is spread
evenly over time and gets exactly its slots. A slot's rank among those of its
source is counted in closed form, without sorting or a window: times below ``j``
are a few dyadic ranges, and the reversed numbers of such a range are an
arithmetic progression. The slot of rank ``r`` takes block ``r``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fissura.llm.ranks import places, prefix_sums
from fissura.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
REPEATS = 3  # of a document, at most
BLOCK = 256  # words of a slot
CHUNK = 4096  # slots, or copies of a row, that are made from one row at a time
BUCKET = 1024  # rows of a source whose offsets are added up together, about
KEY_BITS = 60


@dataclass(frozen=True)
class Mix:
    """``spans``: the mix, as pieces of documents by slot; ``documents``: one row a document."""

    spans: DataFrame
    documents: DataFrame


def _every(first: Column, last: Column) -> Column:
    """``first`` to ``last``; empty where ``last`` is smaller."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def reversed_bits(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(values)
    for i in range(bits):
        out |= ((values >> i) & 1) << (bits - 1 - i)
    return out


def count_below(times: np.ndarray, limit: np.ndarray, bits: int) -> np.ndarray:
    """How many times before each of ``times`` have a reversed number below ``limit``."""
    total = np.zeros_like(times)
    for i in range(bits):
        # Times that agree with this one above bit i, where it has a one and they a zero.
        start = reversed_bits((times >> (i + 1)) << (i + 1), bits)
        step = 1 << (bits - i)
        n = np.clip(-((start - limit) // step), 0, 1 << i)
        total += np.where((times >> i) & 1, n, 0)
    return total


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """``place, rank, slot`` of every slot, from ``place, first, quota`` of every source."""
    bits = max(1, (n_slots - 1).bit_length())
    begin = F.col("first") + F.col("chunk") * CHUNK
    end = F.least(begin + CHUNK, F.col("first") + F.col("quota"))
    chunks = sources.filter("quota > 0").select(
        "place", "first", "quota", F.explode(_every(F.lit(0).cast("bigint"), F.expr(f"(quota - 1) div {CHUNK}"))).alias("chunk")
    )
    numbers = chunks.repartition(-(-n_slots // (64 * CHUNK)) or 1, "place", "chunk").select(
        "place", "first", "quota", F.explode(F.sequence(begin, end - 1)).alias("number")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, quota, number = (batch.column(c).to_numpy() for c in ("first", "quota", "number"))
            time = reversed_bits(number, bits)
            rank = count_below(time, first + quota, bits) - count_below(time, first, bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), pa.array(rank), pa.array(time)], ["place", "rank", "slot"]
            )

    return numbers.mapInArrow(run, "place long, rank long, slot long")


def _targets(sources: DataFrame, repeats: int) -> DataFrame:
    """``sources`` with ``target``: shares of all words by weight, none above ``repeats`` times the source.

    Who is above at one level of shares is above at all later ones, so the level
    is all that rounds hand on; the driver holds two sums.
    """
    total, weights = sources.agg(F.sum("words"), F.sum("weight")).first()
    most = F.col("words") * repeats
    rest, free = total or 0, weights or 1
    while True:
        share = F.lit(rest).cast("bigint") * F.col("weight") / F.lit(free).cast("bigint")
        above = share > most
        held, freed = sources.agg(
            F.sum(F.when(above, most).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))
        ).first()
        now = ((total or 0) - (held or 0), freed or 1)
        if now == (rest, free):
            return sources.withColumn("target", F.when(above, most.cast("double")).otherwise(share))
        rest, free = now


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK
) -> Mix:
    """The mix of ``docs`` (``doc_id, source, text``) and what it takes of every document.

    Sizes are words of whole texts; null and empty texts have none and take no
    part. Sources, a null one last, weigh ``weights`` in turn and share as many
    words as there are; a target is at most ``repeats`` times its source. A source's
    taken words are its target to the nearest word. The order within a source is
    that of hashes of id and text, so reruns agree, whatever the order of rows
    and partitions. A repeated row is taken as a row of its own; a null id is an id.
    An empty table gives an empty mix. Other columns are ignored.

    ``spans``: ``slot, place, doc_id, start, words``: ``words`` words of a document from
    word ``start`` on, by slot and place in the slot. ``documents``: ``doc_id,
    source, size, source_size, target, taken``.
    """
    text = F.coalesce("text", F.lit(""))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text)
    digits = F.substring(F.sha2(named, 256), 1, KEY_BITS // 4)
    rows = docs.select(
        # Null last.
        F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("of"), "source", "doc_id",
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), F.conv(digits, 16, 10).cast("bigint").alias("key"),
    )
    one = ["of", "source", "doc_id", "size", "key"]
    units = stored(rows.groupBy(one).agg(F.count("*").alias("copies")), "units")

    sums = units.groupBy("of").agg(F.sum(F.expr("size * copies")).alias("words"), F.count("*").alias("rows"))
    sources = places(stored(sums, "sources"), "of")
    weight = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(_targets(sources.withColumn("weight", weight), repeats), "targets")
    # ``due`` words in ``quota`` slots; ``depth`` bits of the key tell a source's buckets.
    sources = sources.withColumn(
        "due", F.least(F.floor(F.col("target") + 0.5), F.col("words") * repeats)
    ).withColumn("quota", F.call_function("div", F.col("due") + (block - 1), F.lit(block)))
    depth = F.greatest(F.ceil(F.log2(F.col("rows") / float(BUCKET))), F.lit(0)).cast("int")
    sources = stored(sources.withColumn("depth", F.least(depth, F.lit(KEY_BITS - 1))), "quotas")
    n, n_slots, deepest = sources.agg(F.count("*"), F.sum("quota"), F.max("depth")).first()
    n_slots, deepest = n_slots or 0, deepest or 0
    owned = prefix_sums(sources, [], "place", "quota", 0, max(n - 1, 0)).withColumnRenamed("before", "first")
    # Stored, so that its size is known: Spark takes what comes out of Python for as small as what goes in.
    slots = stored(schedule(owned.select("place", "first", "quota"), n_slots), "slots")

    known = sources.select("of", "place", "words", "target", "due", "depth")
    units = units.join(known, "of").withColumn("bucket", F.expr(f"shiftright(key, {KEY_BITS} - depth)"))
    sizes = stored(units.groupBy("place", "bucket").agg(F.sum(F.expr("size * copies")).alias("n")), "buckets")
    starts = prefix_sums(sizes, ["place"], "bucket", "n", 0, (1 << deepest) - 1).drop("n")
    inside = Window.partitionBy("place", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        units.withColumn("inside", F.coalesce(F.sum(F.expr("size * copies")).over(inside), F.lit(0).cast("bigint")))
        .join(starts, ["place", "bucket"])
        .withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {CHUNK})")))
        .withColumn("copy", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(copies, (chunk + 1) * {CHUNK}) - 1)")))
        .withColumn("offset", F.expr("before + inside + copy * size"))
    )
    # The times that a document is read, and the blocks that it lies in.
    zero = F.lit(0).cast("bigint")
    reads = _every(zero, F.when(F.col("size") > 0, F.floor((F.col("due") - F.col("offset") - 1) / F.col("words"))).otherwise(-1))
    begin = F.col("offset") + F.col("read") * F.col("words")
    end = F.least(begin + F.col("size"), "due")
    pieces = (
        placed.withColumn("read", F.explode_outer(reads))
        .withColumns({"begin": begin, "end": end})
        .withColumn("rank", F.explode_outer(F.when(F.col("read").isNotNull(), F.expr(f"sequence(begin div {block}, (end - 1) div {block})"))))
        .withColumn("low", F.greatest("begin", F.col("rank") * block))
        .withColumn("taken", F.least("end", (F.col("rank") + 1) * block) - F.col("low"))
    )
    row = ["place", "source", "doc_id", "key", "copy", "size", "words", "target"]
    pieces = pieces.select(*row, "rank", "taken", "begin", "low")
    joined = pieces.join(slots, ["place", "rank"], "left")
    spans = joined.filter("slot is not null").select(
        "slot", (F.col("low") - F.col("rank") * block).alias("place"), "doc_id",
        (F.col("low") - F.col("begin")).alias("start"), F.col("taken").alias("words"),
    )
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("taken"))), zero)
    documents = joined.groupBy(row).agg(taken.alias("taken"))
    return Mix(
        spans,
        documents.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", "taken"),
    )


#: The same in closed form, without a schedule: what a source is due, cut from its ordered stream.
SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS of, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    substr(sha256(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')), 1, 15) AS key
  FROM documents
), sources AS (
  SELECT of, CAST(sum(size) AS BIGINT) AS words, 1 + (row_number() OVER (ORDER BY encode(of)) - 1) % 3 AS weight
  FROM sized GROUP BY of
), levels AS (
  SELECT 0 AS k, CAST(sum(words) AS BIGINT) AS rest, CAST(sum(weight) AS BIGINT) AS free FROM sources
  UNION ALL
  SELECT k + 1, rest, free FROM (
    SELECT k, l.rest AS old,
      CAST((SELECT sum(words) FROM sources) - sum(CASE WHEN l.rest * weight / l.free::DOUBLE > 3 * words THEN 3 * words ELSE 0 END) AS BIGINT) AS rest,
      CAST(sum(CASE WHEN l.rest * weight / l.free::DOUBLE > 3 * words THEN 0 ELSE weight END) AS BIGINT) AS free
    FROM levels l, sources GROUP BY k, l.rest, l.free
  ) WHERE rest <> old
), targets AS (
  SELECT of, words, least(l.rest * weight / l.free::DOUBLE, 3 * words) AS target
  FROM sources, (SELECT rest, free FROM levels ORDER BY k DESC LIMIT 1) l
), streams AS (
  SELECT doc_id, s.of, size, words, target, least(CAST(floor(target + 0.5) AS BIGINT), 3 * words) AS due,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.of ORDER BY key, doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o
  FROM sized s JOIN targets t ON s.of = t.of
)
SELECT doc_id, size, words AS source_size, target, CAST(
    greatest(0, least(o + size, due) - o) + greatest(0, least(o + words + size, due) - o - words)
      + greatest(0, least(o + 2 * words + size, due) - o - 2 * words) AS BIGINT) AS taken
FROM streams
"""
