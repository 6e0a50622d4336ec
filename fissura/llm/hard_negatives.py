"""Hard negatives per anchor and positive, by slots between the positives' upper limits.

An anchor's positives each allow negatives in a window of scores ``[low, high]``.
The windows overlap, but their upper limits, sorted, split the scores into
disjoint slots. A slot keeps its first ``k`` rows; the first ``k`` rows at or below a
limit are the first ``k`` of the slots from that limit downwards. So one pass
that keeps ``k`` rows a slot answers all windows of an anchor.

Anchors are dealt into blocks and all rows into stripes. A task holds one block
and streams a stripe past it, so its memory is bounded by the block; what it
hands on is ``k`` rows a slot and anchor, whatever the stripe holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fissura.llm.shared import stored

ANCHORS = 1 << 15  # of a block
STRIPE = 8192  # rows of a stripe at least
TILE = (512, 2048)  # anchors and rows that are multiplied at a time
SCALE = 256.0
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
_FOUND = pa.schema([("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("slot", pa.int32()),
                    ("score", pa.int64()), ("vec_id", pa.int64())])
_CELL = ("dim", "family", "block", "stripe")


def _usable(vector: Column) -> Column:
    """No null and no component that is null or not finite once it is scaled."""
    sound = lambda x: x.isNotNull() & (F.abs(x.cast("double") * SCALE) < float("inf"))
    return vector.isNotNull() & F.forall(vector, sound)


def _floor_part(x: Column, num: int, den: int) -> Column:
    """``floor(x * num / den)`` of a long, without overflow for ``num <= den``."""
    rest = F.pmod(x, F.lit(den).cast("bigint"))
    whole = F.call_function("div", x, F.lit(den)) - (x % den < 0).cast("bigint")
    return num * whole + F.call_function("div", num * rest, F.lit(den))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: floats where they suffice, else Python's ints."""
    largest = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if largest < _EXACT:
        return a @ b.T
    exact = np.frompyfunc(int, 1, 1)
    if not a.shape[1]:
        return np.zeros((len(a), len(b)))
    return np.clip(exact(a) @ exact(b).T, -_LONG, _LONG)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * values).reshape(len(column), dim)


class _Block:
    """The first ``k`` rows of every slot of the anchors of a block, kept up to date."""

    def __init__(self, anchors: pa.Table, dim: int, k: int, same: bool):
        self.ids, self.keys, self.labels = (
            anchors.column(c).to_numpy() for c in ("vec_id", "key", "label")
        )
        self.vectors = _vectors(anchors.column("vector").combine_chunks(), dim)
        self.k, self.same, self.dim = k, same, dim
        slots = anchors.column("slots").to_pylist()
        self.n_slots = max((len(s) for s in slots), default=0)
        self.high = np.full((len(slots), self.n_slots + 1), -np.inf, object)
        self.low = np.full((len(slots), self.n_slots), -np.inf, object)
        for i, windows in enumerate(slots):
            for p, w in enumerate(windows):
                self.high[i, p] = np.inf if w["high"] is None else w["high"]
                self.low[i, p] = -np.inf if w["low"] is None else w["low"]
        shape = (len(slots), self.n_slots, k)
        self.score, self.found = np.full(shape, -np.inf, object), np.zeros(shape, np.int64)

    def add(self, rows: pa.RecordBatch) -> None:
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        vectors = _vectors(rows.column("vector"), self.dim)
        for i in range(0, len(self.ids), TILE[0]):
            for j in range(0, len(ids), TILE[1]):
                here, there = slice(i, i + TILE[0]), slice(j, j + TILE[1])
                score = _products(self.vectors[here], vectors[there])
                equal = self.labels[here, None] == labels[None, there]
                wanted = equal & (self.ids[here, None] != ids[None, there]) if self.same else ~equal
                for p in range(self.n_slots):
                    self._slot(here, p, score, wanted, ids[there])

    def _slot(self, here: slice, p: int, score: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> None:
        kind = score.dtype
        high, below, low, least = (
            a.astype(kind)[:, None]
            for a in (self.high[here, p], self.high[here, p + 1], self.low[here, p], self.score[here, p, -1])
        )
        mask = wanted & (score <= high) & (score > below) & (score >= low) & (score >= least)
        if kind != object and mask.shape[1] > self.k and mask.sum() > 4 * self.k * len(mask):
            kept = np.where(mask, score, -np.inf)
            mask &= score >= np.partition(kept, -self.k, axis=1)[:, -self.k, None]
        a, b = np.nonzero(mask)
        if not len(a):
            return
        touched = np.unique(a)
        old_score, old_ids = self.score[here][touched, p], self.found[here][touched, p]
        real = old_score.ravel() > -np.inf
        who = np.r_[a, np.repeat(touched, self.k)[real]]
        value = np.r_[score[a, b].astype(object), old_score.ravel()[real]]
        of = np.r_[ids[b], old_ids.ravel()[real]]
        # Objects may be ints beyond the floats: order by their rank.
        rank = np.unique(value.astype(kind), return_inverse=True)[1]
        order = np.lexsort((of, -rank, who))
        who, value, of = who[order], value[order], of[order]
        first = np.r_[True, who[1:] != who[:-1]]
        place = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
        keep = place < self.k
        rows = who[keep] + here.start
        self.score[rows, p, place[keep]], self.found[rows, p, place[keep]] = value[keep], of[keep]

    def result(self) -> pa.RecordBatch:
        i, p, n = np.nonzero(self.score > -np.inf)
        score = [int(v) for v in self.score[i, p, n]]
        columns = [self.ids[i], self.keys[i], p.astype(np.int32), score, self.found[i, p, n]]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _FOUND)], schema=_FOUND)


def _best(anchors: DataFrame, rows: DataFrame, blocks: int, stripes: int, k: int, same: bool) -> DataFrame:
    """``anchor_id, anchor_key, slot, score, vec_id, rank``: the first ``k`` rows of every slot."""
    n_blocks, n_stripes = F.lit(blocks).cast("bigint"), F.lit(stripes).cast("bigint")
    # Positives have their anchor's label: no other rows need meet it.
    family = F.col("label") if same else F.lit(0).cast("bigint")
    mix = F.xxhash64("vec_id", "key")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    common = (F.size("vector").cast("bigint").alias("dim"), family.alias("family"))
    values = ("vec_id", "key", "label", "vector")
    held = anchors.select(*common, F.pmod(mix, n_blocks).alias("block"), every(n_stripes).alias("stripe"),
                          F.lit(False).alias("passing"), *values, "slots")
    passing = rows.select(*common, every(n_blocks).alias("block"), F.pmod(mix, n_stripes).alias("stripe"),
                          F.lit(True).alias("passing"), *values,
                          F.lit(None).cast(held.schema["slots"].dataType).alias("slots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in _CELL])
            marks = np.vstack([marks, batch.column("passing").to_numpy(zero_copy_only=False)[None]])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                part, here = batch.slice(begin, end - begin), tuple(marks[:-1, begin].tolist())
                if here != cell:
                    if block is not None:
                        yield block.result()
                    cell, waiting, block = here, [], None
                if not marks[-1, begin]:
                    waiting.append(part)
                elif waiting or block is not None:
                    if block is None:
                        block, waiting = _Block(pa.Table.from_batches(waiting), here[0], k, same), []
                    block.add(part)
        if block is not None:
            yield block.result()

    cells = blocks * stripes
    found = (
        held.unionByName(passing)
        .repartition(2 * cells, *_CELL)
        .sortWithinPartitions(*_CELL, "passing")
        .mapInArrow(run, "anchor_id long, anchor_key long, slot int, score long, vec_id long")
    )
    by_score = Window.partitionBy("anchor_id", "anchor_key", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)


def mine_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: tuple[int, int] = (50, 100),
    high: tuple[int, int] = (95, 100),
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id``, ``label`` and ``embedding``; other columns are
    ignored. Components become ``floor(256 x)``; a score is the inner product,
    in whole numbers, and ties go by the smaller id. For every anchor, and each
    of its first ``positives`` other rows of its label, come the first
    ``negatives`` rows of other labels with ``low * positive_score <=
    negative_score <= high * positive_score``.

    Rows with a null id, label, vector or component, or one that is not finite
    after scaling, take no part. A repeated row counts once; rows that share
    an id but differ are rows of their own, and never positives of each other.
    Only vectors of one length meet; empty ones score 0. Scores beyond a long
    saturate. A positive with no row in its window, which all negative scores
    are, gives no row, nor does an empty table.
    """
    sound = rows.select("vec_id", F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("vector"))
    sound = sound.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector"))).distinct()
    sound = sound.select("*", F.xxhash64("vec_id", "label", "vector").alias("key"), is_anchor.alias("anchor"))
    sound = stored(sound, "vectors")
    spark = sound.sparkSession
    n, n_anchors = sound.agg(F.count("*"), F.count_if("anchor")).first()
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, -(-n_anchors // ANCHORS))
    stripes = max(1, min(-(-n // STRIPE), -(-4 * tasks // blocks)))

    anchors = sound.filter("anchor")
    no_limit = F.array(F.struct(F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high")))
    found = _best(anchors.withColumn("slots", no_limit), sound, blocks, stripes, positives, True)
    score = F.col("score")
    windows = found.select(
        F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key"),
        F.struct(
            F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), score.alias("positive_score"),
            (-_floor_part(-score, *low)).alias("low"), _floor_part(score, *high).alias("high"),
        ).alias("window"),
    )
    windows = windows.groupBy("vec_id", "key").agg(F.sort_array(F.collect_list("window")).alias("windows"))
    windows = stored(windows, "windows")  # at most ``positives`` an anchor

    bounds = F.transform("windows", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high")))
    limited = anchors.join(windows.withColumn("slots", bounds), ["vec_id", "key"])
    kept = _best(limited, sound, blocks, stripes, negatives, False)
    entry = F.struct("slot", "rank", F.col("vec_id").alias("id"), "score")
    kept = kept.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key")).agg(
        F.sort_array(F.collect_list(entry)).alias("entries")  # ``negatives`` a slot at most
    )
    # Slots follow each other downwards, so a window's rows are the first of the slots from its own on.
    own = lambda e: (e["slot"] >= F.col("window.slot") - 1) & (e["score"] >= F.col("window.low"))
    chosen = F.slice(F.filter("entries", own), 1, negatives)
    return (
        windows.join(kept, ["vec_id", "key"])
        .select("vec_id", F.explode("windows").alias("window"), "entries")
        .select("vec_id", "window", F.posexplode(chosen).alias("place", "entry"))
        .select(
            F.col("vec_id").alias("anchor_id"), F.col("window.positive_id").alias("positive_id"),
            (F.col("place") + 1).alias("rank"), F.col("entry.id").alias("negative_id"),
            F.col("window.positive_score").alias("positive_score"), F.col("entry.score").alias("negative_score"),
        )
    )


#: The same from all pairs of an anchor and a row.
SQL = """
WITH sound AS (
  SELECT DISTINCT vec_id, label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256 * x::DOUBLE))) = 0
), rows_ AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id, label, embedding) AS key,
    CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM sound
), scored AS (
  SELECT a.vec_id AS anchor_id, a.key, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON len(a.v) = len(b.v) AND len(a.v) > 0 AND a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, key, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same AND vec_id <> anchor_id
  QUALIFY place <= 5
), windows AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.key, place ORDER BY score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s
    ON p.key = s.key AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
  QUALIFY rank <= 3
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM windows
"""
