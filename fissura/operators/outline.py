"""Outer outline of a mask.

*Outside* is the background that is 4-connected to a frame around the image;
the outline is the mask pixels with a 4-neighbour outside. Background that the
mask encloses, and mask parts inside it, get no outline. So: fill the enclosed
gaps, and keep the pixels of the filled shape that a cross-shaped erosion
removes.

Enclosed gaps are found per strip of scanlines: one task sees one strip of one
image, never more than ``strip_pixels`` of it. Neighbouring strips share their
border scanline, and for images taller than a strip a second step links the
border gaps alone. Two shuffles at most, whatever the shape of the mask.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fissura.operators.masks import (
    FULL_WORD,
    IMAGE,
    IMAGE_AND_OUTLINE,
    WORD,
    merge_pieces,
    runs_to_words,
    thicken_runs,
    words_to_pieces,
)

STRIP_PIXELS = 1 << 24
_RUN = -1  # component number of a run, which is no gap


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, for ``n`` nodes and edges a-b."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if np.array_equal(ra, rb):
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(root, root[root]):
            root = root[root]


def _gaps_of(runs: pa.Table) -> pa.Table:
    """The runs of whole strips and the gaps between them, by component.

    ``solid`` marks runs and the gaps they enclose. ``runs`` is sorted by image, strip, ``y`` and ``x0``. All its strips are
    handled in the same array operations.
    """
    image = runs.column("image_id").to_numpy()
    strip, rows, y, x0, x1 = (
        runs.column(c).to_numpy().astype(np.int64) for c in ("strip", "rows", "y", "x0", "x1")
    )
    in_strip = np.r_[False, (image[1:] == image[:-1]) & (strip[1:] == strip[:-1])]
    in_line = in_strip & np.r_[False, y[1:] == y[:-1]]

    # Scanlines with runs, numbered in order; a gap lies between two runs of one.
    first = np.flatnonzero(~in_line)
    last = np.r_[first[1:], len(y)] - 1
    line = np.cumsum(~in_line) - 1
    group = np.cumsum(~in_strip)[first]
    left = np.flatnonzero(in_line) - 1
    g_line, g_y, g0, g1 = line[left], y[left], x1[left], x0[left + 1]

    # Node 0 is the outside. A scanline without runs is all outside, unless it
    # belongs to the neighbouring strip, which decides about it.
    escapes = np.zeros(len(left), dtype=bool)
    top = strip[left] * rows[left]
    for step, foreign in ((-1, (g_y == top) & (top > 0)), (1, g_y == top + rows[left])):
        other = np.clip(g_line + step, 0, len(first) - 1)
        present = (group[other] == group[g_line]) & (y[first[other]] == g_y + step)
        beside = (g0 < x0[first[other]]) | (g1 > x1[last[other]])
        escapes |= ~foreign & (~present | beside)

    # Gaps of the next scanline that overlap a gap are consecutive.
    span = np.int64(1) << 32
    below = np.flatnonzero(present)
    lo = np.searchsorted(g_line * span + g1, (g_line[below] + 1) * span + g0[below], "right")
    hi = np.searchsorted(g_line * span + g0, (g_line[below] + 1) * span + g1[below], "left")
    n_edges = np.maximum(hi - lo, 0)
    starts = np.cumsum(n_edges) - n_edges
    targets = np.arange(n_edges.sum()) + np.repeat(lo - starts, n_edges)
    escaped = np.flatnonzero(escapes)
    part = connected(
        len(left) + 1,
        np.r_[np.repeat(below, n_edges) + 1, escaped + 1],
        np.r_[targets + 1, np.zeros_like(escaped)],
    )[1:]
    # Numbered within the strip, so that it does not matter which strips were labelled together.
    begin = np.searchsorted(group[g_line], group[g_line])
    part = np.where(part > 0, part - begin, 0)

    def rows_at(index, start, end, component):
        kept = [c for c in runs.column_names if c not in ("rows", "x0", "x1")]
        columns = runs.select(kept).take(index)
        for name, values in (("x0", start), ("x1", end)):
            columns = columns.append_column(name, pa.array(values, pa.int32()))
        return columns.append_column("part", pa.array(component)).append_column(
            "solid", pa.array(component != 0)
        )

    return pa.concat_tables(
        [
            rows_at(np.arange(len(y)), x0, x1, np.full(len(y), _RUN)),
            rows_at(left, g0, g1, part),
        ]
    )


def _gap_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply ``_gaps_of`` to a sorted partition, never splitting a strip."""

    def strip_of(batch, i):
        return batch.column("image_id")[i], batch.column("strip")[i]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        end = strip_of(batch, -1)
        ends = pc.and_(pc.equal(batch.column("image_id"), end[0]), pc.equal(batch.column("strip"), end[1]))
        cut = batch.num_rows - pc.sum(ends).as_py()
        if cut == 0 and held and strip_of(held[0], 0) == end:
            held.append(batch)
            continue
        done = [b for b in (*held, batch.slice(0, cut)) if b.num_rows]
        held = [batch.slice(cut)]
        if done:
            yield from _gaps_of(pa.Table.from_batches(done)).to_batches()
    if held:
        yield from _gaps_of(pa.Table.from_batches(held)).to_batches()


def _open_parts(key: tuple, gaps: pa.Table) -> pa.Table:
    """Components of one image that reach the outside through another strip.

    Sees only gaps on border scanlines, each once per strip that shares it.
    """
    pdf = gaps.to_pandas()
    node = pdf.groupby(["strip", "part"]).ngroup().to_numpy() + 1
    place = pdf.groupby(["y", "x0"]).ngroup().to_numpy() + node.max() + 1
    outside = node[~pdf["solid"].to_numpy()]
    root = connected(
        int(place.max()) + 1,
        np.r_[node, outside],
        np.r_[place, np.zeros_like(outside)],
    )
    found = pdf.loc[(root[node] == 0) & pdf["solid"], ["strip", "part"]].drop_duplicates()
    return pa.table(
        {
            "image_id": pa.repeat(key[0], len(found)),
            "strip": pa.array(found["strip"], pa.int32()),
            "part": pa.array(found["part"], pa.int64()),
        }
    )


def _strip_rows(strip_pixels: int) -> Column:
    return F.greatest(F.lit(1), F.expr(f"cast({strip_pixels} div width as int)"))


def filled_runs(
    runs: DataFrame,
    keys: Sequence[str] = IMAGE,
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    """The mask with the background it closes off from the frame filled in.

    A run and a gap it touches stay separate rows. Images of one strip and
    taller ones part before the gaps are labelled: only the latter take the
    step that links strips. It reads their labels twice; they are the same both
    times, and nothing runs ahead of the query for images that are not there.
    """
    tall = F.col("height") > _strip_rows(strip_pixels)
    shared = (F.col("y") % F.col("rows") == 0) & (F.col("y") > 0)
    own = F.expr("y div rows").cast("int")
    result = [*keys, "y", "x0", "x1"]

    def labelled(some: DataFrame) -> DataFrame:
        strips = (
            some.select(*keys, "y", "x0", "x1", _strip_rows(strip_pixels).alias("rows"))
            .withColumn("strip", F.explode(F.when(shared, F.array(own - 1, own)).otherwise(F.array(own))))
            .select(*keys, "strip", "rows", "y", "x0", "x1")
        )
        layout = T.StructType(
            [
                *strips.select(*keys, "strip", "y", "x0", "x1").schema,
                T.StructField("part", T.LongType()),
                T.StructField("solid", T.BooleanType()),
            ]
        )
        # Sorted, so that a task streams through its strips one after the other.
        return (
            strips.repartition("image_id", "strip")
            .sortWithinPartitions("image_id", "strip", "y", "x0")
            .mapInArrow(_gap_batches, layout)
        )

    low = labelled(runs.filter(~tall)).filter("solid").select(*result)
    high = labelled(runs.filter(tall)).withColumn("rows", _strip_rows(strip_pixels))
    opened = (
        high.filter(shared & (F.col("part") != _RUN))
        .select("image_id", "strip", "y", "x0", "part", "solid")
        .groupBy("image_id")
        .applyInArrow(_open_parts, "image_id bigint, strip int, part bigint")
    )
    closed = (
        high.filter(F.col("solid") & (F.col("strip") == own))
        .join(opened, ["image_id", "strip", "part"], "left_anti")
        .select(*result)
    )
    return low.unionByName(closed)


def boundary_words(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels of a shape with a 4-neighbour off the shape, as words.

    Every word hands its bits to the places above and below and its end bits to
    the words beside it; one aggregation then has all five views of a word.
    """
    seen = (
        "y + CASE view WHEN 'above' THEN 1 WHEN 'below' THEN -1 ELSE 0 END AS y",
        "w + CASE view WHEN 'left' THEN 1 WHEN 'right' THEN -1 ELSE 0 END AS w",
        f"CASE view WHEN 'left' THEN shiftright(bits, {WORD - 1})"
        f" WHEN 'right' THEN shiftleft(bits & 1L, {WORD - 1}) ELSE bits END AS bits",
    )

    def gathered(view):
        return F.expr(f"bit_or(CASE WHEN view = '{view}' THEN bits ELSE 0L END)")

    inner = (
        f"above & below & (((own * 2) & {FULL_WORD}) | left_bit) & (shiftright(own, 1) | right_bit)"
    )
    return (
        runs_to_words(runs)
        .selectExpr("*", "explode(array('own', 'above', 'below', 'left', 'right')) AS view")
        .selectExpr(*keys, "view", *seen)
        .filter("bits != 0")
        .groupBy(*keys, "y", "w")
        .agg(
            gathered("own").alias("own"),
            gathered("above").alias("above"),
            gathered("below").alias("below"),
            gathered("left").alias("left_bit"),
            gathered("right").alias("right_bit"),
        )
        .filter("own != 0")
        .selectExpr(*keys, "y", "w", f"own & ~({inner}) AS bits")
        .filter("bits != 0")
    )


def outline_words(
    runs: DataFrame,
    keys: Sequence[str] = IMAGE,
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    return boundary_words(filled_runs(runs, keys, strip_pixels), keys)


def outline_runs(
    runs: DataFrame,
    keys: Sequence[str] = IMAGE,
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    """One-pixel outer outline of a mask, as runs."""
    words = outline_words(runs, keys, strip_pixels)
    return merge_pieces(words_to_pieces(words), keys)


def thick_outline_runs(
    runs: DataFrame,
    keys: Sequence[str] = IMAGE_AND_OUTLINE,
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    """Outline as wide as each image's ``outline`` key says; 0 draws none."""
    words = outline_words(runs.filter("outline > 0"), keys, strip_pixels)
    return thicken_runs(words_to_pieces(words), keys)
