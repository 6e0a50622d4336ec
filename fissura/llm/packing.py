"""Packing documents into sequences by length patterns.

The plan works on the histogram of piece lengths, whose size does not depend on
the number of documents:

1. Lengths are counted in bins of ``BIN`` tokens. Every pattern of one, two or
   three bins that fills a sequence is a column, and non-negative least squares
   fit repeat counts to the histogram.
2. The counts are rounded. A pattern takes the longest lengths left in its
   bins, and in the place of the last the longest length that still fits.
3. What is left goes, longest first, into the fullest sequence that has room.

Pieces are then numbered within their length, and the number leads to sequence
and offset. Numbering is by (length, salt), with the counts before each salt
added, so no group of pieces of one length meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fissura.llm.shared import Bounded, arrow_schema, map_blocks, stored, texts_of
from fissura.llm.word_bpe import word_bpe

BIN = 8
MEMO = 250_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(
    df: DataFrame, path: str, size: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> DataFrame:
    """The pieces of every row: its ids and ``end_id``, cut only where longer than ``size``."""

    def work():
        bpe, step = word_bpe(path), 4 * size
        memo = Bounded(lambda word: np.asarray(bpe.library_ids(word), "<u4").tobytes(), MEMO)
        end = int(end_id).to_bytes(4, "little")

        def each(ids, texts):
            out = [[] for _ in range(5)]
            for doc_id, text in zip(ids, texts):
                data = b"".join(map(memo.__getitem__, bpe.words(text))) + end
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    row = doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)
                    for column, value in zip(out, row):
                        column.append(value)
            memo.trim()
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), out))

        return each

    return map_blocks(texts_of(df, id_col, text_col), work, PIECES)


def fit_counts(patterns: list[tuple[int, ...]], b: np.ndarray, rounds: int = 3) -> np.ndarray:
    """x >= 0 of the least ``|a x - b|``, by the active-set method.

    Column k of ``a`` says how often each bin is in pattern k. Only columns in
    use are ever laid out; ``b[0]`` stands for no bin and must be 0.
    """
    parts = np.zeros((len(patterns), 3), np.int64)
    for k, pattern in enumerate(patterns):
        parts[k, : len(pattern)] = pattern
    x, active = np.zeros(len(patterns)), np.zeros(len(patterns), bool)
    scale = 1e-9 * max(1.0, float(b.max(initial=0)))
    for _ in range(rounds * len(b)):
        left = b - np.bincount(parts.ravel(), np.repeat(x, 3), len(b))
        left[0] = 0
        slope = left[parts].sum(axis=1)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= scale:
            break
        active[best] = True
        while active.any():
            on = np.flatnonzero(active)
            a = np.zeros((len(b), len(on)))
            np.add.at(a, (parts[on].ravel(), np.repeat(np.arange(len(on)), 3)), 1.0)
            a[0] = 0
            y = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(on)), a.T @ b)
            if (y > 0).all():
                x[:] = 0
                x[on] = y
                break
            low = y <= 0
            fall = x[on] - y
            step = float(np.min(x[on][low] / np.where(fall[low] > 0, fall[low], 1.0)))
            x[on] += step * (y - x[on])
            active[on[(x[on] <= 1e-12) & low]] = False
            x[~active] = 0
    return x


def bin_patterns(bins: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """One to three bins, largest first, that fill a sequence of ``bins``; only those present."""
    out = [(bins,)] if present[bins] else []
    for first in range(bins - 1, 0, -1):
        if not present[first]:
            continue
        for second in range(min(first, bins - first), 0, -1):
            third = bins - first - second
            if present[second] and third <= second and (third == 0 or present[third]):
                out.append((first, second, third) if third else (first, second))
    return out


def plan_patterns(histogram: dict[int, int], size: int, bin_size: int = BIN) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), together using every piece once."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    planned: Counter = Counter()
    bins = -(-size // bin_size)
    binned = np.zeros(bins + 1)
    np.add.at(binned, -(-np.arange(size + 1) // bin_size), left)
    patterns = bin_patterns(bins, binned > 0)
    if patterns:
        repeats = np.rint(fit_counts(patterns, binned)).astype(np.int64)
        for k in np.flatnonzero(repeats).tolist():
            _instantiate(patterns[k], int(repeats[k]), left, size, bin_size, planned)
    return _best_fit(planned, left, size)


def _longest(left: np.ndarray, low: int, high: int) -> int:
    """The longest length in (low, high] that has pieces, or 0."""
    found = np.flatnonzero(left[low + 1 : high + 1])
    return low + 1 + int(found[-1]) if len(found) else 0


def _instantiate(pattern, repeats, left, size, bin_size, planned) -> None:
    while repeats > 0:
        chosen: list[int] = []
        for k, part in enumerate(pattern):
            room = size - sum(chosen)
            last = k == len(pattern) - 1 and k > 0
            low = 0 if last else (part - 1) * bin_size
            for length in chosen:
                left[length] -= 1
            length = _longest(left, low, room if last else min(room, part * bin_size))
            for other in chosen:
                left[other] += 1
            if not length:
                break
            chosen.append(length)
        if len(chosen) < len(pattern):
            return
        need = Counter(chosen)
        times = min(repeats, *(int(left[v]) // n for v, n in need.items()))
        for length, n in need.items():
            left[length] -= n * times
        planned[tuple(chosen)] += times
        repeats -= times


def _best_fit(planned: Counter, left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Put what is left into the fullest sequences with room, opening new ones where none has."""
    open_: dict[int, list[list]] = defaultdict(list)
    for pattern, n in planned.items():
        open_[size - sum(pattern)].append([pattern, n])
    rooms = sorted(open_)

    def add(pattern, n, room):
        if not open_[room]:
            insort(rooms, room)
        open_[room].append([pattern, n])

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fits = size // length
                for times, parts in ((n // fits, fits), (1, n % fits)):
                    if times and parts:
                        add((length,) * parts, times, size - length * parts)
                break
            room = rooms[at]
            pattern, count = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            times = min(n, count)
            if count > times:
                add(pattern, count - times, room)
            add((*pattern, length), times, room - length)
            n -= times
    return [(tuple(p), n) for group in open_.values() for p, n in group]


def place_table(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Runs of numbers within a length, sorted: where each goes."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    rows.sort()
    length, first, sequence, offset = np.asarray(rows, np.int64).reshape(-1, 4).T
    return {"length": length, "first": first, "sequence": sequence, "offset": offset}


def pack_documents(
    df: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row.

    A null or empty text is a piece of the end id alone. Rows with equal or null
    ids are packed each on its own; other columns are ignored; an empty table
    gives no rows. One pass over the texts, whose short result is written to
    shared storage, then two shuffles of it.
    """
    pieces = stored(cut_pieces(df, path, size, id_col, text_col), "pieces")
    counted = pieces.groupBy("length").count().collect()  # at most ``size`` rows
    histogram = {r["length"]: r["count"] for r in counted}
    total = sum(histogram.values())
    places = place_table(plan_patterns(histogram, size))

    salts = max(total // 50_000, min(total // 256, 4096), 1)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    numbered = (
        salted.withColumn("number", F.row_number().over(within) - 1)
        .join(groups, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number"))
    )
    schema = PIECES + ", sequence_id long, offset long"
    types = arrow_schema(schema)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = int(places["first"].max(initial=0)) + 1
        starts = places["length"] * width + places["first"]  # below size * total
        for batch in batches:
            if not batch.num_rows:
                continue
            length, number = (batch.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(starts, length * width + np.minimum(number, width - 1), side="right") - 1
            sequence = places["sequence"][at] + number - places["first"][at]
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(places["offset"][at])]
            yield pa.RecordBatch.from_arrays(columns, schema=types)

    return numbered.mapInArrow(place, schema)
