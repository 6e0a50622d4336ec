"""Hard negatives against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fissura.llm import hard_negatives
from fissura.llm.hard_negatives import mine_negatives

LAYOUT = "vec_id long, label int, embedding array<double>, score double, slots string"


def brute(rows, divisor, positives=5, negatives=3):
    """Every pair in plain integers."""
    unique = {repr(r): r for r in rows}.values()
    sound = []
    for vec_id, label, vector in unique:
        if None in (vec_id, label, vector) or any(x is None or not math.isfinite(256 * x) for x in vector):
            continue
        sound.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    out = []
    for a in sound:
        if a[0] % divisor:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b) for b in sound if len(a[2]) == len(b[2])]
        scored.sort(key=lambda p: (-p[0], p[1][0]))
        same = [(s, b) for s, b in scored if b[1] == a[1] and b[0] != a[0]][:positives]
        for ps, p in same:
            fit = [(s, b) for s, b in scored if b[1] != a[1] and 50 * ps <= 100 * s <= 95 * ps][:negatives]
            out += [(a[0], p[0], k, b[0], ps, s) for k, (s, b) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, divisor):
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], LAYOUT).repartition(4)
    return sorted(tuple(r) for r in mine_negatives(df, F.col("vec_id") % divisor == 0).collect())


def vectors(n, seed, dim=4, spread=1.0):
    rng = random.Random(seed)
    # Few values, so scores tie; one label has a third of the rows.
    return [
        (i, 0 if rng.random() < 0.33 else rng.randint(1, 3), [spread * rng.randint(-1, 4) / 4 for _ in range(dim)])
        for i in range(n)
    ]


@pytest.mark.parametrize(("anchors", "stripe", "tile"), [(1 << 15, 8192, (512, 2048)), (8, 40, (3, 7))])
def test_equals_all_pairs(spark, monkeypatch, anchors, stripe, tile):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "STRIPE", stripe)
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    rows = vectors(300, 1)
    want = brute(rows, 5)
    assert len(want) > 200
    assert mined(spark, rows, 5) == want


def test_awkward_rows(spark):
    rows = vectors(60, 2) + vectors(60, 2)[:20]  # repeated rows
    rows += [(0, 2, [0.5, 0.5, 0.5, 1.0]), (5, 0, [1.0, 1.0, 1.0, 1.0])]  # other vectors under the same ids
    rows += [(None, 1, [1.0] * 4), (200, None, [1.0] * 4), (205, 1, None), (210, 1, [1.0, None, 1.0, 1.0])]
    rows += [(215, 1, [float("nan")] * 4), (220, 1, [float("inf")] * 4), (225, 1, [1e308] * 4)]
    rows += [(230, 1, []), (235, 2, []), (240, 1, []), (245, 1, [1.0, 2.0]), (250, 1, [2.0, 2.0]), (252, 2, [1.0, 1.0])]
    want = brute(rows, 5)
    assert any(r[0] == 245 for r in want) and any(r[0] == 230 for r in want)
    assert mined(spark, rows, 5) == want
    assert mined(spark, [], 5) == []


def test_large_components_stay_exact(spark):
    """Products beyond the whole numbers that a double holds."""
    rows = [(i, label, [2.0**20 * x + y for x, y in v]) for i, (label, v) in enumerate(
        [(k % 3, [(3 + k % 2, k / 256), (2, (k * 7 % 5) / 256)]) for k in range(40)])]
    assert max(abs(r[4]) for r in brute(rows, 5)) > 1 << 53
    assert mined(spark, rows, 5) == brute(rows, 5)


def test_slots_of_equal_and_negative_positives(spark):
    one = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.5]), (3, 1, [-1.0, 0.0]), (4, 1, [0.0, 1.0])]
    other = [(10 + k, 2, [k / 16, 0.0]) for k in range(-8, 20)]
    got = mined(spark, one + other, 100)
    assert got == brute(one + other, 100)
    assert {r[1] for r in got} == {1, 2, 4}
