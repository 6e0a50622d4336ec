import numpy as np
import pytest
from pyspark.sql import functions as F

from fissura.operators import masks, outline
from fissura.schemas import DETECTIONS
from tests import brute

SHAPES = [(1, 1), (3, 5), (8, 8), (7, 40), (5, 100), (12, 64), (20, 33)]


@pytest.fixture(scope="module")
def grids():
    rng = np.random.default_rng(1)
    found = []
    for image_id in range(42):
        h, w = SHAPES[image_id % len(SHAPES)]
        n = image_id % 4
        density = (0.15, 0.45, 0.75)[image_id % 3]
        found.append(np.where(rng.random((n, h, w)) < density, 0.9, 0.1).astype(np.float32))
    full = np.full((1, 6, 70), 0.9, np.float32)
    edge = np.full((1, 4, 4), 0.5, np.float32)
    nan = np.full((1, 4, 4), np.nan, np.float32)
    nan[0, 1, 2] = 0.7
    return [*found, full, edge, nan]


@pytest.fixture(scope="module")
def detections(spark, grids):
    rows = [
        (i, i * 100 + k, 0.9, *m.shape, [float(v) for v in m.ravel()])
        for i, g in enumerate(grids)
        for k, m in enumerate(g)
    ]
    return spark.createDataFrame(rows, DETECTIONS).cache()


def unions(grids):
    return {i: (g > 0.5).any(axis=0) for i, g in enumerate(grids) if len(g)}


def by_image(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["image_id"], []).append(r)
    return out


def assert_canonical(rows):
    lines = {}
    for r in rows:
        assert r["x0"] < r["x1"]
        lines.setdefault(r["y"], []).append((r["x0"], r["x1"]))
    for spans in lines.values():
        spans.sort()
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_instance_runs(grids, detections):
    found = {}
    for r in masks.instance_runs(detections).collect():
        found.setdefault(r["instance_id"], []).append(r)
    for i, g in enumerate(grids):
        for k, m in enumerate(g):
            rows = found.get(i * 100 + k, [])
            assert brute.pixels(rows) == brute.set_pixels(m > 0.5)
            assert_canonical(rows)


def test_union(grids, detections):
    words = masks.score_words(detections)
    runs = masks.merge_pieces(masks.words_to_pieces(words), ["image_id"])
    found = by_image(runs)
    for i, union in unions(grids).items():
        assert brute.pixels(found.get(i, [])) == brute.set_pixels(union)
        assert_canonical(found.get(i, []))


def test_union_of_runs_is_idempotent_and_ignores_order(detections):
    runs = masks.instance_runs(detections)
    once = masks.union_runs(runs)
    again = masks.union_runs(once.unionByName(once))
    shuffled = masks.union_runs(runs.repartition(5, F.rand(3)))
    assert sorted(once.collect()) == sorted(again.collect()) == sorted(shuffled.collect())
    union_area = masks.mask_areas(once).agg(F.sum("mask_area")).first()[0]
    assert 0 < union_area <= masks.mask_areas(runs).agg(F.sum("mask_area")).first()[0]


@pytest.mark.parametrize("size", [(20, 13), (5, 3), (8, 8), (9, 130)])
def test_fit(spark, grids, detections, size):
    sizes = F.lit(size[0]).alias("height"), F.lit(size[1]).alias("width")
    found = by_image(masks.fit_runs(masks.score_words(detections).select("*", *sizes)))
    for i, union in unions(grids).items():
        assert brute.pixels(found.get(i, [])) == brute.set_pixels(brute.fit(union, *size))
        assert_canonical(found.get(i, []))


def mask_runs(spark, bitmaps):
    rows = [
        (i, m.shape[0], m.shape[1], int(y), int(x), int(x) + 1)
        for i, m in enumerate(bitmaps)
        for y, x in zip(*np.nonzero(m))
    ]
    layout = "image_id bigint, height int, width int, y int, x0 int, x1 int"
    return masks.union_runs(spark.createDataFrame(rows, layout), masks.IMAGE)


def ring_with_dot():
    m = np.zeros((9, 9), bool)
    m[1:8, 1:8] = True
    m[2:7, 2:7] = False
    m[4, 4] = True
    return m


def spiral(n):
    """Walls with a corridor that winds to the middle, left open or shut."""
    m = np.zeros((n, n), bool)
    top, left, bottom, right = 0, 0, n - 1, n - 1
    while top < bottom and left < right:
        m[top, left : right + 1] = True
        m[top : bottom + 1, right] = True
        m[bottom, left : right + 1] = True
        m[top + 2 : bottom + 1, left] = True
        m[top + 2, left : left + 2] = True
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
    return m


def shapes():
    rng = np.random.default_rng(7)
    cut = ring_with_dot()
    cut[4, 7] = False
    diagonal = ring_with_dot()
    diagonal[1, 1] = False
    sealed = spiral(41)
    sealed[1, 0] = True
    tall = [rng.random((60, 37)) < d for d in (0.3, 0.55, 0.65, 0.8)]
    small = [rng.random(s) < 0.6 for s in SHAPES]
    gap_row = ring_with_dot()
    gap_row[4, :] = False
    return [
        ring_with_dot(), cut, diagonal, gap_row, spiral(41), sealed,
        np.ones((40, 3), bool), np.eye(12, dtype=bool), *tall, *small,
    ]


@pytest.mark.parametrize("strip_pixels", [1, 60, 150, 400, outline.STRIP_PIXELS])
def test_outline(spark, strip_pixels):
    bitmaps = shapes()
    found = by_image(outline.outline_runs(mask_runs(spark, bitmaps), strip_pixels=strip_pixels))
    for i, m in enumerate(bitmaps):
        assert brute.pixels(found.get(i, [])) == brute.outline(m), i
        assert_canonical(found.get(i, []))


def test_outline_skips_holes(spark):
    found = brute.pixels(outline.outline_runs(mask_runs(spark, [ring_with_dot()])).collect())
    assert (4, 4) not in found and len(found) == 24


@pytest.mark.parametrize("thickness", [0, 1, 2, 3, 4, 10])
def test_thick_outline(spark, thickness):
    bitmaps = shapes()
    runs = mask_runs(spark, bitmaps).withColumn("outline", F.lit(thickness))
    found = by_image(outline.thick_outline_runs(runs))
    for i, m in enumerate(bitmaps):
        expected = brute.thicken(brute.outline(m), thickness, *m.shape) if thickness else set()
        assert brute.pixels(found.get(i, [])) == expected


@pytest.mark.parametrize("strip_pixels", [masks.THICK_PIXELS, 200, 40])
def test_thickening_by_distances_equals_the_disc(spark, strip_pixels):
    """Every width from 0 to 200, on sparse pixels of images up to many times smaller."""
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for t in range(1, 201):
        h, w = (int(v) for v in rng.integers(1, 40, 2))
        mask = rng.random((h, w)) < rng.choice([0.002, 0.05, 0.4])
        mask[rng.integers(h), rng.integers(w)] = True
        want[t] = brute.thicken(brute.set_pixels(mask), t, h, w)
        for y in range(h):
            x = np.flatnonzero(mask[y]).tolist()
            rows += [(t, h, w, t, y, a, a + 1) for a in x]
    layout = "image_id bigint, height int, width int, outline int, y int, x0 int, x1 int"
    df = spark.createDataFrame(rows, layout).repartition(5)
    found = masks.thicken_runs(df, masks.IMAGE_AND_OUTLINE, strip_pixels).collect()
    by_image = {}
    for r in found:
        assert 0 <= r["x0"] < r["x1"] <= r["width"] and r["outline"] == r["image_id"]
        by_image.setdefault(r["image_id"], []).append(r)
    for t, pixels in want.items():
        mine = sorted((r["y"], r["x0"], r["x1"]) for r in by_image[t])
        assert brute.pixels(by_image[t]) == pixels, t
        # Maximal and apart.
        assert all(a[0] < b[0] or a[2] < b[1] for a, b in zip(mine, mine[1:])), t
