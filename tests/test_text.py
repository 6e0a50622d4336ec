"""File names, parameters and colours, against Python's own rules."""

import math
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from fissura.functions import names, params

NAMES = [
    "a.jpg", "a.JPG", "dir.x/a", "x.tar.gz", ".jpg", "a.", "..jpg", "a..jpg", "", "a b.PNG",
    "é.webp", "a/.jpg", "a.jpg/", "a.jpg ", "new\nline.png", "a.jpg\n", "b.Jpeg", "c.bMp", "d.TIF",
    "e.tiff", "f.WebP", "site/b.x/photo.1.png", None,
]


def test_suffix_stem_and_allow_list(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "name string").select(
        "name",
        names.suffix(F.col("name")).alias("suffix"),
        names.stem(F.col("name")).alias("stem"),
        names.is_allowed(F.col("name")).alias("allowed"),
        names.beside_input(F.col("name")).alias("beside"),
    )
    for r in rows.collect():
        if r["name"] is None:
            assert r["allowed"] is False
            continue
        path = PurePosixPath(r["name"])
        assert r["suffix"] == path.suffix.lower(), r
        assert r["stem"] == path.stem, r
        assert r["allowed"] == (path.suffix.lower() in set(names.ALLOWED_SUFFIXES))
        if path.name and not r["name"].endswith("/"):
            assert r["beside"] == str(path.with_name(path.stem + "_overlay.jpg"))


def test_identity_key_is_stable_and_distinct(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a1", None)], "path string, n bigint")
    key = names.identity_key(F.col("path"), F.col("n"))
    once = [r[0] for r in df.select(key).collect()]
    assert once == [r[0] for r in df.select(key).collect()] and len(set(once)) == 3
    parts = spark.createDataFrame([(None, "a"), ("a", None), ("a", ""), ("", "a")], "x string, y string")
    assert parts.select(names.identity_key(F.col("x"), F.col("y"))).distinct().count() == 4


NUMBERS = [
    None, "", "abc", "0.25", " 0.3 ", "1e-1", "nan", "-nan", "inf", "-inf", "Infinity", "0.5f", "0.5d",
    "0x1p3", "0x10", "2", "2.5", "+4", "-1", "-4", "99", "99999999999", "9" * 40, "1_0", "1__0", "_1",
    ".5", "5.", ".", "1e", "--1", "1 2", "\t7\n", "1_0.2_5",
]


def clamped(value, low, high):
    return min(max(value, low), high)


def form_params(conf, alpha, outline):
    try:
        c = float(0.25 if conf is None else conf)
        a = float(0.5 if alpha is None else alpha)
        o = int(2 if outline is None else outline)
    except ValueError:
        c, a, o = 0.25, 0.5, 2
    return clamped(c, 0.0, 1.0), clamped(a, 0.0, 1.0), clamped(o, 0, 10)


def alike(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b


def test_lenient_params_follow_python(spark):
    raw = [(a, b, c) for a in NUMBERS for b in ("0.5", None, "x", "7") for c in NUMBERS]
    df = spark.createDataFrame(raw, "conf_raw string, alpha_raw string, outline_raw string")
    for r in params.normalise_params(df).collect():
        want = form_params(r["conf_raw"], r["alpha_raw"], r["outline_raw"])
        assert alike(r["conf"], want[0]) and alike(r["alpha"], want[1]), r
        assert r["outline"] == want[2], r


def test_strict_params_keep_values_and_refuse_text(spark):
    layout = "conf_raw string, alpha_raw string, outline_raw string"
    good = spark.createDataFrame([("2.5", None, "-4"), (None, "-3", None)], layout)
    rows = params.normalise_params(good, "strict").select("conf", "alpha", "outline").collect()
    assert sorted(map(tuple, rows)) == [(0.25, -3.0, 2), (2.5, 0.5, -4)]
    bad = spark.createDataFrame([("0.2", "x", "1"), ("0.2", "1", "99999999999")], layout)
    rows = params.normalise_params(bad, "strict").select("conf", "outline", "error").collect()
    assert set(map(tuple, rows)) == {(None, None, "invalid alpha value: x"), (0.2, 2147483647, None)}
    with pytest.raises(ValueError):
        params.normalise_params(bad, "other")


def python_colour(text):
    try:
        parts = [int(p.strip()) for p in text.split(",")]
    except ValueError:
        return None
    return tuple(clamped(p, 0, 255) for p in parts) if len(parts) == 3 else None


COLOURS = [
    "0,0,255", " 1 , 2 , 3 ", "300,-5,0", "1,2", "1,2,3,4", "a,b,c", "", ",,", "1,2,", "1.5,2,3",
    "+7,08,9", "1_0,2,3", "9" * 30 + ",0,-" + "9" * 30, "1,\t2,3\n",
]


def test_colour(spark):
    df = spark.createDataFrame([(c,) for c in COLOURS], "c string")
    for r in df.select("c", params.parse_colour(F.col("c")).alias("v")).collect():
        assert (tuple(r["v"]) if r["v"] else None) == python_colour(r["c"]), r
    with pytest.raises(Exception, match="color must be"):
        df.select(params.parse_colour(F.col("c"), "strict")).collect()


def test_strict_colours_fail_alone(spark):
    df = spark.createDataFrame([(c, None if i % 2 else "earlier") for i, c in enumerate([*COLOURS, None])], "colour_raw string, error string")
    for r in params.normalise_colour(df, "strict").collect():
        want = (0, 0, 255) if r["colour_raw"] is None else python_colour(r["colour_raw"])
        assert (tuple(r["colour"]) if r["colour"] else None) == want
        assert r["error"] in ("earlier", None if want else params.COLOUR_MESSAGE)
    lenient = params.normalise_colour(df.drop("error")).collect()
    assert all("error" not in r.asDict() for r in lenient)
