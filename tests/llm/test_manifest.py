"""Merkle manifest against sorting and plain recursion; places by directories."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fissura.llm import merkle, ranks
from fissura.llm.merkle import manifest
from tests.llm.conftest import TEXTS

LAYOUT = "doc_id long, source string, lang string, n_chars long, text string, node string, place long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, arity):
    """All levels, and per leaf what stands before and after its ancestors."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + arity]) for i in range(0, len(last), arity)])
    paths = []
    for i in range(len(nodes)):
        path, at = [], i
        for level in levels[:-1]:
            low = at - at % arity
            path.append(("".join(level[low:at]), "".join(level[at + 1 : low + arity])))
            at //= arity
        paths.append(path)
    return levels[-1][0], paths


def brute(rows, arity):
    runs = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        leaf = h(*map(field, (doc_id, source, lang, n_chars, text)))
        wrong = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None:
            wrong = h(*map(field, (doc_id, source, lang, n_chars + 1, text)))
        runs[b"" if lang is None else b"=" + lang.encode()].append((doc_id is not None, doc_id, leaf, wrong))
    names = sorted(runs)
    found = {k: tree([r[2] for r in sorted(runs[k])], arity) for k in names}
    root, above = tree([found[k][0] for k in names], arity)
    out = []
    for k, up in zip(names, above):
        for (_, doc_id, leaf, wrong), path in zip(sorted(runs[k]), found[k][1]):
            path, node = path + up, wrong
            for left, right in path:
                node = h(left, node, right)
            proof = h(*(left + right for left, right in path))
            out.append((doc_id, leaf, found[k][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def made(spark, rows, arity=2):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], LAYOUT).repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return sorted((tuple(r) for r in manifest(df, tampered, arity).collect()), key=repr)


AWKWARD = (
    [(d, "s", "en", len(t or ""), t) for d, t in TEXTS]
    + [(None, None, None, None, None)] * 3
    + [(77, "s", "en", 1, "a")] * 9  # equal rows
    + [(77, "s", "en", 1, t) for t in "bcdefg"]  # one id, other texts
    + [(None, "s", "en", 1, t) for t in "hijk"]
    + [(-(10**18), "é", "日本", -5, "x"), (10**18, "", "", 2**63 - 1, ""), (2**63 - 1, "s", "en", 0, "y"), (-(2**63), "s", "en", 0, "z")]
)


@pytest.mark.parametrize(("arity", "slots", "fan"), [(2, 1024, 12), (2, 4, 2), (3, 9, 3)])
def test_equals_plain_trees(spark, monkeypatch, arity, slots, fan):
    monkeypatch.setattr(merkle, "SLOTS", slots)
    monkeypatch.setattr(ranks, "FAN", fan if fan > 2 else 6)
    rows = AWKWARD + [(i * 37 % 1009, f"s{i % 3}", ("de", "fr")[i % 5 == 0], i, f"text {i}") for i in range(150)]
    assert made(spark, rows, arity) == brute(rows, arity)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_small_trees(spark, n):
    rows = [(i, "s", "en", 3, f"t{i}") for i in range(n)]
    assert made(spark, rows) == brute(rows, 2)


def test_empty_table(spark):
    assert made(spark, []) == []


def test_text_without_end(spark):
    rows = [(1, "s", "en", 8_000_000, "ab cd ef " * 900_000), (2, "s", "en", 1, "b")]
    assert made(spark, rows) == brute(rows, 2)


def test_prefix_sums_and_places(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FAN", 3)
    monkeypatch.setattr(ranks, "RANGE", 10)
    keys = [(g, k, k % 5) for g in range(2) for k in [-40, -39, -1, 0, 5, 6, 7, 8, 9, 63, 64, 700, 5000]]
    df = spark.createDataFrame(keys, "g long, k long, v long")
    got = ranks.prefix_sums(df, ["g"], "k", "v", -40, 5000).collect()
    for r in got:
        assert r["before"] == sum(v for g, k, v in keys if g == r["g"] and k < r["k"])
    assert len(got) == len(keys)
    names = sorted({hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(57)} | {"", "é", "~"}, key=str.encode)
    numbered = ranks.places(spark.createDataFrame([(n,) for n in names], "n string"), "n")
    assert [r["n"] for r in numbered.orderBy("place").collect()] == names
    assert [r["place"] for r in numbered.orderBy("place").collect()] == list(range(len(names)))
