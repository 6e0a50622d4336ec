"""Similarity joins and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from fissura.llm import cover_tree, jaccard_join
from fissura.llm.graph import components
from fissura.llm.shingles import shingle_sets
from fissura.llm.syncmers import SHORT, fingerprint_documents
from tests.llm.conftest import TEXTS, documents_of


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def joined(pairs, ids):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_rows(n=160, seed=3):
    """Groups around the threshold, a passage that many share, and words of their own."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for k in range(n):
        if k % 4:
            words = [f"g{k % 5}x{i}" for i in range(60)]
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(60)] = f"r{rng.randrange(10**6)}"
        else:
            words = passage + [f"u{k}x{i}" for i in range(rng.randint(0, 30))]
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize(("width", "num", "small"), [(3, 90, 48), (5, 80, 2)])
def test_join_equals_brute_force(spark, monkeypatch, width, num, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rows = near_rows()
    sets = {d: shingles(t, width) for d, t in rows}
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    comp = joined(links, sets)
    got = jaccard_join.join_similar(documents_of(spark, rows).repartition(5), width, num, 100).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {d: (len(s), comp[d]) for d, s in sets.items()}
    assert len(set(comp.values())) < len(rows)


def test_join_of_awkward_rows(documents, nothing):
    got = sorted((r[0] or -1, r[1], r[2]) for r in jaccard_join.join_similar(documents, 3, 90, 100).collect())
    want = {1: 1, 2: 1, 9: 9, 10: 9}
    assert got == sorted(
        (d or -1, len(shingles(t, 3)), want.get(d, d)) for d, t in TEXTS
    )
    assert jaccard_join.join_similar(nothing, 3, 90, 100).collect() == []


def test_shingle_sets_count_like_tuples():
    texts = [t or "" for _, t in TEXTS] + ["a b", "a b a b a b", "A b", "ab", "a\x0bb\x0cc\rd", "\u3000a b"]
    for width in (1, 3, 5):
        assert [len(s) for s in shingle_sets(texts, width)] == [len(shingles(t, width)) for t in texts]
    one, two = shingle_sets(["x A b c", "y a B c"], 3)
    assert len(np.intersect1d(one, two)) == 1


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    links += [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(40)]
    ids = {i for e in links for i in e if e[0] != e[1]}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r[0]: r[1] for r in got} == joined(links, ids)
    assert len(got) == len(ids)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("cell", [1024, 12])
def test_vectors_equal_brute_force(spark, cell):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(12):
        centre = rng.normal(size=16)
        for _ in range(14):
            rows.append((len(rows), (centre + rng.normal(size=16) * rng.choice([0, 0.05, 0.3])).tolist(), g % 3))
    awkward = [
        (900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1),
        (904, rows[0][1], None), (905, [float("inf")] + [1.0] * 15, 0), (906, [1.0, 2.0], 0), (907, rows[0][1], 0),
        (907, rows[0][1], 0), (908, [-v for v in rows[0][1]], 0),
    ]
    df = spark.createDataFrame(
        [(*r, 5, "y") for r in rows + awkward], "vec_id long, embedding array<double>, label int, count int, id string"
    )
    live = [(i, np.array(v), lab) for i, v, lab in [*rows, *awkward[6:]]]
    degree, pairs = [0] * len(live), []
    for (a, (i, v, s)), (b, (j, w, t)) in combinations(enumerate(live), 2):
        if s == t and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
            degree[a] += 1
            degree[b] += 1
            pairs.append((i, j))
    comp = joined(pairs, {i for i, _, _ in live})
    want = [(i, degree[k], comp[i], comp[i] == i) for k, (i, _, _) in enumerate(live)]
    want += [(r[0], 0, r[0], True) for r in awkward[:6]]
    got = cover_tree.link_vectors(df, 0.93, cell=cell).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert cover_tree.link_vectors(df.limit(0), 0.93).collect() == []


def test_levels_of_cells_equal_brute_force(spark, monkeypatch):
    """A dense cluster, one direction in many lengths, clusters at the threshold and outliers, split to small cells."""
    monkeypatch.setattr(cover_tree, "PART", 50)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 12))
    x = np.concatenate([
        centres[0] + rng.normal(size=(150, 12)) * 0.005, centres[1] * rng.uniform(0.1, 9, size=(80, 1)),
        centres[2] + rng.normal(size=(120, 12)) * 0.25, centres[3] + rng.normal(size=(60, 12)) * 0.15, rng.normal(size=(40, 12)),
    ])
    x = x[rng.permutation(len(x))]
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    comp = joined([(int(a), int(b)) for a, b in np.argwhere(linked)], range(len(x)))
    want = {i: (int(linked[i].sum()), comp[i]) for i in range(len(x))}
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = cover_tree.link_vectors(df, 0.93, cell=10, fan=8).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert len(got) == len(x)


@pytest.mark.parametrize("leaf", [6, 512])
def test_trees_equal_brute_force(leaf):
    rng = np.random.default_rng(8)
    raw = np.concatenate([
        rng.normal(size=(900, 20)), rng.normal(size=(9, 20)).repeat(70, axis=0) + rng.normal(size=(630, 20)) * 0.2,
    ])
    x, norm = cover_tree._unit(raw)
    links = cover_tree.Links(np.ones(len(x), np.int64))
    sides = [cover_tree.build(x, p, leaf=leaf) for p in np.array_split(rng.permutation(len(x)), 2)]
    for one, two in ((0, 0), (0, 1), (1, 1)):
        cover_tree.traverse(x, raw, norm, sides[one], sides[two], 0.93, links)
    linked = x @ x.T >= 0.93
    np.fill_diagonal(linked, False)
    comp = joined([(int(a), int(b)) for a, b in np.argwhere(linked)], range(len(x)))
    assert links.found.tolist() == linked.sum(axis=1).tolist()
    assert [links.top(i) for i in range(len(x))] == [comp[i] for i in range(len(x))]


def test_pairs_within_the_threshold_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.ones((300, 8)) + rng.normal(size=(300, 8)) * 0.001
    points = spark.createDataFrame([(i, v.tolist(), 1, 5) for i, v in enumerate(x)], "id long, vector array<double>, count long, cell long")
    monkeypatch.setattr(cover_tree, "_compare", lambda cosine: lambda table: table.select([]).slice(0, len(table) // 0))
    rows = cover_tree._links(points, 0.93, 20, 8).groupBy("id").sum("links").collect()
    assert {r["sum(links)"] for r in rows} == {299} and len(rows) == 300


def test_fingerprints(documents, nothing):
    rows = fingerprint_documents(documents).collect()
    assert len(rows) == len(TEXTS)
    order = sorted(((t or "", d) for d, t in TEXTS if d is not None), key=lambda r: (-r[1], r[0]))
    order += [(t, d) for d, t in TEXTS if d is None]
    found = {}
    for r in rows:
        found.setdefault((r["doc_id"], r["edited_sha256"]), r)
    for k, (text, d) in enumerate(order):
        following, half = order[(k + 1) % len(order)][0], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = found[d, hashlib.sha256(edited.encode()).hexdigest()]
        assert r["n_chars"] == len(text)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == text:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] != by_id[8]["fingerprint"]
    assert by_id[4]["fingerprint"] == by_id[6]["fingerprint"] == ""
    assert by_id[2]["near_next"] == 1.0 and by_id[8]["near_next"] < 0.1
    assert 0.3 < by_id[8]["near_edited"] < 0.9
    assert fingerprint_documents(nothing).collect() == []


def test_anchors_are_closed_syncmers(spark):
    """An anchor appears wherever its words do, and nearly every stretch of words has one."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(["new", "start", *words[50:]]))]
    one, two = (r["fingerprint"] for r in fingerprint_documents(documents_of(spark, rows)).orderBy("doc_id").collect())
    cut = lambda s: [(s[i : i + 8], int(s[i + 8 : i + 16], 16)) for i in range(0, len(s), 16)]
    one, two = cut(one), cut(two)
    assert [h for h, at in one if at >= 50] == [h for h, at in two if at >= 2]
    assert 50 <= len(one) <= 150


def test_sketch_adds_up_over_many_partitions(spark):
    rows = [(-i, "the same three words again") for i in range(1, 400)] + near_rows()
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    want = np.zeros(jaccard_join.BINS, np.int64)
    for one in shingle_sets([t for _, t in rows], 3):
        np.add.at(want, jaccard_join._bin(one), 1)
    assert want.max() > 255 and texts.rdd.getNumPartitions() > jaccard_join.FEW
    assert (jaccard_join._sketch(texts, 3) == want).all()


def clash_rows():
    """Ids that stand with several texts, some of them copies of others' texts."""
    w = " ".join(f"w{i}" for i in range(40))
    v = " ".join(f"v{i}" for i in range(40))
    return [
        (1, w), (5, w + " x"), (5, v), (8, v + " y"), (7, " ".join(f"q{i}" for i in range(30))),
        (7, " ".join(f"z{i}" for i in range(30))), (9, w), (9, w), (9, v), (3, " ".join(f"q{i}" for i in range(30))),
        (12, None), (12, ""), (12, ""), (None, w), (20, "alone it stands and is like nothing else here"),
    ]


def linked_sets(rows, width, num):
    sets = [shingles(t, width) if d is not None else frozenset() for d, t in rows]
    return sets, [
        (i, j) for i, j in combinations(range(len(rows)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])
    ]


@pytest.mark.parametrize("small", [48, 1])
def test_ids_with_several_texts_link_under_the_id(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rows = clash_rows() + [(d, t) for d, t in near_rows(60, 5) if d > 20]
    rows += [(d - 1, t + " more words at the end") for d, t in near_rows(60, 5) if d > 21 and d % 6 == 0]
    sets, pairs = linked_sets(rows, 3, 90)
    same = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and rows[i][0] == rows[j][0]]
    top = joined(pairs + same, range(len(rows)))
    low = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            low[top[i]] = min(low.get(top[i], d), d)
    # A row without words has its id's component, as it has its id.
    of_id = {d: low[top[i]] for i, (d, _) in enumerate(rows) if sets[i]}
    want = sorted(((d, len(shingles(t, 3)), of_id.get(d, d)) for d, t in rows), key=repr)
    got = jaccard_join.join_similar(documents_of(spark, rows).repartition(3), 3, 90, 100)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_near_duplicates_lose_no_other_text(spark):
    import corpus_pipeline

    rows = clash_rows()
    sets, pairs = linked_sets(rows, 5, 80)
    top = joined(pairs, range(len(rows)))
    groups = {}
    for i, (d, t) in enumerate(rows):
        key = ("group", top[i]) if sets[i] else ("row", d, t) if d is not None else ("null", i)
        groups.setdefault(key, []).append(d)
    docs = documents_of(spark, rows).repartition(4)
    for _ in range(2):
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert kept.dtypes == docs.dtypes
        kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert sorted((d for d, _ in kept), key=repr) == sorted(
            (min(g, key=lambda d: (d is None, d or 0)) for g in groups.values()), key=repr
        )
        assert {t for d, t in kept if d == 7} == {t for d, t in rows if d == 7 and "z0" in t}
        assert (5, rows[2][1]) in kept and (5, rows[1][1]) not in kept


def plain_likeness(a, b):
    """The definition over lists of (hash, place)."""
    first = lambda rows: {h: min(p for g, p in rows if g == h) for h, _ in rows}
    at_a, at_b = first(a), first(b)
    shifts = Counter(at_b[h] - at_a[h] for h in at_a.keys() & at_b.keys())
    shift = min(shifts, key=lambda d: (-shifts[d], abs(d), d)) if shifts else 0
    dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0
    placed_a, placed_b = set(a), {(h, p - shift) for h, p in b}
    return (dice(placed_a, placed_b) + dice(set(at_a), set(at_b))) / 2


def fingerprint_parts(text):
    anchors, _, words = text.partition("/")
    cut = lambda s: [(s[i : i + 8], int(s[i + 8 : i + 16], 16)) for i in range(0, len(s), 16)]
    return cut(anchors), cut(words)


def test_fingerprints_are_laid_over_each_other(spark):
    """Words in front of a text move no anchor; short texts are compared by words."""
    rng = random.Random(8)
    long = [f"w{rng.randrange(400)}" for _ in range(300)]
    short = [f"s{i}" for i in range(14)]
    again = [f"r{i}" for i in range(40)] * 6
    chain = [
        long, ["put", "in", "front", *long], long[150:] + long[:150], [*long[:100], "within", *long[100:]],
        short, ["new", *short], short[:7] + ["x"] + short[7:], short[:4], again, ["x", *again[40:]],
        [f"b{i}" for i in range(48)], [f"b{i}" for i in range(49)], [f"b{i}" for i in range(8)], [],
    ]
    n = len(chain)
    rows = [(n - k, " ".join(words)) for k, words in enumerate(chain)]
    got = {r["doc_id"]: r for r in fingerprint_documents(documents_of(spark, rows)).collect()}
    for k in range(n):
        one, two = got[n - k], got[n - (k + 1) % n]
        a, b = fingerprint_parts(one["fingerprint"]), fingerprint_parts(two["fingerprint"])
        both_short = len(chain[k]) <= SHORT and len(chain[(k + 1) % n]) <= SHORT
        assert one["near_next"] == pytest.approx(plain_likeness(a[both_short], b[both_short])), k
        new = fingerprint_parts(one["edited_fingerprint"])
        by_words = bool(a[1] or not a[0]) and bool(new[1] or not new[0])
        assert one["near_edited"] == pytest.approx(plain_likeness(a[by_words], new[by_words])), k
    near = [got[n - k]["near_next"] for k in range(n)]
    assert near[0] > 0.95  # three words in front
    assert 0.45 < near[1] < 0.9  # halves exchanged
    assert near[4] > 0.9 and near[5] > 0.6  # of fourteen words, none or half of which moved
