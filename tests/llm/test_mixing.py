"""Source mixing against a plain schedule over word lists."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from fissura.llm import mixing
from fissura.llm.mixing import count_below, mix, reversed_bits, schedule
from tests.llm.conftest import documents_of

LAYOUT = "doc_id long, source string, text string, size long, rank string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, rest, free = {}, sum(sizes.values()), list(names)
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if rest * weight[s] / total > 3 * sizes[s]]
        if not above:
            target |= {s: rest * weight[s] / total for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        rest -= sum(3 * sizes[s] for s in above)
        free = [s for s in free if s not in above]
    return target


def brute(rows):
    """Every source's words in its order, read word by word until its target is met."""
    streams = defaultdict(list)
    for i, (doc_id, source, text) in enumerate(rows):
        key = hashlib.sha256(f"{'-' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()[:15]
        streams[source].append((key, doc_id is not None, doc_id, len(words_of(text)), i))
    sizes = {s: sum(d[3] for d in docs) for s, docs in streams.items()}
    targets = brute_targets(sizes)
    taken = [0] * len(rows)
    for source, docs in streams.items():
        stream = [d[4] for d in sorted(docs) for _ in range(d[3])]
        for k in range(min(int(targets[source] + 0.5), 3 * len(stream))):
            taken[stream[k % len(stream)]] += 1
    return sorted(
        (
            (d, s, len(words_of(t)), sizes[s], targets[s], n)
            for (d, s, t), n in zip(rows, taken)
        ),
        key=repr,
    )


def mixed(spark, rows, **kind):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], LAYOUT).repartition(3)
    return mix(df, **kind)


ROWS = (
    [(i, "hot" if i % 3 else f"s{i % 7}", " ".join(f"w{k}" for k in range(i * 7 % 23))) for i in range(150)]
    + [(1000, "tiny", "one")] + [(1001, "none", None), (1002, "none", " \n")]
    + [(2000, None, "a b c")] * 9  # repeated rows
    + [(2000, None, "another text"), (None, "hot", "no id"), (None, "hot", None), (3, "é", "x y"), (4, "", "x\x1cy z")]
    + [(5, "long", "word " * 3000)]
)


@pytest.mark.parametrize(("block", "bucket", "chunk"), [(256, 1024, 4096), (4, 8, 2)])
def test_equals_word_by_word(spark, monkeypatch, block, bucket, chunk):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    result = mixed(spark, ROWS, block=block)
    got = sorted((tuple(r) for r in result.documents.collect()), key=repr)
    assert got == brute(ROWS)
    assert all(r[5] <= 3 * r[2] for r in got)


def test_spans_are_the_mix(spark):
    """Slots are full but for each source's last, and spans add up to what is taken."""
    result = mixed(spark, ROWS, block=16)
    taken, slots = defaultdict(int), defaultdict(list)
    for r in result.spans.collect():
        taken[r["doc_id"]] += r["words"]
        slots[r["slot"]].append((r["place"], r["words"], r["doc_id"], r["start"]))
    want = defaultdict(int)
    for d, _, _, _, _, n in brute(ROWS):
        want[d] += n
    assert {k: v for k, v in want.items() if v} == dict(taken)
    short = 0
    for pieces in slots.values():
        pieces.sort(key=lambda p: p[0])
        at = 0
        for place, n, _, start in pieces:
            assert place == at and start >= 0
            at += n
        short += at < 16
    assert short <= len({r[1] for r in ROWS})


def test_ranks_count_the_slots_before(spark):
    rng = random.Random(4)
    for n in (1, 2, 3, 7, 64, 100, 1000):
        bits = max(1, (n - 1).bit_length())
        time = reversed_bits(np.arange(n), bits)
        assert len(set(time.tolist())) == n
        limit = rng.randint(0, n)
        brute_count = [sum(1 for k in range(t) if int(reversed_bits(np.array([k]), bits)[0]) < limit) for t in time]
        assert count_below(time, np.full(n, limit), bits).tolist() == brute_count
    cuts = [0, 5, 5, 40, 333, 1000]
    rows = [(i, a, b - a) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    slots = schedule(spark.createDataFrame(rows, "place long, first long, quota long"), 1000).collect()
    assert len({r["slot"] for r in slots}) == 1000
    for i, _, quota in rows:
        mine = sorted((r["slot"], r["rank"]) for r in slots if r["place"] == i)
        assert [r for _, r in mine] == list(range(quota))
    # Every stretch of the schedule holds each source's share, to a few slots.
    order = [r["place"] for r in sorted(slots, key=lambda r: r["slot"])]
    for end in range(50, 1001, 50):
        for i, _, quota in rows:
            assert abs(order[:end].count(i) - quota * end / 1000) < 8


def test_empty_tables_and_other_columns(spark, nothing, documents):
    assert mix(nothing).documents.collect() == [] and mix(nothing).spans.collect() == []
    rows = [(r["doc_id"], r["source"], r["text"]) for r in documents.collect()]
    assert sorted((tuple(r) for r in mix(documents).documents.collect()), key=repr) == brute(rows)
    blank = documents_of(spark, [(1, None), (2, "")])
    assert [r["taken"] for r in mix(blank).documents.collect()] == [0, 0]
