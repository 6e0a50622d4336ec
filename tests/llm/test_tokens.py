"""Token counts, encoding and packing against the tokenizers library."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fissura.llm import lexicon, packing
from fissura.llm.token_counts import (
    N_CLASSES,
    START,
    STEP,
    TokenCounter,
    chunk_states,
    count_tokens,
)
from fissura.llm.word_bpe import WordBpe
from tests.llm.conftest import TEXTS

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LETTERS = " \n\t''stmdrvleabXYZ019.,!éß日ΣİƐ\u0307ẋ² \u200b\u0085\u3000٣"


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    some = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    fixed = ["'re're 'r'x ''s 's", "a" * 900, " " * 300 + "x", "\n" * 70, "<|endoftext|>a <|startoftext|><|endoftext|>", "\0\x01"]
    return some + fixed + ["".join(rng.choice("abn") for _ in range(90)) for _ in range(20)]


def test_counts_equal_the_library():
    texts, library = odd_texts(4000), Tokenizer.from_file(BYTES)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert TokenCounter(BYTES).counts(texts).tolist() == want


def test_counts_survive_a_full_automaton():
    counter = TokenCounter(BYTES)
    counter.pieces.bound, counter.memo.bound = 50, 10
    texts, library = odd_texts(300, 6), Tokenizer.from_file(BYTES)
    got = [n for a in range(0, len(texts), 20) for n in counter.counts(texts[a : a + 20]).tolist()]
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_pieces_are_walked():
    rng = random.Random(8)
    run = lambda n, letters="abcdefghijklmnopqrstuvwxyz": "".join(rng.choices(letters, k=n))
    texts = [run(20_000) + " and " + run(600), "x" * 3000, "ab" * 3000, "日本" * 900, "é" * 700, "-" * 5000, run(511), run(513, "aeé")]
    want = [len(e.ids) for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]
    counter = TokenCounter(BYTES)
    assert counter.counts(texts).tolist() == want
    assert len(counter.pieces.configs) < 5000  # long runs leave no states behind


def test_scan_of_chunk_maps_equals_one_walk():
    classes = np.random.default_rng(1).integers(0, N_CLASSES, (37, 128)).astype(np.uint8)
    state, want = START, []
    for row in classes:
        want.append(state)
        for c in row:
            state = STEP[state * N_CLASSES + c]
    assert chunk_states(classes).tolist() == want


def test_count_tokens_rows(documents, nothing):
    library = Tokenizer.from_file(BYTES)
    want = sorted(
        (-1 if d is None else d, len((t or "").encode()), n := len(library.encode(t or "").ids), n > 1024)
        for d, t in TEXTS
    )
    got = count_tokens(documents, BYTES).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want
    assert any(r["over_limit"] for r in got)
    assert count_tokens(nothing, BYTES).collect() == []


def test_words_and_merges_equal_the_library():
    bpe, library = WordBpe(WORDS), Tokenizer.from_file(WORDS)
    texts = odd_texts(3000, 7)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        words = bpe.words(text)
        assert [i for w in words for i in bpe.merge(w)] == want.ids, text
        assert [i for w in words for i in bpe.library_ids(w)] == want.ids, text


def test_lexicon_shares_suffixes_and_finds_all():
    words = [a + b for a in ("", "x", "yy", "zab") for b in ("tion", "ing", "er", "é")] + ["z", "a" * 70]
    built = lexicon.compile_lexicon({w: [i, i + 1] for i, w in enumerate(words)})
    lex = lexicon.Lexicon(np.frombuffer(built, np.int32))
    asked = [*words, "tio", "", "q", "ti" * 60]
    places = lex.places(asked).tolist()
    for i, w in enumerate(words[:-1]):
        assert lex.ids_at(places[i]) == [i, i + 1], w
    assert places[len(words) - 1 :] == [-1] * 5
    letters = sum(len(w.encode()) for w in words[:-1])
    assert len(lex.keys) < letters / 2
    assert lexicon.Lexicon(np.frombuffer(lexicon.compile_lexicon({}), np.int32)).places(["a"]).tolist() == [-1]


@pytest.mark.parametrize("size", [0, 5, 1000])
def test_encode_documents(documents, nothing, size):
    library = Tokenizer.from_file(WORDS)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d or -1, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [(r[0] or -1, *r[1:]) for r in lexicon.encode_documents(documents, WORDS, words=size).collect()]
    assert sorted(got) == sorted(want)
    if not size:
        assert lexicon.encode_documents(nothing, WORDS).collect() == []


def test_round_trip():
    bpe = WordBpe(WORDS)
    encoder = lexicon.Encoder(bpe, lexicon.Lexicon(np.frombuffer(lexicon.compile_lexicon({}), np.int32)))
    ids = encoder.encode("Some words, <|endoftext|> again")
    back = encoder.decode(ids).replace(" ", "").replace("</w>", " ").replace("<|endoftext|>", "<|endoftext|> ")
    assert encoder.encode(back) == ids


def test_packing(documents, nothing):
    library, size = Tokenizer.from_file(WORDS), 64
    rows = packing.pack_documents(documents, WORDS, size).collect()
    want = []
    for d, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want.append((d or -1, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((r["doc_id"] or -1, *r[1:5]) for r in rows) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(sequences) <= -(-sum(w[3] for w in want) // size) + 1
    assert packing.pack_documents(nothing, WORDS, size).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.gamma(1 + seed, 150, 3000).astype(int) + 1, 2048)
    histogram = dict(zip(*(v.tolist() for v in np.unique(lengths, return_counts=True))))
    plan = packing.plan_patterns(histogram, 2048)
    used = defaultdict(int)
    for pattern, n in plan:
        assert sum(pattern) <= 2048 and n > 0
        for v in pattern:
            used[v] += n
    assert used == histogram
    assert sum(n for _, n in plan) <= 1.02 * lengths.sum() / 2048 + 1


def test_fit_counts_is_the_least_squares_fit():
    patterns, want = [(4,), (3, 1), (2, 2), (2, 1, 1)], np.array([3.0, 2.0, 0.0, 5.0])
    b = np.zeros(5)
    for p, x in zip(patterns, want):
        for v in p:
            b[v] += x
    assert np.allclose(packing.fit_counts(patterns, b), want, atol=1e-6)
