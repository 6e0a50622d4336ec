"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The words that occur most are compiled into an automaton whose equal suffixes
are shared (built from sorted words, each state entered once into a register).
Transitions carry numbers that add up to the place of the word in sorted order,
and that place leads to its ids. The arrays are one file, which every executor
fetches once and its workers map into memory. Words outside the lexicon are
merged exactly, so the lexicon's size changes the speed and never the result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissura.llm.shared import Bounded, blocks, map_blocks, put_file, texts_of
from fissura.llm.word_bpe import WordBpe, word_bpe

LEXICON_WORDS = 65_536
WORD_BYTES = 64  # longer words are not compiled
MEMO = 100_000


def word_counts(df: DataFrame, path: str, flush: int = 200_000) -> DataFrame:
    """``word, n`` over all texts of ``df``; counted in the task before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, counts = word_bpe(path), Counter()
        for batch in batches:
            texts = batch.column(1)
            for begin, end in blocks(texts):
                for text in texts.slice(begin, end - begin).to_pylist():
                    counts.update(bpe.words(text))
                if len(counts) > flush:
                    yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})
                    counts.clear()
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(counts, pa.string()), "n": pa.array(counts.values(), pa.int64())}
        )

    return df.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The transducer and its ids as one file of 32-bit integers."""
    words = sorted((w.encode(), ids) for w, ids in entries.items() if 0 < len(w.encode()) <= WORD_BYTES)
    register: dict[tuple, int] = {}
    sizes: list[int] = []  # words below each registered state
    arcs: list[tuple] = []  # of each registered state: (byte, target)
    finals: list[bool] = []

    def registered(node: list) -> int:
        final, below = node
        key = (final, tuple(below))
        state = register.get(key)
        if state is None:
            state = register[key] = len(arcs)
            arcs.append(key[1])
            finals.append(final)
            sizes.append(final + sum(sizes[t] for _, t in key[1]))
        return state

    path: list[list] = [[False, []]]  # nodes of the last word, not registered yet
    last = b""
    for word, _ in words:
        common = 0
        while common < len(last) and common < len(word) and last[common] == word[common]:
            common += 1
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], registered(node)))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], registered(node)))
    root = registered(path[0])

    keys, targets, numbers = [], [], []
    for state, below in enumerate(arcs):
        before = int(finals[state])
        for byte, target in below:
            keys.append(state << 8 | byte)
            targets.append(target)
            numbers.append(before)
            before += sizes[target]
    ids = [np.asarray(i, np.int32) for _, i in words]
    parts = [
        np.asarray(keys, np.int32), np.asarray(targets, np.int32), np.asarray(numbers, np.int32),
        np.asarray(finals, np.int32), np.cumsum([0, *map(len, ids)]).astype(np.int32),
        np.concatenate([*ids, np.zeros(0, np.int32)]),
    ]
    head = np.asarray([root, *map(len, parts)], np.int32)
    return b"".join(p.tobytes() for p in (head, *parts))


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, data: np.ndarray):
        self.root, *lengths = data[:7].tolist()
        ends = 7 + np.cumsum(lengths)
        parts = [data[b - n : b] for b, n in zip(ends.tolist(), lengths)]
        self.keys, self.targets, self.numbers, self.finals, self.offsets, self.ids = parts

    @classmethod
    def mapped(cls, name: str) -> Lexicon:
        return cls(np.memmap(SparkFiles.get(name), np.int32, "r"))

    def places(self, words: list[str]) -> np.ndarray:
        """Place of each word in the lexicon, -1 where it is not there.

        All words take their next transition together.
        """
        found = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return found
        content = [w.encode() for w in words]
        sizes = np.fromiter(map(len, content), np.int64, len(content))
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] <= WORD_BYTES]
        begin = (np.cumsum(sizes) - sizes)[order]
        left = sizes[order]
        data = np.frombuffer(b"".join(content), np.uint8)
        state = np.full(len(order), self.root, np.int64)
        total = np.zeros(len(order), np.int64)
        at = 0
        while len(order):
            ended = left == at
            if ended.any():
                done = ended & (self.finals[state] > 0)
                found[order[done]] = total[done]
                order, begin, left = order[~ended], begin[~ended], left[~ended]
                state, total = state[~ended], total[~ended]
            key = (state << 8 | data[begin + at]).astype(np.int32)
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            order, begin, left = order[on], begin[on], left[on]
            state, total = self.targets[arc[on]].astype(np.int64), total[on] + self.numbers[arc[on]]
            at += 1
        return found

    def ids_at(self, place: int) -> list[int]:
        return self.ids[self.offsets[place] : self.offsets[place + 1]].tolist()


class Encoder:
    """Texts to ids and back, by a lexicon and exact merges for the rest."""

    def __init__(self, bpe: WordBpe, lexicon: Lexicon):
        self.bpe, self.lexicon = bpe, lexicon
        self.memo = Bounded(self.bpe.merge, MEMO)  # word: (ids as text, tokens as text)

    def learn(self, words: set[str]) -> None:
        """Have the entries of all ``words``."""
        old = self.memo.old
        self.memo.update((w, old[w]) for w in words.difference(self.memo) if w in old)
        new = list(words.difference(self.memo))
        tokens = self.bpe.tokens
        for word, place in zip(new, self.lexicon.places(new).tolist()):
            ids = self.lexicon.ids_at(place) if place >= 0 else self.bpe.merge(word)
            self.memo[word] = " ".join(map(str, ids)), " ".join([tokens[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        words = self.bpe.words(text)
        self.learn(set(words))
        return [int(i) for w in words for i in self.memo[w][0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """As the library: it has no decoder set, so tokens are joined by spaces."""
        return " ".join([self.bpe.tokens[i] for i in ids])

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, digests of the ids and of the decoded text."""
        split = list(map(self.bpe.words, texts))
        self.memo.trim()
        self.learn(set().union(*split))
        out, memo = [], self.memo
        for words in split:
            if not words:
                out.append((0, EMPTY, EMPTY))
                continue
            ids, tokens = zip(*map(memo.__getitem__, words))
            ids = " ".join(ids)
            out.append(
                (
                    ids.count(" ") + 1,
                    hashlib.sha256(ids.encode()).hexdigest(),
                    hashlib.sha256(" ".join(tokens).encode()).hexdigest(),
                )
            )
        return out


EMPTY = hashlib.sha256(b"").hexdigest()


def build_lexicon(df: DataFrame, path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the ``words`` most frequent words of ``df``; the name executors know the file by.

    Counts are over all texts. What reaches the driver is bounded by ``words``.
    """
    counts = word_counts(df, path)
    short = F.octet_length("word").between(1, WORD_BYTES)
    top = counts.filter(short).orderBy(F.desc("n"), "word").limit(words).toArrow().column("word").to_pylist()
    bpe = word_bpe(path)
    return put_file(df.sparkSession, "lexicon", compile_lexicon({w: bpe.merge(w) for w in top}))


def encode_documents(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row.

    A null text counts as empty: no ids, digests of the empty string. Repeated
    rows and null ids are kept as they are; other columns are ignored. An empty
    table gives an empty lexicon and no rows. Two passes over the texts, one
    shuffle of counted words.
    """
    texts = texts_of(df, id_col, text_col)
    name = build_lexicon(texts, path, words)

    def work():
        encoder = Encoder(word_bpe(path), Lexicon.mapped(name))

        def each(ids, texts):
            n, coded, decoded = zip(*encoder.digests(texts))
            return {"doc_id": ids, "n_tokens": n, "ids_sha256": coded, "decoded_sha256": decoded}

        return each

    return map_blocks(texts, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
