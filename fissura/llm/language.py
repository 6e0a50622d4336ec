"""Language identification by unigram pieces, all segmentations counted.

The pieces are a fixed public vocabulary. Each language has a probability for
each piece, fitted by expectation maximisation to the word counts of a sample
of labelled documents. The likelihood of a word is the sum over all ways to
cut it into pieces, which a forward pass gives for all languages and many words
at once; a text's is the product over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissura.llm.sampling import held_out, labelled_sample
from fissura.llm.shared import add_blocks, blocks, texts_of

WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"  # begins a word, as in the vocabulary
CUT = 40  # letters; a longer run is scored in parts
LONGEST_PIECE = 16
UNKNOWN = 1e-6  # of a letter that is no piece, in any language
PER_LANGUAGE = 400  # documents a language is learned from
ROUNDS = 4
MEMO = 200_000


def public_pieces(path: str) -> list[str]:
    """The lower-case letter pieces of a sentencepiece model, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    good = (p for p in pieces if len(p) <= LONGEST_PIECE and (p == MARK or p.removeprefix(MARK).isalpha()))
    return list(dict.fromkeys(good))


class Pieces:
    """A trie of pieces that many words walk together."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        alphabet = sorted(set("".join(pieces)))
        self.code = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        arcs, ends = {}, {}
        for number, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = arcs.setdefault(node * self.width + int(self.code[ord(c)]), len(arcs) + 1)
            ends[node] = number
        self.keys = np.array(sorted(arcs), np.int64)
        self.targets = np.array([arcs[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.full(len(arcs) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes (words x letters, -1 after the end) of marked words, and their lengths."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        joined = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le"), np.uint32)
        out = np.full((len(words), int(sizes.max(initial=1))), -1, np.int32)
        out[np.arange(out.shape[1]) < sizes[:, None]] = self.code[joined]
        return out, sizes

    def edges(self, codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, piece) of every piece in the words, by position; -1: the unknown letter."""
        for at in range(codes.shape[1]):
            words = np.flatnonzero(sizes > at)
            node = np.zeros(len(words), np.int64)
            for to in range(at + 1, min(at + LONGEST_PIECE, codes.shape[1]) + 1):
                letter = codes[words, to - 1]
                key = node * self.width + letter
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                on = (self.keys[arc] == key) & (letter > 0)
                target = np.where(on, self.targets[arc], 0)
                piece = np.where(on, self.ends[target], -1)
                if to == at + 1:
                    yield at, to, words, piece
                elif (piece >= 0).any():
                    yield at, to, words[piece >= 0], piece[piece >= 0]
                words, node = words[on], target[on]
                if not len(words):
                    break


def forward(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Likelihood of each word in each language; ``table`` has UNKNOWN as its last row."""
    codes, sizes = pieces.letters(words)
    alpha = np.zeros((codes.shape[1] + 1, len(words), table.shape[1]))
    alpha[0] = 1.0
    for at, to, rows, piece in pieces.edges(codes, sizes):
        alpha[to, rows] += alpha[at, rows] * table[piece]
    return alpha[sizes, np.arange(len(words))]


def expected(pieces: Pieces, table: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """How often each piece is used in each language, over all segmentations."""
    codes, sizes = pieces.letters(words)
    steps = list(pieces.edges(codes, sizes))
    alpha = np.zeros((codes.shape[1] + 1, len(words), table.shape[1]))
    beta = np.zeros_like(alpha)
    alpha[0] = 1.0
    beta[sizes, np.arange(len(words))] = 1.0
    for at, to, rows, piece in steps:
        alpha[to, rows] += alpha[at, rows] * table[piece]
    for at, to, rows, piece in sorted(steps, key=lambda s: -s[0]):
        beta[at, rows] += beta[to, rows] * table[piece]
    weight = counts / alpha[sizes, np.arange(len(words))]
    out = np.zeros_like(table)
    for at, to, rows, piece in steps:
        np.add.at(out, piece, alpha[at, rows] * table[piece] * beta[to, rows] * weight[rows])
    out[-1] = 0
    return out


def by_length(words: list[str], most: int = 8192) -> Iterator[np.ndarray]:
    """Indices of words in groups of similar length."""
    order = np.argsort([len(w) for w in words], kind="stable")
    for a in range(0, len(order), most):
        yield order[a : a + most]


class LanguageModel:
    """Piece probabilities of some languages."""

    def __init__(self, vocabulary: list[str], languages: list[str], table: np.ndarray | None = None):
        self.vocabulary, self.languages = vocabulary, languages
        self.pieces = Pieces(vocabulary)
        k = len(languages)
        self.table = table if table is not None else np.full((len(vocabulary) + 1, k), 1 / max(1, len(vocabulary)))
        self.table[-1] = UNKNOWN

    def fit(self, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> LanguageModel:
        """Raise the likelihood of ``counts`` (words x languages), step by step."""
        for _ in range(rounds):
            used = np.zeros_like(self.table)
            for part in by_length(words):
                used += expected(self.pieces, self.table, [words[i] for i in part], counts[part])
            used = used[:-1] + 0.05
            self.table[:-1] = used / used.sum(axis=0)
        return self

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)))
        for part in by_length(words):
            out[part] = np.log(np.maximum(forward(self.pieces, self.table, [words[i] for i in part]), 1e-300))
        return out


def text_words(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    if any(len(w) > CUT for w in words):
        words = [w[a : a + CUT] for w in words for a in range(0, len(w), CUT)]
    return words


class Scorer:
    """Texts to (language, posterior)."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        if len(self.place) > MEMO:
            self.place.clear()
            self.rows = self.rows[:0]
        new = list(words.difference(self.place))
        if new:
            self.place |= {w: len(self.rows) + k for k, w in enumerate(new)}
            self.rows = np.concatenate([self.rows, self.model.log_likelihoods(new)])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        split = list(map(text_words, texts))
        self.learn(set().union(*split))
        names, scores = [], []
        for text, words in zip(texts, split):
            letters = any(map(str.isalpha, words)) or any(map(str.isalpha, text))
            if not letters or not self.model.languages:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(np.argmax(odds))
            names.append(self.model.languages[best])
            scores.append(float(1.0 / odds.sum()))
        return names, scores


def sample_counts(sample: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Words, languages and counts of the sampled documents; counted before they are collected."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in blocks(batch.column(1)):
                counts: dict[str, Counter] = {}
                part = batch.slice(begin, end - begin)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    counts.setdefault(lang, Counter()).update(text_words(text))
                rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
                yield pa.RecordBatch.from_pydict(
                    dict(zip(("lang", "word", "n"), zip(*rows))) if rows else {"lang": [], "word": [], "n": []},
                    schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]),
                )

    counted = sample.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = counted.toArrow().to_pydict()
    languages, words = sorted(set(rows["lang"])), sorted(set(rows["word"]))
    at = {w: i for i, w in enumerate(words)}
    counts = np.zeros((len(words), len(languages)))
    counts[[at[w] for w in rows["word"]], [languages.index(lang) for lang in rows["lang"]]] = rows["n"]
    return languages, words, counts


def train(df: DataFrame, path: str, id_col: str, text_col: str, lang_col: str, per_language: int) -> LanguageModel:
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = labelled_sample(rows.filter("text is not null"), "doc_id", "lang", per_language)
    languages, words, counts = sample_counts(sample.select("lang", "text"))
    model = LanguageModel(public_pieces(path), languages)
    return model.fit(words, counts) if words else model


def identify(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    Learns from about ``per_language`` documents of each language (of all, where
    there are fewer) outside fold 0; predicts every whole text from the text
    alone. A null text, or one without a letter, is ``und`` with score 0, and so
    is every text where no document has a language. Ties go to the language
    first in order. Repeated rows and null ids are kept, null ids never learned
    from; of the other columns only those in ``carry`` come along. No shuffle of
    texts.
    """
    model = train(df, path, id_col, text_col, lang_col, per_language)
    spark = df.sparkSession
    parts = spark.sparkContext.broadcast((model.vocabulary, model.languages, model.table))

    def work():
        scorer = Scorer(LanguageModel(*parts.value))

        def each(ids, texts):
            names, scores = scorer.predict(texts)
            return {"doc_id": ids, "lang_pred": names, "score": scores}

        return each

    texts = texts_of(df, id_col, text_col, carry)
    found = add_blocks(texts, work, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", *carry)
