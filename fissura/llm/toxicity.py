"""Toxicity of texts by a bidirectional gated recurrent network with attention.

A word enters as the sum of an embedding of its own and of the embeddings of
its character n-grams, so words that were never seen are judged by their parts.
Runs of letters longer than a word, as in scripts without spaces, enter as
overlapping parts, so every n-gram of a text is read.
Two recurrent passes read a segment of words, attention pools the states of a
window in it, and one unit scores the window. All windows of a text count, one
beginning at every word; segments overlap so that each window lies whole in its own. A
segment is read once for all its windows: their sums over states are sliding
sums. The text's score is that of its worst window.

The network is trained in numpy on a bounded sample of labelled documents. Only
documents have labels, so after some epochs on drawn windows it is trained on
the worst window of each document, which is the one that a label is about.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissura.llm.sampling import held_out, labelled_sample
from fissura.llm.shared import add_blocks, texts_of

WORD = re.compile(r"[^\W_]+")
WINDOW, STRIDE = 32, 1
SEGMENT = 64  # words that are read in one go
BEGIN = SEGMENT - WINDOW + 1  # windows that begin in a segment
WORDS, GRAMS = 1 << 14, 1 << 14  # rows of the embedding tables
WIDTH, HIDDEN = 12, 10
CUT = 48  # letters of the longest word; longer runs enter in parts
PART, OVERLAP = 12, 6  # letters of a part, about a word, and those that it shares with the next; n-grams are shorter
CHUNK = 4096  # words whose rows are held at a time
PER_LABEL = 1500  # documents
DRAWN = 10  # windows of a document in the first epochs
EPOCHS, WORST_EPOCHS = 3, 4
STEPS, WORST_STEPS = 24, 8  # batches that the epochs of either kind come to at least, however few documents there are
BATCH = 256
MEMO = 120_000
PAD = 0  # the place of the word that fills windows up


def text_words(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    if max(map(len, words), default=0) <= CUT:
        return words
    return [part for word in words for part in word_parts(word)]


def word_parts(word: str) -> list[str]:
    """The word, or parts of a longer run, the last up to the end."""
    if len(word) <= CUT:
        return [word]
    return [word[a : a + PART] for a in range(0, len(word) - OVERLAP, PART - OVERLAP)]


def word_rows(word: str) -> list[int]:
    """Rows of the embedding table: the word's, then those of its n-grams of 3 to 5 letters."""
    marked = f"<{word}>".encode()
    rows = [zlib.crc32(word.encode()) % WORDS]
    for n in (3, 4, 5):
        rows += [WORDS + zlib.crc32(marked[i : i + n]) % GRAMS for i in range(len(marked) - n + 1)]
    return rows


def windows(n: int) -> list[tuple[int, int]]:
    """All windows of n words: WINDOW long, or the whole of a shorter text."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    return [(a, a + WINDOW) for a in range(n - WINDOW + 1)]


def counted(counts: list[int] | np.ndarray) -> np.ndarray:
    """Windows of texts of so many words."""
    counts = np.asarray(counts, np.int64)
    return np.where(counts > 0, np.maximum(counts - WINDOW + 1, 1), 0)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which text, and which of its parts, for so many parts of each text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def segment_index(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops among all words, the text, and the windows that begin in it, of every segment."""
    counts = np.asarray(counts, np.int64)
    n = counted(counts)
    owner, k = spread(-(-n // BEGIN))
    first = (np.cumsum(counts) - counts)[owner]
    starts = first + k * BEGIN
    stops = np.minimum(starts + SEGMENT, first + counts[owner])
    return starts, stops, owner, np.minimum(n[owner] - k * BEGIN, BEGIN)


def window_index(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops among all words, the text, and the start of the segment, of every window."""
    counts = np.asarray(counts, np.int64)
    owner, w = spread(counted(counts))
    first = (np.cumsum(counts) - counts)[owner]
    starts = first + w
    stops = np.minimum(starts + WINDOW, first + counts[owner])
    return starts, stops, owner, first + w // BEGIN * BEGIN


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward and backward pass. Time runs along the first axis."""

    def __init__(self, parameters: dict[str, np.ndarray] | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = parameters or {
            "E": draw(WORDS + GRAMS, WIDTH, scale=0.1),
            **{f"W{d}": draw(WIDTH, 3 * HIDDEN, scale=0.3) for d in "fb"},
            **{f"U{d}": draw(HIDDEN, 3 * HIDDEN, scale=0.3) for d in "fb"},
            **{f"b{d}": np.zeros(3 * HIDDEN, np.float32) for d in "fb"},
            "A": draw(2 * HIDDEN, HIDDEN, scale=0.3), "a": draw(HIDDEN, scale=0.3),
            "v": draw(2 * HIDDEN, scale=0.3), "c": np.zeros(1, np.float32),
        }

    def embed(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One vector for each word, the scaled sum of its rows."""
        sums = np.add.reduceat(self.p["E"][rows], bounds[:-1], axis=0)
        return sums / np.sqrt(np.diff(bounds))[:, None].astype(np.float32)

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """What a word adds to the gates of both directions."""
        p = self.p
        return np.concatenate([vectors @ p["Wf"] + p["bf"], vectors @ p["Wb"] + p["bb"]], axis=1)

    def run(self, inputs: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction; inputs (time, windows, 3 HIDDEN), mask 0 after the end."""
        steps, n, _ = inputs.shape
        u = self.p[f"U{d}"]
        gate, new = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = inputs[t]
            zr = sigmoid(x[:, : 2 * HIDDEN] + h @ gate)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            back = h @ new
            g = np.tanh(x[:, 2 * HIDDEN :] + r * back)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, back, g, m))
            h = h + m * (1 - z) * (g - h)
            out[t] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray):
        p = self.p
        e = np.tanh(states @ p["A"])
        s = e @ p["a"] - 1e9 * (1 - mask)
        s = np.exp(s - s.max(axis=0))
        weight = s / s.sum(axis=0)
        context = (states * weight[:, :, None]).sum(axis=0)
        return context @ p["v"] + p["c"][0], (e, weight, context)

    def logits(self, table: np.ndarray, places: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Scores of windows; table: gates of each word, places (time, windows), mask: of segments and of windows."""
        x = table[places]
        half, (inside, pooled) = 3 * HIDDEN, mask
        states = [self.run(x[:, :, :half], inside, "f"), self.run(x[:, :, half:], inside, "b")]
        return self.pool(np.concatenate(states, axis=2), pooled)[0]

    def gradients(self, rows, bounds, places, mask, target, weight):
        """Loss and gradients of a batch of windows."""
        p, half = self.p, 3 * HIDDEN
        mask, pooled = mask
        vectors = self.embed(rows, bounds)
        x = self.gates(vectors)[places]
        kept = {d: [] for d in "fb"}
        states = np.concatenate(
            [self.run(x[:, :, :half], mask, "f", kept["f"]), self.run(x[:, :, half:], mask, "b", kept["b"])], axis=2
        )
        logit, (e, share, context) = self.pool(states, pooled)
        y = sigmoid(logit)
        loss = -float((weight * (target * np.log(y + 1e-7) + (1 - target) * np.log(1 - y + 1e-7))).mean())
        d_logit = (weight * (y - target) / len(y)).astype(np.float32)
        g = {"c": d_logit.sum(keepdims=True), "v": d_logit @ context}
        d_context = d_logit[:, None] * p["v"]
        d_states = share[:, :, None] * d_context
        d_share = (states * d_context).sum(axis=2)
        d_s = share * (d_share - (share * d_share).sum(axis=0))
        g["a"] = np.einsum("tn,tnk->k", d_s, e)
        d_e = d_s[:, :, None] * p["a"] * (1 - e * e)
        g["A"] = np.tensordot(states, d_e, ([0, 1], [0, 1]))
        d_states = d_states + d_e @ p["A"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = p[f"U{d}"]
            g[f"U{d}"] = np.zeros_like(u)
            d_h = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, z, r, back, new, m in reversed(kept[d]):
                d_h = d_h + d_states[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                step = d_h * m
                d_new = step * (1 - z) * (1 - new * new)
                d_z = step * (h - new) * z * (1 - z)
                d_r = d_new * back * r * (1 - r)
                d_gate = np.concatenate([d_z, d_r, d_new], axis=1)
                d_x[t, :, k * half : (k + 1) * half] = d_gate
                inner = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[f"U{d}"] += h.T @ inner
                d_h = d_h - step * (1 - z) + inner @ u.T
        flat = d_x.reshape(-1, 2 * half)
        per_word = np.zeros((len(vectors), 2 * half), np.float32)
        np.add.at(per_word, places.ravel(), flat)
        d_vectors = per_word[:, :half] @ p["Wf"].T + per_word[:, half:] @ p["Wb"].T
        for k, d in enumerate("fb"):
            mine = per_word[:, k * half : (k + 1) * half]
            g[f"W{d}"], g[f"b{d}"] = vectors.T @ mine, mine.sum(axis=0)
        sizes = np.diff(bounds)
        spread = np.repeat(d_vectors / np.sqrt(sizes)[:, None].astype(np.float32), sizes, axis=0)
        g["E"] = (rows, spread)
        return loss, g


class Reader:
    """The same scores as ``Network.logits``, laid out for speed.

    Gates are separate contiguous arrays, one row a window. Both functions are
    written with one exponential, whose sign or factor is put into the weights:
    1 - z = 1 / (1 + exp(x)), r = 1 / (1 + exp(-x)), g = 1 - 2 / (1 + exp(2 x)).
    """

    def __init__(self, network: Network):
        p = self.p = network.p
        scale = np.repeat(np.array([1.0, -1.0, 2.0], np.float32), HIDDEN)
        self.inputs = [(p[f"W{d}"] * scale, p[f"b{d}"] * scale) for d in "fb"]
        self.inner = [
            [np.ascontiguousarray(part) for part in np.split(p[f"U{d}"] * scale, 3, axis=1)] for d in "fb"
        ]
        self.split = [(p["A"][:HIDDEN], p["v"][:HIDDEN]), (p["A"][HIDDEN:], p["v"][HIDDEN:])]

    def gates(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Of each word, what it adds to the three gates of either direction: six tables."""
        return [
            np.ascontiguousarray(part, np.float32)
            for w, b in self.inputs
            for part in np.split(vectors @ w + b, 3, axis=1)
        ]

    def states(self, tables: list[np.ndarray], places: np.ndarray, mask: np.ndarray, d: int) -> np.ndarray:
        steps, n = places.shape
        out = np.empty((steps, n, HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        gate = np.empty((2, n, HIDDEN), np.float32)  # 1 - z and r
        add, back, g = (np.empty((n, HIDDEN), np.float32) for _ in range(3))
        to_z, to_r, to_g = self.inner[d]
        z_in, r_in, g_in = tables[3 * d : 3 * d + 3]
        whole = mask.all(axis=1)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            at = places[t]
            for k, (table, inner) in enumerate(((z_in, to_z), (r_in, to_r))):
                np.take(table, at, axis=0, out=gate[k], mode="clip")
                gate[k] += np.matmul(h, inner, out=add)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            np.matmul(h, to_g, out=back)
            back *= gate[1]
            np.take(g_in, at, axis=0, out=g, mode="clip")
            g += back
            np.exp(g, out=g)
            g += 1
            np.divide(-2, g, out=g)
            g += 1
            g -= h
            g *= gate[0]
            if not whole[t]:
                g *= mask[t][:, None]
            h += g
            out[t] = h
        return out

    def logits(self, tables: list[np.ndarray], places: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of the window that begins at each of the first BEGIN words of every segment."""
        e, worth = 0.0, 0.0
        with np.errstate(over="ignore"):  # of the exponential: the quotient is 0 then
            for d, (attend, value) in enumerate(self.split):
                states = self.states(tables, places, mask, d).reshape(-1, HIDDEN)
                e = e + states @ attend
                worth = worth + states @ value
            e = 1 - 2 / (1 + np.exp(2 * e))
        s, worth = (e @ self.p["a"]).reshape(mask.shape), worth.reshape(mask.shape)
        s = np.where(mask > 0, s.astype(np.float64), -np.inf)
        share = np.zeros((SEGMENT, mask.shape[1]))
        share[: len(s)] = np.exp(s - s.max(axis=0))
        value = share.copy()
        value[: len(s)] *= worth
        with np.errstate(invalid="ignore"):  # windows that do not exist
            return slid(value) / slid(share) + self.p["c"][0]

    def best(self, tables: list[np.ndarray], places: np.ndarray, index, every: bool = False) -> np.ndarray:
        """The highest logit of each segment, or all that there are, segment by segment."""
        starts, stops, _, n = index
        lengths = stops - starts
        out = np.full((len(starts), BEGIN), -np.inf)
        order = np.argsort(-lengths, kind="stable")  # like lengths together: shorter ones take fewer steps
        for a in range(0, len(order), 1024):
            some = order[a : a + 1024]
            filled = fill(places, starts[some], stops[some], int(lengths[some[0]]))
            out[some] = self.logits(tables, *filled).T
        there = np.arange(BEGIN) < n[:, None]
        return out[there] if every else np.where(there, out, -np.inf).max(axis=1, initial=-np.inf)


def slid(x: np.ndarray) -> np.ndarray:
    """Sums over WINDOW rows from each of the first BEGIN rows on, by doubling; nothing is taken off again."""
    far = 1
    while far < WINDOW:
        x = x[: len(x) - far] + x[far:]
        far *= 2
    return x[:BEGIN]


class Trainer:
    """Adam; of the embedding table only the rows of the batch move."""

    def __init__(self, network: Network, rate: float = 0.01):
        self.n, self.rate, self.step = network, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in network.p.items()}

    def apply(self, g: dict) -> None:
        self.step += 1
        for k, grad in g.items():
            if k == "E":
                rows, inverse = np.unique(grad[0], return_inverse=True)
                total = np.zeros((len(rows), WIDTH), np.float32)
                np.add.at(total, inverse, grad[1])
                grad = total
            else:
                rows = slice(None)
            m = self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * grad
            s = self.s[k][rows] = 0.99 * self.s[k][rows] + 0.01 * grad * grad
            scale = np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
            self.n.p[k][rows] -= self.rate * scale * m / (np.sqrt(s) + 1e-7)


class Corpus:
    """Labelled texts as places of words."""

    def __init__(self, texts: list[str]):
        self.words: dict[str, int] = {"": PAD}
        self.counts, places = [], []
        for text in texts:
            found = text_words(text)
            self.counts.append(len(found))
            places += [self.words.setdefault(w, len(self.words)) for w in found]
        self.places = np.array(places, np.int64)
        self.starts, self.stops, self.owner, self.segment = window_index(self.counts)
        self.ends = np.cumsum(self.counts)[self.owner] if len(self.owner) else self.owner
        parts = [np.array(word_rows(w), np.int32) for w in self.words]
        self.sizes = np.array([len(r) for r in parts])
        self.rows = np.concatenate(parts)
        self.first = np.cumsum(self.sizes) - self.sizes

    def batch(self, chosen: np.ndarray):
        """Rows, bounds and places of the chosen windows' segments, the mask of these and of the windows."""
        begin = self.segment[chosen]
        places, inside = fill(self.places, begin, np.minimum(begin + SEGMENT, self.ends[chosen]))
        at = begin + np.arange(SEGMENT)[:, None]
        pooled = ((at >= self.starts[chosen]) & (at < self.stops[chosen])).astype(np.float32)
        mask = np.stack([inside, pooled])
        used, inverse = np.unique(places, return_inverse=True)
        sizes = self.sizes[used]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes) + np.repeat(self.first[used], sizes)
        return self.rows[at], bounds, inverse.reshape(places.shape), mask

    def scores(self, network: Network) -> np.ndarray:
        """Of every window."""
        reader = Reader(network)
        bounds = np.append(self.first, len(self.rows))
        vectors = [
            network.embed(self.rows[b[0] : b[-1]], b - b[0])
            for b in (bounds[a : a + CHUNK + 1] for a in range(0, len(self.first), CHUNK))
        ]
        tables = reader.gates(np.concatenate(vectors))
        return reader.best(tables, self.places, segment_index(self.counts), every=True)


def fill(
    places: np.ndarray, starts: np.ndarray, stops: np.ndarray, steps: int = SEGMENT
) -> tuple[np.ndarray, np.ndarray]:
    """Words (time, segments) and 1.0 where there is one; PAD where there is none."""
    at = starts + np.arange(steps)[:, None]
    inside = at < stops
    return np.where(inside, places[np.minimum(at, len(places) - 1)], PAD), inside.astype(np.float32)


def worst(scores: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The window of the highest score of each text; texts without windows have none."""
    order = np.lexsort((scores, owner))
    last = np.flatnonzero(np.append(owner[order][1:] != owner[order][:-1], True))
    return order[last]


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[Network, float]:
    """The network, and what to take from a text's worst logit so that 0 parts the labels.

    Infinity where texts with words have fewer than two labels: nothing is learned.
    """
    network, corpus = Network(seed=seed), Corpus(texts)
    target = np.asarray(labels, np.float32)
    if len(np.unique(target[corpus.owner])) < 2:
        return network, np.inf
    rng, trainer = np.random.default_rng(seed), Trainer(network)
    share = target.mean()
    weight = np.where(target > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)

    def epoch(chosen: np.ndarray) -> None:
        chosen = rng.permutation(chosen)
        for a in range(0, len(chosen), BATCH):
            part = chosen[a : a + BATCH]
            doc = corpus.owner[part]
            trainer.apply(network.gradients(*corpus.batch(part), target[doc], weight[doc])[1])

    done = 0
    while done < EPOCHS or trainer.step < STEPS:
        done += 1
        mixed = rng.permutation(len(corpus.starts))
        order = mixed[np.argsort(corpus.owner[mixed], kind="stable")]
        owner = corpus.owner[order]
        within = np.arange(len(order)) - np.searchsorted(owner, owner)
        epoch(order[within < DRAWN])
    trainer.rate /= 2
    done, before = 0, trainer.step
    while done < WORST_EPOCHS or trainer.step - before < WORST_STEPS:
        done += 1
        epoch(worst(corpus.scores(network), corpus.owner, len(texts)))
    scores = corpus.scores(network)
    top = worst(scores, corpus.owner, len(texts))
    return network, _threshold(scores[top], target[corpus.owner[top]] > 0)


def _threshold(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap among the cuts of the best balanced accuracy."""
    order = np.argsort(scores, kind="stable")
    scores, toxic = scores[order], toxic[order]
    missed = np.concatenate([[0], np.cumsum(toxic)]) / max(1, toxic.sum())
    kept = np.concatenate([[0], np.cumsum(~toxic)]) / max(1, (~toxic).sum())
    good = kept - missed
    edges = np.concatenate([[scores[0] - 2], scores, [scores[-1] + 2]])
    best = np.flatnonzero(good >= good.max() - 1e-9)
    k = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[k] + edges[k + 1]) / 2)


class Scorer:
    """Scores texts; remembers the gates of words, up to a bound."""

    def __init__(self, network: Network, threshold: float):
        self.n, self.reader, self.threshold = network, Reader(network), threshold
        self.forget()

    def forget(self) -> None:
        self.place = {"": PAD}
        self.tables = self.reader.gates(self.vectors([""]))

    def vectors(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), WIDTH), np.float32)
        for a in range(0, len(words), CHUNK):
            parts = list(map(word_rows, words[a : a + CHUNK]))
            bounds = np.concatenate([[0], np.cumsum(list(map(len, parts)))])
            out[a : a + CHUNK] = self.n.embed(np.array([i for r in parts for i in r], np.int64), bounds)
        return out

    def scores(self, texts: list[str]) -> list[float]:
        if np.isinf(self.threshold):
            return [0.0] * len(texts)
        if len(self.place) > MEMO:
            self.forget()
        split = list(map(text_words, texts))
        new = list(set().union(*split).difference(self.place))
        if new:
            self.place |= {w: len(self.place) + k for k, w in enumerate(new)}
            more = self.reader.gates(self.vectors(new))
            self.tables = [np.concatenate(pair) for pair in zip(self.tables, more)]
        counts = list(map(len, split))
        places = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, sum(counts))
        index = segment_index(counts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, index[2], self.reader.best(self.tables, places, index))
        return np.where(np.isinf(out), 0.0, sigmoid(out - self.threshold)).tolist()


def score_toxicity(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: int = PER_LABEL,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``df``.

    Learns from about ``per_label`` documents of each label (all, where there
    are fewer) outside fold 0 that ``labels`` marks 0 or 1; other labels and null
    ids or texts are not learned from. Every whole text is scored from the text
    alone, all its windows. A null text, or one without words, scores 0.0, and
    so does every text where documents of fewer than two labels can be learned from.
    Repeated rows are kept; of the other columns only those in ``carry`` come along.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    chosen = labelled_sample(marked.filter("label in (0, 1)"), "doc_id", "label", per_label)
    # The sample's size is bounded by ``per_label``, so it is sent to where the texts are.
    sample = rows.join(F.broadcast(chosen), "doc_id").filter("text is not null").select("doc_id", "text", "label")
    found = sorted(sample.distinct().collect())
    network, threshold = train([r["text"] for r in found], [r["label"] for r in found])
    shared = df.sparkSession.sparkContext.broadcast((network.p, threshold))

    def work():
        parameters, cut = shared.value
        scorer = Scorer(Network(parameters), cut)

        def each(ids, texts):
            return {"doc_id": ids, "score": scorer.scores(texts)}

        return each

    scored = add_blocks(texts_of(df, id_col, text_col, carry), work, "doc_id long, score double")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted, *carry)
