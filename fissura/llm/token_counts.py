"""Token counts of byte-level BPE by finite-state transducers.

Two deterministic transducers in a row. The *splitter* has twelve states over
twelve character classes; its transitions say where a piece begins. It runs
over whole blocks of text at once: every chunk of characters is a map from
states to states, a parallel prefix scan composes the maps, and one pass from
the states so found marks the pieces. The *piece transducer* reads the bytes
of a piece; each transition carries the change in the number of tokens. Its
states are built when first reached and dropped when there are too many.

Why a finite state suffices: the encoding of a prefix ends in exactly one token
``t``, and without ``t`` it is the encoding of the shorter prefix, so ``t`` is
the one token that ends there and is *compatible* with the last token before
it, which means that the two encode to themselves. What later bytes can need
of the past is the last token at those positions from which the bytes read so
far may still grow into a token. That is the state.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissura.llm.charclass import LETTER, NUMBER, OTHER, SPACE, CharClasses
from fissura.llm.shared import Bounded, map_blocks, texts_of

# Character classes of the splitter.
END, SP, WS, NUM, OTH, APO, LET, ONE, C_R, C_V, C_L, C_E = range(12)
# Its states; a state says what the open piece is.
START, IN_LET, IN_NUM, IN_OTH, AT_APO, APO_R, APO_V, APO_L, SP1, SPN, WS1, WSN = range(12)
N_STATES = N_CLASSES = 12
HERE, BEFORE = 1, 2  # a piece begins at this character, at the one before

CHUNK = 128
PIECE_CHARS = 48  # longer pieces are not remembered
MEMO, STATES = 150_000, 400_000


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission for state * N_CLASSES + class."""
    letters = (LET, ONE, C_R, C_V, C_L, C_E)
    fresh = {END: START, SP: SP1, WS: WS1, NUM: IN_NUM, OTH: IN_OTH, APO: AT_APO}
    fresh |= dict.fromkeys(letters, IN_LET)
    joined = {NUM: IN_NUM, OTH: IN_OTH, APO: IN_OTH} | dict.fromkeys(letters, IN_LET)
    step = np.zeros((N_STATES, N_CLASSES), np.uint8)
    emit = np.zeros((N_STATES, N_CLASSES), np.uint8)
    for c in range(N_CLASSES):
        for state in range(N_STATES):
            to, out = fresh[c], HERE
            if state == IN_LET and c in letters:
                to, out = IN_LET, 0
            elif state == IN_NUM and c == NUM:
                to, out = IN_NUM, 0
            elif state in (IN_OTH, AT_APO) and c in (OTH, APO):
                to, out = IN_OTH, 0
            elif state == AT_APO and c == ONE:
                to, out = START, 0
            elif state == AT_APO and c in (C_R, C_V, C_L):
                to, out = {C_R: APO_R, C_V: APO_V, C_L: APO_L}[c], 0
            elif state in (APO_R, APO_V, APO_L):
                if c == (C_L if state == APO_L else C_E):
                    to, out = START, 0
                elif c in letters:
                    to, out = IN_LET, BEFORE
                else:
                    out = HERE | BEFORE
            elif state in (SP1, SPN, WS1, WSN) and c != END:
                if c in (SP, WS):
                    to, out = (SPN if c == SP else WSN), 0
                elif state in (SP1, SPN):
                    to, out = joined[c], (BEFORE if state == SPN else 0)
                else:
                    out = HERE | (BEFORE if state == WSN else 0)
            step[state, c], emit[state, c] = to, out
    return step.ravel(), emit.ravel()


STEP, EMIT = splitter_tables()
#: Two characters at once: class pair to the map of all states.
PAIR = np.stack(
    [
        STEP[STEP[np.arange(N_STATES) * N_CLASSES + a] * N_CLASSES + b]
        for a in range(N_CLASSES)
        for b in range(N_CLASSES)
    ],
    axis=1,
).ravel()  # state * 144 + pair


def chunk_states(classes: np.ndarray) -> np.ndarray:
    """State before each chunk of ``CHUNK`` characters, rows of ``classes``.

    The chunks' maps are composed by doubling: after the k-th step a map covers
    2**k chunks. The first chunk begins in START.
    """
    k = len(classes)
    pairs = classes[:, 0::2].astype(np.int32) * N_CLASSES + classes[:, 1::2]
    pairs = np.ascontiguousarray(pairs.T)
    maps = np.broadcast_to(np.arange(N_STATES, dtype=np.int32)[:, None], (N_STATES, k))
    for column in pairs:
        maps = PAIR[maps * (N_CLASSES * N_CLASSES) + column]
        maps = maps.astype(np.int32)
    far = 1
    while far < k:
        after = maps.copy()
        after[:, far:] = np.take_along_axis(maps[:, far:], maps[:, :-far], axis=0)
        maps, far = after, far * 2
    return np.concatenate([[START], maps[START, :-1]])


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Positions where pieces begin, END characters among them."""
    n = len(classes)
    padded = np.full(-(-n // CHUNK) * CHUNK, END, np.uint8)
    padded[:n] = classes
    padded = padded.reshape(-1, CHUNK)
    states = chunk_states(padded).astype(np.int32)
    columns = np.ascontiguousarray(padded.T)
    emitted = np.empty_like(columns)
    for t, column in enumerate(columns):
        at = states * N_CLASSES + column
        emitted[t] = EMIT[at]
        states = STEP[at].astype(np.int32)
    flat = np.ascontiguousarray(emitted.T).ravel()
    begins = (flat & HERE).astype(bool)
    begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return np.flatnonzero(begins[:n])


class BytePairs:
    """The merges of a byte-level vocabulary, over ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = {ch: b for b, ch in byte_letters().items()}
        self.bytes = {i: bytes(to_byte[c] for c in s) for s, i in model["vocab"].items()}
        self.ids = {b: i for i, b in self.bytes.items()}
        vocab = model["vocab"]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]

    def encode(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        while len(ids) > 1:
            best = min(
                (m[0], i) for i in range(len(ids) - 1)
                if (m := self.merges.get((ids[i], ids[i + 1]), NEVER))
            )
            if best[0] == NEVER[0]:
                break
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids


NEVER = (1 << 60, -1)
LONG_PIECE = 512  # bytes; longer pieces are walked one by one
GROUP_BYTES = 1 << 18  # of pieces that are counted together, and so of new states in between two looks at the bound


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceTransducer:
    """Bytes of a piece to its number of tokens; states are built on demand."""

    def __init__(self, pairs: BytePairs, bound: int = STATES):
        self.pairs, self.bound = pairs, bound
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for token, content in pairs.bytes.items():
            node = 0
            for b in content:
                at = self.children[node].get(b)
                if at is None:
                    at = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = at
            self.token[node] = token
        self.fits: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        # A state: for each live start, (trie node, last token there, tokens there less tokens now).
        self.configs = [((0, -1, 0),)]
        self.number = {self.configs[0]: 0}
        self.column = np.full(256, -1, np.int32)  # of a byte, once it has occurred
        self.columns = 0
        self.arcs = np.full((1 << 12, 64), -1, np.int32)  # next state * 512 + 256 + emitted tokens

    def compatible(self, last: int, token: int) -> bool:
        """The two encode to themselves; last -1 is the piece's start."""
        got = self.fits.get((last, token))
        if got is None:
            if len(self.fits) > 4 * self.bound:
                self.fits.clear()
            if (last, token) in self.pairs.merges:
                got = self.fits[last, token] = False
                return got
            pair = [token] if last < 0 else [last, token]
            content = b"".join(map(self.pairs.bytes.__getitem__, pair))
            got = self.fits[last, token] = self.pairs.encode(content) == pair
        return got

    def build(self, state: int, byte: int) -> None:
        """Add the transition of ``state`` on ``byte``."""
        kept, found = [], None
        for node, last, tokens in self.configs[state]:
            below = self.children[node].get(byte)
            if below is None:
                continue
            token = self.token[below]
            if found is None and token >= 0 and self.compatible(last, token):
                found = token, tokens + 1
            kept.append((below, last, tokens))
        token, delta = found
        config = tuple((n, last, k - delta) for n, last, k in kept if self.children[n])
        config += ((0, token, 0),)
        to = self.number.get(config)
        if to is None:
            to = self.number[config] = len(self.configs)
            self.configs.append(config)
            if to >= len(self.arcs):
                self.arcs = np.concatenate([self.arcs, np.full_like(self.arcs, -1)])
        self.arcs[state, self.column[byte]] = to << 9 | delta + 256

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece. Long ones, whose states hardly ever come again, leave none behind."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.empty(len(pieces), np.int64)
        for i in np.flatnonzero(sizes > LONG_PIECE).tolist():
            out[i] = self.walk(pieces[i])
        short = np.flatnonzero(sizes <= LONG_PIECE)
        group = np.cumsum(sizes[short]) // GROUP_BYTES
        for some in np.split(short, np.flatnonzero(np.diff(group)) + 1):
            if len(some):
                out[some] = self.together([pieces[i] for i in some.tolist()])
        return out

    def walk(self, piece: bytes) -> int:
        """Tokens of one piece, over configurations that are not numbered."""
        live, count = [(0, -1, 0)], 0
        children, tokens = self.children, self.token
        for byte in piece:
            kept, found = [], None
            for node, last, before in live:
                below = children[node].get(byte)
                if below is None:
                    continue
                token = tokens[below]
                if found is None and token >= 0 and self.compatible(last, token):
                    found = token, before + 1
                if children[below]:
                    kept.append((below, last, before))
            token, count = found
            kept.append((0, token, count))
            live = kept
        return count

    def together(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece; all pieces take their next transition together."""
        if len(self.configs) > self.bound:
            self.forget()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        content = np.frombuffer(b"".join(pieces), np.uint8)
        for byte in np.unique(content[self.column[content] < 0]):
            if self.columns == self.arcs.shape[1]:
                self.arcs = np.concatenate([self.arcs, np.full_like(self.arcs, -1)], axis=1)
            self.column[byte] = self.columns
            self.columns += 1
        state, total = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        alive = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
        for at, n in enumerate(alive.tolist()):  # n pieces are longer than ``at``
            bytes_ = content[begin[:n] + at]
            columns = self.column[bytes_]
            arcs = self.arcs[state[:n], columns]
            if (arcs < 0).any():
                new = np.flatnonzero(arcs < 0)
                for pair in np.unique(state[new] << 8 | bytes_[new]).tolist():
                    self.build(pair >> 8, pair & 255)
                arcs = self.arcs[state[:n], columns]
            state[:n] = arcs >> 9
            total[:n] += (arcs & 511) - 256
        out = np.empty(len(pieces), np.int64)
        out[order] = total
        return out


CONTRACTIONS = {" ": SP, "'": APO, "stmd": ONE, "r": C_R, "v": C_V, "l": C_L, "e": C_E}


class TokenCounter:
    """Counts tokens of texts as the library does for a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        split = library.pre_tokenizer.pre_tokenize_str
        self.classes = CharClasses(lambda text: len(split(text)))
        self.pieces = PieceTransducer(BytePairs(path))
        base = {LETTER: LET, NUMBER: NUM, SPACE: WS, OTHER: OTH}
        self.ascii = np.array([base[int(k)] for k in self.classes.table[:128]], np.uint8)
        for chars, kind in CONTRACTIONS.items():
            self.ascii[[ord(c) for c in chars]] = kind
        self.new: list[str] = []
        self.memo = Bounded(self.later, MEMO)

    def later(self, piece: str) -> int:
        """A placeholder for a piece that the block has first."""
        self.new.append(piece)
        return -len(self.new)

    def splitter_classes(self, codes: np.ndarray) -> np.ndarray:
        of = np.empty(256, np.uint8)
        of[[LETTER, NUMBER, SPACE, OTHER]] = LET, NUM, WS, OTH
        out = of[self.classes.of(codes)]
        small = codes < 128
        out[small] = self.ascii[codes[small]]
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            found = [text]
            for mark in self.special:
                found = [x for part in found for x in part.split(mark)]
            out[i] = len(found) - 1
            for part in found:
                if part:
                    parts.append(part)
                    owner.append(i)
        if not parts:
            return out
        joined = "\0".join(parts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = self.splitter_classes(codes)
        classes[ends] = END
        starts = piece_starts(classes)
        stops = np.append(starts[1:], len(joined))
        real = classes[starts] != END
        starts, stops = starts[real], stops[real]
        memo = self.memo
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
        numbers = np.fromiter(map(memo.__getitem__, pieces), np.int64, len(pieces))
        if self.new:
            found = self.pieces.counts([p.encode() for p in self.new])
            waiting = numbers < 0
            numbers[waiting] = found[-1 - numbers[waiting]]
            memo.update(zip(self.new, found.tolist()))
            for piece in self.new:
                if len(piece) > PIECE_CHARS:
                    del memo[piece]
            self.new.clear()
        parts_of = np.searchsorted(ends, starts)
        np.add.at(out, np.asarray(owner), np.bincount(parts_of, numbers, len(parts)).astype(np.int64))
        memo.trim()
        return out


def count_tokens(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``df``.

    ``path`` is a tokenizer file of byte-level BPE, readable on every node.
    Whole texts count, whatever their length; a null text counts as empty (0
    tokens). Repeated rows and null ids are kept as they are; other columns are
    ignored. One pass, no shuffle.
    """

    def work():
        counter = worker_counter(path)

        def each(ids, texts):
            return {
                "doc_id": ids,
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": counter.counts(texts),
            }

        return each

    counted = map_blocks(texts_of(df, id_col, text_col), work, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


_COUNTERS: dict[str, TokenCounter] = {}


def worker_counter(path: str) -> TokenCounter:
    """One for each Python worker: its tables cost a second to build."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]
