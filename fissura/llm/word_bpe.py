"""Words and merges of a lower-casing BPE with word ends, as its library encodes."""

from __future__ import annotations

import json
import re
import unicodedata

from fissura.llm.charclass import AGREED, LETTER, NUMBER, PLAIN, SPACE, CharClasses
from fissura.llm.token_counts import NEVER, byte_letters


def _set(classes: CharClasses, kind: int) -> str:
    """Code points below AGREED of one class, as the inside of a character set."""
    codes, out = [c for c in range(AGREED) if classes.table[c] == kind], ""
    for c in codes:
        if c - 1 not in codes:
            last = c
            while last + 1 in codes:
                last += 1
            out += re.escape(chr(c)) + (f"-{re.escape(chr(last))}" if last > c else "")
    return out


class WordBpe:
    """Splits texts into normalised words and merges a word to ids.

    A special token's string inside a text is a word of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.normalize = library.normalizer.normalize_str
        self.model = library.model
        self.letters = byte_letters()
        split = library.pre_tokenizer.pre_tokenize_str
        self.classes = CharClasses(lambda text: len(split(text)))
        letters, numbers, spaces = (_set(self.classes, k) for k in (LETTER, NUMBER, SPACE))
        self.pattern = re.compile(
            f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{letters}{numbers}{spaces}]+"
        )
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.inner = {b: vocab[ch] for b, ch in byte_letters().items()}
        self.final = {b: vocab[ch + end] for b, ch in byte_letters().items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]

    def words(self, text: str) -> list[str]:
        if "<|" not in text:
            return self.plain_words(text)
        out = []
        for part in self.marks.split(text):
            out += [part] if part in self.special else self.plain_words(part)
        return out

    def plain_words(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text.lower())
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if PLAIN.fullmatch(text) and PLAIN.fullmatch(low):
            return self.pattern.findall(low)
        low = self.normalize(text)
        # The split depends on classes alone: stand-ins of the same class take the places.
        stands = low.translate(Stands(self.classes))
        return [low[m.start() : m.end()] for m in self.pattern.finditer(stands)]

    def merge(self, word: str) -> list[int]:
        """Ids of a word: the pair of lowest rank merges first, the leftmost of equals."""
        if word in self.special:
            return [self.special[word]]
        content = word.encode()
        ids = [self.inner[b] for b in content[:-1]] + [self.final[content[-1]]]
        if len(ids) > 64:
            return self.merge_long(ids)
        merges = self.merges
        ranks = [merges.get(p, NEVER)[0] for p in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NEVER[0]:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [merges[ids[i], ids[i + 1]][1]]
            del ranks[i]
            if i:
                ranks[i - 1] = merges.get((ids[i - 1], ids[i]), NEVER)[0]
            if i < len(ranks):
                ranks[i] = merges.get((ids[i], ids[i + 1]), NEVER)[0]
        return ids

    def library_ids(self, word: str) -> list[int]:
        """The same ids from the library's own model, which is faster."""
        if word in self.special:
            return [self.special[word]]
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.letters)
        return [token.id for token in self.model.tokenize(word)]

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        import heapq

        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n and (m := merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, ids[left], ids[right]))
        return [t for t in ids if t >= 0]


class Stands(dict):
    """For str.translate: code points from AGREED on to one of the same class below it."""

    def __init__(self, classes: CharClasses):
        super().__init__()
        self.classes = classes

    def __missing__(self, code: int) -> int:
        kind = self.classes.ask(code)
        self[code] = code if code < AGREED else ord({LETTER: "a", NUMBER: "1", SPACE: " "}.get(kind, "!"))
        return self[code]


_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]
