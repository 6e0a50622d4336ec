"""Classes of code points, as an installed tokenizer splits them."""

from __future__ import annotations

import re

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255

#: Below this code point every Unicode version in use agrees; above, the library is asked.
AGREED = 0x500


class CharClasses:
    """LETTER, NUMBER, SPACE or OTHER for each code point.

    Libraries embed different Unicode versions. Code points from ``AGREED`` on
    are classed by ``splits(text)``, the number of pieces that the tokenizer's
    own splitter makes of a text, asked once for each that occurs.
    """

    def __init__(self, splits):
        self.splits = splits
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        for c in range(AGREED):
            ch = chr(c)
            self.table[c] = (
                LETTER if regex.match(r"\p{L}", ch)
                else NUMBER if regex.match(r"\p{N}", ch)
                else SPACE if regex.match(r"\s", ch)
                else OTHER
            )

    def ask(self, code: int) -> int:
        got = self.table[code]
        if got == UNKNOWN:
            got = self.table[code] = self.classify(chr(code))
        return int(got)

    def classify(self, ch: str) -> int:
        removed = self.splits(" ") == 0  # the splitter drops white space
        if removed and self.splits(ch) == 0:
            return SPACE
        if self.splits("a" + ch) == 1:
            return LETTER
        if self.splits("!" + ch) == 1:
            return OTHER
        return NUMBER if removed or self.splits("1" + ch) == 1 else SPACE

    def of(self, codes: np.ndarray) -> np.ndarray:
        got = self.table[codes]
        if (new := got == UNKNOWN).any():
            for code in np.unique(codes[new]):
                self.ask(int(code))
            got = self.table[codes]
        return got


#: Text of code points below AGREED only.
PLAIN = re.compile(r"[\x00-ӿ]*")
