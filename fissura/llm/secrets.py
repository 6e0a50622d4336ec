"""Secrets in text: credential patterns, and literals assigned to sensitive names.

Three base patterns are always reported. Beyond them a small lexer reads
``name <separator> value`` in source and configuration syntax. A value is a
quoted literal, literals added together, a bare word, or the name of an earlier
constant. Constants are propagated: a literal is judged by every name it
reaches, so ``k = "f9x..."; db_password = k`` gives the literal behind ``k``.
A literal's score is the weight of the most sensitive of these names times how
much the literal looks like a credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from fissura.llm.shared import add_blocks, texts_of

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# The longest runs, so asking for the length at once skips nothing else.
HEX = re.compile(r"[0-9a-f]{24,}")

SEPARATOR = re.compile(r"[:=]")
NAME_BEFORE = re.compile(r"""(?:^|[^A-Za-z0-9_.$-])(["']?)([A-Za-z_$][A-Za-z0-9_.-]*)\1[ \t]*$""", re.ASCII)
NAME_CHARS = 256  # a longer word before a separator is not a name
# Possessive, so that no way back is kept for each character of a long literal.
QUOTED = re.compile(
    r'''[ \t]*(?:"([^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'([^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'|`([^`\n]*+)`)'''
)
PLUS = re.compile(r"""[ \t]*\+(?=[ \t]*["'`])""")
BARE = re.compile(r"""[ \t]*([^\s"'`,;#(){}\[\]<>]+)""")
REFERENCE = re.compile(r"\$?\{?([A-Za-z_$][A-Za-z0-9_.-]*)\}?", re.ASCII)
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How sensitive a name is by the words in it, alone or two in a row.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "secret": 1.0, "pwd": 0.9, "pass": 0.8,
    "token": 0.9, "apikey": 1.0, "api key": 1.0, "access key": 1.0, "private key": 1.0,
    "secret key": 1.0, "encryption key": 1.0, "signing key": 1.0, "auth key": 1.0, "bearer": 0.9,
    "credential": 0.9, "credentials": 0.9, "connection string": 0.8,
}
PLACEHOLDERS = frozenset(
    "changeme example placeholder password secret token none null true false undefined redacted "
    "required optional string default".split()
)
THRESHOLD = 0.6
MIN_LENGTH = 6


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_LENGTH]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def name_weight(name: str) -> float:
    words = [w.lower() for w in NAME_WORD.findall(name)]
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return max((WEIGHTS.get(w, 0.0) for w in words + pairs), default=0.0)


def strength(literal: str) -> float:
    """0 to 1: long, varied, of mixed kinds, no placeholder, no prose or path."""
    n = len(literal)
    if n < MIN_LENGTH or literal.lower() in PLACEHOLDERS or re.search(r"\s|^\W+$|^https?://|^[./]", literal):
        return 0.0
    bits = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / 3.5) * (0.55, 0.85, 1.0, 1.0)[max(kinds, 1) - 1]


def assignments(text: str) -> list[tuple[str, int, int, str, str | None]]:
    """(name, start, end, content, referenced name) of the values, in order."""
    found, done = [], 0
    for at in SEPARATOR.finditer(text):
        begin, after = at.start(), at.end()
        if begin < done:
            continue
        line = max(text.rfind("\n", max(0, begin - NAME_CHARS), begin) + 1, begin - NAME_CHARS, done)
        name = NAME_BEFORE.search(text[line:begin])
        if not name:
            continue
        while after < len(text) and text[after] in "=>":  # := => ==
            after += 1
        if value := QUOTED.match(text, after):
            start, content, reference = value.start(value.lastindex), value[value.lastindex], None
            while (plus := PLUS.match(text, value.end())) and (more := QUOTED.match(text, plus.end())):
                value = more
                content += value[value.lastindex]
            end = value.end(value.lastindex)
        elif value := BARE.match(text, after):
            start, end = value.span(1)
            if text[end - 1] in ":=":  # another name, not a value
                continue
            content, alias = value[1], REFERENCE.fullmatch(value[1])
            reference = alias[1] if alias else None
        else:
            continue
        done = end
        found.append((name[2], start, end, content, reference))
    return found


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name and look like a credential."""
    if ":" not in text and "=" not in text:
        return []
    constants: dict[str, int] = {}
    literals: list[list] = []  # start, end, content, weight of the most sensitive name reached
    for name, start, end, content, reference in assignments(text):
        known = constants.get(reference) if reference else None
        if known is None:
            known = len(literals)
            literals.append([start, end, content, 0.0])
        constants[name] = known
        literals[known][3] = max(literals[known][3], name_weight(name))
    return [
        (a, b, "literal") for a, b, content, weight in literals
        if weight and weight * strength(content) >= threshold
    ]


def spans_of(text: str, threshold: float = THRESHOLD) -> tuple[list, list]:
    """The base spans, and those with the literals outside them; by start, then kind."""
    order = lambda span: (span[0], KINDS.index(span[2]))
    base = sorted(base_spans(text), key=order)
    more = [
        s for s in literal_spans(text, threshold)
        if not any(a <= s[0] and s[1] <= b for a, b, _ in base)
    ]
    return base, sorted(base + more, key=order) if more else base


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{kind}:{a}:{b}" for a, b, kind in spans])


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: counts of the base kinds, the base spans' digest, all spans, the redacted text.

    ``redacted`` is null where nothing is to be hidden.

    Spans are in code points, ends exclusive. A null text counts as empty and
    has no span. Repeated rows give repeated results; of the other columns
    only those in ``carry`` come along. One pass without a shuffle; a text is read whole.
    """

    def work():
        def each(ids, texts):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted")}
            for text in texts:
                base, every = spans_of(text, threshold)
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(every))
                out["redacted"].append(redact(text, every) if every else None)
            return {"doc_id": ids} | out

        return each

    return add_blocks(
        texts_of(df, id_col, text_col, carry),
        work,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string",
    )
