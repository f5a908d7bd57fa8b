"""Secrets in texts: fixed patterns, and values in credential contexts that are hard to guess.

How hard a value is to guess is the cheapest way to put it together from words
(ranked by a public vocabulary, with capitals and look-alike characters), dates,
repeats, keyboard walks, runs of the alphabet, and brute force over the rest. A
dynamic programme over the positions of the value finds the least sum of bits;
its work grows with the length of the value only.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import TwoGenerations, text_fields

# fixed values
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: A name of a credential, a sign that its value follows, and the value: printable ASCII without spaces, quotes and angle brackets.
CONTEXT = re.compile(
    r"(?ai)(?<![A-Za-z0-9])(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|client|private|secret|auth)[_ -]?(?:key|secret|token)"
    r"|auth(?:orization)?|credentials?|login)s?[\"'\])]{0,2}[ \t]*(?:=>|->|:=|[:=]{1,2}|\bis\b)|\bbearer\b)[ \t]*[\"'`]?(?:bearer[ \t]+)?"
    r"([!#-&(-;=?-_a-~]+)"
)
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans("~!@#$%^&*()_+{}|:\"<>?", "`1234567890-=[]\\;',./")
LOOKS_LIKE = str.maketrans("@430!15$7", "aaeoiisst")


@dataclass(frozen=True)
class SecretConfig:
    """``least_bits``: a value that costs fewer bits is a placeholder or prose; ``least_length`` of a value in
    characters; ``segment_bits``: what one more part of a value costs; ``longest_word`` and ``longest_unit`` in characters."""

    least_bits: float = 40.0
    least_length: int = 8
    segment_bits: float = 1.0
    longest_word: int = 20
    longest_unit: int = 12
    cache: int = 20_000


@functools.lru_cache(maxsize=2)
def ranked_words(path: str) -> dict[str, float]:
    """Bits of every word of ASCII letters in a file of ranked tokens: the root of its rank among the words."""
    words: dict[str, float] = {}
    with open(path, "rb") as f:
        for line in f:
            token = base64.b64decode(line.split()[0]).strip(b" ")
            if len(token) > 2 and token.isalpha() and token.isascii():
                words.setdefault(token.decode().lower(), math.log2(len(words) + 2))
    return words


def _places() -> dict[str, tuple[int, float]]:
    return {c: (r, k + r * 0.5) for r, row in enumerate(ROWS) for k, c in enumerate(row)}


PLACES = _places()


def beside(a: str, b: str) -> tuple[int, int] | None:
    """The direction from one key to a neighbour, None if the keys aren't neighbours."""
    p, q = PLACES.get(a.lower().translate(SHIFTED)), PLACES.get(b.lower().translate(SHIFTED))
    if p is None or q is None or p == q or abs(p[0] - q[0]) > 1 or abs(p[1] - q[1]) > 1:
        return None
    return q[0] - p[0], (q[1] > p[1]) - (q[1] < p[1])


def brute_bits(c: str) -> float:
    return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)


def case_bits(word: str) -> float:
    """Bits of how capitals are set: none, the first or all are cheap."""
    big = sum(c.isupper() for c in word)
    if not big:
        return 0.0
    if big == len(word) or (big == 1 and word[0].isupper()):
        return 1.0
    return math.log2(sum(math.comb(len(word), k) for k in range(1, min(big, len(word) - big) + 1)) + 2)


_YEAR = r"(?:19|20)\d\d"
_DATES = [
    (re.compile(rf"(?=({_YEAR}))", re.A), math.log2(150)),
    *((re.compile(rf"(?=({a}))", re.A), math.log2(150 * 366) + extra) for a, extra in (
        (rf"{_YEAR}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])", 1), (rf"(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2]){_YEAR}", 1),
        (rf"(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]){_YEAR}", 1),
        (rf"{_YEAR}([-/._])(?:1[0-2]|0?[1-9])\2(?:[12]\d|3[01]|0?[1-9])", 3), (rf"(?:[12]\d|3[01]|0?[1-9])([-/._])(?:1[0-2]|0?[1-9])\2{_YEAR}", 3),
    )),
]


def _runs(value: str, follows) -> Iterator[tuple[int, int]]:
    """Longest ranges of at least three characters in which every one follows the one before."""
    a = 0
    for k in range(1, len(value) + 1):
        if k == len(value) or not follows(k):
            if k - a > 2:
                yield a, k
            a = k


def spans(value: str, words: dict[str, float], cfg: SecretConfig) -> Iterator[tuple[int, int, float]]:
    """``(start, end, bits)`` of all words, dates, repeats, walks and runs in ``value``.

    Words and dates overlap freely; of repeats and walks the longest are given, repeats from every start of their unit."""
    low = value.lower()
    plain = low.translate(LOOKS_LIKE)
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + cfg.longest_word) + 1):
            bits = words.get(low[i:j])
            if bits is not None:
                yield i, j, bits + case_bits(value[i:j])
            elif plain[i:j] != low[i:j] and (bits := words.get(plain[i:j])) is not None:
                yield i, j, bits + case_bits(value[i:j]) + sum(a != b for a, b in zip(low[i:j], plain[i:j]))
    for pattern, bits in _DATES:
        for m in pattern.finditer(value):
            yield m.start(), m.end(1), bits
    for u in range(1, min(cfg.longest_unit, n // 2) + 1):
        a = 0
        for k in range(u, n + 1):
            if k < n and value[k] == value[k - u]:
                continue
            for i in range(a, min(a + u, k)):
                r = (k - i) // u
                if r > 1 and r * u > 2:
                    yield i, i + r * u, guess_bits(value[i : i + u], words, cfg) + math.log2(r)
            a = k - u + 1
    step = [0, *(ord(b) - ord(a) for a, b in zip(value, value[1:]))]
    kin = [False, *(a.isalnum() and b.isalnum() and a.isdigit() == b.isdigit() for a, b in zip(value, value[1:]))]
    start = 0
    for k in range(1, n + 1):
        # an alphabet run keeps one step up or down
        if k < n and kin[k] and abs(step[k]) == 1 and (k - start < 2 or step[k] == step[k - 1]):
            continue
        if k - start > 2:
            yield start, k, math.log2(62) + math.log2(k - start)
        start = k - 1 if k < n and kin[k] and abs(step[k]) == 1 and k - start > 1 else k
    ways = [None, *(beside(a, b) for a, b in zip(value, value[1:]))]
    for a, b in _runs(value, lambda k: ways[k] is not None):
        turns = 1 + sum(ways[k] != ways[k - 1] for k in range(a + 2, b))
        yield a, b, math.log2(47 * (b - a)) + turns * math.log2(6)


def guess_bits(value: str, words: dict[str, float], cfg: SecretConfig) -> float:
    """Bits of the cheapest segmentation of ``value``."""
    n = len(value)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    if n > 2:
        for i, j, bits in spans(value, words, cfg):
            ending[j].append((i, bits))
    best, brute = [0.0] * (n + 1), [math.inf] * (n + 1)  # in all; with a last part of brute force
    for j in range(1, n + 1):
        brute[j] = min(brute[j - 1], best[j - 1] + cfg.segment_bits) + brute_bits(value[j - 1])
        best[j] = min([brute[j], *(best[i] + bits + cfg.segment_bits for i, bits in ending[j])])
    return best[n]


class Costs(TwoGenerations):
    """Bits of values, those of late at hand."""

    def __init__(self, words: dict[str, float], cfg: SecretConfig):
        super().__init__(cfg.cache)
        self.words, self.cfg = words, cfg

    def __missing__(self, value: str) -> float:
        bits = self.old.get(value)
        bits = guess_bits(value, self.words, self.cfg) if bits is None else bits
        if len(value) < 256:
            self[value] = bits
        return bits


@functools.lru_cache(maxsize=2)
def costs_of(vocabulary: str, cfg: SecretConfig) -> Costs:
    """The costs a worker keeps."""
    return Costs(ranked_words(vocabulary), cfg)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, number of the kind, end)`` of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) > 5]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def credential_values(text: str, cfg: SecretConfig) -> Iterator[tuple[int, int]]:
    """Ranges of values in credential contexts, without what ends a sentence or closes a bracket."""
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        while b > a and text[b - 1] in ".,;:)]}!?":
            b -= 1
        if b - a >= cfg.least_length:
            yield a, b


def scan(text: str, costs: Costs, cfg: SecretConfig) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[str]]:
    """Spans of the patterns, spans that the guess cost adds, and all costs as ``start:end:bits``."""
    base = base_spans(text)
    added, said = [], []
    for a, b in credential_values(text, cfg):
        bits = costs[text[a:b]]
        said.append(f"{a}:{b}:{bits:.1f}")
        if bits >= cfg.least_bits and not any(x <= a and b <= y for x, _, y in base):
            added.append((a, 3, b))
    return base, added, said


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, costs string"


def scanned(docs: DataFrame, vocabulary: str, cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """``docs`` with a struct ``_secrets``: numbers of base spans by kind, base_sha256, all spans, n_guess, costs.

    Places are code points of the whole text, the end exclusive. A null or
    empty text has no spans. Every row is scanned by itself, so repeated rows, ties and
    null ids make no difference; further columns of any name pass through.
    """

    def run(texts: list[str]) -> list[pa.Array]:
        known = costs_of(vocabulary, cfg)
        known.age()
        rows = []
        for t in texts:
            base, added, said = scan(t, known, cfg)
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added), ",".join(said)))
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
        return [pa.array(c, k) for c, k in zip(cols, kinds)]

    return text_fields(docs, "text", "_secrets", FIELDS, run)


def report(docs: DataFrame, vocabulary: str, cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, costs)`` of every row."""
    return scanned(docs.select("doc_id", "text"), vocabulary, cfg).select("doc_id", "_secrets.*")
