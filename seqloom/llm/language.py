"""Language of texts by piece unigrams, summed over all segmentations.

The pieces of a fixed public vocabulary have a probability in every language.
The probability of a word is the sum over all its segmentations into pieces
(forward algorithm), that of a text the product over its words. Probabilities
are learnt by expectation maximisation (forward-backward) over the words of a
bounded sample of the training documents.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch, TwoGenerations, blocks, pieces

WORDS = re.compile(r"[^\W\d_]+")
SPACE = "▁"
UNKNOWN = "und"
CACHE = 300_000
#: Words up to this length share a lattice; longer ones are taken one by one.
SHORT = 48


@dataclass(frozen=True)
class LanguageConfig:
    """``sample_docs``: documents of each language the model is fitted on, at most about;
    ``rounds`` of expectation maximisation; ``smooth``: count added to every piece."""

    sample_docs: int = 2000
    rounds: int = 3
    smooth: float = 0.05


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """Pieces in lower case and their numbers, and the length of the longest."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {
        sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
    }
    number = {p: k for k, p in enumerate(sorted(p for p in found if p.lstrip(SPACE).isalpha()))}
    return number, max(map(len, number), default=1)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


class Lattice:
    """All segmentations of some words: edges ``(word, start, end, piece)`` sorted by end."""

    def __init__(self, words: list[str], vocab: tuple[dict[str, int], int]):
        number, longest = vocab
        other = len(number)  # a single character outside the vocabulary
        get = number.get
        word, start, end, piece = [], [], [], []
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)
        for k, w in enumerate(words):
            s = SPACE + w
            n = len(s)
            for i in range(n):
                for j in range(i + 1, min(n, i + longest) + 1):
                    p = get(s[i:j])
                    if p is None:
                        if j > i + 1:
                            continue
                        p = other
                    word.append(k)
                    start.append(i)
                    end.append(j)
                    piece.append(p)
        self.word, self.start = np.array(word, np.int64), np.array(start, np.int64)
        self.end, self.piece = np.array(end, np.int64), np.array(piece, np.int64)

    def _steps(self, key: np.ndarray):
        order = np.lexsort((self.word, key))
        at = np.searchsorted(key[order], np.arange(int(key.max()) + 2)) if len(key) else []
        for k in range(len(at) - 1):
            if at[k] < at[k + 1]:
                e = order[at[k] : at[k + 1]]
                yield k, e, np.flatnonzero(np.r_[True, self.word[e][1:] != self.word[e][:-1]])

    @staticmethod
    def _sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(x, first)
        size = np.diff(np.r_[first, len(x)])
        return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, size, axis=0)), first))

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """Log sums over the segmentations of every beginning; ``log_p`` has a row for each edge."""
        a = np.full((len(self.sizes), int(self.sizes.max(initial=0)) + 1, log_p.shape[1]), -np.inf)
        a[:, 0] = 0
        for j, e, first in self._steps(self.end):
            a[self.word[e[first]], j] = self._sum(a[self.word[e], self.start[e]] + log_p[e], first)
        return a

    def totals(self, a: np.ndarray) -> np.ndarray:
        return a[np.arange(len(self.sizes)), self.sizes]

    def expected(self, log_p: np.ndarray) -> np.ndarray:
        """Share of the segmentations, by probability, that use each edge (one language)."""
        a = self.forward(log_p)
        b = np.full_like(a, -np.inf)
        b[np.arange(len(self.sizes)), self.sizes] = 0
        steps = list(self._steps(self.start))
        for i, e, first in reversed(steps):
            b[self.word[e[first]], i] = self._sum(b[self.word[e], self.end[e]] + log_p[e], first)
        total = self.totals(a)[self.word]
        return np.exp(a[self.word, self.start] + log_p + b[self.word, self.end] - total)[:, 0]


def groups(words: list[str], size: int = 4000) -> Iterator[list[int]]:
    """Positions of words that share a lattice: of similar length, long ones alone."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        n = size if len(words[order[min(at + size, len(order)) - 1]]) <= SHORT else 1
        yield order[at : at + n]
        at += n


class Scorer:
    """Log probabilities of words in all languages; those of recent words are kept."""

    def __init__(self, path: str, langs: tuple[str, ...], log_p: np.ndarray):
        self.vocab, self.langs, self.log_p = vocabulary(path), langs, log_p
        self.cache = TwoGenerations(CACHE)

    def learn(self, words: set[str]) -> None:
        self.cache.age()
        new = [w for w in words if w not in self.cache and w not in self.cache.old]
        for g in groups(new):
            some = [new[k] for k in g]
            lattice = Lattice(some, self.vocab)
            total = lattice.totals(lattice.forward(self.log_p[lattice.piece]))
            self.cache.update(zip(some, total))

    def logs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every text in every language, and whether it has a letter."""
        out = np.zeros((len(texts), len(self.langs)))
        letter = np.zeros(len(texts), bool)
        for i, j in blocks(texts):
            lists = [[w for p in pieces(t) for w in words_of(p)] for t in texts[i:j]]
            distinct = {w for x in lists for w in x}
            self.learn(distinct)
            number = {w: k for k, w in enumerate(distinct)}
            table = np.array([self.cache[w] for w in number]).reshape(-1, len(self.langs))
            for k, x in enumerate(lists, i):
                if x:
                    out[k] = table[np.fromiter(map(number.__getitem__, x), np.int64, len(x))].sum(0)
                    letter[k] = any(map(str.isalpha, x)) or any(c.isalpha() for w in x for c in w)
        return out, letter

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logs, letter = self.logs(texts)
        best = logs.argmax(1)
        top = logs[np.arange(len(texts)), best]
        score = 1 / np.exp(logs - top[:, None]).sum(1)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, letter)], np.where(letter, score, 0.0)


def train(docs: DataFrame, path: str, cfg: LanguageConfig = LanguageConfig()) -> tuple[tuple[str, ...], np.ndarray]:
    """Languages and log probabilities ``(piece, language)`` from rows ``(text, lang)``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = tuple(sorted(sizes))
    n_pieces = len(vocabulary(path)[0]) + 1
    if not langs:
        return langs, np.zeros((n_pieces, 0))
    # a hash of the text decides who is in the sample; equal texts are in or out together
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, cfg.sample_docs / sizes[lang])])
    sample = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(w for p in pieces(text) for w in words_of(p))
            for lang, c in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs.index(lang)] * len(c), pa.int32()), pa.array(c.keys(), pa.string()),
                     pa.array(c.values(), pa.int64())], ["lang", "word", "n"],
                )

    words = sample.mapInArrow(count, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words, _ = scratch.write(words, "words")
    log_p = np.full((n_pieces, len(langs)), -np.log(n_pieces))
    for _ in range(cfg.rounds):
        model = spark.sparkContext.broadcast(log_p)  # pieces times languages

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, vocab = np.zeros(log_p_shape), vocabulary(path)
            for b in batches:
                lang, n = b.column(0).to_numpy(), b.column(2).to_numpy()
                text = b.column(1).to_pylist()
                for g in groups(text):
                    lattice = Lattice([text[k] for k in g], vocab)
                    of = lang[g][lattice.word]
                    used = lattice.expected(model.value[lattice.piece, of][:, None]) * n[g][lattice.word]
                    np.add.at(total, (lattice.piece, of), used)
            piece, of = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece), pa.array(of), pa.array(total[piece, of])], ["piece", "lang", "n"]
            )

        log_p_shape = log_p.shape
        got = words.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        counts = np.full(log_p.shape, cfg.smooth)
        for r in got.collect():  # at most pieces times languages
            counts[r["piece"], r["lang"]] += r["n"]
        log_p = np.log(counts / counts.sum(0))
    return langs, log_p


def identify(docs: DataFrame, held_out, path: str, cfg: LanguageConfig = LanguageConfig()) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row.

    Learns from the texts and non-null languages of rows that are not held out;
    a prediction sees the text alone. A null or letterless text is ``und`` with
    score 0. Of equally likely languages the first by name is taken. Without
    training rows everything is ``und``. Repeated rows and null ids give a row
    each; further columns are ignored; an empty table gives an empty result.
    """
    langs, log_p = train(docs.where(~held_out), path, cfg)
    model = docs.sparkSession.sparkContext.broadcast((langs, log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(path, *model.value)
        for b in batches:
            lang, score = scorer.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", held_out.alias("held_out"), text.alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )
