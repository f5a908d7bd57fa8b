"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch are held as one flat array of symbols with the number
of their sequence. A step looks up the rank of every neighbouring pair, finds
the lowest rank of each sequence, and merges it in all sequences at once, until
no sequence has a pair left. What counts are the surviving symbols.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import TwoGenerations, blocks, pieces

SPACE = "▁"
NO_RANK = np.int32(2**31 - 1)
CACHE = 400_000


class PieceModel:
    """Merges of a byte-fallback BPE piece model, as sorted arrays of pairs.

    A symbol is a single character or a piece. Characters that no piece holds
    never merge and stand for their UTF-8 bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        known = [
            (sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
        ]
        # one piece after another in the order of merging: the highest score first
        order = sorted(range(len(known)), key=lambda k: -known[k][1])
        names = [known[k][0] for k in order]
        rank = {p: r for r, p in enumerate(names)}
        symbol = dict(rank)
        for c in sorted({c for p in names for c in p} - rank.keys()):
            symbol[c] = len(symbol)
        self.size = len(symbol)
        self.of_char = np.full(0x110000, -1, np.int32)
        self.single = np.zeros(0x110000, bool)
        for c, s in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
                self.single[ord(c)] = c in rank
        pairs = {}
        for p, r in rank.items():
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        # pre-tokens may be cut before a space unless a piece has one behind another character
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in names)

    def pair_ranks(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each position; the last of a sequence has none."""
        out = np.full(len(sym), NO_RANK, np.int32)
        if len(sym) > 1 and len(self.keys):
            ok = (seq[1:] == seq[:-1]) & (sym[1:] >= 0) & (sym[:-1] >= 0)
            key = sym[:-1][ok].astype(np.int64) * self.size + sym[1:][ok]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[:-1][ok] = np.where(self.keys[at] == key, self.ranks[at], NO_RANK)
        return out

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of every word, all words merged together."""
        total = np.zeros(len(words), np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        seq = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym = self.of_char[points]
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        weight = np.where(self.single[points], 1, width).astype(np.int64)
        ranks = self.pair_ranks(sym, seq)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest = np.minimum.reduceat(ranks, starts)
            size = np.diff(np.r_[starts, len(sym)])
            live = lowest != NO_RANK
            if not live.all():
                stay = np.repeat(live, size)
                np.add.at(total, seq[~stay], weight[~stay])
                sym, seq, weight, ranks = sym[stay], seq[stay], weight[stay], ranks[stay]
                if not len(sym):
                    break
                lowest, size = lowest[live], size[live]
                starts = np.r_[0, np.cumsum(size)[:-1]]
            each = np.repeat(lowest, size)
            hit = ranks == each
            # of overlapping hits (aaa) every second one from the left
            where = np.flatnonzero(hit)
            run = np.r_[True, np.diff(where) != 1]
            first = where[run][np.cumsum(run) - 1]
            where = where[(where - first) % 2 == 0]
            step = self._merge(sym, seq, weight, each, where)
            # merging several pairs of a sequence at once is only right if none of the new pairs comes before them
            many = np.bincount(np.repeat(np.arange(len(size)), size)[where], minlength=len(size)) > 1
            if many.any():
                at = np.flatnonzero(np.r_[True, step[1][1:] != step[1][:-1]])
                early = many & (np.minimum.reduceat(step[3], at) <= lowest)
                if early.any():
                    number = np.repeat(np.arange(len(size)), size)[where]
                    leftmost = np.r_[True, number[1:] != number[:-1]]
                    step = self._merge(sym, seq, weight, each, where[leftmost | ~early[number]])
            sym, seq, weight, ranks = step
        return total

    def _merge(self, sym, seq, weight, each, where):
        sym, weight = sym.copy(), weight.copy()
        sym[where], weight[where] = each[where], 1
        keep = np.ones(len(sym), bool)
        keep[where + 1] = False
        sym, seq = sym[keep], seq[keep]
        return sym, seq, weight[keep], self.pair_ranks(sym, seq)


_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_CUT = re.compile(f"(?<=[^ {SPACE}])(?= )")


class Counter:
    """Counts of whole texts; counts of pre-tokens seen of late are kept."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.cache = TwoGenerations(CACHE)

    def words(self, text: str, first: bool) -> list[str]:
        s = text.replace(" ", SPACE)
        if first:
            s = SPACE + s
        if not self.model.cuts:
            return [s]
        if SPACE + SPACE not in s and s[0] == SPACE:
            return [SPACE + w for w in s.split(SPACE)[1:]]
        return _WORDS.findall(s)

    def learn(self, parts: list[list[str]]) -> None:
        self.cache.age()
        new = list({w for p in parts for w in p if w not in self.cache and w not in self.cache.old})
        self.cache.update(zip(new, self.model.count(new).tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        for a, b in blocks(texts):
            if b - a == 1 and self.model.cuts:  # possibly very long
                for k, piece in enumerate(pieces(texts[a], cut=_CUT)):
                    if piece:
                        w = self.words(piece, k == 0)
                        self.learn([w])
                        out[a] += sum(map(self.cache.__getitem__, w))
                continue
            parts = [self.words(t, True) if t else [] for t in texts[a:b]]
            self.learn(parts)
            for k, w in enumerate(parts, a):
                out[k] = sum(map(self.cache.__getitem__, w))
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs``.

    A null text counts as empty: no bytes, no tokens. Repeated rows are counted
    each; a null id stays null; further columns are ignored. An empty table
    gives an empty result. Texts of any length are counted whole, in pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(c.counts(b.column(2).to_pylist()), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce("text", F.lit(""))
    return (
        docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
        .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
