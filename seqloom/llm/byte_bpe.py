"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Whether a token is final depends on a bounded number of bytes behind it: a merge
``(x, y)`` can only be forestalled by an earlier merge that takes the right end
of ``y`` away, which in turn can only be forestalled by a still earlier one. The
ranks of such a chain fall, so the longest chain of the merge list gives a
sufficient lookahead. Bytes are held back until that many are known behind them,
so memory is constant however long a text or one of its words is.
"""

from __future__ import annotations

import bisect
import codecs
import functools
import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import TwoGenerations, pieces

#: Fixed value: the pattern of pre-tokens that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 300_000
LONG = 256
SEGMENT = 1 << 17
NO_RANK = 1 << 62


def byte_letters() -> dict[str, int]:
    """The printable letter of every byte in vocabulary files, as letter to byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge list of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.of_byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        # both tokens in one key, rank and new token in one value: the smallest value is the lowest rank
        self.packed = {a << 20 | b: rank << 20 | new for (a, b), (rank, new) in self.pairs.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes behind a token that decide whether it is final.

        ``reach`` of a merge (x, y): the bytes behind x that decide whether it
        takes place. These are y and, for every token s at the right end of y
        while y is being formed, the reach of earlier merges (s, z).
        """
        made = {new: (a, b, rank) for (a, b), (rank, new) in self.pairs.items()}
        ranks: dict[int, list[int]] = {}  # of merges by their left token, ascending
        most: dict[int, list[int]] = {}  # largest reach so far, in step with ranks
        longest = 0
        for (a, b), (rank, _) in self.pairs.items():  # in the order of the ranks
            reach, before, s = 0, rank, b
            while True:
                k = bisect.bisect_left(ranks.get(s, []), before)
                if k:
                    reach = max(reach, most[s][k - 1])
                if s not in made:
                    break
                _, s, before = made[s]
            reach += len(self.bytes_of[b])
            ranks.setdefault(a, []).append(rank)
            so_far = most.setdefault(a, [])
            so_far.append(max(reach, so_far[-1] if so_far else 0))
            longest = max(longest, reach)
        return longest

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a short run of bytes: the lowest rank first, from the left."""
        ids = [self.of_byte[b] for b in data]
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.packed.get
        ranks = [get(a << 20 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != NO_RANK:
            k = ranks.index(low)
            ids[k : k + 2] = [low & 0xFFFFF]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | ids[k], NO_RANK)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 20 | ids[k + 1], NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*hit, k, ids[k], ids[k + 1]) for k in range(n - 1) if (hit := self.pairs.get((ids[k], ids[k + 1])))]
        heap = [(rank, k, new, a, b) for rank, new, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (hit := self.pairs.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (hit[0], left, hit[1], ids[left], ids[right]))
        return [i for i in ids if i >= 0]


class Transducer:
    """Takes the bytes of one pre-token bit by bit and gives tokens once they are final."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.held = b""
        self.window = 4 * merges.lookahead + 64

    def push(self, data: bytes) -> Iterator[int]:
        at = 0
        while at < len(data):
            more = self.window - len(self.held)
            self.held += data[at : at + more]
            at += more
            if len(self.held) >= self.window:
                yield from self._emit(len(self.held) - self.merges.lookahead)

    def _emit(self, stable: int) -> Iterator[int]:
        """Tokens that end within the first ``stable`` bytes. A final boundary
        separates the merges of both sides, so the rest starts afresh there."""
        end = 0
        for i in self.merges.merge(self.held):
            size = len(self.merges.bytes_of[i])
            if end + size > stable:
                break
            end += size
            yield i
        self.held = self.held[end:]

    def flush(self) -> Iterator[int]:
        yield from self._emit(len(self.held))


class TextDecoder:
    """Token ids to text, one at a time: bytes of a character may be spread over
    tokens; bytes that can't begin or go on with a character become U+FFFD."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids) -> str:
        return self.state.decode(b"".join([self.bytes_of[i] for i in ids]))

    def push_bytes(self, data: bytes) -> str:
        return self.state.decode(data)

    def flush(self) -> str:
        return self.state.decode(b"", True)


class Coder:
    """Encoder and decoder of whole texts with the ids of recent pre-tokens at hand."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.words = regex.compile(PATTERN)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.cache = TwoGenerations(CACHE)

    def tokens(self, word: str) -> Iterator[int]:
        if len(word) < 128:  # all of it is within the first window
            return iter(self.merges.merge(word.encode()))
        t = Transducer(self.merges)
        return itertools.chain(t.push(word.encode()), t.flush())

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Ordinary text and special strings in turn."""
        if self.special is None or not self.special.search(text):
            yield text, False
            return
        for k, part in enumerate(self.special.split(text)):
            if part:
                yield part, k % 2 == 1

    def stream(self, text: str) -> Iterator[tuple[str, int, bytes]]:
        """``(decimal ids joined by commas, number of ids, their bytes)`` of consecutive parts."""
        cache = self.cache
        for segment, special in self.segments(text):
            if special:
                i = self.merges.special[segment]
                yield str(i), 1, self.merges.bytes_of[i]
                continue
            for piece in pieces(segment, SEGMENT):
                cache.age()
                words = self.words.findall(piece)
                long = self.learn(set(words))
                at = 0
                for k in [k for k, w in enumerate(words) if w in long] if long else ():
                    # a long word passes through by itself, and is not kept
                    if at < k:
                        yield joined(words[at:k], cache)
                    for i in self.tokens(words[k]):
                        yield str(i), 1, self.merges.bytes_of[i]
                    at = k + 1
                if at < len(words):
                    yield joined(words[at:], cache)

    def learn(self, words: set[str]) -> set[str]:
        """Put the words into the cache; those too long for it are returned."""
        cache, old, long = self.cache, self.cache.old, set()
        for w in words:
            if w not in cache:
                if w in old:
                    cache[w] = old[w]
                elif len(w) > LONG:
                    long.add(w)
                else:
                    ids = list(self.tokens(w))
                    cache[w] = ",".join(map(str, ids)), len(ids), b"".join(map(self.merges.bytes_of.__getitem__, ids))
        return long

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and digests of the ids and of the decoded text."""
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        decoder = TextDecoder(self.merges)
        for said, count, data in self.stream(text):
            ids.update((("," if n else "") + said).encode())
            decoded.update(decoder.push_bytes(data).encode())
            n += count
        decoded.update(decoder.flush().encode())
        return n, ids.hexdigest(), decoded.hexdigest()

    def encode(self, text: str) -> list[int]:
        return [int(i) for said, _, _ in self.stream(text) for i in said.split(",")]

    def decode(self, ids: list[int]) -> str:
        d = TextDecoder(self.merges)
        return d.push(ids) + d.flush()


def joined(words: list[str], cache: dict) -> tuple[str, int, bytes]:
    said, counts, data = zip(*map(cache.__getitem__, words))
    return ",".join(said), sum(counts), b"".join(data)


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` of every row; null text gives no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            ids = pa.array([c.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit(""))).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of every row of ``(doc_id, ids)``; null ids give empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            texts = pa.array([c.decode(i or []) for i in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row, without holding the ids.

    A null text counts as empty: no tokens, digests of the empty string.
    Repeated rows and null ids give a row each; further columns are ignored; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            n, ids, text = zip(*[c.digest(t) for t in b.column(1).to_pylist()]) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.coalesce("text", F.lit(""))).mapInArrow(run, schema)
