"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Words are 64-bit hashes. Counting packs the pairs of a task into sorted arrays
for each part of the hash space, so that a shuffle row is one array and not one
pair; a reducer merges the arrays of its part and writes them, sorted, into the
shared folder. Scoring maps these files into memory: workers of a machine share
the pages, and only what is looked up is read.

A pair belongs to the part of its first word. Pairs of very frequent first words
are dealt out by both words; the sums of those few contexts are added up
afterwards.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch, WordHashes, blocks

BEGIN = 1
END_WORD = b"\x00end"  # no word holds this: words come from texts as they are, and this marks the end
#: Tokens whose pairs a task gathers before it packs them.
GATHER = 2_000_000
#: Pairs of one part, about.
PART_PAIRS = 2_000_000
CACHE = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)


END = WordHashes(1)[b" " + END_WORD]


def token_hashes(texts: list[str], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text closed by END, and their numbers."""
    parts, sizes = [], []
    cache.age()
    for t in texts:
        words = t.encode().lower().split()  # of bytes: A-Z only, and the six ASCII spaces
        ids = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        parts += [ids, np.array([END], np.uint64)]
        sizes.append(len(words) + 1)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(sizes, np.int64)


def contexts(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The word before each token; BEGIN at the start of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.r_[0, np.cumsum(sizes)[:-1]]] = BEGIN
    return before


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return scramble(scramble(u) + w)


def part_of(u: np.ndarray, w: np.ndarray, parts: int, hot: np.ndarray) -> np.ndarray:
    split = np.isin(u, hot)
    return np.where(split, pair_key(u, w), scramble(u)).astype(np.uint64) % np.uint64(parts)


def summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of parallel key arrays in ascending order, and the sums of ``n``."""
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    if not len(n):
        return keys, n
    new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
    return [k[new] for k in keys], np.add.reduceat(n, np.flatnonzero(new))


def packed(part: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each part with the sorted columns as bytes."""
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(int(part.max()) + 2 if len(part) else 1))
    held = [k for k in range(len(at) - 1) if at[k] < at[k + 1]]
    sorted_columns = [c[order] for c in columns]
    arrays = [pa.array([c[at[k] : at[k + 1]].tobytes() for k in held], pa.binary()) for c in sorted_columns]
    return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *arrays], ["part", *names])


def unpacked(table: pa.Table, name: str, dtype) -> np.ndarray:
    # row by row: columns of all rows together may be longer than one Arrow array holds
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in table.column(name)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def shared_path(root: str) -> str:
    """The shared folder as a path of the file system, which memory mapping needs."""
    url = urlparse(root)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{root}: the model files are mapped into memory; spark.checkpoint.dir must be a mounted folder")
    return url.path


def store(path: str, array: np.ndarray) -> None:
    """Written beside and renamed: a task that runs twice leaves one whole file."""
    beside = f"{path}.{os.urandom(6).hex()}"
    with open(beside, "wb") as f:
        f.write(np.ascontiguousarray(array).data)
    os.replace(beside, path)


def load(path: str, dtype) -> np.ndarray:
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


def gathered(batches: Iterator[pa.RecordBatch], give) -> Iterator[pa.RecordBatch]:
    """``give(ids, sizes)`` of about GATHER tokens at a time."""
    cache, ids, sizes, held = WordHashes(CACHE), [], [], 0
    for b in batches:
        texts = b.column(0).to_pylist()
        for i, j in blocks(texts):
            x, n = token_hashes(texts[i:j], cache)
            ids.append(x)
            sizes.append(n)
            held += len(x)
            if held >= GATHER:
                yield give(np.concatenate(ids), np.concatenate(sizes))
                ids, sizes, held = [], [], 0
    if ids:
        yield give(np.concatenate(ids), np.concatenate(sizes))


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of things seen once to four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3 * y)
    return tuple(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))


def cut_of(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


class Model:
    """The arrays of a trained model, mapped into memory."""

    def __init__(self, spec: dict):
        self.spec = spec
        root = spec["root"]
        self.words = [[load(f"{root}/word-{q}.{x}", t) for x, t in (("key", np.uint64), ("n", np.int64), ("cont", np.int64))]
                      for q in range(spec["word_parts"])]
        self.pairs = [[load(f"{root}/pair-{p}.{x}", t) for x, t in (("key", np.uint64), ("n", np.int32))]
                      for p in range(spec["parts"])]
        self.left = [[load(f"{root}/left-{p}.{x}", t) for x, t in (("key", np.uint64), ("sums", np.int64))]
                     for p in range(spec["parts"])]
        self.hot = np.array(spec["hot"], np.uint64)
        self.hot_sums = np.array(spec["hot_sums"], np.int64).reshape(-1, 4)

    def _find(self, tables, part, key):
        """Positions of ``key`` in the first array of its part; -1 where it is absent."""
        order = np.lexsort((key, part))
        sorted_part, sorted_key = part[order], key[order]
        at = np.searchsorted(sorted_part, np.arange(len(tables) + 1, dtype=np.uint64))
        for p in range(len(tables)):
            if at[p] < at[p + 1] and len(tables[p][0]):
                k = sorted_key[at[p] : at[p + 1]]
                pos = np.minimum(np.searchsorted(tables[p][0], k), len(tables[p][0]) - 1)
                hit = np.flatnonzero(tables[p][0][pos] == k)
                yield p, order[at[p] : at[p + 1]][hit], pos[hit]

    def probabilities(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(w | u) and the training count of w."""
        s = self.spec
        count, cont = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        distinct, back = np.unique(w, return_inverse=True)
        c, k = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        for q, rows, pos in self._find(self.words, scramble(distinct) % np.uint64(s["word_parts"]), distinct):
            c[rows], k[rows] = self.words[q][1][pos], self.words[q][2][pos]
        count, cont = c[back], k[back]
        base = 1.0 / (s["distinct"] + 1)
        if s["pairs"]:
            low = (cont - cut_of(cont, s["d_low"])) / s["pairs"] + s["rest_low"] * base
        else:
            low = np.full(len(w), base)
        seen = np.zeros(len(w), np.int64)
        for p, rows, pos in self._find(self.pairs, part_of(u, w, s["parts"], self.hot), pair_key(u, w)):
            seen[rows] = self.pairs[p][1][pos]
        distinct, back = np.unique(u, return_inverse=True)
        sums = np.zeros((len(distinct), 4), np.int64)
        for p, rows, pos in self._find(self.left, scramble(distinct) % np.uint64(s["parts"]), distinct):
            sums[rows] = self.left[p][1].reshape(-1, 4)[pos]
        if len(self.hot):
            pos = np.minimum(np.searchsorted(self.hot, distinct), len(self.hot) - 1)
            hit = self.hot[pos] == distinct
            sums[hit] = self.hot_sums[pos[hit]]
        total = sums[:, 0][back]
        spare = (sums[:, 1:] @ np.array(s["d_high"]))[back]
        known = np.maximum(total, 1)
        high = (seen - cut_of(seen, s["d_high"])) / known + spare / known * low
        return np.where(total > 0, high, low), count


@functools.lru_cache(maxsize=1)
def _model(root: str, spec_items: tuple) -> Model:
    return Model(dict(spec_items))


def train(docs: DataFrame, held_out) -> dict:
    """Count the texts of ``docs`` where ``held_out`` is false; what workers need to map the model."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "bigrams")
    root = shared_path(scratch.root)
    os.makedirs(root, exist_ok=True)
    texts = docs.where(~held_out).select(F.coalesce("text", F.lit("")).alias("text"))
    word_parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def words(batches):
        def give(ids, sizes):
            (w,), n = summed([ids], np.ones(len(ids), np.int64))
            return packed(scramble(w) % np.uint64(word_parts), [w, n], ["w", "n"])
        return gathered(batches, give)

    def merge_words(key, table):
        (w,), n = summed([unpacked(table, "w", np.uint64)], unpacked(table, "n", np.int64))
        q = key[0].as_py()
        store(f"{root}/word-{q}.key", w)
        store(f"{root}/word-{q}.n", n)
        top = np.argsort(-n, kind="stable")[:1024]
        return pa.table({
            "part": pa.array([q], pa.int32()), "tokens": pa.array([int(n.sum())], pa.int64()),
            "words": pa.array([len(n)], pa.int64()), "top": pa.array([w[top].tobytes()], pa.binary()),
            "top_n": pa.array([n[top].tobytes()], pa.binary()),
        })

    got = texts.mapInArrow(words, "part int, w binary, n binary").groupBy("part").applyInArrow(
        merge_words, "part int, tokens long, words long, top binary, top_n binary"
    ).collect()
    tokens, distinct = sum(r["tokens"] for r in got), sum(r["words"] for r in got)
    for q in set(range(word_parts)) - {r["part"] for r in got}:
        store(f"{root}/word-{q}.key", np.zeros(0, np.uint64))
        store(f"{root}/word-{q}.n", np.zeros(0, np.int64))
    parts = max(word_parts, tokens // PART_PAIRS)
    # a word is frequent if it alone would fill an eighth of a part: at most 8 * parts words, and the start
    frequent = [np.frombuffer(r["top"], np.uint64)[np.frombuffer(r["top_n"], np.int64) * 8 * parts > tokens] for r in got]
    hot = np.unique(np.concatenate([*frequent, np.array([BEGIN], np.uint64)]))

    def pairs(batches):
        def give(ids, sizes):
            (u, w), n = summed([contexts(ids, sizes), ids], np.ones(len(ids), np.int32))
            return packed(part_of(u, w, parts, hot), [u, w, n.astype(np.int32)], ["u", "w", "n"])
        return gathered(batches, give)

    def merge_pairs(key, table):
        p = key[0].as_py()
        (u, w), n = summed([unpacked(table, "u", np.uint64), unpacked(table, "w", np.uint64)], unpacked(table, "n", np.int32))
        k = pair_key(u, w)
        order = np.argsort(k)
        store(f"{root}/pair-{p}.key", k[order])
        store(f"{root}/pair-{p}.n", n[order].astype(np.int32))
        seen = np.stack([n, n == 1, n == 2, n > 2], 1).astype(np.int64)
        new = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        left, sums = u[new], np.add.reduceat(seen, new)
        own = ~np.isin(left, hot)
        store(f"{root}/left-{p}.key", left[own])
        store(f"{root}/left-{p}.sums", sums[own])
        (right,), times = summed([w], np.ones(len(w), np.int32))
        of_right = packed(scramble(right) % np.uint64(word_parts), [right, times.astype(np.int32)], ["w", "n"])
        times = [int((n == x).sum()) for x in (1, 2, 3, 4)]
        rows = of_right.num_rows
        return pa.table({
            "part": of_right.column(0), "w": of_right.column(1), "n": of_right.column(2),
            "pairs": pa.array([len(n)] + [0] * (rows - 1), pa.int64()),
            "times": pa.array([times] + [[0] * 4] * (rows - 1), pa.list_(pa.int64())),
            "hot": pa.array([left[~own].tobytes()] + [b""] * (rows - 1), pa.binary()),
            "hot_sums": pa.array([sums[~own].tobytes()] + [b""] * (rows - 1), pa.binary()),
        })

    schema = "part int, w binary, n binary, pairs long, times array<long>, hot binary, hot_sums binary"
    ends, _ = scratch.write(
        texts.mapInArrow(pairs, "part int, u binary, w binary, n binary").groupBy("part").applyInArrow(merge_pairs, schema),
        "ends",
    )
    times = [F.sum(F.get("times", F.lit(k))) for k in range(4)]
    n_pairs, *times = (x or 0 for x in ends.agg(F.sum("pairs"), *times).first())

    def hot_rows(batches):
        for b in batches:
            keys = np.concatenate([np.frombuffer(x, np.uint64) for x in b.column(0).to_pylist()] or [np.zeros(0, np.uint64)])
            sums = np.concatenate([np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()] or [np.zeros(0, np.int64)])
            sums = sums.reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in sums.T)], ["u", "a", "b", "c", "d"]
            )

    of_hot = ends.where("length(hot) > 0").select("hot", "hot_sums").mapInArrow(
        hot_rows, "u long, a long, b long, c long, d long"
    ).groupBy("u").agg(*[F.sum(c).alias(c) for c in "abcd"]).collect()  # at most 8 words a part
    for p in range(parts):
        if not os.path.exists(f"{root}/pair-{p}.key"):
            for name in ("pair-{}.key", "pair-{}.n", "left-{}.key", "left-{}.sums"):
                store(f"{root}/{name.format(p)}", np.zeros(0, np.uint64))

    def merge_ends(key, table):
        q = key[0].as_py()
        (w,), n = summed([unpacked(table, "w", np.uint64)], unpacked(table, "n", np.int32).astype(np.int64))
        all_words = load(f"{root}/word-{q}.key", np.uint64)
        cont = np.zeros(len(all_words), np.int64)
        cont[np.searchsorted(all_words, w)] = n
        store(f"{root}/word-{q}.cont", cont)
        seen = [int((n == x).sum()) for x in (1, 2, 3, 4)] + [int((n > 2).sum())]
        return pa.table({"part": pa.array([q], pa.int32()), "seen": pa.array([seen], pa.list_(pa.int64()))})

    low = ends.select("part", "w", "n").groupBy("part").applyInArrow(merge_ends, "part int, seen array<long>").collect()
    for q in set(range(word_parts)) - {r["part"] for r in low}:
        store(f"{root}/word-{q}.cont", np.zeros(0, np.int64))
    d_high = discounts(np.array(times))
    seen = np.sum([r["seen"] for r in low], axis=0) if low else np.zeros(5)
    d_low = discounts(seen[:4])
    rest_low = (d_low[0] * seen[0] + d_low[1] * seen[1] + d_low[2] * seen[4]) / max(1, n_pairs)
    hot_sums = np.zeros((len(hot), 4), np.int64)
    for r in of_hot:
        hot_sums[np.searchsorted(hot, np.int64(r["u"]).view(np.uint64))] = [r[c] for c in "abcd"]
    return {
        "root": root, "word_parts": word_parts, "parts": parts, "tokens": tokens, "distinct": distinct, "pairs": n_pairs,
        "d_high": d_high, "d_low": d_low, "rest_low": float(rest_low),
        "hot": tuple(hot.tolist()), "hot_sums": tuple(hot_sums.ravel().tolist()),
    }


def score(docs: DataFrame, held_out, spec: dict | None = None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    A null text is empty: its one token is the end. Repeated rows count as
    often as they occur; a row with a null id is in training. Further columns are
    ignored; an empty table gives an empty result.
    """
    spec = spec or train(docs, held_out)
    model = docs.sparkSession.sparkContext.broadcast(spec)  # numbers and at most 8 hot words a part
    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = model.value
        m, cache = _model(spec["root"], tuple(spec.items())), WordHashes(CACHE)
        scale = np.log10(float(spec["tokens"] + spec["distinct"] + 1))  # one added to the count of every word and of the unknown
        for b in batches:
            texts = b.column(2).to_pylist()
            out = [np.zeros(len(texts)) for _ in range(4)]
            for i, j in blocks(texts):
                ids, sizes = token_hashes(texts[i:j], cache)
                p, c = m.probabilities(contexts(ids, sizes), ids)
                at = np.r_[0, np.cumsum(sizes)[:-1]]
                out[0][i:j] = sizes
                out[1][i:j] = np.add.reduceat(c > 0, at, dtype=np.int64)
                out[2][i:j] = np.add.reduceat(np.log10(c + 1.0) - scale, at)
                out[3][i:j] = np.add.reduceat(np.log10(p), at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)),
                 pa.array(np.full(len(texts), spec["tokens"], np.int64)), pa.array(out[2]), pa.array(out[3])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", held_out.alias("held_out"), text.alias("text")).mapInArrow(run, schema)
