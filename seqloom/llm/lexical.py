"""Ranked lexical search with Block-Max MaxScore over a sharded inverted index.

Documents are dealt into shards of bounded size. A shard has one row per term:
its postings in blocks of 128, compressed, and for every block the pairs of term
frequency and document length that no other posting of the block beats. From
these the highest contribution of a block follows for any corpus statistics, so
that one pass over the texts builds the index.

A search deals the items into blocks, joins the terms of a block with the rows
of the index, and works on one shard and one block of items at a time. Lists are
in the order of their bounds; those whose bounds together stay below the tenth
best score so far are not essential: no document is taken from them alone. A
document of the essential lists is dropped as soon as its score and the maxima
of the blocks that could hold it stay below that score; only blocks that then
still hold a document are decompressed. The best ten of all shards are merged.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch, pieces, release

#: What is no ASCII letter or digit parts terms; A-Z are lower-cased, other letters stay.
TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings of a block.
BLOCK = 128
DOC_BITS = 20
HEADS = 6
#: The term of the row that holds the documents of a shard; no term is empty.
HEADER = ""


@dataclass(frozen=True)
class SearchConfig:
    """``k`` documents an item; ``shard_bytes`` of text in a shard at least, as far as a partition
    has them; ``items``: items searched together; ``window``: documents between two looks at the score to beat."""

    k: int = 10
    shard_bytes: int = 16 << 20
    items: int = 256
    window: int = 2048


def penalties(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents with ``n`` terms."""
    if len(n) and 75 * int(n.max()) * docs >= 1 << 63:
        return np.array([25 + 75 * int(x) * docs // total for x in n], np.int64)
    return 25 + 75 * n.astype(np.int64) * docs // max(total, 1)


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def to_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of whole numbers, seven bits each with the lowest first, and where every number starts."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k))
    at = np.zeros(len(v) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        more = (size[some] > k + 1).astype(np.uint64) << np.uint64(7)
        out[at[:-1][some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)) | more
    return out, at


def from_varints(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts) if len(raw) else np.zeros(0, np.int64)


class Shard:
    """Postings of the documents gathered so far, as sorted keys of term and document with counts."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.loose: list[np.ndarray] = []
        self.held = 0
        self.bytes = 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, doc_id: int | None, text: str) -> None:
        n, doc = 0, len(self.ids)
        for piece in pieces(text):
            words = piece.encode().translate(TERM_BYTES).split()
            ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            self.loose.append(ids << DOC_BITS | doc)
            self.held += len(words)
            n += len(words)
            self.bytes += len(piece)
            if self.held > 1 << 21:
                self.settle()
        self.ids.append(doc_id)
        self.lengths.append(n)

    def settle(self) -> None:
        fresh, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.loose]), return_counts=True)
        if len(self.keys):
            both = np.concatenate([self.keys, fresh])
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.concatenate([self.counts, n])[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            fresh, n = both[first], np.add.reduceat(n, first)
        self.keys, self.counts, self.loose, self.held = fresh, n, [], 0

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The header, then a row per term in the order of first use."""
        self.settle()
        n = np.array(self.lengths, np.int64)
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        absent = np.array([i is None for i in self.ids], np.uint8)
        yield _rows(shard, pa.array([HEADER]), [(n > 0).sum()], [n.sum()], *(pa.array([x.tobytes()], pa.binary()) for x in (n, ids, absent)))
        term, doc, tf = self.keys >> DOC_BITS, self.keys & ((1 << DOC_BITS) - 1), self.counts
        if not len(term):
            return
        start = _starts(term)
        df = np.diff(np.append(start, len(term)))
        within = np.arange(len(term)) - np.repeat(start, df)
        begin = np.flatnonzero(within % BLOCK == 0)
        block = np.cumsum(within % BLOCK == 0) - 1
        end = np.append(begin[1:], len(term))
        gap = np.diff(doc, prepend=0)
        gap[begin] = 0
        body, at = to_varints(np.stack([gap, tf], 1).ravel())
        best = undominated(block, tf, n[doc])
        sky = np.stack([tf[best], n[doc[best]]], 1).astype(np.int32)
        sky_at = np.append(0, np.cumsum(np.bincount(block[best], minlength=len(begin))))
        of_term = np.append(np.searchsorted(begin, start), len(begin))  # first block of every term
        first = np.repeat(of_term[:-1], np.diff(of_term))  # of the term of every block
        heads = np.stack([
            doc[begin], doc[end - 1], at[2 * begin] - at[2 * begin[first]], at[2 * end] - at[2 * begin[first]],
            sky_at[:-1] - sky_at[first], sky_at[1:] - sky_at[first],
        ], 1).astype(np.int32)
        terms = pa.array(list(self.number), pa.binary()).cast(pa.string())
        whole = _rows(
            shard, terms, df, np.zeros(len(df), np.int64), _binaries(heads, of_term * heads.itemsize * HEADS),
            _binaries(sky, sky_at[of_term] * sky.itemsize * 2), _binaries(body, at[2 * np.append(start, len(term))]))
        for k in range(0, whole.num_rows, 8192):
            yield whole.slice(k, 8192)


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Parts of the bytes of ``data`` as an Arrow array, without a Python object each."""
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _rows(shard: int, term: pa.Array, df, total, heads: pa.Array, sky: pa.Array, body: pa.Array) -> pa.RecordBatch:
    numbers = [pa.array(np.full(len(term), shard), pa.int64()), pa.array(np.asarray(df), pa.int64()), pa.array(np.asarray(total), pa.int64())]
    return pa.RecordBatch.from_arrays(
        [numbers[0], term, numbers[1], numbers[2], heads, sky, body], ["shard", "term", "df", "total", "heads", "sky", "body"])


def undominated(block: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Postings that no other of their block beats in both frequency and shortness, one of each equal pair, by block.

    In the order of falling frequency these are the ones with shorter and shorter documents."""
    if int(block[-1]) < 1 << 21 and int(tf.max()) < 1 << 10 and int(n.max()) < 1 << 32:
        order = np.argsort(block << 42 | ((1 << 10) - tf) << 32 | n)
    else:
        order = np.lexsort((n, -tf, block))
    size = n[order] - (block[order] << 33)  # every block is below all before it
    least = np.minimum.accumulate(size)
    return order[np.flatnonzero(np.concatenate([[True], least[1:] < least[:-1]]))]


INDEX = "shard long, term string, df long, total long, heads binary, sky binary, body binary"


def index(docs: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """The index rows of all documents. The row with an empty term counts the shard's documents with terms (``df``) and all terms (``total``)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, shard = TaskContext.get().partitionId(), 0, Shard()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                c = b.slice(k, 256)
                for i, text in zip(c.column(0).to_pylist(), c.column(1).to_pylist()):
                    shard.add(i, text)
                    if shard.bytes >= cfg.shard_bytes or len(shard.ids) >= 1 << 16:
                        yield from shard.rows(part << 32 | made)
                        made, shard = made + 1, Shard()
                        release()
        if shard.ids:
            yield from shard.rows(part << 32 | made)
        del shard
        release()

    # an empty text holds nothing that could be found
    return docs.where("length(text) > 0").select("doc_id", "text").mapInArrow(build, INDEX)


class Postings:
    """A term's list in one shard: block maxima at once, blocks on demand."""

    def __init__(self, heads: bytes, sky: bytes, body: bytes, m: np.ndarray, docs: int, total: int):
        self.heads = np.frombuffer(heads, np.int32).reshape(-1, HEADS).astype(np.int64)
        pairs = np.frombuffer(sky, np.int32).reshape(-1, 2).astype(np.int64)
        self.body, self.m, self.open = np.frombuffer(body, np.uint8), m, {}
        self.first, self.last = self.heads[:, 0], self.heads[:, 1]
        self.most = np.maximum.reduceat(contribution(pairs[:, 0], penalties(pairs[:, 1], docs, total)), self.heads[:, 4])
        self.bound = int(self.most.max())

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and what the term gives them."""
        if (got := self.open.get(k)) is None:
            first, _, a, b, *_ = self.heads[k].tolist()
            pairs = from_varints(self.body[a:b]).reshape(-1, 2)
            doc = first + np.cumsum(pairs[:, 0])
            got = self.open[k] = doc, contribution(pairs[:, 1], self.m[doc])
        return got

    def within(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``lo`` below ``hi`` and what the term gives them."""
        a, b = np.searchsorted(self.last, lo), np.searchsorted(self.first, hi)
        if a >= b:
            return _NONE
        got = [self.block(k) for k in range(a, b)]
        doc, gain = got[0] if len(got) == 1 else map(np.concatenate, zip(*got))
        i, j = np.searchsorted(doc, (lo, hi))
        return doc[i:j], gain[i:j]

    def limits(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that may hold each document and the most it may give; 0 where no block can."""
        k = np.searchsorted(self.last, doc)
        inside = k < len(self.last)
        k = np.where(inside, k, 0)
        return k, np.where(inside & (self.first[k] <= doc), self.most[k], 0)


_NONE = np.zeros(0, np.int64), np.zeros(0, np.int64)


def best_documents(
    lists: list[tuple[int, Postings]], size: int, rank: np.ndarray, cfg: SearchConfig
) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard with the ``cfg.k`` best scores above 0, and their scores, by Block-Max MaxScore.

    ``lists`` has the weight of each term of an item and its list; ``rank`` orders documents of equal score."""
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: x[0] * x[1].bound)
    sums = np.cumsum([w * p.bound for w, p in lists])
    top, scores, beat = _NONE[0], _NONE[0], 0
    for lo in range(0, size if lists else 0, cfg.window):
        hi = min(size, lo + cfg.window)
        split = int(np.searchsorted(sums, beat))  # lists before it can't bring a document to the score to beat
        if split == len(lists):
            break
        score = np.zeros(hi - lo, np.int64)
        for w, p in lists[split:]:
            doc, gain = p.within(lo, hi)
            score[doc - lo] += w * gain
        doc = np.flatnonzero(score)
        score = score[doc]
        doc += lo
        rest = lists[:split][::-1]
        if rest and len(doc):
            # a cheap look with the bounds of whole lists, then block maxima
            some = score + sums[split - 1] >= beat
            doc, score = doc[some], score[some]
            looks = [p.limits(doc) for _, p in rest]
            most = np.stack([w * y for (w, _), (_, y) in zip(rest, looks)]) if len(doc) else np.zeros((len(rest), 0), np.int64)
            left = most.sum(0)
            blocks = [k for k, _ in looks]
            alive = np.flatnonzero(score + left >= beat)
            for j, (w, p) in enumerate(rest):
                left = left - most[j]
                at = alive[most[j, alive] > 0]
                for k in np.unique(blocks[j][at]).tolist():
                    mine = at[blocks[j][at] == k]
                    there, gain = p.block(k)
                    place = np.minimum(np.searchsorted(there, doc[mine]), len(there) - 1)
                    score[mine] += np.where(there[place] == doc[mine], w * gain[place], 0)
                alive = alive[score[alive] + left[alive] >= beat]
            doc, score = doc[alive], score[alive]
        if beat:
            some = score >= beat
            doc, score = doc[some], score[some]
        if len(doc):
            top, scores = np.concatenate([top, doc]), np.concatenate([scores, score])
            order = np.lexsort((rank[top], -scores))[: cfg.k]
            top, scores = top[order], scores[order]
            if len(top) == cfg.k:
                beat = int(scores[-1])
    return top, scores


def search(docs: DataFrame, items: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the best documents of every row of ``items``.

    A null or text without terms finds nothing and is found by nothing. Equal scores
    come in the order of doc_id, null ids last; repeated documents each take a rank,
    and so do rows of one id. Repeated items are answered each. Further columns
    don't count; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    made, index_path = scratch.write(index(docs, cfg), "index")
    n, total = made.where(F.col("term") == HEADER).agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    rows, _ = scratch.write(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    # the numbers of items are dense within a partition, so a block never has more than cfg.items of them
    asked = rows.select("item", F.expr(f"item div {cfg.items}").alias("part"), F.explode(F.regexp_extract_all(low, F.lit(f"({TERM})"), 1)).alias("term"))
    asked = asked.groupBy("part", "term", "item").agg(F.count(F.lit(1)).alias("times"))
    asked, _ = scratch.write(asked, "asked")
    terms = asked.select("term").distinct()
    weigh = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)))
    df = made.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).select("term", weigh.alias("w"))
    users = asked.groupBy("part", "term").agg(F.collect_list(F.struct("item", "times")).alias("users")).join(df, "term")
    header = asked.select("part").distinct().select(
        "part", F.lit(HEADER).alias("term"), F.array().cast("array<struct<item:bigint,times:bigint>>").alias("users"), F.lit(0).cast("long").alias("w"))
    users, _ = scratch.write(users.select("part", "term", "users", "w").unionByName(header), "users")

    def run(t: pa.Table) -> pa.Table:
        head, lists, by_item = None, [], defaultdict(list)
        for r in t.to_pylist():
            if r["term"] == HEADER:
                head = r
            else:
                lists.append(r)
        lengths, ids = np.frombuffer(head["heads"], np.int64), np.frombuffer(head["sky"], np.int64)
        absent = np.frombuffer(head["body"], np.uint8)
        m = penalties(lengths, n, total)
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, absent))] = np.arange(len(ids))
        for r in lists:
            p = Postings(r["heads"], r["sky"], r["body"], m, n, total)
            for u in r["users"]:
                by_item[u["item"]].append((r["w"] * u["times"], p))
        out = [[], [], []]
        for item, mine in by_item.items():
            doc, score = best_documents(mine, len(ids), rank, cfg)
            out[0] += [item] * len(doc)
            out[1] += [None if absent[d] else int(ids[d]) for d in doc]
            out[2] += score.tolist()
        return pa.table({"item": pa.array(out[0], pa.int64()), "doc_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    heaps = made.join(users, "term").groupBy("shard", "part").applyInArrow(run, "item long, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cfg.k)
        .join(rows.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
    )


def oracle_sql(k: int = 10) -> str:
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    found = f"unnest(regexp_extract_all({low}, '{TERM}'))"
    return f"""
WITH words AS (SELECT doc_id, {found} AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM sizes),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * nn) // l) AS m FROM sizes, whole),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {found} AS term FROM benchmark) GROUP BY item_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, whole GROUP BY term),
scores AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
 FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
