"""Best-fit packing of documents into sequences of fixed length.

Lengths are whole numbers up to the capacity, so documents and gaps sorted by
size are runs of equal values, and there are never more runs than the capacity
has values. A round takes the longest run of documents that is not placed yet
and sweeps over the gap runs from its successor, the smallest gap that holds
it: the k-th document of the run gets the k-th gap (its rank resolves every
conflict), gaps are updated, and runs that are split go on as two. Where no gap
is large enough, new sequences are opened for the rest of the run. All documents
of a run move at once, so the number of rounds depends on the capacity alone.

Ranks of documents, of which there are many, are found in Spark: counts per
length and block of ids, and numbers within a block. A place follows from the
rank, so placing is one more pass without a shuffle.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.byte_bpe import PATTERN
from seqloom.llm.common import Scratch, in_slices, pieces

CAPACITY = 2048
END = 0
#: Rows that share a length are numbered in blocks of about this many.
BLOCK_ROWS = 1 << 16
LEAST_BLOCKS = 64


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    special = {"<|endoftext|>": len(ranks)}
    return tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a whole text, special strings as special tokens, and the end id."""
    e = encoder(path)
    parts = [e.encode_to_numpy(p, allowed_special="all") for p in pieces(text)]
    return np.concatenate([*parts, np.array([END], np.uint32)]).astype("<u4")


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: documents as pieces of at most ``capacity``.

    Only the first piece of a document may be shorter than the capacity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            row, number, start, length, crc = [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = token_ids(text, path)
                short = (len(ids) - 1) % capacity + 1
                ends = range(short, len(ids) + 1, capacity)
                for j, end in enumerate(ends):
                    begin = end - (capacity if j else short)
                    row.append(k)
                    number.append(j)
                    start.append(begin)
                    length.append(end - begin)
                    crc.append(zlib.crc32(ids[begin:end].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", F.coalesce("text", F.lit(""))).mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, int], np.ndarray]:
    """Places of all ranks: the first rank of every length, and rows
    ``(first rank, number, first sequence, offset)`` in the order of the ranks.

    Ranks go from the longest to the shortest document. ``counts`` and the gap
    runs have at most ``capacity`` different values.
    """
    gaps: list[int] = []  # sizes of gaps there are, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # of sequences with that gap: first, number
    base, places, rank, sequences = {}, [], 0, 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        base[length], left = rank, counts[length]
        while left:
            k = bisect.bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[k]
            else:
                gap, first = capacity, sequences
                n = -(-left // (gap // length))
                sequences += n
            # after a document of this length the same gap may still be the best fit for the next
            each = gap // length
            full = min(n, left // each)
            for m, docs in ((full, each), (1 if full < n and left % each and left < n * each else 0, left % each)):
                if not m:
                    continue
                for t in range(docs):
                    places.append((rank, m, first, capacity - gap + t * length))
                    rank += m
                put(gap - docs * length, first, m)
                first, n, left = first + m, n - m, left - docs * m
            put(gap, first, n)
    return base, np.array(places, np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece.

    ``path`` is the vocabulary as ranks. A null text is empty: its one piece is
    the end id. Repeated rows and null ids are packed each as a document of its
    own. Further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    parts, _ = scratch.write(cut(docs, path, capacity), "pieces")
    n_blocks = max(LEAST_BLOCKS, parts.count() // BLOCK_ROWS)
    parts = parts.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_blocks)))
    counts, _ = scratch.write(parts.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n")), "counts")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    base, places = best_fit(by_length, capacity)
    plan = spark.sparkContext.broadcast((base, places))
    w = Window.partitionBy("length").orderBy("_block")
    before = counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    number = F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece"))
    ranked = parts.join(before, ["length", "_block"]).withColumn("_rank", F.col("_before") + number - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_rank, rows = plan.value
        table = np.zeros(capacity + 1, np.int64)
        table[list(first_rank)] = list(first_rank.values())
        for b in batches:
            rank = table[b.column(3).to_numpy()] + b.column(5).to_numpy()
            at = rows[np.searchsorted(rows[:, 0], rank, "right") - 1] if b.num_rows else rows[:0]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(at[:, 2] + rank - at[:, 0]), pa.array(at[:, 3])],
                [*b.schema.names[:5], "sequence_id", "offset"],
            )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "_rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
