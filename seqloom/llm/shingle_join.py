"""Jaccard self-join of documents on word shingles with signature trees.

Documents with the same set of shingles are one node. Nodes are the leaves of
signature trees: a leaf has its number of shingles and a bitmap of their
hashes; a tree node has the OR of the bitmaps below it and their range of sizes.
Two tree nodes are only opened if their sizes are compatible and the common
bits leave room for the overlap the similarity demands of the smallest leaves.

Candidates come from an order of all shingles in which frequent ones are last:
similar sets share a shingle among the first ones of both (prefix), so only
tree nodes that share such a shingle meet. The trees are cut into nodes of
bounded size, and each pair of nodes is a row of its own: no group is gathered.

Links are found in rounds, so that large groups of near copies are not compared
pair by pair: nodes with a common first shingle are compared with one anchor;
then every pair of tree nodes that still belongs to two components opens its
most promising pair of leaves; then all leaves that may be similar. A pair is
only left out if its documents are in one component already. Every link rests
on an exact comparison of the shingle sets of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch, WordHashes, blocks, in_slices, unused
from seqloom.llm.components import components

CACHE = 200_000
#: The table of frequencies has 2 ** BUCKET_BITS entries of one byte.
BUCKET_BITS = 22
SLICE_BITS = 14
#: Shingles a task gathers before it counts them.
GATHER = 2_000_000
ROWS_AT_ONCE = 512
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class JoinConfig:
    """``words`` of a shingle; ``percent``: least similarity; ``leaves`` of a tree
    node, about; ``keys``: anchors a node is compared with in the first round;
    ``broadcast_ids``: more ids than this are joined by key instead of being broadcast."""

    words: int = 3
    percent: int = 90
    leaves: int = 128
    keys: int = 3
    broadcast_ids: int = 1_000_000


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str, k: int, cache: WordHashes) -> np.ndarray:
    """Distinct hashes of the ``k``-word shingles, ascending; all words as one if they are fewer."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = max(1, len(ids) - k + 1)
    h = np.full(n, min(len(ids), k), np.uint64)
    for j in range(min(k, len(ids))):
        h = scramble(h + ids[j : j + n])
    return np.unique(h)


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def similar(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def bitmap(h: np.ndarray) -> np.ndarray:
    """Bits of the hashes: at least two bits for each, a power of two."""
    width = max(64, 1 << int(2 * len(h) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(h & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same hashes at a smaller width."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def count_bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


class TreeNode:
    """Some leaves with the OR of their bitmaps and the range of their sizes."""

    def __init__(self, leaves: list[dict]):
        self.ids = np.array([x["id"] for x in leaves], np.int64)
        self.sizes = np.array([x["n"] for x in leaves], np.int64)
        maps = [np.frombuffer(x["bits"], np.uint8) for x in leaves]
        width = min(len(m) for m in maps)
        self.maps = np.stack([folded(m, width) for m in maps])
        self.any = np.bitwise_or.reduce(self.maps, axis=0)

    def fold(self, width: int) -> TreeNode:
        if self.maps.shape[1] > width:
            self.maps, self.any = folded(self.maps, width), folded(self.any, width)
        return self


def needed(a, b, percent: int):
    """Least overlap of sets of these sizes that are similar."""
    return -(-percent * (a + b) // (100 + percent))


def meeting(x: TreeNode, y: TreeNode, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(leaf of x, leaves of y, their possible overlap beyond what is needed)`` of the pairs
    of leaves that may be similar."""
    width = min(x.maps.shape[1], y.maps.shape[1])
    x.fold(width), y.fold(width)
    # a set may have more elements than bits, by this much; they may all be common
    spare_x, spare_y = x.sizes - count_bits(x.maps), y.sizes - count_bits(y.maps)
    room = count_bits(x.any & y.any) + min(spare_x.max(), spare_y.max())
    if room < needed(x.sizes.min(), y.sizes.min(), percent):
        return
    for k in range(len(x.ids)):
        room = count_bits(x.maps[k] & y.any) + min(spare_x[k], spare_y.max())
        if room < needed(x.sizes[k], y.sizes.min(), percent):
            continue
        room = count_bits(x.maps[k][None, :] & y.maps) + np.minimum(spare_x[k], spare_y)
        room = np.minimum(room, np.minimum(x.sizes[k], y.sizes))
        beyond = room - needed(x.sizes[k], y.sizes, percent)
        hit = np.flatnonzero(beyond >= 0)
        if len(hit):
            yield k, hit, beyond[hit]


def measured(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, n, h1, h2, slice, bucket, count)``: size and digests of every document's set.

    Further rows, with a null size, have a task's counts of shingles by bucket
    for each slice of the table of frequencies: all counts of the slice as bytes,
    or only those that aren't zero with their buckets, whichever is shorter.
    """
    names = ["doc_id", "n", "h1", "h2", "slice", "bucket", "count"]

    def tally(sets: list[np.ndarray]) -> pa.RecordBatch:
        bucket, count = np.unique(bucket_of(np.concatenate(sets)), return_counts=True)
        count = np.minimum(count, 255).astype(np.uint8)
        low = (bucket & ((1 << SLICE_BITS) - 1)).astype(np.uint16)
        at = np.searchsorted(bucket >> SLICE_BITS, np.arange((1 << BUCKET_BITS - SLICE_BITS) + 1))
        held, where, counts = np.flatnonzero(at[1:] > at[:-1]), [], []
        for j in held:
            i, e = at[j], at[j + 1]
            if 3 * (e - i) < 1 << SLICE_BITS:
                where.append(low[i:e].tobytes())
                counts.append(count[i:e].tobytes())
            else:
                dense = np.zeros(1 << SLICE_BITS, np.uint8)
                dense[low[i:e]] = count[i:e]
                where.append(b"")
                counts.append(dense.tobytes())
        empty = pa.nulls(len(held), pa.int64())
        return pa.RecordBatch.from_arrays(
            [empty] * 4 + [pa.array(held.astype(np.int32)), pa.array(where, pa.binary()), pa.array(counts, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, gathered, held = WordHashes(CACHE), [], 0
        for b in in_slices(batches):
            texts = b.column(1).to_pylist()
            out = np.zeros((3, len(texts)), np.uint64)
            for i, j in blocks(texts):
                cache.age()
                for r in range(i, j):
                    h = shingles(texts[r], k, cache)
                    out[:, r] = len(h), h.sum(dtype=np.uint64), scramble(h).sum(dtype=np.uint64)
                    gathered.append(h)
                    held += len(h)
                if held > GATHER:
                    yield tally(gathered)
                    gathered, held = [], 0
            signed = out.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(np.ascontiguousarray(x)) for x in signed), pa.nulls(len(texts), pa.int32()),
                 *[pa.nulls(len(texts), pa.binary())] * 2], names)
        if gathered:
            yield tally(gathered)

    return docs.select("doc_id", F.coalesce("text", F.lit(""))).mapInArrow(
        run, "doc_id long, n long, h1 long, h2 long, slice int, bucket binary, count binary")


def bucket_of(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def level_of(count: np.ndarray, usual: float) -> np.ndarray:
    """Level of a bucket's count: how far above the usual one, in quarters of octaves of its spread."""
    above = np.maximum(count - usual, 0) / np.sqrt(usual + 1)
    return np.minimum(np.floor(4 * np.log2(1 + above)), 255).astype(np.uint8)


def frequency_levels(seen: DataFrame, usual: float) -> np.ndarray:
    """Level of frequency of every bucket.

    The table has a fixed size, whatever the number of shingles. It only orders
    them: shingles that share a bucket change no result.
    """

    def part(table):
        total = np.zeros(1 << SLICE_BITS, np.int64)
        for bucket, count in zip(table.column("bucket"), table.column("count")):
            where, n = np.frombuffer(bucket.as_buffer(), np.uint16), np.frombuffer(count.as_buffer(), np.uint8)
            if len(where):
                total[where] += n  # buckets of a row are distinct
            else:
                total += n
        return pa.table({"slice": table.column("slice")[:1], "count": pa.array([total.tobytes()], pa.binary())})

    def whole(table):
        total = np.zeros(1 << SLICE_BITS, np.int64)
        for count in table.column("count"):
            total += np.frombuffer(count.as_buffer(), np.int64)
        return pa.table({"slice": table.column("slice")[:1], "level": pa.array([level_of(total, usual).tobytes()], pa.binary())})

    levels = np.zeros((1 << BUCKET_BITS - SLICE_BITS, 1 << SLICE_BITS), np.uint8)
    rows = seen.where("slice is not null").select("slice", "bucket", "count")
    # in two steps, so that no task adds up the rows of more than about ROWS_AT_ONCE counting tasks
    salts = 1 + rows.count() // (len(levels) * ROWS_AT_ONCE)
    some = rows.withColumn("salt", F.pmod(F.xxhash64("count"), F.lit(salts))).groupBy("slice", "salt").applyInArrow(
        part, "slice int, count binary")
    for r in some.groupBy("slice").applyInArrow(whole, "slice int, level binary").collect():
        levels[r["slice"]] = np.frombuffer(r["level"], np.uint8)
    return levels.ravel()


def signatures(docs: DataFrame, levels, cfg: JoinConfig) -> DataFrame:
    """``(doc_id, n, h1, h2, bits, prefix, keys)`` of every document with a shingle.

    ``prefix`` has the shingles that a similar set must have one of, ``keys`` a
    few of the rarer half, on which near copies mostly agree.
    """
    k, percent, n_keys = cfg.words, cfg.percent, cfg.keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, level = WordHashes(CACHE), levels.value
        for b in in_slices(batches):
            texts, rows = b.column(1).to_pylist(), []
            for i, j in blocks(texts):
                cache.age()
                for r in range(i, j):
                    h = shingles(texts[r], k, cache)
                    if not len(h):
                        continue
                    of = level[bucket_of(h)]
                    order = np.argsort(of, kind="stable")
                    first = h[order[: prefix_length(len(h), percent)]]
                    some = h[order[: (len(h) + 1) // 2]]
                    keys = [int(some[np.argmin(scramble(some + np.uint64(s)))].view(np.int64)) for s in range(n_keys)]
                    rows.append((r, len(h), int(h.sum(dtype=np.uint64).view(np.int64)),
                                 int(scramble(h).sum(dtype=np.uint64).view(np.int64)),
                                 bitmap(h).tobytes(), first.tobytes(), keys))
            at, n, h1, h2, bits, prefix, keys = zip(*rows) if rows else ((),) * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (n, h1, h2)),
                 pa.array(bits, pa.binary()), pa.array(prefix, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n", "h1", "h2", "bits", "prefix", "keys"])

    return docs.select("doc_id", F.coalesce("text", F.lit(""))).mapInArrow(
        run, "doc_id long, n long, h1 long, h2 long, bits binary, prefix binary, keys array<long>")


def shared_tokens(nodes: DataFrame, levels, hot: int, parts: int) -> DataFrame:
    """``(token, id, n, room)`` of the prefix shingles that several nodes have; ``room``
    is the number of shingles from this one on, in the common order.

    A task packs its shingles for each part of the hash space; the part's
    reducer drops those of one node only. Shingles above the level ``hot``, so
    frequent that they could fill a part, are dealt out by node instead, and all kept.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for b in batches:
            sets = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
            if not sets:
                continue
            size = [len(s) for s in sets]
            token = np.concatenate(sets)
            node, n = np.repeat(b.column(0).to_numpy(), size), np.repeat(b.column(1).to_numpy().astype(np.int32), size)
            room = n - np.concatenate([np.arange(k, dtype=np.int32) for k in size])
            often = level[bucket_of(token)] >= hot
            spread = scramble(token + np.where(often, node.astype(np.uint64), np.uint64(0)))
            part = (spread % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, token, node, n, room = part[order], token[order], node[order], n[order], room[order]
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[at[:-1]].astype(np.int32)), cut(token), cut(node), cut(n), cut(room)],
                ["part", "token", "node", "n", "room"])

    def reduce(table):
        level = levels.value
        token, node, n, room = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)])
                                for c, t in (("token", np.uint64), ("node", np.int64), ("n", np.int32), ("room", np.int32)))
        order = np.argsort(token, kind="stable")
        token, node, n, room = token[order], node[order], n[order], room[order]
        same = token[1:] == token[:-1]
        keep = np.r_[same, False] | np.r_[False, same] | (level[bucket_of(token)] >= hot)
        return pa.table({"token": token[keep].view(np.int64), "id": node[keep], "n": n[keep], "room": room[keep]})

    return nodes.select("id", "n", "prefix").mapInArrow(pack, "part int, token binary, node binary, n binary, room binary").groupBy(
        "part").applyInArrow(reduce, "token long, id long, n int, room int")


def compatible(a: str, b: str, percent: int):
    """Whether ranges of sizes hold sizes of similar sets, and whether this can be
    the first shingle they share: the overlap is no larger than the shingles from
    there on. Every similar pair passes at its first common shingle."""
    first = F.least(f"{a}_room", f"{b}_room") * (100 + percent) >= (F.col(f"{a}_least") + F.col(f"{b}_least")) * percent
    return first & (F.col(f"{a}_most") * 100 >= F.col(f"{b}_least") * percent) & (
        F.col(f"{b}_most") * 100 >= F.col(f"{a}_least") * percent)


def verified(pairs: DataFrame, docs: DataFrame, cfg: JoinConfig, scratch: Scratch) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets are similar."""
    pairs, path = scratch.write(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    ids, ids_path = scratch.write(ids, "ids")
    wanted = F.broadcast(ids) if ids.count() <= cfg.broadcast_ids else ids
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    k, percent = cfg.words, cfg.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, y = WordHashes(CACHE), None, None
        for batch in in_slices(batches):
            keep = []
            a_texts, b_ids = batch.column(2), batch.column(1).to_pylist()
            for r in range(batch.num_rows):
                cache.age()
                if b_ids[r] != last:  # rows of one anchor follow each other
                    last, y = b_ids[r], shingles(batch.column(3)[r].as_py(), k, cache)
                x = shingles(a_texts[r].as_py(), k, cache)
                keep.append(similar(len(np.intersect1d(x, y, True)), len(x), len(y), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    edges, edges_path = scratch.write(both.mapInArrow(run, "a long, b long"), "verified")
    scratch.drop(path, ids_path)
    return edges


def joined(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, h1, h2)`` of every row, and ``(h1, h2, n, id, component)`` of every set."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shingles")
    percent = cfg.percent
    seen, _ = scratch.write(measured(docs, cfg.words), "measured")
    rows = seen.where("n is not null").select("doc_id", "n", "h1", "h2")
    sets = rows.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("id"))
    sets, _ = scratch.write(sets, "sets")
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), total // 10_000_000)
    usual = total / (1 << BUCKET_BITS)
    levels = spark.sparkContext.broadcast(frequency_levels(seen, usual))
    hot = max(1, int(level_of(np.float64(usual + total / (8 * parts)), usual)))
    nodes = signatures(docs, levels, cfg).withColumnRenamed("doc_id", "id").join(
        sets, ["id", "n", "h1", "h2"], "left_semi").dropDuplicates(["id"]).select("id", "n", "bits", "prefix", "keys")
    nodes, _ = scratch.write(nodes, "nodes")
    slim = nodes.select("id", "n", "bits")

    # first round: every node with the smallest node of each of its keys
    keyed = nodes.select("id", "n", F.posexplode("keys").alias("k", "key"))
    anchors = keyed.groupBy("k", "key").agg(F.min_by("id", "id").alias("b"), F.min_by("n", "id").alias("m"), F.count(F.lit(1)).alias("c"))
    fit = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    pairs = keyed.join(anchors.where("c > 1"), ["k", "key"]).where(fit & (F.col("id") != F.col("b"))).select(
        F.col("id").alias("a"), "b").distinct()
    edges = verified(pairs, docs, cfg, scratch)
    part, _ = scratch.write(shared_tokens(nodes, levels, hot, parts), "tokens")

    for last in (False, True):
        found = components(edges, scratch)
        owner = slim.join(found.withColumnRenamed("node", "id"), "id", "left").select(
            "id", "n", F.coalesce("component", "id").alias("component"))
        size = owner.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / cfg.leaves).alias("of"))
        owner = owner.join(size, "component").select(
            "id", "n", "component", F.xxhash64("component", F.pmod(F.xxhash64("id"), "of")).alias("node"))
        owner, owner_path = scratch.write(owner, "owner")
        token = part.join(owner.select("id", "component", "node"), "id").groupBy("token", "component", "node").agg(
            F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("room"))
        token, token_path = scratch.write(token, "tree")
        several = token.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        token = token.join(several.select("token"), "token", "left_semi")
        x = token.select("token", *[F.col(c).alias(f"x_{c}") for c in ("component", "node", "least", "most", "room")])
        y = token.select("token", *[F.col(c).alias(f"y_{c}") for c in ("component", "node", "least", "most", "room")])
        meet = x.join(y, "token").where("x_component < y_component").where(compatible("x", "y", percent))
        meet = meet.select("x_node", "y_node").distinct()
        meet, meet_path = scratch.write(meet, "meet")
        used = meet.select(F.col("x_node").alias("node")).unionByName(meet.select(F.col("y_node").alias("node"))).distinct()
        # a tree node has a bounded number of leaves: its component is cut by a hash
        tree = owner.join(used, "node", "left_semi").join(slim.select("id", "bits"), "id").groupBy("node").agg(
            F.collect_list(F.struct("id", "n", "bits")).alias("leaves"))
        tree, tree_path = scratch.write(tree, "trees")
        opened = meet.join(tree.select(F.col("node").alias("x_node"), F.col("leaves").alias("x")), "x_node").join(
            tree.select(F.col("node").alias("y_node"), F.col("leaves").alias("y")), "y_node").select("x", "y")

        def run(batches: Iterator[pa.RecordBatch], last=last) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches):
                a, b = [], []
                for r in range(batch.num_rows):
                    u, v = TreeNode(batch.column(0)[r].as_py()), TreeNode(batch.column(1)[r].as_py())
                    best = None
                    for k, hit, beyond in meeting(u, v, percent):
                        if last:
                            a += [int(u.ids[k])] * len(hit)
                            b += v.ids[hit].tolist()
                        elif best is None or beyond.max() > best[0]:
                            best = int(beyond.max()), int(u.ids[k]), int(v.ids[hit[beyond.argmax()]])
                    if best:
                        a.append(best[1])
                        b.append(best[2])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        more = verified(opened.mapInArrow(run, "a long, b long").distinct(), docs, cfg, scratch)
        edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        scratch.drop(owner_path, token_path, meet_path, tree_path)
    found = components(edges, scratch)
    classes = sets.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "n", "h1", "h2", "id", F.coalesce("component", "id").alias("component"))
    return rows, classes


def told_apart(docs: DataFrame, own: str, scratch: Scratch) -> tuple[DataFrame, bool]:
    """``docs`` with an id of its own for every text, and whether any id had to change.

    Of different texts that share a ``doc_id`` the one of the smallest digest keeps it; the others get numbers above
    all ids. The column ``own`` then holds the ``doc_id`` of every row.
    """
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    twice, path = scratch.write(twice, "twice")
    if twice.isEmpty():
        scratch.drop(path)
        return docs, False
    digest = F.md5(F.coalesce("text", F.lit("")))
    texts, texts_path = scratch.write(
        docs.select("doc_id", "text").join(twice, "doc_id", "left_semi").select("doc_id", digest.alias("digest")).distinct(), "texts")
    others = texts.join(texts.groupBy("doc_id").agg(F.min("digest").alias("first")), "doc_id").where("digest <> first")
    top = docs.agg(F.max("doc_id").cast("long")).first()[0] + 1
    numbered = others.orderBy("doc_id", "digest").select(
        F.col("doc_id").alias("own_id"), "digest", (F.monotonically_increasing_id() + F.lit(top)).alias("new_id"))
    numbered, _ = scratch.write(numbered, "numbered")
    scratch.drop(path, texts_path)
    if numbered.isEmpty():
        return docs, False
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), digest.alias("digest"))
    marked = marked.join(numbered, ["own_id", "digest"], "left")
    columns = [F.coalesce("new_id", "own_id").alias(c) if c == "doc_id" else F.col("row")[c].alias(c) for c in docs.columns]
    return marked.select(*columns, F.col("own_id").alias(own)), True


def links(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row.

    A null, empty or blank text has no shingles and links with nothing. Rows that
    share an id but not a text are documents of their own; a row with a null id gets the component
    of its text's set, null if no row with an id has that set. Further columns are ignored; an empty
    table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession, "apart")
    told, changed = told_apart(docs, "_own", scratch)
    if changed:
        told, _ = scratch.write(told, "told")
    rows, classes = joined(told, cfg)
    out = rows.join(classes.select("n", "h1", "h2", "component"), ["n", "h1", "h2"], "left")
    if changed:
        own = told.where("doc_id is not null").select("doc_id", "_own").distinct()
        out = out.join(own, "doc_id", "left").drop("doc_id").withColumnRenamed("_own", "doc_id")
        least = out.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
        out = out.join(least, "component", "left").withColumn("component", F.col("least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """One row of each component, that of the smallest id, with the columns of ``docs``.

    Rows without shingles or without an id all stay. Of equal texts that share an id
    one stays; different texts that share an id are documents of their own.
    """
    own = unused(docs, "_own")
    told, changed = told_apart(docs, own, Scratch(docs.sparkSession, "apart"))
    out = _representatives(told, cfg)
    if not changed:
        return out
    return out.select(*[F.col(own if c == "doc_id" else "`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns])


def _representatives(docs: DataFrame, cfg: JoinConfig) -> DataFrame:
    rows, classes = joined(docs, cfg)
    scratch = Scratch(docs.sparkSession, "kept")
    gone = rows.join(classes, ["n", "h1", "h2"]).where("doc_id is not null and component <> doc_id").select("doc_id").distinct()
    gone, _ = scratch.write(gone, "gone")
    out = docs.join(F.broadcast(gone) if gone.count() <= cfg.broadcast_ids else gone, "doc_id", "left_anti")
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns])
    named = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    named, _ = scratch.write(named, "twice")
    if named.isEmpty():
        return out
    once = out.join(named, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return out.join(named, "doc_id", "left_anti").unionByName(once.select(*[F.col(f"`{c}`") for c in docs.columns]))
