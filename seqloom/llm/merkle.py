"""Merkle manifest of a dataset and proofs for many of its rows at once.

A row is a leaf; the leaves of a source, in order of their ids, form a tree whose
nodes have sixteen children, and the trees' roots, in order of the sources, form
the top tree. The manifest is the table of leaves with their places and the
table of the nodes above them, built level by level with one exchange each.

Proofs are made as an octopus multiproof: consecutive leaves are dealt into
partitions of bounded size, cut between aligned runs; every partition works out
the coordinates ``(tree, level, place)`` of exactly those nodes that its leaves'
proofs need and that its leaves don't give themselves, fetches them in one join,
derives the nodes its leaves share once, and expands the proofs of its leaves.
"""

from __future__ import annotations

import hashlib
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch

ARITY_BITS = 4
ARITY = 1 << ARITY_BITS
#: Levels of an aligned run of leaves that stays in one partition; a partition has less than twice as many leaves.
RUN_LEVELS = 3
RUN_BITS = ARITY_BITS * RUN_LEVELS
#: The number of the tree over the sources.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Manifest:
    """``leaves``: tree, idx, n (leaves of the tree), block, digest, doc_id, tampered.
    ``nodes``: tree, level, idx, n (nodes of that level), digest, of the levels above the leaves and of
    the whole top tree. ``root`` is null for an empty table; ``trees`` is the number of sources."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None
    trees: int
    scratch: Scratch


def _field(value: Column) -> Column:
    v = value.cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: every field with its size in bytes, so that no two rows read alike."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


def tampers(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def numbered(df: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with its place ``_n`` (from 0) in the order of ``keys``.

    One range exchange; only the row count of every partition meets in one place.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows, _ = scratch.write(rows, name)
    part = F.shiftright("_at", 33).alias("_part")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_part", part).join(sizes, "_part")
    return rows.withColumn("_n", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def _raised(level: DataFrame, k: int) -> DataFrame:
    """The nodes of level ``k + 1`` from those of level ``k``; a group has at most sixteen rows."""
    children = F.array_sort(F.collect_list(F.struct("idx", "digest")))
    return (
        level.where("n > 1").groupBy("tree", "n", F.shiftright("idx", ARITY_BITS).alias("up")).agg(children.alias("c"))
        .select("tree", F.lit(k + 1).alias("level"), F.col("up").alias("idx"),
                F.shiftright(F.col("n") + (ARITY - 1), ARITY_BITS).alias("n"),
                F.sha2(F.concat_ws("", F.col("c.digest")), 256).alias("digest"))
    )


def _levels(level: DataFrame, most: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """All levels above ``level`` of trees of at most ``most`` leaves."""
    out, k = [], 0
    while most > 1:
        level, _ = scratch.write(_raised(level, k), f"{name}-{k + 1}")
        out.append(level)
        k, most = k + 1, -(-most // ARITY)
    return out


def _union(frames: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.limit(0)
    for f in frames:
        out = out.unionByName(f)
    return out


def build(docs: DataFrame) -> Manifest:
    """The manifest of ``docs``.

    Null fields are ``-`` in a leaf; a null source is a source of its own, the
    first. Within a source null ids come first, and rows of one id are in the
    order of their digests; repeated rows are leaves of their own. Further
    columns don't count. An empty table has no root.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    f = {c: docs[c] for c in FIELDS}
    low = F.translate(f["text"], string.ascii_uppercase, string.ascii_lowercase)
    slim = docs.select(
        F.coalesce(F.concat(F.lit("s"), f["source"]), F.lit("")).alias("key"), f["doc_id"].alias("doc_id"),
        leaf_digest([f[c] for c in FIELDS]).alias("digest"),
        F.when(tampers(f["doc_id"]), leaf_digest([*(f[c] for c in FIELDS[:-1]), low])).alias("tampered"),
        # tells repeated rows apart, so that any number of them spreads over the partitions of the range exchange
        F.monotonically_increasing_id().alias("row"),
    )
    slim, slim_path = scratch.write(slim, "digests")
    leaves = numbered(slim, ["key", "doc_id", "digest", "row"], scratch, "ordered")
    sources, _ = scratch.write(leaves.groupBy("key").agg(F.min("_n").alias("start"), F.count(F.lit(1)).alias("n")), "sources")
    trees, most = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    sources = numbered(sources, ["start"], scratch, "trees").withColumnRenamed("_n", "tree")
    run = F.shiftleft(F.shiftright("idx", RUN_BITS), RUN_BITS)
    leaves = (
        leaves.join(sources, "key").withColumn("idx", F.col("_n") - F.col("start"))
        .select("tree", "idx", "n", F.shiftright(F.col("start") + run, RUN_BITS).alias("block"), "digest", "doc_id", "tampered")
    )
    leaves, _ = scratch.write(leaves, "leaves")
    scratch.drop(slim_path)
    ground = leaves.select("tree", F.lit(0).alias("level"), "idx", "n", "digest")
    levels = _levels(ground, most, scratch, "level")
    roots = _union([x.where("n = 1") for x in [ground, *levels]], ground)
    top = roots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("n"), "digest"
    )
    top, _ = scratch.write(top, "top-0")
    above = [top, *_levels(top, trees, scratch, "top")]
    last = above[-1].first()
    return Manifest(leaves, _union([*levels, *above], ground), last["digest"] if last else None, trees, scratch)


def digest_of(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _own_levels(tree: np.ndarray, idx: np.ndarray, n: np.ndarray, trees: int):
    """The nodes that leaves lead to, level by level: ``(tree, level, idx, n)`` arrays of nodes that have siblings or a parent.

    The trees of the sources first, then the top tree."""
    sources = np.unique(tree)
    for level_of, count in (((tree, idx), n), ((np.full(len(sources), TOP), sources), np.full(len(sources), trees))):
        (t, i), m, level = level_of, count, 0
        while True:
            go = m > 1
            t, i, m = t[go], i[go], m[go]
            if not len(t):
                break
            order = np.lexsort((i, t))
            t, i, m = t[order], i[order], m[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1])
            t, i, m = t[new], i[new], m[new]
            yield t, level, i, m
            i, m, level = i >> ARITY_BITS, -(-m // ARITY), level + 1


def missing(tree: np.ndarray, idx: np.ndarray, n: np.ndarray, trees: int) -> list[tuple[int, int, int]]:
    """Coordinates of the nodes beside the paths of the leaves that no path contains: the fewest a verifier needs."""
    out = []
    for t, level, i, m in _own_levels(tree, idx, n, trees):
        have = set(zip(t.tolist(), i.tolist()))
        for a, first, size in sorted({(a, b >> ARITY_BITS << ARITY_BITS, c) for a, b, c in zip(t.tolist(), i.tolist(), m.tolist())}):
            out += [(a, level, j) for j in range(first, min(first + ARITY, size)) if (a, j) not in have]
    return out


class Paths:
    """What a partition knows of the trees: the nodes above its leaves, derived once, and the siblings on every path."""

    def __init__(self, tree, idx, n, digests, fetched: dict[tuple[int, int, int], str], trees: int):
        self.known = dict(fetched)
        self.size: dict[tuple[int, int], int] = {}
        self.trees = trees
        for a, b, c, d in zip(tree.tolist(), idx.tolist(), n.tolist(), digests):
            self.known[a, 0, b] = d
            self.size[a, 0] = c
        self.size[TOP, 0] = trees
        self.paths: dict[tuple[int, int, int], tuple] = {}
        done = set()
        for t, level, i, m in _own_levels(tree, idx, n, trees):
            if TOP not in done and (t == TOP).any():
                done.add(TOP)
                self._roots(tree)
            for a, run, c in sorted(set(zip(t.tolist(), (i >> ARITY_BITS).tolist(), m.tolist()))):
                self.size[a, level] = c
                self.known[a, level + 1, run] = digest_of(self.children(a, level, run))
                self.size[a, level + 1] = -(-c // ARITY)
        if TOP not in done:
            self._roots(tree)

    def _roots(self, tree) -> None:
        for a in np.unique(tree).tolist():
            self.known[TOP, 0, a] = self.known[a, self.height(a), 0]

    def height(self, tree: int) -> int:
        level = 0
        while self.size[tree, level] > 1:
            level += 1
        return level

    def children(self, tree: int, level: int, run: int) -> list[str]:
        first = run << ARITY_BITS
        return [self.known[tree, level, j] for j in range(first, min(first + ARITY, self.size[tree, level]))]

    def siblings(self, tree: int, level: int, i: int) -> tuple[list[str], list[str]]:
        c = self.children(tree, level, i >> ARITY_BITS)
        at = i & (ARITY - 1)
        return c[:at], c[at + 1 :]

    def path(self, tree: int, level: int, i: int) -> tuple:
        """``((before, after), ...)`` of a node that isn't a leaf up to the root: digests before and after it, level by level."""
        key = tree, level, i
        if (got := self.paths.get(key)) is not None:
            return got
        if self.size[tree, level] > 1:
            before, after = self.siblings(tree, level, i)
            out = (("".join(before), "".join(after)), *self.path(tree, level + 1, i >> ARITY_BITS))
        else:
            out = () if tree == TOP else self.path(TOP, 0, tree)
        self.paths[key] = out
        return out

    def leaf_path(self, tree: int, i: int) -> tuple:
        if self.size[tree, 0] == 1:
            return self.path(TOP, 0, tree)
        before, after = self.siblings(tree, 0, i)
        return (("".join(before), "".join(after)), *self.path(tree, 1, i >> ARITY_BITS))

    def root(self) -> str:
        return self.known[TOP, self.height(TOP), 0]


def fold(digest: str, path: tuple) -> str:
    """The root that follows from a leaf and the siblings on its path."""
    for before, after in path:
        digest = hashlib.sha256(f"{before}{digest}{after}".encode()).hexdigest()
    return digest


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(made: Manifest, wanted: DataFrame | None = None, with_siblings: bool = False) -> DataFrame:
    """Proofs of the leaves in ``wanted`` (rows of ``made.leaves``; all, if None), checked with what
    stands in ``tampered``, else with the leaf itself.

    A row per leaf: doc_id, leaf, subroot, root, proof_sha256 (of all siblings, leaf to root and left to
    right), folded_root and verified; ``with_siblings`` adds their list as ``siblings``.
    """
    root, trees = made.root, made.trees
    leaves = made.leaves if wanted is None else wanted
    # a partition of all leaves has whole runs, so it asks for no leaf
    nodes = made.nodes if wanted is None else made.nodes.unionByName(
        made.leaves.select("tree", F.lit(0).alias("level"), "idx", "n", "digest"))

    def asks(t: pa.Table) -> pa.Table:
        tree, idx, n = (t.column(c).to_numpy() for c in ("tree", "idx", "n"))
        rows = missing(tree, idx, n, trees)
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.table({
            "block": pa.array([t.column("block")[0].as_py()] * len(rows), pa.int64()), "tree": pa.array(cols[0], pa.int64()),
            "level": pa.array(cols[1], pa.int32()), "idx": pa.array(cols[2], pa.int64()),
        })

    schema = PROOF + (", siblings array<string>" if with_siblings else "")

    def expand(t: pa.Table, got: pa.Table) -> pa.Table:
        tree, idx, n = (t.column(c).to_numpy() for c in ("tree", "idx", "n"))
        digests, tampered = t.column("digest").to_pylist(), t.column("tampered").to_pylist()
        fetched = {(r["tree"], r["level"], r["idx"]): r["digest"] for r in got.to_pylist()}
        p = Paths(tree, idx, n, digests, fetched, trees)
        whole, proofs, folded, subroots, lists = p.root(), [], [], [], []
        for a, i, d, bad in zip(tree.tolist(), idx.tolist(), digests, tampered):
            path = p.leaf_path(a, i)
            text = "".join([x for pair in path for x in pair])
            proofs.append(hashlib.sha256(text.encode()).hexdigest())
            # of an original leaf the fold is the derivation of its partition
            folded.append(whole if bad is None or bad == d else fold(bad, path))
            subroots.append(p.known[TOP, 0, a])
            if with_siblings:
                lists.append([text[k : k + 64] for k in range(0, len(text), 64)])
        out = {
            "doc_id": t.column("doc_id"), "leaf": pa.array(digests, pa.string()), "subroot": pa.array(subroots, pa.string()),
            "root": pa.array([root] * len(digests), pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root for x in folded], pa.bool_()),
        }
        if with_siblings:
            out["siblings"] = pa.array(lists, pa.list_(pa.string()))
        return pa.table(out)

    needs = leaves.select("block", "tree", "idx", "n").groupBy("block").applyInArrow(asks, "block long, tree long, level int, idx long")
    fetched = needs.join(nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])
    fetched, _ = made.scratch.write(fetched.select("block", "tree", "level", "idx", "digest"), "fetched")
    return leaves.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(expand, schema)


def manifest_report(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of every row of ``docs``, and whether it still verifies after tampering with every fifth."""
    return prove(build(docs))


def oracle_sql(levels: int = 5) -> str:
    """The same rows in SQL, for sources of at most ``16 ** levels`` rows and as many sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, FIELDS[:-1]), field(text)]) + ")"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    bits = "list_reduce(list_prepend(xor(c, b), [0::BIGINT,0,0,0,0,0,0,0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), "
        f"lambda c, b: xor({bits.replace('xor(c, b)', '(xor(c, b) & 255)')}, c >> 8)), 4294967295)"
    )
    parts = [
        f"digests AS (SELECT doc_id, source, {leaf('text')} AS digest, CASE WHEN coalesce({crc} % 5 = 0, false) THEN {leaf(low)} END AS tampered FROM documents)",
        "s0 AS (SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, doc_id, digest, tampered FROM digests)",
    ]

    def climb(p: str) -> None:
        for k in range(levels):
            parts.append(
                f"{p}{k + 1} AS (SELECT tree, idx // 16 AS idx, CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE min(digest) END AS digest "
                f"FROM (SELECT tree, idx, digest, count(*) OVER (PARTITION BY tree) AS n FROM {p}{k}) GROUP BY tree, idx // 16)"
            )
            parts.append(
                f"{p}b{k} AS (SELECT a.tree, a.idx, a.n, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS pre, "
                f"coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS post "
                f"FROM (SELECT tree, idx, count(*) OVER (PARTITION BY tree) AS n FROM {p}{k}) a JOIN {p}{k} b "
                f"ON a.tree = b.tree AND a.idx // 16 = b.idx // 16 GROUP BY a.tree, a.idx, a.n)"
            )

    climb("s")
    parts.append(f"t0 AS (SELECT 0 AS tree, tree AS idx, digest FROM s{levels})")
    climb("t")
    steps = [("s", k) for k in range(levels)] + [("t", k) for k in range(levels)]
    parts.append("f0 AS (SELECT doc_id, tree, idx, digest AS leaf, coalesce(tampered, digest) AS cur, '' AS proof FROM s0)")
    for j, (p, k) in enumerate(steps):
        on = f"b.tree = f.tree AND b.idx = f.idx // {16 ** k}" if p == "s" else f"b.idx = f.tree // {16 ** k}"
        parts.append(
            f"f{j + 1} AS (SELECT f.doc_id, f.tree, f.idx, f.leaf, CASE WHEN b.n > 1 THEN sha256(b.pre || f.cur || b.post) ELSE f.cur END AS cur, "
            f"f.proof || b.pre || b.post AS proof FROM f{j} f JOIN {p}b{k} b ON {on})"
        )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT f.doc_id, f.leaf, t0.digest AS subroot, r.digest AS root, sha256(f.proof) AS proof_sha256, "
        f"f.cur AS folded_root, f.cur = r.digest AS verified FROM f{len(steps)} f JOIN t0 ON t0.idx = f.tree CROSS JOIN t{levels} r"
    )
