"""Guide trees by rounds of merges, for all families at once.

The linkages used here are reducible: merging two clusters that are each
other's nearest never spoils another such pair. So each round merges all of
them in all families, and the number of rounds is near the logarithm of the
family size instead of the size, unless most clusters have the same nearest one:
a family then merges few pairs in a round, up to as many rounds as it has
sequences. So the rounds of a family of at most ``TASK_CLUSTERS`` clusters are made in
one task; larger ones take rounds of all tasks until they are that small. Pairs are ordered by ``(distance, larger
label, smaller label)``; the larger label of a merge survives.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.windows import running_max, stable_rank
from seqloom.session import cpu_partitions, exchanged, materialize

#: Clusters of a family up to which its rounds are made in one task (a matrix of 8 MB).
TASK_CLUSTERS = 1024
MERGES = "family string, hi int, lo int, d double, hi_size long, lo_size long, size long, height double, level int, his array<int>, los array<int>"


def chain_order(seqs: DataFrame) -> DataFrame:
    """``(family, idx, q)``: position of each sequence in a fixed pseudo-random order, by digest of its number."""
    digest = F.conv(F.substring(F.md5(F.col("idx").cast("string")), 1, 13), 16, 10).cast("double")
    ranked = stable_rank(seqs.select("family", F.col("idx").cast("int").alias("idx")).withColumn("_h", digest), ["family"], "_h", "idx", "q")
    return ranked.select("family", "idx", "q")


def chain_distances(seqs: DataFrame) -> DataFrame:
    """Distances that make any linkage join the sequences one after another, in
    the order of ``chain_order``."""
    q = chain_order(seqs)
    n = seqs.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    x, y = q.toDF("family", "x", "qx"), q.toDF("family", "y", "qy")
    step = F.lit(1.0) / F.floor(F.col("n") * F.col("n") / 2)
    return (
        x.join(exchanged(y), "family").where("qx < qy").join(exchanged(n), "family")
        .select(
            "family", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
            (step * (F.col("qy") * (F.col("qy") - 1) / 2 + F.col("qx") + 1)).alias("d"),
        )
    )


def chained_tree(seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, members)`` of the tree that joins one sequence after another.

    What average linkage makes of ``chain_distances``, in closed form: step ``k``
    joins the sequence of rank ``k`` to all before it, at the mean of its
    distances. No loop, and no pair of sequences is formed for the nodes.
    """
    q = chain_order(seqs)
    top = running_max(q, ["family"], "q", "idx", "_top")
    before = top.select("family", (F.col("q") + 1).alias("q"), F.col("_top").alias("_was"))
    shape = q.groupBy("family").agg(F.count(F.lit(1)).alias("n"), (F.max("idx") + 1).alias("_first"))
    k = F.col("q")
    s = top.where("q > 0").join(exchanged(before), ["family", "q"]).join(exchanged(shape), "family").select(
        "family", "q", "idx", "n", (F.col("_first") + k - 1).cast("int").alias("node"),
        F.when(k == 1, F.col("_was")).otherwise((F.col("_first") + k - 2).cast("int")).alias("_chain"),
        (F.col("idx") > F.col("_was")).alias("_new_first"),
        F.round(F.lit(1.0) / F.floor(F.col("n") * F.col("n") / 2) * ((k * k - 1) / 2 + 1), 12).alias("height"),
    )
    inner = s.select(
        "family", "node", F.when(F.col("_new_first"), F.col("idx")).otherwise(F.col("_chain")).alias("left"),
        F.when(F.col("_new_first"), F.col("_chain")).otherwise(F.col("idx")).alias("right"),
        (k + 1).cast("long").alias("leaves"), "height", k.cast("int").alias("level"),
    )
    child = inner.select("family", F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("parent"),
                         (F.col("height") * 0.5).alias("dist"))
    leaves = q.select("family", F.col("idx").alias("node"), F.lit(None).cast("int").alias("left"), F.lit(None).cast("int").alias("right"),
                      F.lit(1).cast("long").alias("leaves"), F.lit(0.0).alias("height"), F.lit(0).alias("level"))
    nodes = inner.unionByName(leaves).join(exchanged(child), ["family", "node"], "left").select(
        "family", "node", "left", "right", "parent", F.coalesce("dist", F.lit(0.0)).alias("dist"), "leaves", "height", "level")
    steps = s.select("family", F.col("q").alias("_k"), "node", "_new_first")
    new_side = F.when(F.col("_new_first"), "L").otherwise("R")
    members = q.join(exchanged(steps), "family").where("q <= _k").select(
        "family", "node", F.col("idx").alias("leaf"),
        F.when(F.col("q") == F.col("_k"), new_side).otherwise(F.when(F.col("_new_first"), "R").otherwise("L")).alias("side"))
    return nodes, members


def build_trees(distances: DataFrame, linkage: str = "upgma", seqs: DataFrame | None = None):
    """Trees of all families from ``(family, a, b, d)`` with ``a < b``.

    ``seqs`` has ``(family, idx)`` of all sequences; the only one of a family is a tree of its own. Empty tables
    give empty trees. Returns ``(nodes, members)``: ``nodes`` has one row per node with its
    children, parent, branch length to the parent, leaf count, height and level;
    ``members`` lists the leaves below every inner node and their side.
    """
    if linkage not in ("upgma", "wpgma", "single"):
        raise ValueError(f"unknown linkage: {linkage}")
    leaf = F.struct(F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("height"), F.lit(0).alias("level"))
    state = distances.select(
        "family", F.col("a").cast("int"), F.col("b").cast("int"), F.col("d").cast("double"), leaf.alias("ca"), leaf.alias("cb")
    )
    state = materialize(_first_step(materialize(state, "tree-distances")), "tree-distances")
    found = state.select("family", F.explode(F.array("a", "b")).alias("leaf"))
    if seqs is not None:
        found = found.unionByName(seqs.select("family", F.col("idx").cast("int").alias("leaf")))
    where = materialize(found.distinct().withColumn("label", F.col("leaf")), "tree-leaves")
    leaves = where.select("family", "leaf")
    merges, members, rounds = [], [], 0
    hi_side, lo_side = ("L", "R") if linkage != "single" else ("R", "L")
    while not state.isEmpty():
        if rounds % 4 == 0:
            few = state.groupBy("family").agg(F.count(F.lit(1)).alias("_k")).where(
                F.col("_k") <= TASK_CLUSTERS * (TASK_CLUSTERS - 1) // 2).select("family")
            few = materialize(few, "tree-few")
            m = materialize(_rounds_in_tasks(state.join(exchanged(few), "family", "left_semi"), linkage), "tree-merges")
            merged = F.struct("size", "height", "level").alias("merged")
            merges.append(m.select("family", "hi", "lo", "d", "hi_size", "lo_size", merged))
            olds = m.select("family", F.explode(F.array(
                F.struct(F.col("his").alias("olds"), F.lit(hi_side).alias("side")), F.struct(F.col("los").alias("olds"), F.lit(lo_side).alias("side")),
            )).alias("o"), F.col("hi").alias("label"), "size").select("family", F.explode("o.olds").alias("old"), "o.side", "label", "size")
            at = where.select("family", "leaf", F.col("label").alias("old"))
            members.append(at.join(exchanged(olds), ["family", "old"]).select("family", "leaf", "side", "label", "size"))
            state = state.join(exchanged(few), "family", "left_anti")
            if state.isEmpty():
                break
            state = materialize(state, "tree-distances")
        rounds += 1  # the nearest pair of every family merges in each round, so there is an end
        m = materialize(_mutual_nearest(state), "tree-merges")
        merges.append(m)
        moves = m.select("family", F.explode(F.array(
            F.struct(F.col("hi").alias("old"), F.lit(hi_side).alias("side")),
            F.struct(F.col("lo").alias("old"), F.lit(lo_side).alias("side")),
        )).alias("o"), F.col("hi").alias("new"), F.col("merged").alias("c")).select("family", "o.old", "o.side", "new", "c")
        where = where.select("family", "leaf", F.col("label").alias("old")).join(exchanged(moves), ["family", "old"], "left").select(
            "family", "leaf", F.coalesce("new", "old").alias("label"), "side", F.col("c.size").alias("size")
        )
        if rounds % 4 == 0:
            where = materialize(where, "tree-members")
        members.append(where.where("side is not null").select("family", "leaf", "side", "label", "size"))
        state = materialize(_merge_state(state, moves, linkage), "tree-distances")
    if not merges:
        merges = [_mutual_nearest(state)]
        members = [leaves.limit(0).selectExpr("family", "leaf", "'L' as side", "leaf as label", "1L as size")]
    return _finish(reduce(DataFrame.unionByName, merges), reduce(DataFrame.unionByName, members), leaves, linkage)


def _first_step(state: DataFrame) -> DataFrame:
    """Marks the first merge of every family: ``late`` is 0 for its pair and 1 for all others.

    The first merge has its distance as it is given and averages them so; every step behind it rounds all
    distances, whether it changes them or not, so equal ones may part from the first and unequal ones meet.
    """
    order = F.struct("d", F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    first = state.groupBy("family").agg(F.min(order).alias("_q"))
    own = lambda c: F.col(c).isin(F.col("_q.hi"), F.col("_q.lo"))
    return state.join(exchanged(first), "family").withColumn("late", (~(own("a") & own("b"))).cast("int")).withColumn(
        "d", F.when(own("a") | own("b"), F.col("d")).otherwise(F.round("d", 12))).drop("_q")


def _rounded(x: np.ndarray) -> np.ndarray:
    """12 digits, halves up as the engine rounds them."""
    scaled = x * 1e12
    out = np.rint(scaled) / 1e12
    for k in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 0.01)):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal("1e-12"), ROUND_HALF_UP))
    return out


def _rounds_in_tasks(state: DataFrame, linkage: str) -> DataFrame:
    """All merges of whole families: the rounds of ``_mutual_nearest`` and ``_merge_state`` on a matrix per family.

    Gives the columns of ``MERGES``; ``his`` and ``los`` are the clusters of ``state`` that went into both sides."""

    def merged(family, col):
        labels, at = np.unique(np.concatenate([col["a"], col["b"]]), return_inverse=True)
        n, a, b = len(labels), at[: len(col["a"])], at[len(col["a"]) :]
        size, height, level = np.ones(n), np.zeros(n), np.zeros(n, int)
        for k, c in ((a, "a"), (b, "b")):
            size[k], height[k], level[k] = col[f"size_{c}"], col[f"height_{c}"], col[f"level_{c}"]
        d, late = col["d"], col["late"]
        low = np.full((n, n), np.inf)
        shown = np.where(late == 0, d, _rounded(d))
        for x, y in ((a, b), (b, a)):
            np.minimum.at(low, (x, y), shown)
        first = np.zeros((n, n), bool)
        first[a[late == 0], b[late == 0]] = first[b[late == 0], a[late == 0]] = True
        # sums and numbers of the distances of each pair, which may be listed more than once at the start
        total, times, least = np.zeros((n, n)), np.zeros((n, n)), np.full((n, n), np.inf)
        for x, y in ((a, b), (b, a)):
            np.add.at(total, (x, y), d)
            np.add.at(times, (x, y), 1.0)
            np.minimum.at(least, (x, y), d)
        parts = [[int(x)] for x in labels]
        out = []
        while n > 1:
            near = np.argmin(np.where(first, -np.inf, low), axis=1)
            own = np.arange(n)
            fine = np.isfinite(low[own, near]) & (near[near] == own) & (near < own)
            hi, lo = own[fine], near[fine]
            if not len(hi):
                break
            for x, y in zip(hi, lo):
                at_d = low[x, y]
                up = (int(size[x] + size[y]), float(max(at_d, height[x], height[y])), int(max(level[x], level[y]) + 1))
                out.append((family, int(labels[x]), int(labels[y]), float(at_d), int(size[x]), int(size[y]), *up, parts[x], parts[y]))
            weight = size[:, None] * size[None, :] if linkage == "upgma" else np.ones((n, n))
            s, w = weight * total, weight * times
            for m in (s, w):
                m[hi] += m[lo]
                m[:, hi] += m[:, lo]
            least[hi] = np.minimum(least[hi], least[lo])
            least[:, hi] = np.minimum(least[:, hi], least[:, lo])
            for x, y, row in zip(hi, lo, out[len(out) - len(hi) :]):
                size[x], height[x], level[x], parts[x] = *row[6:9], row[9] + row[10]
            keep = np.ones(n, bool)
            keep[lo] = False
            s, w, least = (m[np.ix_(keep, keep)] for m in (s, w, least))
            labels, size, height, level = labels[keep], size[keep], height[keep], level[keep]
            parts, n = [x for x, k in zip(parts, keep) if k], int(keep.sum())
            there = w > 0
            there[np.arange(n), np.arange(n)] = False
            new = np.triu(_rounded(np.where(there, least if linkage == "single" else s / np.where(there, w, 1.0), 0.0)))
            total, times = new + new.T, there.astype(float)
            low = np.where(there, total, np.inf)
            least, first = low.copy(), np.zeros((n, n), bool)
        return out

    def run(batches):
        names = [c.split()[0] for c in MERGES.split(", ")]
        family, held = None, []
        whole = lambda: merged(family, {c: np.concatenate([h[c] for h in held]) for c in held[0]})
        for pdf in batches:
            out, ids = [], pdf.pop("family").to_numpy()
            cols = {c: pdf[c].to_numpy() for c in pdf}
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else []
            for lo, hi in zip(starts, [*starts[1:], len(ids)]):
                if held and ids[lo] != family:
                    out, held = out + whole(), []
                family = ids[lo]
                held.append({c: v[lo:hi] for c, v in cols.items()})
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(whole(), columns=names)

    of = lambda c: [F.col(f"c{c}.{x}").alias(f"{x}_{c}") for x in ("size", "height", "level")]
    # by a hash, as an exchange equal to that of the join before it is left out, and the join's own one is made of few tasks
    return state.select("family", "a", "b", "d", "late", *of("a"), *of("b")).repartition(
        cpu_partitions(state), F.xxhash64("family")).sortWithinPartitions("family").mapInPandas(run, MERGES)


def _mutual_nearest(state: DataFrame) -> DataFrame:
    """Cluster pairs that are each other's nearest."""
    d = F.when(F.col("late") == 0, F.col("d")).otherwise(F.round("d", 12)).alias("d")
    pair = F.struct("late", d, F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    near = state.select("family", F.explode(F.array("a", "b")).alias("c"), pair.alias("q"),
                        F.when(F.col("a") > F.col("b"), F.col("ca")).otherwise(F.col("cb")).alias("chi"),
                        F.when(F.col("a") > F.col("b"), F.col("cb")).otherwise(F.col("ca")).alias("clo"))
    best = near.groupBy("family", "c").agg(F.min(F.struct("q", "chi", "clo")).alias("m"))
    both = best.groupBy("family", "m").agg(F.count(F.lit(1)).alias("k")).where("k = 2")
    hi, lo = F.col("m.chi"), F.col("m.clo")
    height = F.greatest(F.col("m.q.d"), hi["height"], lo["height"])
    merged = F.struct(
        (hi["size"] + lo["size"]).alias("size"), height.alias("height"),
        (F.greatest(hi["level"], lo["level"]) + 1).alias("level"),
    )
    return both.select(
        "family", F.col("m.q.hi").alias("hi"), F.col("m.q.lo").alias("lo"), F.col("m.q.d").alias("d"),
        hi["size"].alias("hi_size"), lo["size"].alias("lo_size"), merged.alias("merged"),
    )


def _merge_state(state: DataFrame, moves: DataFrame, linkage: str) -> DataFrame:
    ma = moves.select("family", F.col("old").alias("a"), F.col("new").alias("na"), F.col("c").alias("nca"))
    mb = moves.select("family", F.col("old").alias("b"), F.col("new").alias("nb"), F.col("c").alias("ncb"))
    j = state.join(exchanged(ma), ["family", "a"], "left").join(exchanged(mb), ["family", "b"], "left").select(
        "family", F.coalesce("na", "a").alias("x"), F.coalesce("nb", "b").alias("y"), "d",
        (F.col("ca.size") * F.col("cb.size")).alias("w"),
        F.coalesce("nca", "ca").alias("cx"), F.coalesce("ncb", "cb").alias("cy"),
    ).where("x <> y")
    swap = F.col("x") > F.col("y")
    j = j.select(
        "family", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d", "w",
        F.when(swap, F.col("cy")).otherwise(F.col("cx")).alias("ca"),
        F.when(swap, F.col("cx")).otherwise(F.col("cy")).alias("cb"),
    )
    # rounded, so that equal distances stay equal in whatever order they are added
    d = {
        "upgma": F.sum(F.col("w") * F.col("d")) / F.sum("w"),
        "wpgma": F.avg("d"),
        "single": F.min("d"),
    }[linkage]
    return j.groupBy("family", "a", "b").agg(
        F.round(d, 12).alias("d"), F.first("ca").alias("ca"), F.first("cb").alias("cb")).withColumn("late", F.lit(1))


def _finish(merges: DataFrame, members: DataFrame, leaves: DataFrame, linkage: str):
    w = Window.partitionBy("family").orderBy("merged.height", "merged.level", "hi", "lo")
    first = leaves.groupBy("family").agg((F.max("leaf") + 1).alias("_first"))
    m = merges.join(exchanged(first), "family").select(
        "family", (F.col("_first") + F.row_number().over(w) - 1).cast("int").alias("node"),
        "hi", "lo", "hi_size", "lo_size", "merged", "d",
    )
    m = materialize(m, "tree-nodes")
    ids = m.select("family", F.col("hi").alias("label"), F.col("merged.size").alias("size"), "node")
    edges = m.select(
        "family", F.col("node").alias("parent"), F.col("merged.height").alias("_h"),
        F.explode(F.array(
            F.struct(F.col("hi").alias("label"), F.col("hi_size").alias("size"), F.lit(0).alias("o")),
            F.struct(F.col("lo").alias("label"), F.col("lo_size").alias("size"), F.lit(1).alias("o")),
        )).alias("c"),
    ).select("family", "parent", "_h", "c.label", "c.size", F.col("c.o").alias("o"))
    child = edges.join(exchanged(ids), ["family", "label", "size"], "left").select(
        "family", "parent", F.when(F.col("size") == 1, F.col("label")).otherwise(F.col("node")).alias("node"),
        (F.col("_h") * 0.5).alias("dist"), "o",
    )
    swap = 1 if linkage == "single" else 0
    kids = child.groupBy("family", F.col("parent").alias("node")).agg(
        F.max(F.when(F.col("o") == swap, F.col("node"))).alias("left"),
        F.max(F.when(F.col("o") == 1 - swap, F.col("node"))).alias("right"),
    )
    inner = m.select("family", "node", F.col("merged.size").alias("leaves"), F.col("merged.height").alias("height"),
                     F.col("merged.level").alias("level"))
    every = inner.unionByName(leaves.select(
        "family", F.col("leaf").alias("node"), F.lit(1).cast("long").alias("leaves"), F.lit(0.0).alias("height"),
        F.lit(0).alias("level"),
    ))
    nodes = every.join(exchanged(child.select("family", "node", "parent", "dist")), ["family", "node"], "left").join(
        exchanged(kids), ["family", "node"], "left"
    ).select("family", "node", "left", "right", "parent", F.coalesce("dist", F.lit(0.0)).alias("dist"), "leaves", "height", "level")
    below = members.join(exchanged(ids), ["family", "label", "size"]).select("family", "node", "leaf", "side")
    return nodes, below


def path_weights(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Unnormalised weight of each leaf: branch length over leaf count, summed
    along its path below the root."""
    part = F.when(F.col("parent").isNotNull(), F.col("dist") / F.col("leaves")).otherwise(F.lit(0.0))
    v = nodes.select("family", "node", part.alias("_w"))
    on_path = members.select("family", "node", "leaf").unionByName(
        nodes.where("level = 0").select("family", "node", F.col("node").alias("leaf"))
    )
    return on_path.join(exchanged(v), ["family", "node"]).groupBy("family", "leaf").agg(F.sum("_w").alias("w"))


def normalise_weights(weights: DataFrame, value: str = "w", floor: float | None = None) -> DataFrame:
    """Weights divided by their sum per family; equal when the sum is zero.
    ``floor`` raises small weights after the division."""
    total = weights.groupBy("family").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    w = F.when(F.col("_s") == 0, F.lit(1.0) / F.col("_n")).otherwise(F.col(value) / F.col("_s"))
    w = F.greatest(w, F.lit(floor)) if floor is not None else w
    return weights.join(exchanged(total), "family").withColumn("weight", w).drop("_s", "_n")


def integer_weights(weights: DataFrame, value: str = "w", scale: int = 1000) -> DataFrame:
    """Weights as integers: hundredths cut off, scaled to a sum near ``scale``,
    at least 1; all equal when every weight is cut to zero."""
    i = weights.withColumn("_i", (F.lit(100) * F.col(value)).cast("long"))
    total = i.groupBy("family").agg(F.sum("_i").alias("_s"), F.count(F.lit(1)).alias("_n"))
    one = F.when(F.col("_s") == 0, F.lit(1)).otherwise(F.col("_i"))
    s = F.when(F.col("_s") == 0, F.col("_n")).otherwise(F.col("_s"))
    out = F.greatest(F.floor(one * F.lit(scale) / s).cast("long"), F.lit(1).cast("long"))
    return i.join(exchanged(total), "family").withColumn("int_weight", out).drop("_i", "_s", "_n")


def leaf_pairs(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Lowest common ancestor of all leaf pairs ``a < b``, the leaf count below
    it and the number of branches between the leaves.

    Each pair meets at exactly one node, where its leaves are on two sides, so
    the join makes every pair once.
    """
    left = members.where("side = 'L'").select("family", "node", F.col("leaf").alias("_l"))
    right = members.where("side = 'R'").select("family", "node", F.col("leaf").alias("_r"))
    info = nodes.select("family", "node", "leaves", "level")
    pairs = left.join(exchanged(right), ["family", "node"]).join(exchanged(info), ["family", "node"])
    return pairs.select(
        "family", F.least("_l", "_r").alias("a"), F.greatest("_l", "_r").alias("b"), "node",
        F.col("leaves").alias("subtree"), "level",
    )


def branch_distances(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Number of branches between all leaf pairs."""
    # inner nodes below and including each ancestor, along the path of a leaf
    path = Window.partitionBy("family", "leaf").orderBy("leaves").rowsBetween(Window.unboundedPreceding, 0)
    steps = members.join(exchanged(nodes.select("family", "node", "leaves")), ["family", "node"]).select(
        "family", "leaf", "node", F.count(F.lit(1)).over(path).alias("_up")
    )
    p = leaf_pairs(nodes, members)
    sa = steps.select("family", F.col("leaf").alias("a"), "node", F.col("_up").alias("_ua"))
    sb = steps.select("family", F.col("leaf").alias("b"), "node", F.col("_up").alias("_ub"))
    return p.join(exchanged(sa), ["family", "a", "node"]).join(exchanged(sb), ["family", "b", "node"]).select(
        "family", "a", "b", (F.col("_ua") + F.col("_ub")).cast("int").alias("branches")
    )


def merge_orders(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Merge steps, children before parents, with the leaves of both sides."""
    sides = members.groupBy("family", "node").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == "L", F.col("leaf")))).alias("left_leaves"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "R", F.col("leaf")))).alias("right_leaves"),
    )
    w = Window.partitionBy("family").orderBy("node")
    return nodes.where("level > 0").join(exchanged(sides), ["family", "node"]).select(
        "family", F.row_number().over(w).alias("step"), "node", "left", "right", "left_leaves", "right_leaves"
    )


def selectivity_distances(pairs: DataFrame, seqs_n: DataFrame, mode: str, selectivity: float = 200.0) -> DataFrame:
    """Distance used to accept third sequences: leaf count under the common
    ancestor, pair distance, or random seed sequences."""
    if mode == "subtree":
        return pairs.select("family", "a", "b", F.col("subtree").cast("double").alias("sel"))
    if mode == "similarity":
        return pairs.select("family", "a", "b", F.col("d").cast("double").alias("sel"))
    if mode == "seed":
        from seqloom.functions.draws import twister_stream

        # outputs beyond the largest multiple of n are drawn again
        count = int(selectivity)
        raws = F.array(*[F.lit(v).cast("long") for v in twister_stream(4 * count + 64)])
        fair = F.filter(raws, lambda g: F.floor(g / F.col("n")) < F.floor(F.lit(4294967295) / F.col("n")))
        drawn = F.slice(fair, 1, count)
        enough = F.when(F.size(drawn) == count, drawn).otherwise(F.raise_error(F.lit("the stream of random numbers ran out")))
        seeds = seqs_n.select("family", F.transform(enough, lambda g: g % F.col("n")).alias("_seeds"))
        hit = F.array_contains("_seeds", F.col("a").cast("long")) | F.array_contains("_seeds", F.col("b").cast("long"))
        return pairs.join(exchanged(seeds), "family").select(
            "family", "a", "b", F.when(hit, F.lit(0.0)).otherwise(F.lit(3.4028234663852886e38)).alias("sel")
        )
    raise ValueError(f"unknown selectivity mode: {mode}")
