"""Rooted binary trees of all families at once: Euler tours, intervals, common ancestors, sums along paths.

A tour is a linked list of arcs, two per node, ranked by pointer doubling: every
round each arc jumps as far as its goal has come, so the rounds are the
logarithm of the nodes, whatever the shape of the tree. An arc is the goal of
one arc only, hence no round has a hot key. Places in the tour give depths,
leaf counts and intervals by running sums in blocks; the lowest common ancestor
of two leaves is the shallowest node between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.windows import prefix_sum
from seqloom.session import exchanged, materialize

#: Leaves of a block; pairs of leaves are made from pairs of blocks.
LEAF_BLOCK = 64


def _jumped(state: DataFrame, tag: str) -> DataFrame:
    """``(family, key, goal, total)`` with every total summed up to the end of its path: jumps double in each round.

    Rows at the end of their path are not joined again, so that their null goals don't meet in one place.
    """
    state = materialize(state, tag)
    most, rounds = state.count(), 0
    while not state.where("goal is not null").isEmpty():
        if 1 << rounds > most:
            raise ValueError("a tree has a circle")
        ahead = state.select("family", F.col("key").alias("goal"), F.col("goal").alias("_goal"), F.col("total").alias("_total"))
        far = state.where("goal is not null").join(exchanged(ahead), ["family", "goal"]).select(
            "family", "key", F.col("_goal").alias("goal"), (F.col("total") + F.col("_total")).alias("total"))
        state, rounds = materialize(far.unionByName(state.where("goal is null")), tag), rounds + 1
    return state.select("family", "key", "total")


def list_ranks(links: DataFrame) -> DataFrame:
    """``(family, arc, left)`` from ``(family, arc, goal)``: arcs from each one to the end of its list, itself included.

    ``goal`` is null at an end. A list without an end (a circle) is an error.
    """
    ranks = _jumped(links.select("family", F.col("arc").alias("key"), "goal", F.lit(1).cast("long").alias("total")), "ranks")
    return ranks.select("family", F.col("key").alias("arc"), F.col("total").alias("left"))


def ancestor_sums(nodes: DataFrame, value: str, out: str) -> DataFrame:
    """``(family, node, out)``: ``value`` summed over each node and its ancestors.

    Takes rows ``(family, node, parent, value)`` from anywhere, such as a parsed text. Rounds are
    the logarithm of the depth, so a chain of any length takes few.
    """
    sums = _jumped(nodes.select("family", F.col("node").alias("key"), F.col("parent").alias("goal"), F.col(value).alias("total")), "jumps")
    return sums.select("family", F.col("key").alias("node"), F.col("total").alias(out))


def euler_tour(nodes: DataFrame) -> DataFrame:
    """``nodes`` with its places in the tour of its family's tree.

    ``nodes`` has family, node, left, right, parent (null where there is none). Added are
    ``first`` and ``last`` (arcs into and out of the node, from 0), ``depth`` (of the
    root 0), and ``leaf_from``, ``leaf_to`` (places of its leaves from left to right, the end exclusive). A
    family without nodes gives nothing; a single node is its own tour.
    """
    down = lambda n: (F.col(n).cast("long") * 2)
    up = lambda n: (F.col(n).cast("long") * 2 + 1)
    shape = nodes.select("family", "node", "left", "right", "parent")
    above = shape.select("family", F.col("node").alias("parent"), F.col("left").alias("_l"), F.col("right").alias("_r"))
    both = shape.join(exchanged(above), ["family", "parent"], "left")
    after = F.when(F.col("parent").isNull(), F.lit(None).cast("long")).when(F.col("node") == F.col("_l"), down("_r")).otherwise(up("parent"))
    links = both.select("family", F.explode(F.array(
        F.struct(down("node").alias("arc"), F.when(F.col("left").isNull(), up("node")).otherwise(down("left")).alias("goal")),
        F.struct(up("node").alias("arc"), after.alias("goal")),
    )).alias("x")).select("family", "x.arc", "x.goal")
    ranks = list_ranks(links)
    total = ranks.groupBy("family").agg(F.max("left").alias("_n"))
    kinds = shape.select("family", "node", F.col("left").isNull().cast("long").alias("_leaf"))
    arcs = ranks.select("family", F.shiftright("arc", 1).cast("int").alias("node"), (F.col("arc") % 2).alias("_up"), "left").join(
        exchanged(total), "family").join(exchanged(kinds), ["family", "node"]).select(
        "family", "node", "_up", (F.col("_n") - F.col("left")).alias("pos"), (F.lit(1) - 2 * F.col("_up")).alias("_step"),
        F.when(F.col("_up") == 0, F.col("_leaf")).otherwise(F.lit(0)).alias("_new"))
    arcs = prefix_sum(arcs, ["family"], "pos", "_step", "_deep")
    arcs = prefix_sum(arcs, ["family"], "pos", "_new", "_seen")
    at = lambda c, k: F.max(F.when(F.col("_up") == k, F.col(c)))
    places = arcs.groupBy("family", "node").agg(
        at("pos", 0).alias("first"), at("pos", 1).alias("last"), (at("_deep", 0) - 1).alias("depth"),
        (at("_seen", 0) - at("_new", 0)).alias("leaf_from"), at("_seen", 1).alias("leaf_to"))
    return nodes.join(exchanged(places), ["family", "node"])


def path_weights(nodes: DataFrame) -> DataFrame:
    """Unnormalised weight ``(family, leaf, w)`` of each leaf: branch length over leaf count, summed along its path below the root.

    ``nodes`` is a tour (``euler_tour``) with ``dist``, the length of the branch above a node."""
    part = F.when(F.col("parent").isNotNull(), F.col("dist") / (F.col("leaf_to") - F.col("leaf_from"))).otherwise(F.lit(0.0))
    sums = ancestor_sums(nodes.withColumn("_w", part), "_w", "w")
    return nodes.where("left is null").select("family", "node").join(exchanged(sums), ["family", "node"]).select(
        "family", F.col("node").alias("leaf"), "w")


def merge_intervals(nodes: DataFrame) -> DataFrame:
    """Merge steps, children before parents, with the places of the leaves of both sides (ends exclusive).

    The leaves of a step are those whose place lies in its interval, so no list of leaves is formed."""
    from seqloom.operators.windows import stable_rank

    mid = nodes.select("family", F.col("node").alias("left"), F.col("leaf_to").alias("_mid"))
    inner = nodes.where("left is not null").join(exchanged(mid), ["family", "left"])
    ranked = stable_rank(inner.withColumn("_o", F.col("node").cast("long")), ["family"], "node", "_o", "_r")
    return ranked.select(
        "family", (F.col("_r") + 1).alias("step"), "node", "left", "right", F.col("leaf_from").alias("left_from"),
        F.col("_mid").alias("left_to"), F.col("_mid").alias("right_from"), F.col("leaf_to").alias("right_to"))


def leaf_pairs(nodes: DataFrame, carry: list[str] | None = None, block: int = LEAF_BLOCK) -> DataFrame:
    """Lowest common ancestor of all leaf pairs ``a < b`` of each family: ``(family, a, b, node, subtree, branches, *carry)``.

    ``nodes`` is a tour. ``subtree`` counts the leaves below the ancestor, ``branches`` those between the two leaves;
    ``carry`` names further columns of the ancestor. Between two leaves
    that follow each other stands the node that parts them; the ancestor of any two is the shallowest
    of those between them. Leaves are dealt into blocks by their places. Within a block the minima are taken from its
    array; across blocks they are the end of the one, the start of the other, and two overlapping entries of a
    sparse table over whole blocks. Rows of a key are the pairs of two blocks, so neither the root nor a hot
    family gathers its pairs in one place.
    """
    carry = carry or []
    mid = nodes.select("family", F.col("node").alias("left"), F.col("leaf_to").alias("_mid"))
    gap = F.struct("depth", "node", (F.col("leaf_to") - F.col("leaf_from")).alias("subtree"), *carry)
    gaps = nodes.where("left is not null").join(exchanged(mid), ["family", "left"]).select("family", (F.col("_mid") - 1).alias("k"), gap.alias("g"))
    leaves = nodes.where("left is null").select("family", F.col("leaf_from").alias("k"), F.struct(F.col("node").alias("leaf"), "depth").alias("x"))
    cells = leaves.join(exchanged(gaps), ["family", "k"], "left").withColumn("blk", F.floor(F.col("k") / block).cast("long"))
    rows = cells.groupBy("family", "blk").agg(F.array_sort(F.collect_list(F.struct("k", "x", "g"))).alias("c"))
    size = F.size("c")
    g = F.transform("c", lambda c: c["g"])
    # of each leaf: the shallowest node from it to the end of the block, and from the start of the block to it
    to_end = F.transform("c", lambda c, i: F.struct(c["x"].alias("x"), F.array_min(F.slice(g, i + 1, size)).alias("g")))
    to_start = F.transform("c", lambda c, i: F.struct(c["x"].alias("x"), F.array_min(F.slice(g, F.lit(1), i)).alias("g")))
    rows = materialize(rows.select("family", "blk", to_end.alias("ends"), to_start.alias("starts"), g.alias("gs"), F.array_min(g).alias("all")), "leaf-blocks")

    def found(df: DataFrame, x: Column, y: Column, best: Column) -> DataFrame:
        a, b = x["leaf"], y["leaf"]
        return df.select(
            "family", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), best["node"].alias("node"), best["subtree"].alias("subtree"),
            (x["depth"] + y["depth"] - 2 * best["depth"]).cast("int").alias("branches"), *[best[c].alias(c) for c in carry])

    inside = rows.select("family", "gs", "ends", F.posexplode("ends").alias("i", "p"))
    inside = inside.where(F.col("i") + 1 < F.size("ends")).select(
        "family", "gs", "i", "p", F.posexplode(F.slice("ends", F.col("i") + 2, F.size("ends"))).alias("d", "q"))
    inside = found(inside, F.col("p.x"), F.col("q.x"), F.array_min(F.slice("gs", F.col("i") + 1, F.col("d") + 1)))
    top = rows.agg(F.max("blk")).first()[0] or 0
    if top == 0:
        return inside
    # level k holds the minima of 2^k blocks from every block on
    level = rows.select("family", F.lit(0).alias("k"), "blk", F.col("all").alias("m"))
    table, k = level, 0
    while 2 << k <= top:
        ahead = level.select("family", (F.col("blk") - (1 << k)).alias("blk"), F.col("m").alias("_m"))
        level = materialize(level.join(exchanged(ahead), ["family", "blk"]).select("family", F.lit(k + 1).alias("k"), "blk", F.least("m", "_m").alias("m")), "block-minima")
        table, k = table.unionByName(level), k + 1
    last = rows.groupBy("family").agg(F.max("blk").alias("_last"))
    pairs = rows.select("family", F.col("blk").alias("i")).join(exchanged(last), "family").where("i < _last").select(
        "family", "i", F.explode(F.sequence(F.col("i") + 1, F.col("_last"))).alias("j"))
    span = F.col("j") - F.col("i") - 1
    pairs = pairs.withColumn("k", F.when(span > 0, F.floor(F.log2(span.cast("double"))).cast("int")))
    low = table.select("family", "k", (F.col("blk") - 1).alias("i"), F.col("m").alias("_m1"))
    high = table.select("family", "k", (F.col("blk") + F.expr("shiftleft(1, k)")).alias("j"), F.col("m").alias("_m2"))
    far = pairs.where("k is not null").join(exchanged(low), ["family", "k", "i"]).join(exchanged(high), ["family", "k", "j"]).select(
        "family", "i", "j", F.least("_m1", "_m2").alias("m"))
    near = pairs.where("k is null").select("family", "i", "j", F.lit(None).cast(far.schema["m"].dataType).alias("m"))
    ends = rows.select("family", F.col("blk").alias("i"), "ends")
    starts = rows.select("family", F.col("blk").alias("j"), "starts")
    across = far.unionByName(near).join(exchanged(ends), ["family", "i"]).join(exchanged(starts), ["family", "j"])
    across = across.select("family", "m", F.explode("ends").alias("p"), "starts").select("family", "m", "p", F.explode("starts").alias("q"))
    return inside.unionByName(found(across, F.col("p.x"), F.col("q.x"), F.least("p.g", "q.g", "m")))
