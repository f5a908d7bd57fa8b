"""Newick trees as text, parsed and written as sets of rows.

A text becomes a row per token. The depth of brackets is a running sum over
them, and the bracket that holds an item is the last one opened at its depth, a
running maximum; both work in blocks (``operators.windows``), so neither a
large tree nor a bracket with many branches meets in one task. Writing puts
the pieces of a tree in the order of its Euler tour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.tours import euler_tour
from seqloom.operators.windows import prefix_sum, running_max
from seqloom.session import exchanged, materialize

TOKEN = r"[(),;]|:[^(),;:]+|[^(),;:\s]+"
#: What may not follow what, by kinds of tokens: n is a name, d a length; a tree starts with a bracket or a name and ends with ``;``.
WRONG = r"^[^(n]|[(,][,);d]|n[(n]|d[(nd]|\)[(n]|;.|[^;]$|^$"


def _error() -> Column:
    return F.raise_error(F.lit("invalid tree format"))


def tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(family, pos, kind, tok)`` of all trees. A null text, characters that are no
    token, tokens that can't follow each other and lengths that are no numbers are errors."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"({TOKEN})"), F.lit(1))
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    kind = lambda t: F.when(F.substring(t, 1, 1) == ":", "d").when(t.isin("(", ")", ",", ";"), t).otherwise("n")
    kinds = F.array_join(F.transform("_t", kind), "")
    fine = (bare(F.array_join("_t", "")) == bare(F.col(text))) & ~kinds.rlike(WRONG)
    checked = F.when(F.coalesce(fine, F.lit(False)), F.col("_t")).otherwise(_error())
    rows = texts.select("family", text, found.alias("_t")).select("family", F.posexplode(checked).alias("pos", "tok"))
    return rows.select("family", F.col("pos").cast("long"), kind(F.col("tok")).alias("kind"), "tok")


def parse(texts: DataFrame, text: str = "text") -> DataFrame:
    """Nodes ``(family, node, left, right, name, dist, parent)`` of the trees of all families.

    Leaves are numbered in the order of appearance, inner nodes behind them in the
    order in which they are closed; a node with more than two branches is folded to the
    left, its first folds at length 0. A missing length is 0. Malformed trees (``tokens``; brackets that don't match or
    hold a single branch; several trees or none) are an error. Families are to be distinct; an empty table gives no node.
    """
    t = tokens(texts, text)
    step = F.when(F.col("kind") == "(", 1).when(F.col("kind") == ")", -1).otherwise(0)
    t = prefix_sum(t.withColumn("_s", step), ["family"], "pos", "_s", "depth")
    t = prefix_sum(t.withColumn("_n", (F.col("kind") == "n").cast("int")), ["family"], "pos", "_n", "_names")
    t = materialize(t.drop("_s", "_n"), "newick-tokens")
    shape = t.groupBy("family").agg(
        F.sum((F.col("kind") == "n").cast("int")).alias("leaves"), F.min("depth").alias("_low"), F.max_by("depth", "pos").alias("_end"))

    # the last bracket opened at a depth before an item: that of the item at its depth, of a closing bracket one below
    level = lambda role, d, o: F.struct(F.lit(role).alias("role"), d.alias("lev"), o.alias("open"))
    nothing = F.lit(None).cast("long")
    events = F.when(F.col("kind") == "(", F.array(level("open", F.col("depth"), F.col("pos")))).when(
        F.col("kind") == ")", F.array(level("in", F.col("depth"), nothing), level("own", F.col("depth") + 1, nothing))).when(
        F.col("kind") == "n", F.array(level("in", F.col("depth"), nothing)))
    held = t.where("kind in ('(', ')', 'n')").select("family", "pos", F.explode(events).alias("e")).select("family", "pos", "e.*")
    held = running_max(held, ["family", "lev"], "pos", "open", "bracket").where("role <> 'open'")
    held = held.groupBy("family", "pos").agg(
        F.max(F.when(F.col("role") == "in", F.col("bracket"))).alias("bracket"), F.max(F.when(F.col("role") == "own", F.col("bracket"))).alias("own"))
    # a length stands right behind its item
    lengths = t.where("kind = 'd'").select("family", (F.col("pos") - 1).alias("pos"), F.trim(F.substring("tok", 2, 1 << 30)).alias("_d"))
    items = t.where("kind in (')', 'n')").select("family", "pos", "kind", F.when(F.col("kind") == "n", F.col("tok")).alias("name"), "_names")
    items = items.join(exchanged(held), ["family", "pos"]).join(exchanged(lengths), ["family", "pos"], "left")
    number = F.col("_d").try_cast("double")
    # null for a length that is no number
    dist = F.when(F.col("_d").isNull(), F.lit(0.0)).otherwise(number)
    items = items.select("family", "pos", "kind", "name", "_names", "bracket", "own", dist.alias("dist"))
    # outside all brackets there is one item only; -1 stands for there
    items = prefix_sum(items.withColumn("bracket", F.coalesce("bracket", F.lit(-1))).withColumn("_1", F.lit(1)), ["family", "bracket"], "pos", "_1", "j")
    items = materialize(items.drop("_1"), "newick-items")
    branches = items.groupBy("family", "bracket").agg(F.count(F.lit(1)).alias("k"))
    closed = items.where("kind = ')'").select("family", "pos", F.col("own").alias("bracket")).join(exchanged(branches), ["family", "bracket"], "left")
    closed = prefix_sum(closed.withColumn("_f", F.coalesce("k", F.lit(0)) - 1), ["family"], "pos", "_f", "_to")
    # the folds of a bracket are numbered _base to _base + k - 2; the last is the bracket's node
    closed = closed.join(exchanged(shape.select("family", "leaves")), "family").select(
        "family", "bracket", "pos", "k", (F.col("leaves") + F.col("_to") - F.col("_f")).cast("int").alias("_base"))
    closed = materialize(closed, "newick-brackets")
    tops = branches.where("bracket = -1").select("family", F.col("k").alias("_trees"))
    narrow = closed.groupBy("family").agg(F.min("k").alias("_least"), F.count_if(F.col("k").isNull()).alias("_none"))
    wrong = items.groupBy("family").agg(F.count_if(F.col("dist").isNull()).alias("_wrong"))
    state = shape.join(exchanged(tops), "family", "left").join(exchanged(narrow), "family", "left").join(exchanged(wrong), "family", "left").select("family", (
        (F.col("_low") < 0) | (F.col("_end") != 0) | (F.coalesce("_trees", F.lit(0)) != 1) | (F.coalesce("_least", F.lit(2)) < 2)
        | (F.coalesce("_none", F.lit(0)) > 0) | (F.coalesce("_wrong", F.lit(0)) > 0)).alias("_bad"))
    numbers = closed.select("family", "pos", (F.col("_base") + F.col("k") - 2).cast("int").alias("_own"))
    folds = closed.select("family", "bracket", "k", "_base")
    placed = items.join(exchanged(numbers), ["family", "pos"], "left").join(exchanged(folds), ["family", "bracket"], "left").join(exchanged(state), "family").select(
        "family", F.when(F.col("kind") == "n", (F.col("_names") - 1).cast("int")).otherwise(F.col("_own")).alias("node"),
        "_bad", "kind", "name", "dist", "bracket", "own", "j", "k", "_base",
        (F.col("_base") + F.greatest(F.col("j") - 2, F.lit(0))).cast("int").alias("parent"))
    # a filter, so that whoever reads the nodes meets the error, whatever columns are read
    placed = materialize(placed, "newick-nodes").where(F.when(F.col("_bad"), _error()).otherwise(F.lit(True)))
    leaves = placed.where("kind = 'n'").select(
        "family", "node", F.lit(None).cast("int").alias("left"), F.lit(None).cast("int").alias("right"), "name", "dist", "parent")
    firsts = placed.where("j = 1 and bracket >= 0").select("family", "bracket", F.col("node").alias("_first"))
    outer = placed.where("kind = ')'").select("family", F.col("own").alias("bracket"), F.col("dist").alias("_dist"), F.col("parent").alias("_up"))
    fold = placed.where("j > 1 and bracket >= 0").join(exchanged(firsts), ["family", "bracket"]).join(exchanged(outer), ["family", "bracket"])
    whole = F.col("j") == F.col("k")
    inner = fold.select(
        "family", F.col("parent").alias("_id"), F.when(F.col("j") == 2, F.col("_first")).otherwise(F.col("parent") - 1).alias("left"),
        F.col("node").alias("right"), F.lit(None).cast("string").alias("name"), F.when(whole, F.col("_dist")).otherwise(F.lit(0.0)).alias("dist"),
        F.when(whole, F.col("_up")).otherwise(F.col("parent") + 1).alias("_parent"),
    ).withColumnsRenamed({"_id": "node", "_parent": "parent"})
    return leaves.unionByName(inner)


def pieces(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """``(family, pos, piece)``: the text of every tree in pieces, in the order of ``pos``, however large the tree.

    ``nodes`` as of ``parse`` or a tree builder; ``names``: ``(family, node, name)`` of the leaves.
    """
    tour = euler_tour(nodes.select("family", "node", "left", "right", "parent", "dist"))
    lefts = nodes.where("left is not null").select("family", F.col("left").alias("node"), F.lit(",").alias("_comma"))
    t = tour.join(exchanged(names.select("family", "node", "name")), ["family", "node"], "left").join(exchanged(lefts), ["family", "node"], "left")
    leaf = F.col("left").isNull()
    end = F.concat(
        F.when(leaf, "").otherwise(")"), F.when(F.col("parent").isNull(), ";").otherwise(F.concat(F.lit(":"), F.col("dist").cast("string"))),
        F.coalesce("_comma", F.lit("")))
    both = F.array(F.struct(F.col("first").alias("pos"), F.when(leaf, F.col("name")).otherwise("(").alias("piece")),
                   F.struct(F.col("last").alias("pos"), end.alias("piece")))
    return t.select("family", F.explode(both).alias("x")).select("family", "x.*")


def render(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Newick text ``(family, text)`` of the trees of all families, one row each."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    return pieces(nodes, names).groupBy("family").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"))
