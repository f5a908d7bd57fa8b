"""The set-based Newick parser and writer against a stack of single trees."""

import random
import re

import pytest

from seqloom.operators import tours as TO
from seqloom.operators import trees as T
from seqloom.session import materialize
from seqloom.sources import newick as NW


def stacked(text):
    """Rows ``(node, left, right, name, dist, parent)`` of one well-formed tree."""
    names, inner, stack, items = [], [], [], []
    for t in re.findall(r"[(),;]|:[^(),;:]+|[^(),;:\s]+", text):
        if t == "(":
            stack.append(items)
            items = []
        elif t == ")":
            left = items[0]
            for right in items[1:]:
                left = {"left": left, "right": right, "dist": 0.0}
                inner.append(left)
            items = stack.pop()
            items.append(left)
        elif t[0] == ":":
            items[-1]["dist"] = float(t[1:])
        elif t not in ",;":
            items.append({"name": t, "dist": 0.0})
            names.append(items[-1])
    for k, v in enumerate(names + inner):
        v["id"] = k
    for v in inner:
        v["left"]["up"] = v["right"]["up"] = v["id"]
    return {(v["id"], v.get("left", {}).get("id"), v.get("right", {}).get("id"), v.get("name"), v["dist"], v.get("up")) for v in names + inner}


def written(r, depth):
    if depth == 0 or r.random() < 0.2:
        t = f"n{r.randrange(1000)}" + r.choice(["", "_x", "|y-z"])
    else:
        t = "(" + r.choice([",", " , ", ",\n"]).join(written(r, depth - 1) for _ in range(r.choice([2, 2, 3, 6]))) + ")"
    return t + r.choice(["", f":{r.random():.4f}", ": 1e-3", ":2"])


def parsed(spark, trees):
    got = {}
    for r in NW.parse(spark.createDataFrame(list(trees.items()), "family string, text string")).collect():
        got.setdefault(r.family, set()).add((r.node, r.left, r.right, r.name, r.dist, r.parent))
    return got


def test_parses_like_a_stack(spark):
    trees = {f"t{k}": written(random.Random(k), k % 5) + ";" for k in range(25)}
    trees |= {"one": " a ; ", "star": "(" + ",".join(f"s{k}:{k}" for k in range(5000)) + ");", "same": "(a,a,a);"}
    assert parsed(spark, trees) == {f: stacked(t) for f, t in trees.items()}
    assert NW.parse(spark.createDataFrame([], "family string, text string")).count() == 0


def fails(df):
    with pytest.raises(Exception, match="invalid tree format"):
        df.collect()


def test_texts_that_are_no_trees(spark):
    for bad in ("(a,b)", "(a,b);x", "(a,,b);", "(,a);", "()", "(a,b)c;", "(a b);", "(a:,b);", "a::1;", ";", "", None, ")a,b(;", "(a,b)(c,d);"):
        fails(NW.tokens(spark.createDataFrame([("f", bad), ("g", "(a,b);")], "family string, text string")))


@pytest.mark.parametrize("bad", ["((a,b);", "(a,b));", "(a);", "((a,b));", "a,b;", "(a:x,b);"])
def test_brackets_that_are_no_trees(spark, bad):
    fails(NW.parse(spark.createDataFrame([("f", bad), ("g", "(a,b);")], "family string, text string")))


def test_round_trip_and_weights_of_a_chain(spark):
    """A chain of ten thousand leaves: written, parsed, and weighed like the sum over its path."""
    n = 10_000
    text = "(" * (n - 1) + "a0:1"
    text += "".join(f",a{k}:0.5):0.25" for k in range(1, n))
    text = text[: -len(":0.25")] + ";"
    nodes = materialize(NW.parse(spark.createDataFrame([("chain", text), ("small", "((p:1,q:2):0.5,r:4);")], "family string, text string")), "test-newick")
    tour = materialize(TO.euler_tour(nodes), "test-tour")
    got = {(r.family, r.name): r.w for r in TO.path_weights(tour).join(
        nodes.selectExpr("family", "node as leaf", "name"), ["family", "leaf"]).collect()}
    assert got["small", "p"] == 1.25 and got["small", "q"] == 2.25 and got["small", "r"] == 4
    above = 0.0
    for k in range(n - 1, 0, -1):  # the bracket that ak closes holds k + 1 leaves
        assert abs(got["chain", f"a{k}"] - (above + 0.5)) < 1e-9
        above += 0.25 / k if k > 1 else 1.0
    assert abs(got["chain", "a0"] - above) < 1e-9
    names = nodes.where("name is not null").select("family", "node", "name")
    back = {r.family: r.text for r in NW.render(nodes, names).collect()}
    assert stacked(back["small"]) == stacked("((p:1,q:2):0.5,r:4);")
    assert {x[1:] for x in stacked(back["chain"]) if x[3] == "a77"} == {x[1:] for x in stacked(text) if x[3] == "a77"} and back["chain"].count("(") == n - 1
    assert NW.pieces(nodes, names).where("family = 'chain'").count() == 2 * (2 * n - 1)


def test_renders_built_trees(spark):
    r = random.Random(4)
    rows = [("f", a, b, round(r.random(), 3)) for a in range(12) for b in range(a + 1, 12)] + [("g", 3, 5, 0.25)]
    nodes, _ = T.build_trees(spark.createDataFrame(rows, "family string, a int, b int, d double"))
    names = nodes.where("level = 0").selectExpr("family", "node", "concat('t', node) as name")
    text = {x.family: x.text for x in NW.render(nodes, names).collect()}
    assert text["g"] == "(t5:0.125,t3:0.125);"
    got = stacked(text["f"])
    assert len(got) == 23 and {x[3] for x in got} - {None} == {f"t{k}" for k in range(12)}
    want = sum(x.dist for x in nodes.where("family = 'f'").collect())
    assert abs(sum(x[4] for x in got) - want) < 1e-9
