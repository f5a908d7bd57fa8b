"""Tours, common ancestors and path sums against walks over single trees."""

import random

import pytest

from seqloom.operators import tours as TO
from seqloom.operators import trees as T

NODE = "family string, node int, left int, right int, parent int, dist double"


def random_tree(n, seed, chain=False):
    """Rows ``(node, left, right, parent, dist)`` of a binary tree of ``n`` leaves with shuffled numbers."""
    r = random.Random(seed)
    alive, kids, nxt = list(range(n)), {}, n
    while len(alive) > 1:
        x = alive.pop() if chain else alive.pop(r.randrange(len(alive)))
        y = alive.pop(0) if chain else alive.pop(r.randrange(len(alive)))
        kids[nxt] = (x, y)
        alive.append(nxt)
        nxt += 1
    number = list(range(nxt))
    r.shuffle(number)
    parent = {c: p for p, cs in kids.items() for c in cs}
    return [(number[v], *([number[c] for c in kids.get(v, ())] or [None, None]), number[parent[v]] if v in parent else None, round(r.random(), 3)) for v in range(nxt)]


def walked(rows):
    """Depth, leaves and path of every node, the leaves from left to right."""
    by = {r[0]: r for r in rows}
    order, stack = [], [next(r[0] for r in rows if r[3] is None)]
    while stack:
        v = stack.pop()
        if by[v][1] is None:
            order.append(v)
        else:
            stack += [by[v][2], by[v][1]]
    up = {}
    for v in by:
        path, x = [], v
        while x is not None:
            path.append(x)
            x = by[x][3]
        up[v] = path
    return by, order, up


def forest(spark, trees):
    return spark.createDataFrame([(f, *r) for f, rows in trees.items() for r in rows], NODE)


TREES = {"one": random_tree(1, 0), "two": random_tree(2, 1), "some": random_tree(23, 2), "many": random_tree(150, 3), "chain": random_tree(90, 4, chain=True)}


@pytest.fixture(scope="module")
def tour(spark):
    from seqloom.session import materialize

    return materialize(TO.euler_tour(forest(spark, TREES)), "test-tour")


def test_places(tour):
    got = {(r.family, r.node): r for r in tour.collect()}
    assert len(got) == sum(map(len, TREES.values()))
    for f, rows in TREES.items():
        by, order, up = walked(rows)
        place = {v: k for k, v in enumerate(order)}
        for v in by:
            r = got[f, v]
            below = [place[x] for x in order if v in up[x]]
            assert (r.depth, r.leaf_from, r.leaf_to) == (len(up[v]) - 1, min(below), max(below) + 1)
            assert r.last - r.first + 1 == 2 * sum(v in up[x] for x in by)
        assert sorted(x for v in by for x in (got[f, v].first, got[f, v].last)) == list(range(2 * len(rows)))


@pytest.mark.parametrize("block", [1, 4, 64])
def test_common_ancestors(spark, tour, block):
    small = tour.where("family <> 'many'") if block == 1 else tour
    got = {(r.family, r.a, r.b): (r.node, r.subtree, r.branches, r.dist) for r in TO.leaf_pairs(small, ["dist"], block).collect()}
    want = {}
    for f, rows in TREES.items():
        if block == 1 and f == "many":
            continue
        by, order, up = walked(rows)
        for a in order:
            for b in order:
                if a < b:
                    v = next(x for x in up[a] if x in set(up[b]))
                    want[f, a, b] = (v, sum(v in up[x] for x in order), up[a].index(v) + up[b].index(v), by[v][4])
    assert got == want


def test_path_sums_and_weights(spark, tour):
    got = {(r.family, r.node): r.s for r in TO.ancestor_sums(tour, "dist", "s").collect()}
    weights = {(r.family, r.leaf): r.w for r in TO.path_weights(tour).collect()}
    for f, rows in TREES.items():
        by, order, up = walked(rows)
        for v in by:
            assert abs(got[f, v] - sum(by[x][4] for x in up[v])) < 1e-9
        for v in order:
            w = sum(by[x][4] / sum(x in up[y] for y in order) for x in up[v] if by[x][3] is not None)
            assert abs(weights[f, v] - w) < 1e-9
    assert len(weights) == sum(r[1] is None for rows in TREES.values() for r in rows)


def test_merge_intervals(spark, tour):
    got = TO.merge_intervals(tour).collect()
    for f, rows in TREES.items():
        by, order, up = walked(rows)
        mine = sorted((r for r in got if r.family == f), key=lambda r: r.step)
        assert [r.step for r in mine] == list(range(1, len(mine) + 1)) and [r.node for r in mine] == sorted(v for v in by if by[v][1] is not None)
        for r in mine:
            assert set(order[r.left_from : r.left_to]) == {x for x in order if r.left in up[x]}
            assert set(order[r.right_from : r.right_to]) == {x for x in order if r.right in up[x]}


def test_agrees_with_member_lists(spark):
    r = random.Random(9)
    rows = [("f", a, b, round(r.random(), 3)) for a in range(25) for b in range(a + 1, 25)] + [("g", 0, 1, 0.5)]
    nodes, members = T.build_trees(spark.createDataFrame(rows, "family string, a int, b int, d double"))
    key = ["family", "a", "b", "node", "subtree", "level"]
    tour = TO.euler_tour(nodes)
    assert sorted(map(tuple, TO.leaf_pairs(tour, ["level"]).select(key).collect())) == sorted(map(tuple, T.leaf_pairs(nodes, members).select(key).collect()))
    want = {(x.family, x.leaf): x.w for x in T.path_weights(nodes, members).collect()}
    assert all(abs(want[x.family, x.leaf] - x.w) < 1e-12 for x in TO.path_weights(tour).collect()) and len(want) == 27


def test_circles_and_empty_tables(spark):
    loop = spark.createDataFrame([("f", 0, None, None, 1, 0.0), ("f", 1, None, None, 0, 0.0)], NODE)
    with pytest.raises(ValueError, match="circle"):
        TO.ancestor_sums(loop, "dist", "s")
    none = loop.limit(0)
    tour = TO.euler_tour(none)
    assert tour.count() == TO.leaf_pairs(tour).count() == TO.path_weights(tour).count() == 0


def hubs(n, seed):
    """Distances of ``n`` sequences whose nearest one is always the first, so that one pair merges per round."""
    r = random.Random(seed)
    return [(a, b, (0.1 if a == 0 else 0.5) + round(r.random() / 10, 13)) for a in range(n) for b in range(a + 1, n)]


@pytest.mark.parametrize("linkage", ["upgma", "wpgma", "single"])
def test_rounds_in_tasks_are_rounds_of_all(spark, monkeypatch, linkage):
    r = random.Random(3)
    trees = {"hub": hubs(6, 1), "twice": hubs(4, 2) + hubs(4, 5), "ties": [(a, b, 0.5) for a in range(5) for b in range(a + 1, 5)], "pair": [(3, 7, 0.25)],
             "some": [(a, b, r.choice([0.25, r.random()])) for a in range(1, 9) for b in range(a + 1, 9)], "gap": [(0, 1, 0.1), (1, 2, 0.2), (5, 6, 0.3)]}
    df = spark.createDataFrame([(f, *x) for f, rows in trees.items() for x in rows], "family string, a int, b int, d double")
    got = [[sorted(map(str, t.collect())) for t in T.build_trees(df, linkage)]]
    monkeypatch.setattr(T, "TASK_CLUSTERS", 4)  # rounds of all tasks, until four clusters are left
    got.append([sorted(map(str, t.collect())) for t in T.build_trees(df, linkage)])
    assert got[0] == got[1]


def test_rounds_do_not_grow_with_a_family(spark, monkeypatch):
    tags = []
    real = T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, tag: tags.append(tag) or real(df, tag))
    df = spark.createDataFrame([("hub", *x) for x in hubs(14, 4)], "family string, a int, b int, d double")
    nodes, _ = T.build_trees(df)
    assert nodes.count() == 27 and nodes.agg({"level": "max"}).first()[0] > 10 and tags.count("tree-merges") <= 2
