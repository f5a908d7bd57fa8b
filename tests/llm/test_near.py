from collections import Counter, defaultdict

import numpy as np
import pytest

from seqloom.llm.common import Scratch
from seqloom.llm.components import components
from seqloom.llm.near_vectors import VectorConfig, links as vector_links
from seqloom.llm.shingle_join import JoinConfig, links, representatives, shingles, WordHashes

from .conftest import edited, prose, rows_of


def smallest_reachable(nodes, pairs):
    own = {n: n for n in nodes}

    def find(x):
        while own[x] != x:
            own[x] = own[own[x]]
            x = own[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        own[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    pairs += [(1000, k) for k in range(1001, 1100)] + [(-5, 3)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {x["node"]: x["component"] for x in components(edges, Scratch(spark, "test")).collect()}
    want = smallest_reachable({n for p in pairs for n in p}, pairs)
    assert got == {n: c for n, c in want.items() if n != c}
    assert components(edges.limit(0), Scratch(spark, "test")).count() == 0


@pytest.mark.parametrize("cfg", [VectorConfig(), VectorConfig(cell_rows=25, block_rows=9)])
def test_vectors_against_brute_force(spark, cfg):
    r = np.random.default_rng(1)
    rows, centre = [], r.normal(size=(6, 16))
    for k in range(240):
        x = centre[k % 6] + r.normal(size=16) * (0.15 if k % 3 else 1.5)
        rows.append((k, x.tolist(), int(k % 6) // 2))
    rows += [(500 + k, rows[0][1], 0) for k in range(40)]
    rows += [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, [None] + [1.0] * 15, 0), (604, rows[0][1], None),
             (605, [float("inf")] * 16, 0), (606, rows[0][1][:4], 0), (None, rows[0][1], 0), (1, rows[1][1], 0), (607, [], 0)]
    v = spark.createDataFrame([(*x, "clash", 1) for x in rows], "vec_id long, embedding array<double>, label int, id string, n long")
    nodes, pairs, n = {x[0] for x in rows if x[0] is not None}, [], Counter()
    good = [k for k, (i, e, label) in enumerate(rows) if i is not None and label is not None and e and all(
        c is not None and np.isfinite(c) for c in e) and any(e)]
    for x, a in enumerate(good):
        for b in good[x + 1 :]:
            (i, e, la), (j, f, lb) = rows[a], rows[b]
            if la == lb and len(e) == len(f) and np.dot(e, f) / np.linalg.norm(e) / np.linalg.norm(f) >= 0.93:
                pairs.append((i, j))
                n[a] += 1
                n[b] += 1
    own = smallest_reachable(nodes, pairs)
    want = Counter((i, n[k], own.get(i), i is not None and own[i] == i) for k, (i, _, _) in enumerate(rows))
    assert Counter(tuple(x) for x in vector_links(v, cfg).collect()) == want
    assert vector_links(v.limit(0)).count() == 0


def test_vectors_of_any_magnitude(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1.01e200]), (2, [1e-200, 1e-200]), (3, [1.0, 0.1]), (4, [1.0, 1.0]), (5, [1.7e308, 1.7e308]), (6, [5e-324, 0.0])]
    v = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_links(v).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 4: (4, 0), 5: (4, 0), 3: (1, 3), 6: (1, 3)}


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def brute_components(sets, percent):
    ids, pairs = sorted(sets), []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                pairs.append((a, b))
    return smallest_reachable(ids, pairs)


@pytest.fixture(scope="module")
def copies(spark, odd):
    """Many near copies of a few texts, among them chains that only link step by step."""
    rows = [(1000 + k, edited(prose(k % 4, 260), k, k % 7)) for k in range(90)]
    rows += [(2000 + k, " ".join(f"w{j}" for j in range(k, k + 60))) for k in range(40)]
    rows += [(3000 + k, "shared passage " + " ".join(f"p{j}" for j in range(50)) + " " + prose(100 + k, 20 + 5 * k)) for k in range(20)]
    rows += [(4000 + k, " ".join(f"s{j}" for j in range(9 + k % 3))) for k in range(6)]
    return spark.createDataFrame([(*r, None, None, None, *[None] * 8) for r in rows], odd.schema).unionByName(odd)


@pytest.mark.parametrize(("words", "percent", "leaves"), [(3, 90, 128), (5, 80, 3), (1, 60, 8)])
def test_shingle_join_against_brute_force(copies, words, percent, leaves):
    rows = rows_of(copies)
    sets = sets_of([r for r in rows if r[0] is not None], words)
    own = brute_components(sets, percent)
    got = links(copies, JoinConfig(words, percent, leaves)).collect()
    assert len(got) == len(rows)
    named = [r for r in got if r["doc_id"] is not None]
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in named} == {(i, len(s), own[i]) for i, s in sets.items()}
    assert len(set(own.values())) < len(own) - 20
    # rows without an id get the component of an equal text, or none
    assert {r["component_id"] for r in got if r["doc_id"] is None} <= {None, *own.values()}


def test_representatives(copies, no_documents):
    cfg = JoinConfig(5, 80)
    rows = rows_of(copies)
    own = brute_components(sets_of([r for r in rows if r[0] is not None], 5), 80)
    got = representatives(copies, cfg)
    assert got.columns == copies.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert Counter(ids) == Counter({i: 1 for i, c in own.items() if i == c} | {None: 2})
    assert representatives(no_documents, cfg).count() == 0 == links(no_documents, cfg).count()


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    long = prose(7, 80)
    rows = [(5, long), (5, prose(8, 80)), (5, long), (6, edited(prose(8, 80), 1, 1)), (9, edited(long, 2, 1)), (9, ""), (9, None), (7, prose(9, 60)), (None, long)]
    df = spark.createDataFrame([(i, "own", t, 1, {"x": k}) for k, (i, t) in enumerate(rows)], "doc_id long, _own string, text string, `a.b` int, s map<string,int>")
    cfg = JoinConfig(3, 80)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in links(df, cfg).collect())
    n = [len(x) for x in sets_of(list(enumerate(t for _, t in rows)), 3).values()]
    # both groups hold document 5, by different texts of it
    assert got == Counter([(i, n[k], {7: 7, 9: 9 if not rows[k][1] else 5}.get(i, 5)) for k, (i, _) in enumerate(rows)])
    kept = representatives(df, cfg)
    assert kept.columns == df.columns and {r["_own"] for r in kept.collect()} == {"own"}
    texts = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert texts[7, rows[7][1]] == 1 and texts[None, long] == 1 and texts[9, ""] + texts[9, None] == 1
    # one text of each group stays, and none of a clean document is lost
    groups = [{long, rows[4][1]}, {rows[1][1], rows[3][1]}]
    assert [sum(c for (i, t), c in texts.items() if i is not None and t in g) for g in groups] == [1, 1]
    assert texts.total() == 5
    again = representatives(df, cfg).collect()
    assert Counter((r["doc_id"], r["text"]) for r in again) == texts


def test_shingles_take_ascii_only():
    c = WordHashes(10)
    assert (shingles("A b\tC\nd", 3, c) == shingles("a B c D", 3, c)).all()
    assert len(shingles("Ä b", 3, c)) == 1 and not (shingles("Ä b", 3, c) == shingles("ä b", 3, c)).any()
    assert len(shingles("a\u00a0b c d e", 3, c)) == 2  # a no-break space is part of a word
    assert len(np.intersect1d(shingles("a b", 3, c), shingles("a b c", 3, c))) == 0


def test_order_of_shingles_does_not_matter(copies):
    # frequent shingles are last in the order: a small and a large share of the table give the same links
    cfg = JoinConfig(3, 90)
    some = copies.where("doc_id between 1000 and 1040")
    a = {(r["doc_id"], r["component_id"]) for r in links(some, cfg).collect()}
    sets = sets_of(rows_of(some), 3)
    assert a == set(brute_components(sets, 90).items())
    assert len(defaultdict(int, a)) == 41
