import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom import constants as K
from seqloom.config import AlignerConfig, pair_model, register_scoring, scoring
from seqloom.operators import consistency as CO
from seqloom.operators import pairs as P
from seqloom.operators import progressive as G
from seqloom.operators import sparse as S
from seqloom.operators import sweep
from seqloom.operators import trees as T
from seqloom.plans import classify as M
from seqloom.plans import pipeline as PL
from seqloom.plans.aligner import align, align_state
from tests import brute

CFG = AlignerConfig(refinement_passes=1, block_letters=30, pair_block=2)


def related(rng, n, length):
    base = [rng.choice(K.AMINO) for _ in range(length)]
    out = []
    for _ in range(n):
        s = [c if rng.random() < 0.75 else rng.choice(K.AMINO) for c in base]
        at = rng.randrange(len(s))
        del s[at : at + rng.randint(0, 4)]
        out.append("".join(s))
    return out


@pytest.fixture(scope="module")
def seqs(spark):
    rng = random.Random(11)
    fams = {"a": related(rng, 4, 24), "b": related(rng, 3, 40), "_c": related(rng, 2, 12), "one": ["ACDE"]}
    fams["b"].append("")
    data = [(f, i, f"s{i}", s) for f, v in fams.items() for i, s in enumerate(v)]
    return spark.createDataFrame(data, "family string, idx int, header string, seq string"), fams


@pytest.fixture(scope="module")
def state(seqs):
    return align_state(seqs[0], CFG)


def test_scoring_factory():
    assert scoring("BLOSUM62")["W", "W"] == 11 and scoring("hoxd70")["A", "C"] == -114
    with pytest.raises(ValueError):
        scoring("nothing")
    register_scoring("mine", "AB", [[1, 0], [0, 1]])
    assert scoring("mine")["A", "B"] == 0
    m = pair_model(AlignerConfig.nucleotide())
    assert math.isclose(m.match_odds[0][0], 0.1109 / 0.35**2)


def test_pairs_are_complete(seqs):
    df, fams = seqs
    got = {(r.family, r.a, r.b) for r in P.sequence_pairs(df.where("seq <> ''"), ["seq"], 30).collect()}
    want = {(f, i, j) for f, v in fams.items() for i in range(len(v)) for j in range(i + 1, len(v)) if v[i] and v[j]}
    assert got == want


def test_pair_scores_match_recursion(seqs):
    df, fams = seqs
    table = scoring("blosum62")
    for mode, f in (("global", brute.global_score), ("local", brute.local_score)):
        for r in P.align_scores(df, gap_open=-8, gap_extend=-2, mode=mode, block_letters=30).collect():
            a, b = fams[r.family][r.a], fams[r.family][r.b]
            assert r.score == f(a, b, table, -8, -2), (mode, a, b)
            assert 0 <= r.matches <= min(len(a), len(b))
    same = P.align_scores(df.sparkSession.createDataFrame([("f", 0, "ACDEF"), ("f", 1, "ACDEF")], "family string, idx int, seq string"))
    assert same.first().identity == 1.0


def test_local_path_score(spark):
    table = np.zeros((26, 26))
    for (x, y), v in scoring("blosum62").items():
        table[ord(x) - 65, ord(y) - 65] = v
    flat = sweep.letter_table(table)
    rng = random.Random(4)
    for _ in range(20):
        a, b = ("".join(rng.choice(K.AMINO) for _ in range(rng.randint(3, 15))) for _ in range(2))
        i, j = sweep.local_path(a, b, flat, -8, -8)
        # with equal costs the path can be scored cell by cell
        total = 0
        for k in range(len(i) - 1):
            d = (i[k] - i[k + 1], j[k] - j[k + 1])
            total += table[ord(a[i[k] - 1]) - 65, ord(b[j[k] - 1]) - 65] if d == (1, 1) else -8
        assert total == brute.local_score(a, b, scoring("blosum62"), -8, -8)


def test_meta_posterior(spark, seqs):
    df = seqs[0].where("family = '_c'")
    cells = P.unpack(P.pair_posteriors(df, CFG)).withColumn("p", F.col("p").cast("double"))
    paths, ident = P.local_paths(df), P.align_scores(df)
    out = {(r.i, r.j): r.p for r in P.meta_posteriors(cells, paths, ident).collect()}
    w = 0.01 * (1 - ident.first().identity)
    on = {(r.i, r.j) for r in paths.collect()}
    old = {(r.i, r.j): r.p for r in cells.collect()}
    for c in set(old) | set(out):
        want = math.sqrt(old.get(c, 0) ** 2 * (1 - w) + (w if c in on else 0))
        assert math.isclose(out.get(c, want if want < 0.01 else -1), want, abs_tol=1e-7)


@pytest.mark.parametrize("linkage", ["upgma", "wpgma", "single"])
def test_trees_equal_stepwise_clustering(spark, linkage):
    rng = random.Random(linkage)
    fams = {}
    for f, n in (("x", 2), ("y", 9), ("z", 14)):
        d = [[0.0] * n for _ in range(n)]
        for i in range(n):
            for j in range(i):
                d[i][j] = d[j][i] = rng.random()
        fams[f] = d
    data = [(f, j, i, d[i][j]) for f, d in fams.items() for i in range(len(d)) for j in range(i)]
    nodes, members = T.build_trees(spark.createDataFrame(data, "family string, a int, b int, d double"), linkage)
    got = {(r.family, r.node): r for r in nodes.collect()}
    weights = {(r.family, r.leaf): r.weight for r in T.normalise_weights(T.path_weights(nodes, members)).collect()}
    sub = {(r.family, r.a, r.b): r.subtree for r in T.leaf_pairs(nodes, members).collect()}
    branch = {(r.family, r.a, r.b): r.branches for r in T.branch_distances(nodes, members).collect()}
    for f, d in fams.items():
        n = len(d)
        want = brute.upgma(d, linkage)
        for k, (left, right, h) in enumerate(want):
            r = got[f, n + k]
            assert {r.left, r.right} == {left, right} and math.isclose(r.height, h, abs_tol=1e-12)
            if linkage != "single":
                assert (r.left, r.right) == (left, right)
        parent, dist = {}, {}
        leaves = {i: {i} for i in range(n)}
        for k, (left, right, h) in enumerate(want):
            for c in (left, right):
                parent[c], dist[c] = n + k, h / 2
            leaves[n + k] = leaves[left] | leaves[right]
        raw = []
        for i in range(n):
            v, w = i, 0.0
            while v in parent:
                w += dist[v] / len(leaves[v])
                v = parent[v]
            raw.append(w)
        for i in range(n):
            assert math.isclose(weights[f, i], raw[i] / sum(raw), abs_tol=1e-9)

        def path(i):
            out = [i]
            while out[-1] in parent:
                out.append(parent[out[-1]])
            return out

        for i in range(n):
            for j in range(i + 1, n):
                pi, pj = path(i), path(j)
                lca = next(v for v in pi if v in pj)
                assert sub[f, i, j] == len(leaves[lca])
                assert branch[f, i, j] == pi.index(lca) + pj.index(lca)
    orders = T.merge_orders(nodes, members).where("family = 'y'").orderBy("step").collect()
    assert len(orders) == 8 and sorted(orders[-1].left_leaves + orders[-1].right_leaves) == list(range(9))


def test_tied_distances_give_a_valid_tree(spark):
    data = [("f", i, j, 0.5) for i in range(6) for j in range(i + 1, 6)]
    nodes, members = T.build_trees(spark.createDataFrame(data, "family string, a int, b int, d double"))
    inner = [r for r in nodes.collect() if r.level > 0]
    assert len(inner) == 5 and max(r.leaves for r in inner) == 6
    assert all(r.node > max(r.left, r.right) for r in inner)
    assert T.leaf_pairs(nodes, members).count() == 15


def test_chained_tree_is_a_caterpillar(spark):
    df = spark.createDataFrame([("f", i) for i in range(6)], "family string, idx int")
    nodes, _ = T.build_trees(T.chain_distances(df))
    assert sorted(r.leaves for r in nodes.where("level > 0").collect()) == [2, 3, 4, 5, 6]


def test_block_consistency_equals_join(state):
    packed = state["posteriors"]
    sizes = state["weights"].groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    sel = T.leaf_pairs(state["nodes"], state["members"]).select("family", "a", "b", F.col("subtree").cast("double").alias("sel"))
    third = CO.third_weights(sel, state["weights"], CFG)
    zw = third.select("family", "a", "b", F.explode(F.arrays_zip("zs", "zw")).alias("t")).select(
        "family", "a", "b", F.col("t.zs").alias("z"), F.col("t.zw").alias("w")
    )
    cells = P.unpack(packed)
    joined = CO.relax_cells(cells, zw, block=2).join(third.select("family", "a", "b", "sum_w"), ["family", "a", "b"])
    want = {tuple(r[:5]): r.v for r in joined.select("family", "a", "b", "i", "j", ((F.col("p") + F.col("relaxed")) / F.col("sum_w")).alias("v")).collect()}
    got = {tuple(r[:5]): r.p for r in P.unpack(CO.consistency_pass(packed, third, 0.0, block=2)).select("family", "a", "b", "i", "j", "p").collect()}
    whole = {tuple(r[:5]): r.p for r in P.unpack(CO.consistency_pass(packed, third, 0.0, block=64)).select("family", "a", "b", "i", "j", "p").collect()}
    assert got.keys() == want.keys() == whole.keys()
    for k, v in want.items():
        assert math.isclose(got[k], v, abs_tol=1e-6) and math.isclose(whole[k], v, abs_tol=1e-6)
    # every third sequence is accepted for small families
    n = {r.family: r.n for r in sizes.collect()}
    w = {(r.family, r.leaf): r.weight for r in state["weights"].collect()}
    for r in third.collect():
        own = (1 + 2 * (n[r.family] - 2) / 200) * (w[r.family, r.a] + w[r.family, r.b])
        rest = sum(v for (f, z), v in w.items() if f == r.family and z not in (r.a, r.b))
        assert math.isclose(r.sum_w, 1 + rest / own, rel_tol=1e-9)


@pytest.mark.parametrize("name", ["lowpass", "highpass", "midpass", "homograph"])
def test_random_acceptance_is_reproducible(state, name):
    sel = T.leaf_pairs(state["nodes"], state["members"]).select("family", "a", "b", (F.col("subtree") / 5.0).alias("sel"))
    cfg = replace(CFG, selectivity_filter=name, selectivity=0.4)
    a = CO.third_weights(sel, state["weights"], cfg).orderBy("family", "a", "b").collect()
    b = CO.third_weights(sel, state["weights"], cfg).orderBy("family", "a", "b").collect()
    assert a == b and all(v == 0 for r in a for z, v in zip(r.zs, r.zw) if z in (r.a, r.b))


def test_selectivity_normalisation(state):
    sel = T.leaf_pairs(state["nodes"], state["members"]).select("family", "a", "b", F.col("subtree").cast("double").alias("sel"))
    sizes = state["weights"].groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    top = CO.normalise_selectivity(sel, sizes, "max").agg(F.max("sel")).first()[0]
    assert top == 1.0
    for mode in ("rank", "row_rank"):
        r = CO.normalise_selectivity(sel, sizes, mode).agg(F.min("sel"), F.max("sel")).first()
        assert r[0] == 0.0 and r[1] < 1.0
    seed = T.selectivity_distances(sel, sizes, "seed", 2)
    assert {r.sel for r in seed.select("sel").distinct().collect()} <= {0.0, 3.4028234663852886e38}


def test_best_path(spark):
    rng = np.random.default_rng(3)
    for budget in (10**7, 1):
        for _ in range(20):
            n, m = rng.integers(1, 9, 2)
            p = np.zeros((n + 1, m + 1))
            p[1:, 1:] = np.where(rng.random((n, m)) < 0.4, rng.random((n, m)), 0)
            i, j = np.nonzero(p[1:, 1:])
            c1, c2, length = sweep.best_path(i, j, p[1:, 1:][i, j], int(n), int(m), budget)
            assert list(c1) == sorted(set(c1)) and list(c2) == sorted(set(c2))
            assert set(c1) | set(c2) == set(range(length))
            got = sum(p[x + 1, y + 1] for x, cx in enumerate(c1) for y, cy in enumerate(c2) if cx == cy)
            assert math.isclose(got, brute.best_sum(p), abs_tol=1e-12)


def check_alignment(rows, fams):
    by = {}
    for r in rows:
        by.setdefault(r.family, {})[r.header] = r.seq
    assert by.keys() == fams.keys()
    for f, v in fams.items():
        assert {h: s.replace("-", "") for h, s in by[f].items()} == {f"s{i}": s for i, s in enumerate(v)}
        assert len({len(s) for s in by[f].values()}) == 1
        if len(v) > 1:
            columns = list(zip(*by[f].values()))
            assert all(set(c) != {"-"} for c in columns)


@pytest.mark.parametrize("kind", ["column", "random", "tree"])
def test_alignment_invariants(seqs, state, kind):
    df, fams = seqs
    cfg = replace(CFG, refinement=kind, accept_entropy=kind == "random", ignore_terminal_gaps=kind == "column")
    relaxed, rows = state["relaxed"], state["rows"]
    out = G.refine(rows, relaxed, df, cfg, state["nodes"], state["members"])
    check_alignment(G.render(out, df).collect(), fams)
    before = {r.family: r.len for r in rows.select("family", "len").distinct().collect()}
    after = {r.family: r.len for r in out.select("family", "len").distinct().collect()}
    assert all(after[f] <= before[f] for f in before)


def test_refinement_snapshots(seqs, state):
    seen = []
    G.refine(state["rows"], state["relaxed"], seqs[0], replace(CFG, save_every=1, refinement_passes=2), snapshot=lambda r, i: seen.append((i, r.count())))
    assert [i for i, _ in seen] == [1, 2]


def test_column_reliability_of_identical_rows(spark):
    df = spark.createDataFrame([("f", 0, "ACDEFGHIKLMNPQRSTVWY"), ("f", 1, "ACDEFGHIKLMNPQRSTVWY")], "family string, idx int, seq string")
    st = align_state(df, CFG)
    from seqloom.operators.columns import residue_columns

    rel = S.column_reliability(residue_columns(G.render(st["rows"], df)), P.unpack(st["posteriors"])).collect()
    assert len(rel) == 20 and all(r.m == 2 and 60 <= r.reliability <= 100 for r in rel)


def test_identical_sequences_align_without_gaps(spark):
    s = "MKVLAAGIVGLCAKAYELCHEW"
    df = spark.createDataFrame([("f", i, s) for i in range(4)], "family string, idx int, seq string")
    assert {r.seq for r in align(df, CFG).collect()} == {s}


def test_pipeline_keeps_every_residue(seqs):
    df, fams = seqs
    final, classes, segments = PL.run(df, replace(CFG, consistency_passes=1), details=True)
    check_alignment(final.collect(), fams)
    assert classes.count() >= 3 and segments.count() >= 3


def test_classifiers(spark):
    df = spark.createDataFrame([("a", 0.1, 3.0, 50, 4, 0.1, 0.2, 0.3), ("b", 0.9, 0.5, 2000, 4, 0.1, 0.2, 0.3)],
                               "family string, avg_pid double, un_sp double, len long, n long, sd_pid double, sd double, peak double")
    out = {r.family: r for r in M.length_class(M.strategy_class(M.base_class(df))).collect()}
    assert (out["a"].base_class, out["a"].strategy, out["a"].length_class) == (1, 0, 0)
    assert (out["b"].base_class, out["b"].strategy, out["b"].length_class) == (0, 1, 3)
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    scaled = M.scale(df, M.fit_scaler(df, "m", M.STRATEGY_FEATURES), "m", ["avg_pid", "un_sp"])
    assert {r.scaled_avg_pid for r in scaled.collect()} == {0.0, 1.0}
    train = VectorAssembler(inputCols=M.STRATEGY_FEATURES, outputCol="features").transform(df.withColumn("label", F.lit(5.0)))
    model = RandomForestClassifier(numTrees=2, maxDepth=2).fit(train)
    assert {r.strategy for r in M.strategy_class(df, model).collect()} == {1}


def test_chained_tree_in_closed_form(spark):
    from pyspark.sql import functions as F

    seqs = spark.createDataFrame([("x", k) for k in range(9)] + [("y", k) for k in range(2)] + [("z", 5)], "family string, idx int")
    plain = lambda df: sorted(df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes]).collect(), key=str)
    nodes, members = T.chained_tree(seqs)
    want_nodes, want_members = T.build_trees(T.chain_distances(seqs))
    assert plain(nodes.where("family <> 'z'")) == plain(want_nodes)
    assert plain(members) == plain(want_members.select(members.columns))
    assert [r["node"] for r in nodes.where("family = 'z'").collect()] == [5]


def test_a_family_refines_alike_alone_and_beside_others(spark):
    """The floor of usable columns is the configured number, not that of the largest family."""
    from pyspark.sql import functions as F

    from seqloom.config import AlignerConfig
    from seqloom.functions.draws import twister_stream
    from seqloom.operators.progressive import split_by_column

    rows = [("small", k, [c for c in range(12) if (c * 3 + k) % 4], 12) for k in range(6)]
    rows += [("large", k, [c for c in range(80) if (c * 5 + k) % 3], 80) for k in range(30)]
    df = spark.createDataFrame(rows, "family string, leaf int, cols array<int>, len int")
    cfg, found = AlignerConfig(column_fraction=0.5), []
    for part in (df, df.where("family = 'small'")):
        draws = part.select("family").distinct().withColumn("used", F.lit(0))
        sides, _ = split_by_column(part, draws, twister_stream(16), cfg)
        found.append(sorted(tuple(r) for r in sides.where("family = 'small'").collect()))
    assert found[0] == found[1] and found[0]


def test_a_stream_that_runs_out_is_an_error(spark):
    import pytest
    from pyspark.sql import functions as F

    from seqloom.functions.draws import uniform_draw

    df = spark.range(1).select(uniform_draw([7, 9], F.lit(2), F.lit(0), F.lit(5)).alias("d"))
    with pytest.raises(Exception, match="ran out"):
        df.collect()


def test_only_the_first_merge_has_a_distance_that_is_not_rounded(spark):
    """As in the SQL form: of two equal distances the second one is rounded, and may come to lie below the first."""
    d = 1.0 - 1.0 / 105
    assert round(d, 12) < d
    far = [(a, b, 0.9999) for a, b in ((0, 2), (0, 3), (1, 2), (1, 3))]
    df = spark.createDataFrame([("f", a, b, x) for a, b, x in [(0, 1, d), (2, 3, d), *far]], "family string, a int, b int, d double")
    nodes, _ = T.build_trees(df)
    got = {r["node"]: ({r["left"], r["right"]}, r["height"]) for r in nodes.where("level > 0").collect()}
    assert got == {4: ({2, 3}, round(d, 12)), 5: ({0, 1}, d), 6: ({4, 5}, 0.9999)}


@pytest.mark.parametrize("unit", [4, 64, 1 << 20])
def test_relaxed_places_are_relaxed_cells(spark, unit):
    """Groups of places give the sums over their listed cells, in any number of row blocks, and places listed twice."""
    rng = np.random.default_rng(unit)
    places = []
    for f in range(3):
        free = [(x, p) for x in range(6) for p in range(1, 12)]
        rng.shuffle(free)
        for n in (1, 2, 2, 5, 9, 20):
            got, free = free[:n], free[n:]
            got += got[:1] * (n == 9)
            places.append((f"f{f}", [int(x) for x, _ in got], [int(p) for _, p in got]))
    df = spark.createDataFrame(places, "family string, xs array<int>, ps array<int>")
    cells = [(f, a, b, i, j, 1 / (1 + abs(i - j))) for f, xs, ps in places for a, i in zip(xs, ps) for b, j in zip(xs, ps) if a < b]
    want = CO.relax_cells(spark.createDataFrame(cells, "family string, a int, b int, i int, j int, p double")).drop("p")
    got = CO.relax_places(df, lambda i, j: 1.0 / (1 + np.abs(i - j)), unit)
    rows = lambda d: sorted((*r[:5], round(r.relaxed, 9)) for r in d.collect())
    assert rows(got) == rows(want) and len(rows(got)) == len(cells)


def test_relaxed_words_list_no_cells(spark, tmp_path):
    """The cells of a long conversation are its words squared; they are not shuffled."""
    from seqloom.plans.registry import QUERIES

    rows = [("c", t, "user", " ".join(f"w{chr(97 + (t * k) % 7)}" for k in range(30))) for t in range(12)]
    spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    q = QUERIES["consistency_relax"](spark, str(tmp_path))
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and q.count() > 1000
