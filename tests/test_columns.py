import random
from collections import Counter

import math
import pytest
from pyspark.sql import functions as F

from seqloom import constants as K
from seqloom.operators import columns as C
from seqloom.operators import regions as R

S = K.square(K.BLOSUM62_LOWER)
SCORE = {(a, b): S[i][j] for i, a in enumerate(K.AMINO) for j, b in enumerate(K.AMINO)}


def families(seed=1, count=6):
    rng = random.Random(seed)
    out = {}
    for k in range(count):
        n, length = rng.randint(1, 6), rng.choice([1, 2, 3, 17, 40])
        base = [rng.choice(K.AMINO) for _ in range(length)]
        out[f"f{k}"] = ["".join(b if rng.random() < 0.6 else rng.choice(K.AMINO + "-BXJ") for b in base) for _ in range(n)]
    return out


def frame(spark, fams):
    return spark.createDataFrame(
        [(f, i, f"s{i}", s) for f, v in fams.items() for i, s in enumerate(v)], "family string, idx int, header string, seq string"
    )


def pair_scores(rows):
    out = []
    for col in zip(*rows):
        out.append(sum(SCORE.get((col[i], col[j]), 0) for i in range(len(col)) for j in range(i + 1, len(col))))
    return out


def test_scores_and_statistics(spark):
    fams = families()
    s = C.column_scores(frame(spark, fams))
    got = {(r.family, r.col): (r.pair_sum, r.score) for r in s.collect()}
    stats = {r.family: r for r in C.family_stats(s).collect()}
    for f, rows in fams.items():
        want = pair_scores(rows)
        n = len(rows)
        pairs = n * (n - 1) / 2
        assert [got[f, c][0] for c in range(len(want))] == want
        if n == 1:
            assert got[f, 0][1] is None and stats[f].un_sp is None
            continue
        v = [w / pairs for w in want]
        mean = sum(v) / len(v)
        assert [got[f, c][1] for c in range(len(v))] == v
        assert math.isclose(stats[f].un_sp, mean, abs_tol=1e-12)
        assert math.isclose(stats[f].sd, math.sqrt(sum((x - mean) ** 2 for x in v) / len(v)), abs_tol=1e-9)
        assert math.isclose(stats[f].peak, sum(x >= 1 for x in v) / len(v))
    avg = {r.family: r.avg_score for r in C.average_score(s, ["family"]).collect()}
    assert all(avg[f] == -1.0 for f, rows in fams.items() if len(rows) == 1)


def regions_by_scan(scores, inside, need):
    """The same rule by walking along the columns."""
    out, head = [], None
    last = len(scores) - 1
    for i, v in enumerate(scores + [None]):
        hit = v is not None and inside(v)
        if hit and head is None:
            head = i
        if not hit and head is not None:
            if i - head >= 3:
                end = i - 1 if i - 1 == last else i
                if end - (head + 1) > need:
                    out.append((head + 1, end))
            head = None
    return out


@pytest.mark.parametrize("cls,need", [(0, 1), (1, 10), (3, 30)])
def test_regions(spark, cls, need):
    rng = random.Random(cls)
    rows, scores = [], {}
    for f in ("a", "b", "c"):
        v = []
        while len(v) < 120:
            v += [rng.choice([0.5, 3.0, -1.0])] * rng.randint(1, 45)
        scores[f] = v
        rows += [(f, i, float(x)) for i, x in enumerate(v)]
    scores["whole"] = [0.0] * 50
    rows += [("whole", i, 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, "family string, col long, score double")
    low = {(r.family, r.a, r.b) for r in R.unreliable_regions(df, cls).collect()}
    high = {(r.family, r.a, r.b) for r in R.reliable_regions(df).collect()}
    assert low == {(f, *x) for f, v in scores.items() for x in regions_by_scan(v, lambda s: 0 <= s <= 1.2, need)}
    assert high == {(f, *x) for f, v in scores.items() for x in regions_by_scan(v, lambda s: s > 2, 2)}


def test_segments_cover_and_recombine(spark):
    fams = families(9, 5)
    rows = frame(spark, fams)
    cols = C.column_table(rows)
    shape = C.family_shape(cols)
    reg = R.unreliable_regions(C.score_from_counts(cols).withColumn("score", F.coalesce("score", F.lit(0.0))), 0)
    seg = R.partition_columns(reg, shape)
    cover = {f: Counter() for f in fams}
    for r in seg.collect():
        cover[r.family].update(range(r.s, r.e + 1))
    for f, v in fams.items():
        assert cover[f] == Counter(range(len(v[0])))
    back = {(r.family, r.header): r.seq for r in R.recombine(R.cut_segments(rows, seg, shape)).collect()}
    assert back == {(f, f"s{i}"): s for f, v in fams.items() for i, s in enumerate(v)}


def test_empty_rows_and_choice(spark):
    frags = spark.createDataFrame(
        [("f", 0, 3, "x", "AC-G"), ("f", 0, 3, "y", "----"), ("f", 0, 3, "z", "A--G")],
        "family string, s long, e long, header string, frag string",
    )
    some, empty = R.split_empty_rows(frags)
    assert {r.header for r in empty.collect()} == {"y"}
    new = some.withColumn("frag", F.concat("frag", F.lit("-")))
    back = {r.header: r.frag for r in R.restore_empty_rows(new, empty).collect()}
    assert back == {"x": "AC-G-", "y": "-----", "z": "A--G-"}
    o = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "family string, avg_score double")
    n = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "family string, avg_score double")
    got = {r.family: r.use_original for r in R.choose_segments(o, n, ["family"]).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_count_fallback(spark):
    cols = "family string, s long, e long, header string, frag string"
    new = spark.createDataFrame([("f", 0, 1, "x", "AA"), ("f", 2, 3, "x", "CC"), ("f", 2, 3, "y", "C-")], cols)
    old = spark.createDataFrame([("f", 0, 1, h, "gg") for h in "xy"] + [("f", 2, 3, h, "gg") for h in "xy"], cols)
    n = spark.createDataFrame([("f", 2)], "family string, n long")
    got = sorted((r.s, r.header, r.frag) for r in R.fall_back_on_count(new, old, n).collect())
    assert got == [(0, "x", "gg"), (0, "y", "gg"), (2, "x", "CC"), (2, "y", "C-")]


def test_conservation_and_projection(spark):
    rows = frame(spark, {"f": ["SA-K-F", "TAGK-Y", "AAGK-W"], "g": ["C", "S", "R"]})
    got = {}
    for r in C.conservation_symbol(C.column_table(rows)).orderBy("family", "col").collect():
        got[r.family] = got.get(r.family, "") + r.symbol
    assert got == {"f": ":***" + "*" + ":", "g": " "}
    kept = {r.header: r.seq for r in C.project_rows(rows.where("family = 'f'"), F.col("header") != "s1").collect()}
    assert kept == {"s0": "SA-KF", "s2": "AAGKW"}


def test_property_and_entropy(spark):
    rows = frame(spark, {"f": ["DA", "EA", "K-"]})
    r = {x.col: x for x in C.property_consensus(C.column_table(rows)).collect()}
    bit = {name: 1 << i for i, (name, _) in enumerate(K.PROPERTIES)}
    assert r[0].common == bit["polar"] | bit["charged"]
    assert r[0].present == K.property_mask("D") | K.property_mask("E") | K.property_mask("K")
    e = {x.col: x for x in C.column_entropy(C.column_table(rows)).collect()}
    want = 0.0
    for ch in K.AMINO:
        p = (0.5 + {"A": 2}.get(ch, 0)) / 12
        want -= p * math.log2(p) / math.log2(20)
    assert math.isclose(e[1].entropy, want) and math.isclose(e[1].gap_score, 1 / 3)


def test_duplicate_headers_last_wins(spark):
    df = spark.createDataFrame([("f", 0, "h", "AA"), ("f", 1, "h", "CC"), ("f", 2, "k", "GG")], "family string, idx int, header string, seq string")
    assert {(r.header, r.seq) for r in C.dedup_headers(df).collect()} == {("h", "CC"), ("k", "GG")}


def test_gap_counts_shuffle_no_letter_counts(spark):
    rows = spark.createDataFrame([("f", 0, "h", "AC-D"), ("f", 1, "i", "-C-"), ("g", 0, "h", "")], "family string, idx long, header string, seq string")
    df = C.inner_gap_counts(rows, C.column_table(rows))
    assert sorted(tuple(r) for r in df.collect()) == [("f", 0, 2, 0), ("f", 1, 2, 0), ("f", 2, 2, 1), ("f", 3, 2, 0)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # the counts of single letters stay below the first join: nothing above it names them
    assert "r_A#" not in plan.split("Join LeftOuter")[0]


def test_column_table_is_complete_when_written(spark):
    """The number of rows comes with the cells: the wide table is not joined again."""
    rows = spark.createDataFrame([("f", 0, "h", "AC-D"), ("f", 1, "i", ""), ("f", 2, "j", None), ("g", 0, "h", "")],
                                 "family string, idx long, header string, seq string")
    table = C.column_table(rows)
    assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["family"], r["col"], r["n"], r["r_A"] + r["r_C"] + r["r_D"]) for r in table.collect()]
    assert sorted(got) == [("f", 0, 2, 1), ("f", 1, 2, 1), ("f", 2, 2, 0), ("f", 3, 2, 1)]


def test_dropped_columns_of_long_short_and_empty_rows(spark):
    import random

    r = random.Random(8)
    rows = [("f", k, f"s{k}", "".join(r.choice("A-") if c % 7 else "-" for c in range(n))) for k, n in enumerate((400, 59, 60, 61, 1, 0, 250))]
    rows += [("full", k, f"s{k}", "AC" * 75) for k in range(2)] + [("gaps", 0, "s0", "---"), ("empty", 0, "s0", ""), ("none", 0, "s0", "A-C"), ("none", 1, "s1", None)]
    df = spark.createDataFrame(rows, "family string, idx int, header string, seq string")
    got = {(x.family, x.idx): x.seq for x in C.project_rows(df, F.lit(True)).collect()}
    want = {}
    for f in {x[0] for x in rows}:
        texts = {x[1]: x[3] or "" for x in rows if x[0] == f}
        used = [c for c in range(max(map(len, texts.values()))) if any(t[c : c + 1] not in ("", "-") for t in texts.values())]
        if used:
            want |= {(f, k): "".join(t[c : c + 1] or "-" for c in used) for k, t in texts.items()}
    assert got == want
