"""Cutoffs of sparse matrices by buckets, against plain loops over the cells."""

import random

import pytest

from seqloom.operators import sparse as S


def matrices(seed):
    r = random.Random(seed)
    out = {}
    for k in range(8):
        cells = {}
        for _ in range(r.choice([1, 5, 60])):
            cells[r.randrange(1, 9), r.randrange(1, 30)] = r.choice([r.random(), 0.5, 1.0, 0.25, 1e-7])
        out["f", k, k + 1] = cells
    out["f", 90, 91] = {(1, j): 0.9 - j / 100 for j in range(1, 40)} | {(i, 1): 0.05 for i in range(2, 20)}  # a long row
    return out


def frame(spark, ms):
    return spark.createDataFrame([(*m, i, j, p) for m, cells in ms.items() for (i, j), p in cells.items()],
                                 "family string, a int, b int, i int, j int, p double")


def kept(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.family, r.a, r.b), set()).add((r.i, r.j))
    return out


@pytest.mark.parametrize("keep", [0, 1, 7, 30, 1000])
def test_largest_cells_and_bucket_cutoffs(spark, keep):
    ms = matrices(keep)
    cells = frame(spark, ms)
    counts = spark.createDataFrame([(*m, keep) for m in ms], "family string, a int, b int, keep long")
    want = {m: set(sorted(c, key=lambda x: (-c[x], x))[:keep]) for m, c in ms.items()}
    assert kept(S.keep_largest(cells, counts)) == {m: c for m, c in want.items() if c}
    cut = {(r.family, r.a, r.b): r for r in S.bucket_cutoffs(cells, counts).collect()}
    got = kept(S.filter_by_cutoff(cells, S.bucket_cutoffs(cells, counts), ["family", "a", "b"]))
    for m, c in ms.items():
        fits = [b for b in S.EXPONENTS if 0 < sum(p >= b for p in c.values()) <= keep]
        want = set(c) if len(c) <= keep or not fits else {x for x, p in c.items() if p >= fits[-1]}
        assert got[m] == want and cut[m].kept == len(want)


@pytest.mark.parametrize("fraction,most,dense", [(0.3, 3, False), (0.9, 3, False), (0.05, 2, True), (0.9, 50, True), (0.9, 5, True)])
def test_longest_row(spark, fraction, most, dense):
    ms = matrices(5)
    bounds = S.local_bounds(0.01)
    lengths = spark.createDataFrame([(*m, 20, 40) for m in ms], "family string, a int, b int, len_a long, len_b long")
    got = {(r.family, r.a, r.b): (r.retain, r.cutoff) for r in S.longest_row_cutoffs(
        frame(spark, ms), fraction, most, lengths if dense else None).collect()}
    for m, c in ms.items():
        row = lambda low: max(sum(p >= low for (i, _), p in c.items() if i == x) for x, _ in c)  # noqa: E731, B023
        retain = int((800 if dense else len(c)) * fraction)
        if len(c) < retain and row(0) < most:
            assert got[m] == (retain, None)
            continue
        if len(c) < retain:
            k = len(bounds) - 2
        else:
            above = [sum(p > b for p in c.values()) for b in bounds] + [len(c)]
            k = next((k for k, n in enumerate(above) if n > retain), 0)
        low = [*bounds, 0.0]
        while k > 0 and row(low[k]) > most:
            k -= 1
        assert got[m] == (retain, low[k])
        assert k == 0 or row(low[k]) <= most
