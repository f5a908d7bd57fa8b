import random

import pytest

from seqloom.operators import windows as W


def test_islands_cross_block_borders(spark):
    rng = random.Random(5)
    flags = {f: [rng.random() < 0.7 for _ in range(60)] for f in "ab"}
    flags["c"] = [True] * 33
    df = spark.createDataFrame([(f, i, h) for f, v in flags.items() for i, h in enumerate(v)], "family string, col long, hit boolean")
    want = set()
    for f, v in flags.items():
        start = None
        for i, h in enumerate([*v, False]):
            if h and start is None:
                start = i
            if not h and start is not None:
                want.add((f, start, i - 1))
                start = None
    for block in (1, 4, 7, 4096):
        got = [(r.family, r["first"], r["last"]) for r in W.islands(df, ["family"], block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("parts", ["1", "7"])
def test_stable_rank_with_heavy_ties(spark, parts):
    rng = random.Random(2)
    rows = [("x", i, rng.choice([0.0, -0.0, 0.5, 0.5, -3.25, 1e-9, 7.0])) for i in range(200)]
    rows += [("y", i, rng.uniform(-2, 2)) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, tie long, v double")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r.k, r.tie): r["rank"] for r in W.stable_rank(df, ["k"], "v", "tie").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    for key in "xy":
        part = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        assert [got[key, r[1]] for r in part] == list(range(len(part)))


def test_prefix_sum(spark):
    df = spark.createDataFrame([("a", i, i % 5) for i in range(100)], "k string, pos long, v long")
    for block in (3, 64):
        got = {r.pos: r.s for r in W.prefix_sum(df, ["k"], "pos", "v", "s", block=block).collect()}
        total = 0
        for i in range(100):
            total += i % 5
            assert got[i] == total


def test_retain_cutoff(spark):
    df = spark.createDataFrame([("a", v / 10) for v in range(1, 11)], "k string, p double")
    from pyspark.sql import functions as F

    r = W.retain_cutoff(df, ["k"], "p", [0.9, 0.7, 0.5, 0.3], F.lit(0.3)).first()
    # buckets hold 1.0 | 0.9, 0.8 | 0.7, 0.6 | ...: the fourth cell lies in the third
    assert (r.retain, r.cutoff) == (3, 0.5)


def test_stable_rank_of_a_narrow_range(spark):
    from pyspark.sql import functions as F

    from seqloom.operators.windows import stable_rank

    df = spark.range(4000).select(F.lit("f").alias("family"), F.col("id").alias("tie"), (1000 + F.pmod(F.col("id") * 7919, F.lit(997)) / 1e6).alias("v"))
    got = {r["tie"]: r["rank"] for r in stable_rank(df, ["family"], "v", "tie").collect()}
    values = [(1000 + (k * 7919 % 997) / 1e6, k) for k in range(4000)]
    assert got == {k: i for i, (_, k) in enumerate(sorted(values))}


def test_stable_rank_of_null_keys_and_values(spark):
    rows = [(None, 3, 1.0), (None, 1, None), ("a", 2, 5.0), ("a", 4, None), (None, 9, -1.0)]
    df = spark.createDataFrame(rows, "k string, tie long, v double")
    got = {(r.k, r.tie): r["rank"] for r in W.stable_rank(df, ["k"], "v", "tie").collect()}
    assert got == {(None, 1): 0, (None, 9): 1, (None, 3): 2, ("a", 4): 0, ("a", 2): 1}
    assert W.stable_rank(df.limit(0), ["k"], "v", "tie").count() == 0


def test_running_max(spark):
    from seqloom.operators.windows import running_max

    rows = [("a", k, (k * 37) % 101) for k in range(50)]
    df = spark.createDataFrame(rows, "family string, pos long, v long")
    got = {r["pos"]: r["m"] for r in running_max(df, ["family"], "pos", "v", "m", block=7).collect()}
    assert got == {k: max(v for _, p, v in rows if p <= k) for k in range(50)}
