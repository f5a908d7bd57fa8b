"""Ordered-sequence operators that do not put a whole key into one task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task, which
fails when one key holds a large share of the table. The operators here work in
blocks: rows are numbered or summed inside small blocks, and only one row per
block takes part in the window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import exchanged, materialize

BLOCK = 4096


def islands(df: DataFrame, keys: list[str], pos: str = "col", flag: str = "hit", block: int = BLOCK) -> DataFrame:
    """Maximal runs of consecutive positions with a true flag.

    Returns ``(*keys, first, last)``. Runs are found per block of positions;
    only runs that touch a block border meet in the window over the key.
    """
    hits = df.where(F.col(flag)).withColumn("_blk", F.floor(F.col(pos) / block).cast("long"))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    local = (
        hits.withColumn("_g", F.col(pos) - F.row_number().over(w))
        .groupBy(*keys, "_blk", "_g")
        .agg(F.min(pos).alias("first"), F.max(pos).alias("last"))
        .drop("_g")
    )
    at_border = (F.col("first") == F.col("_blk") * block) | (F.col("last") == F.col("_blk") * block + block - 1)
    inner = local.where(~at_border).select(*keys, "first", "last")
    wk = Window.partitionBy(*keys).orderBy("first")
    chained = (
        local.where(at_border)
        .withColumn("_new", (F.lag("last").over(wk) + 1 != F.col("first")).cast("int"))
        .withColumn("_run", F.sum(F.coalesce("_new", F.lit(1))).over(wk))
        .groupBy(*keys, "_run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .select(*keys, "first", "last")
    )
    return inner.unionByName(chained)


def prefix_sum(df: DataFrame, keys: list[str], pos: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Inclusive running sum of ``value`` in the order of the integer ``pos``."""
    b = df.withColumn("_blk", F.floor(F.col(pos) / block).cast("long"))
    w = Window.partitionBy(*keys).orderBy("_blk")
    totals = (
        b.groupBy(*keys, "_blk")
        .agg(F.sum(value).alias("_t"))
        .withColumn("_off", F.sum("_t").over(w) - F.col("_t"))
        .drop("_t")
    )
    wb = Window.partitionBy(*keys, "_blk").orderBy(pos)
    joined = b.join(exchanged(totals), [*keys, "_blk"])
    return joined.withColumn(out, F.sum(value).over(wb) + F.col("_off")).drop("_blk", "_off")


def running_max(df: DataFrame, keys: list[str], pos: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Inclusive running maximum of ``value`` in the order of the integer ``pos``."""
    b = df.withColumn("_blk", F.floor(F.col(pos) / block).cast("long"))
    w = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tops = b.groupBy(*keys, "_blk").agg(F.max(value).alias("_t")).withColumn("_before", F.max("_t").over(w)).drop("_t")
    wb = Window.partitionBy(*keys, "_blk").orderBy(pos)
    return b.join(exchanged(tops), [*keys, "_blk"]).withColumn(
        out, F.greatest(F.max(value).over(wb), F.coalesce("_before", F.col(value)))).drop("_blk", "_before")


def stable_rank(df: DataFrame, keys: list[str], value: str, tie: str, out: str = "rank") -> DataFrame:
    """0-based rank by ``(value, tie)`` within ``keys``; ``tie`` is a unique integer. Nulls come first, a null key is a key.

    One range exchange sorts all keys together, so a hot key or any number of equal
    values spreads over many partitions. Places within a partition need no window; only a row per
    partition and key is left to add up.
    """
    v = F.col(value).cast("double")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, "_v", tie]
    # zeros of both signs are equal
    rows = df.withColumn("_v", F.when(v == 0, F.lit(0.0)).otherwise(v)).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()).drop("_v"), "ranked")
    part = F.shiftright("_at", 33)
    runs = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], part.alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_p")) - F.col("_n")
    runs = runs.withColumn("_move", earlier - F.col("_first")).drop("_n", "_first")
    same = part == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(runs, same).withColumn(out, (F.col("_at") + F.col("_move")).cast("long")).drop(
        "_at", "_p", "_move", *[f"_k{i}" for i in range(len(keys))])


def max_normalise(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Divide by the largest value of the key when it is above 1."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    x = F.col(value)
    return (
        df.join(top, keys)
        .withColumn(out, F.when(F.col("_top") > 1, x / F.col("_top")).otherwise(x))
        .drop("_top")
    )


def row_rank_normalise(df: DataFrame, keys: list[str], row: str, pos: str, value: str, size: str, out: str) -> DataFrame:
    """Rank within a matrix row divided by the matrix size."""
    ranked = stable_rank(df, [*keys, row], value, pos, "_r")
    return ranked.withColumn(out, F.col("_r") / F.col(size)).drop("_r")


def global_rank_normalise(df: DataFrame, keys: list[str], value: str, tie: str, size: str, out: str) -> DataFrame:
    """Rank over all cells of a matrix divided by ``n (n - 1)``."""
    ranked = stable_rank(df, keys, value, tie, "_r")
    return ranked.withColumn(out, F.col("_r") / (F.col(size) * (F.col(size) - 1))).drop("_r")


def retain_cutoff(
    df: DataFrame, keys: list[str], value: str, bounds: list[float], retain: Column, total: Column | None = None
) -> DataFrame:
    """Cutoff such that the fraction ``retain`` of the cells survives.

    Cells fall into buckets by descending bounds; the cutoff is the bound of
    the first bucket where the running count is above the number to keep, 0 when
    there is none. ``total`` overrides the number of cells the fraction is of.
    """
    arr = F.expr("array(" + ", ".join(f"{float(b)!r}D" for b in bounds) + ")")
    first_below = F.array_position(F.transform(arr, lambda c: F.col(value) > c), F.lit(True))
    bucket = F.when(first_below == 0, F.lit(len(bounds))).otherwise(first_below - 1).cast("int")
    counts = df.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    n_all = total if total is not None else F.sum("_n").over(w)
    run = F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = counts.withColumn("_keep", F.floor(n_all * retain)).withColumn("_run", run)
    hit = F.min(F.when(F.col("_run") > F.col("_keep"), F.col("_b")))
    return marked.groupBy(*keys).agg(
        hit.alias("_b"), F.max("_keep").alias("retain")
    ).select(*keys, "retain", F.coalesce(F.get(arr, F.col("_b")), F.lit(0.0)).alias("cutoff"))
