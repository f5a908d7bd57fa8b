"""Operators on long sparse cells ``(family, a, b, i, j, p)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.windows import prefix_sum, retain_cutoff


def cut(cells: DataFrame, cutoff: float) -> DataFrame:
    """Cells with a value of at least ``cutoff``."""
    return cells.where(F.col("p") >= cutoff)


def totals(cells: DataFrame) -> DataFrame:
    """Number and sum of the cells of each family."""
    return cells.groupBy("family").agg(F.count(F.lit(1)).alias("cells"), F.sum("p").alias("total"))


def row_sizes(cells: DataFrame) -> DataFrame:
    """Number of cells in every non-empty matrix row."""
    return cells.groupBy("family", "a", "b", "i").agg(F.count(F.lit(1)).alias("size"))


def row_offsets(cells: DataFrame) -> DataFrame:
    """Number of cells ahead of every matrix row."""
    run = prefix_sum(row_sizes(cells), ["family", "a", "b"], "i", "size", "_run")
    return run.select("family", "a", "b", "i", "size", (F.col("_run") - F.col("size")).alias("offset"))


def size_histogram(sizes: DataFrame, bounds: list[int], overflow: int = 666) -> DataFrame:
    """Rows by the first bound that is not below their size."""
    bucket = F.lit(overflow)
    for b in sorted(bounds, reverse=True):
        bucket = F.when(F.col("size") <= b, F.lit(b)).otherwise(bucket)
    return sizes.groupBy("family", bucket.alias("bound")).agg(F.count(F.lit(1)).alias("rows"))


def distance_histogram(distances: DataFrame, bins: int = 10) -> DataFrame:
    """Distances in equal bins of ``[0, 1]``; a bin contains its upper border.
    The pairs above 1 are a row of their own, with bin ``bins``."""
    borders = [(k + 1) / bins for k in range(bins)]
    bucket = F.lit(bins)
    for k in range(bins - 1, -1, -1):
        bucket = F.when(F.col("d") <= borders[k], F.lit(k)).otherwise(bucket)
    return distances.select("family", bucket.alias("bin")).groupBy("family", "bin").agg(
        F.count(F.lit(1)).alias("pairs")
    )


def local_bounds(start: float, factor: float = 1.1) -> list[float]:
    """Descending cutoffs from near 1 down to ``start``."""
    import math

    count = int(math.log(1.0 / start) / math.log(factor) + 1)
    out = [start]
    while len(out) < count:
        out.append(out[-1] * factor)
    return out[::-1]


def global_bounds(count: int = 30, factor: float = 1.2) -> list[float]:
    """Descending cutoffs from 1."""
    out = [1.0]
    while len(out) < count:
        out.append(out[-1] / factor)
    return out


def local_cutoffs(cells: DataFrame, fraction: float, start: float = 0.01) -> DataFrame:
    """Cutoff of every matrix that keeps about a fraction of its cells."""
    return retain_cutoff(cells, ["family", "a", "b"], "p", local_bounds(start), F.lit(fraction))


def global_cutoffs(cells: DataFrame, fraction: float) -> DataFrame:
    """One cutoff per family that keeps about a fraction of its cells."""
    return retain_cutoff(cells, ["family"], "p", global_bounds(), F.lit(fraction))


def filter_by_cutoff(cells: DataFrame, cutoffs: DataFrame, keys: list[str]) -> DataFrame:
    """Cells at or above the cutoff of their key; all where it is null."""
    return cells.join(cutoffs.select(*keys, "cutoff"), keys).where("cutoff is null or p >= cutoff").drop("cutoff")


def keep_count(lengths: DataFrame, fill: float) -> DataFrame:
    """Cells to keep per matrix: the shorter length plus a share of the rest."""
    least = F.least(F.col("len_a"), F.col("len_b"))
    return lengths.withColumn("keep", F.floor((F.col("len_a") * F.col("len_b") - least) * fill) + least)


#: Lower borders of the exponents of values up to 1.
EXPONENTS = [2.0**-k for k in range(64)]


def first_at_most(value: Column, bounds: list[float]) -> Column:
    """Place (from 0) of the first of the falling ``bounds`` that isn't above ``value``, their number if there is none."""
    arr = F.array(*[F.lit(float(b)) for b in bounds])
    found = F.array_position(F.transform(arr, lambda c: value >= c), F.lit(True))
    return F.when(found == 0, F.lit(len(bounds))).otherwise(found - 1).cast("int")


def bucket_runs(cells: DataFrame, keys: list[str], bounds: list[float]) -> DataFrame:
    """``(*keys, k, n, run)``: cells of each bucket of values, and those of it and all higher ones.

    One aggregation with map-side combine; the window is over the buckets of a key."""
    n = cells.groupBy(*keys, first_at_most(F.col("p"), bounds).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("run", F.sum("n").over(Window.partitionBy(*keys).orderBy("k")))


def keep_largest(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """The ``keep`` largest cells of every matrix; ties go to the first cell.

    A histogram over the exponents tells the bucket in which the last kept cell
    lies: higher ones are kept whole, lower ones go, and only that bucket is ranked.
    """
    keys = ["family", "a", "b"]
    runs = bucket_runs(cells, keys, EXPONENTS).join(counts.select(*keys, "keep"), keys)
    place = runs.select(*keys, "k", (F.col("run") <= F.col("keep")).alias("_whole"), (F.col("keep") - F.col("run") + F.col("n")).alias("_rest"))
    place = place.where("_whole or _rest > 0")
    at = cells.withColumn("k", first_at_most(F.col("p"), EXPONENTS)).join(place, [*keys, "k"]).drop("k")
    w = Window.partitionBy(*keys).orderBy(F.col("p").desc(), "i", "j")
    ranked = at.where("not _whole").withColumn("_r", F.row_number().over(w)).where("_r <= _rest").drop("_r")
    return at.where("_whole").unionByName(ranked).drop("_whole", "_rest")


def bucket_cutoffs(cells: DataFrame, counts: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    """``(family, a, b, kept, cutoff)``: a cutoff for at most ``keep`` cells of every matrix, found without ranking any.

    It is the border of the last bucket up to which no more than ``keep`` cells lie. Where even the
    highest bucket has more, or nothing is to go, all cells stay (cutoff 0).
    """
    bounds = bounds or EXPONENTS
    keys = ["family", "a", "b"]
    runs = bucket_runs(cells, keys, bounds).join(counts.select(*keys, "keep"), keys)
    fits = F.col("run") <= F.col("keep")
    found = runs.groupBy(*keys).agg(
        F.max(F.when(fits, F.col("k"))).alias("_k"), F.max(F.when(fits, F.col("run"))).alias("_run"),
        F.sum("n").alias("_n"), F.first("keep").alias("_keep"))
    # a matrix that keeps all its cells needs no border
    open_ = F.col("_k").isNull() | (F.col("_n") <= F.col("_keep")) | (F.col("_k") == len(bounds))
    border = F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.col("_k") + 1)
    return found.select(*keys, F.when(open_, F.col("_n")).otherwise(F.col("_run")).alias("kept"),
                        F.when(open_, F.lit(0.0)).otherwise(border).alias("cutoff"))


def longest_row_cutoffs(
    cells: DataFrame, fraction: float, most: int, lengths: DataFrame | None = None, start: float = 0.01
) -> DataFrame:
    """``(family, a, b, retain, cutoff)``: a cutoff that keeps about a fraction of a matrix and no row longer than ``most``.

    The fraction is of its cells, or of all its places where ``lengths`` (``family, a, b, len_a, len_b``) are
    given. A matrix with fewer cells than that stays whole (null cutoff) unless a row is too long; it then starts from the
    last bound but one. From there bounds are raised until the longest row fits; where none does, the
    highest is taken. Rows are counted bucket by bucket, so a row is never listed.
    """
    keys = ["family", "a", "b"]
    bounds = local_bounds(start)
    strict = F.array(*[F.lit(float(b)) for b in bounds])
    first = F.array_position(F.transform(strict, lambda c: F.col("p") > c), F.lit(True))
    by_row = cells.groupBy(*keys, "i", F.when(first == 0, F.lit(len(bounds))).otherwise(first - 1).cast("int").alias("k"),
                           first_at_most(F.col("p"), bounds).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    # cells at or above bound q of a row; the first bound at which there are too many
    in_row = by_row.groupBy(*keys, "i", "q").agg(F.sum("n").alias("n"))
    run = F.sum("n").over(Window.partitionBy(*keys, "i").orderBy("q"))
    rows = in_row.withColumn("_run", run).groupBy(*keys).agg(
        F.min(F.when(F.col("_run") > most, F.col("q"))).alias("_over"), F.max("_run").alias("_longest"))
    total = by_row.groupBy(*keys, "k").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys)
    marked = total.withColumn("_all", F.sum("n").over(w)).withColumn("_run", F.sum("n").over(w.orderBy("k")))
    if lengths is not None:
        marked = marked.join(lengths.select(*keys, (F.col("len_a") * F.col("len_b")).alias("_of")), keys)
    else:
        marked = marked.withColumn("_of", F.col("_all"))
    marked = marked.withColumn("_keep", F.floor(F.col("_of") * fraction))
    found = marked.groupBy(*keys).agg(
        F.max("_keep").alias("retain"), F.max("_all").alias("_all"), F.min(F.when(F.col("_run") > F.col("_keep"), F.col("k"))).alias("_k"))
    few = F.col("_all") < F.col("retain")
    k = F.when(few, F.lit(len(bounds) - 2)).otherwise(F.coalesce("_k", F.lit(0)))
    # the last place of the bounds stands for all cells
    fits = F.least(k, F.coalesce(F.col("_over") - 1, F.lit(len(bounds))))
    value = F.get(strict, F.greatest(fits, F.lit(0)))
    cutoff = F.when(few & (F.col("_longest") < most), F.lit(None).cast("double")).otherwise(F.coalesce(value, F.lit(0.0)))
    return found.join(rows, keys).select(*keys, "retain", cutoff.alias("cutoff"))


def column_reliability(columns: DataFrame, cells: DataFrame) -> DataFrame:
    """Reliability of every alignment column, 0 to 100.

    ``columns``: ``(family, idx, pos, col)``. Every posterior cell looks up the
    columns of its two residues and counts where they agree, so the residue
    pairs of a column are never listed.
    """
    at = lambda k, p: columns.select("family", F.col("idx").alias(k), F.col("pos").alias(p), F.col("col").alias(f"c{k}"))
    hit = cells.join(at("a", "i"), ["family", "a", "i"]).join(at("b", "j"), ["family", "b", "j"]).where("ca = cb")
    sums = hit.groupBy("family", F.col("ca").alias("col")).agg(F.sum("p").alias("_v"))
    m = columns.groupBy("family", "col").agg(F.count(F.lit(1)).alias("m"))
    v = F.coalesce("_v", F.lit(0.0))
    score = F.when(F.col("m") > 1, F.floor(F.lit(200.0) * v / (F.col("m") * (F.col("m") - 1)))).otherwise(F.lit(0))
    return m.join(sums, ["family", "col"], "left").select("family", "col", "m", score.cast("long").alias("reliability"))


def weight_total(pairs: DataFrame, weights: DataFrame, limit: float | None = None, distance: Column | None = None) -> DataFrame:
    """Sum over pairs of the product of both weights, optionally only for pairs
    within a distance."""
    w = lambda k: weights.select("family", F.col("leaf").alias(k), F.col("weight").alias(f"w{k}"))
    p = pairs.where((distance if distance is not None else F.col("d")) <= limit) if limit is not None else pairs
    return p.join(w("a"), ["family", "a"]).join(w("b"), ["family", "b"]).groupBy("family").agg(
        F.sum(F.col("wa") * F.col("wb")).alias("weight_total")
    )


def length_statistics(seqs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Smallest, largest and mean length per family, and of the weights if given."""
    n = F.length("seq").cast("long")
    out = seqs.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.avg(n).alias("mean_len")
    )
    if weights is not None:
        out = out.join(weights.groupBy("family").agg(
            F.min("weight").alias("min_w"), F.max("weight").alias("max_w"), F.avg("weight").alias("mean_w")
        ), "family", "left")
    return out
