"""Per-column statistics of aligned families.

Aligned rows ``(family, idx, header, seq)`` are counted once into the column
table ``(family, col, n, r_A .. r_Z)``; everything else is computed from that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom import constants as K
from seqloom.functions import residues as R
from seqloom.session import materialize

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"



def dedup_headers(rows: DataFrame) -> DataFrame:
    """One row per header, the last one wins."""
    return rows.groupBy("family", "header").agg(
        F.max("idx").alias("idx"), F.max_by("seq", "idx").alias("seq")
    )


def column_table(rows: DataFrame, seq: str = "seq", keys=("family",), pairs: bool = False) -> DataFrame:
    """Letter counts of every column: ``(*keys, col, n, r_A .. r_Z)``, with
    ``pairs`` also ``pair_sum``.

    The number of rows of a family is counted first and travels with each row, so
    that the wide column table is neither joined nor shuffled again. The aggregate
    has one row per column and is written out; the pairs of a column are never
    formed, and map-side combine keeps the shuffle at the size of the columns,
    however many rows a family has.
    """
    keys = list(keys)
    shape = rows.groupBy(*keys).agg(F.count(seq).alias("n"))
    counted = counted_columns(rows.join(shape, keys), seq, keys)
    if pairs:
        counted = counted.withColumn("pair_sum", pair_sum())
    return materialize(counted, "columns")


def counted_columns(rows: DataFrame, seq: str = "seq", keys=("family",)) -> DataFrame:
    """Letter counts as ``column_table``, of rows that already carry ``n``; they are not written.

    Rows that come in partitions by family are counted where they are, so the
    counts of a task are those of its partition.
    """
    keys = list(keys)
    cells = rows.where(F.length(seq) > 0).select(*keys, "n", F.posexplode(F.split(F.col(seq), "")).alias("col", "x"))
    cells = cells.select(*keys, "n", F.col("col").cast("long").alias("col"), R.encode(F.col("x")).alias("_c"))
    aggs = [F.expr(f"count_if(_c = {i}) AS r_{ch}") for i, ch in enumerate(LETTERS)]
    return cells.groupBy(*keys, "col", "n").agg(*aggs)


def family_shape(cols: DataFrame, keys=("family",)) -> DataFrame:
    """``(*keys, n, len)``: rows and columns of each family."""
    return cols.groupBy(*keys).agg(F.max("n").alias("n"), (F.max("col") + 1).alias("len"))


def residue_total() -> Column:
    return F.expr(" + ".join(f"r_{ch}" for ch in LETTERS))


def pair_sum(letters: str = K.AMINO, scores=None) -> Column:
    """Sum of substitution scores over all row pairs of a column, from counts.

    With counts ``c`` and scores ``S`` this is ``(c'Sc - diag(S)'c) / 2``, taken
    over the letters that occur in the column. It is written with array functions,
    because 400 unrolled products would exceed the size up to which the JVM
    compiles a method.
    """
    s, size = scores or K.square(K.BLOSUM62_LOWER), len(letters)
    flat = "array(" + ", ".join(f"{int(v)}L" for r in s for v in r) + ")"
    counts = "array(" + ", ".join(f"struct({i} AS i, r_{ch} AS c)" for i, ch in enumerate(letters)) + ")"
    here = f"filter({counts}, x -> x.c > 0)"
    with_y = f"aggregate(xs, 0L, (u, y) -> u + y.c * get({flat}, x.i * {size} + y.i))"
    one = f"x.c * ({with_y} - get({flat}, x.i * {size} + x.i))"
    # the letters are bound once to xs
    total = f"transform(array({here}), xs -> aggregate(xs, 0L, (t, x) -> t + {one}))[0]"
    return F.expr(f"{total} div 2")


def column_scores(rows: DataFrame, seq: str = "seq", keys=("family",)) -> DataFrame:
    """Average pair score of every column: ``(*keys, col, n, pair_sum, score)``.

    A family with one row has no pairs; its score is null.
    """
    return score_from_counts(column_table(rows, seq, keys, pairs=True), keys)


def score_from_counts(cols: DataFrame, keys=("family",)) -> DataFrame:
    n = F.col("n").cast("double")
    cols = cols if "pair_sum" in cols.columns else cols.withColumn("pair_sum", pair_sum())
    return cols.select(
        *keys, "col", "n", "pair_sum",
        F.when(n > 1, F.col("pair_sum") / (n * (n - 1) / 2)).alias("score"),
    )


def family_stats(scores: DataFrame) -> DataFrame:
    """Mean, population deviation and peak share of the column scores.

    Integer pair sums are added exactly and divided once, so the mean does not
    depend on the order of addition.
    """
    n = F.col("n").cast("double")
    s = scores.groupBy("family").agg(
        F.max("n").alias("n"),
        F.count(F.lit(1)).alias("len"),
        F.sum(F.col("pair_sum").cast("decimal(38,0)")).cast("double").alias("_s"),
        F.sum(F.col("pair_sum").cast("decimal(38,0)") * F.col("pair_sum")).cast("double").alias("_q"),
        F.sum((F.col("score") >= K.PEAK_SCORE).cast("long")).alias("_p"),
    )
    pairs = n * (n - 1) / 2
    mean = F.col("_s") / F.col("len") / pairs
    var = (F.col("_q") / F.col("len") - (F.col("_s") / F.col("len")) * (F.col("_s") / F.col("len"))) / (pairs * pairs)
    return s.select(
        "family", "n", "len",
        F.when(n > 1, mean).alias("un_sp"),
        F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("sd"),
        F.when(n > 1, F.col("_p") / F.col("len")).alias("peak"),
    )


def average_score(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean column score per key, -1 when there is no pair or no column."""
    n = F.col("n").cast("double")
    return scores.groupBy(*keys).agg(
        F.sum(F.col("pair_sum").cast("decimal(38,0)")).cast("double").alias("_s"), F.max("n").alias("n"), F.count(F.lit(1)).alias("len")
    ).select(
        *keys, "n", "len",
        F.when(n > 1, F.col("_s") / F.col("len") / (n * (n - 1) / 2)).otherwise(F.lit(-1.0)).alias("avg_score"),
    )


def unreliable_families(scores: DataFrame, theta: float, share: float) -> DataFrame:
    """True for a family whose share of columns at or below ``theta`` reaches ``share``."""
    low = F.avg((F.col("score") <= theta).cast("double"))
    return scores.groupBy("family").agg(low.alias("low_share")).withColumn(
        "unreliable", F.col("low_share") >= share
    )


def gap_counts(cols: DataFrame) -> DataFrame:
    """Number of gaps per column."""
    return cols.select("family", "col", "n", (F.col("n") - residue_total()).alias("gaps"))


def inner_gap_counts(rows: DataFrame, cols: DataFrame, seq: str = "seq") -> DataFrame:
    """Gaps per column between the first and the last residue of each row.

    Each row adds +1 where its residue span starts and -1 behind its end; the
    running sum is the number of rows that span a column, so gap cells are not
    listed one by one.
    """
    from seqloom.operators.windows import prefix_sum

    head = F.length(F.regexp_extract(seq, r"^[^A-Za-z]*", 0)).cast("long")
    tail = F.length(F.regexp_replace(seq, r"[^A-Za-z]+$", "")).cast("long")
    spans = rows.where(F.col(seq).rlike("[A-Za-z]")).select(
        "family", F.explode(F.array(
            F.struct(head.alias("col"), F.lit(1).cast("long").alias("d")),
            F.struct(tail.alias("col"), F.lit(-1).cast("long").alias("d")),
        )).alias("s")
    ).select("family", "s.col", "s.d").groupBy("family", "col").agg(F.sum("d").alias("d"))
    # the letters are added up first, so that one number per column travels and not 26
    totals = cols.select("family", "col", "n", residue_total().alias("_residues"))
    steps = totals.join(spans, ["family", "col"], "left").na.fill(0, ["d"])
    run = prefix_sum(steps, ["family"], "col", "d", "spanning")
    return run.select("family", "col", "n", (F.col("spanning") - F.col("_residues")).alias("gaps"))


def conservation_symbol(cols: DataFrame) -> DataFrame:
    """Conservation mark per column: ``*`` identical, ``:`` strong group,
    ``.`` weak group, blank otherwise or with a single residue."""
    total = "(" + " + ".join(f"r_{ch}" for ch in LETTERS) + ")"
    arms = [f"WHEN {total} = 1 THEN ' '", f"WHEN greatest({', '.join(f'r_{ch}' for ch in LETTERS)}) = {total} THEN '*'"]
    for mark, groups in ((":", K.STRONG_GROUPS), (".", K.WEAK_GROUPS)):
        arms += [f"WHEN {' + '.join(f'r_{ch}' for ch in g)} = {total} THEN '{mark}'" for g in groups]
    return cols.select("family", "col", F.expr(f"CASE {' '.join(arms)} ELSE ' ' END AS symbol"))


def property_consensus(cols: DataFrame) -> DataFrame:
    """Properties shared by all residues and present in any, and their score."""
    full, bits = (1 << len(K.PROPERTIES)) - 1, len(K.PROPERTIES)
    masks = {ch: K.property_mask(ch) for ch in LETTERS}
    common = " & ".join(f"if(r_{ch} > 0, {m}, {full})" for ch, m in masks.items())
    present = " | ".join(f"if(r_{ch} > 0, {m}, 0)" for ch, m in masks.items())
    return cols.withColumn("common", F.expr(common)).withColumn("present", F.expr(present)).withColumn(
        "property_score", F.expr(f"(bit_count(common) + {bits} - bit_count(present)) / {bits}.0D")
    )


def column_entropy(cols: DataFrame) -> DataFrame:
    """Entropy, property and gap score of every column, and their product.

    Every letter of the alphabet starts with a count of 0.5; the denominator is
    half the alphabet plus all residues, known or not. The terms of absent letters
    are equal and taken together; written out, those of all letters exceed the size up
    to which the JVM compiles a method.
    """
    size = len(K.AMINO)
    cols = cols.withColumn("_t", residue_total() + F.lit(size // 2))
    here = "filter(array(" + ", ".join(f"r_{ch}" for ch in K.AMINO) + "), c -> c > 0)"
    term = "((c + 0.5D) / _t) * log2((c + 0.5D) / _t)"
    some = f"aggregate(_here, 0.0D, (s, c) -> s + {term})"
    entropy = F.expr(f"-({some} + ({size} - size(_here)) * (0.5D / _t) * log2(0.5D / _t)) / log2({size}.0D)")
    cols = cols.withColumn("_here", F.expr(here))
    gap = (F.col("n") - residue_total()) / F.col("n")
    return property_consensus(cols).withColumn("entropy", entropy).withColumn("gap_score", gap).select(
        "family", "col", "n", "entropy", "property_score", "gap_score",
        ((F.lit(1.0) - F.col("entropy")) * F.col("property_score") * (F.lit(1.0) - F.col("gap_score"))).alias("score"),
    )


def alignment_entropy(cols: DataFrame) -> DataFrame:
    """Sum of the column scores per family."""
    return column_entropy(cols).groupBy("family").agg(F.sum("score").alias("entropy_score"))


def rank_columns_by_gaps(gaps: DataFrame) -> DataFrame:
    """Columns with gaps, ordered by distance of the gap count from half the
    rows (largest first), then by position."""
    from seqloom.operators.windows import stable_rank

    far = F.abs(F.col("n") / 2 - F.col("gaps"))
    return stable_rank(gaps.where("gaps > 0").withColumn("_k", -far), ["family"], "_k", "col", "rank").drop("_k")


def rank_columns_by_score(scores: DataFrame, value: str = "score") -> DataFrame:
    """Columns by ascending score, then by position."""
    from seqloom.operators.windows import stable_rank

    return stable_rank(scores, ["family"], value, "col", "rank")


def highlight_rows(rows: DataFrame, scores: DataFrame, theta: float, seq: str = "seq") -> DataFrame:
    """Rows with the residues of columns that score at least ``theta`` in upper case, others in lower case.

    The scores of a family, one for each column, are gathered once; rows change in place.
    """
    by_column = scores.groupBy("family").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("col", "score"))), lambda c: c["score"]).alias("_scores"))
    marked = F.transform(F.split(F.col(seq), ""), lambda x, i: R.highlight(x, F.get("_scores", i), theta))
    return rows.join(by_column, "family").withColumn(seq, F.array_join(marked, "")).drop("_scores")


def residue_columns(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """``(family, idx, pos, col)``: column of the k-th residue, both 1-based."""
    chars = F.filter(
        F.transform(F.split(F.col(seq), ""), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("c"))),
        lambda s: s["x"] != "-",
    )
    return rows.select("family", "idx", F.posexplode(chars).alias("p", "s")).select(
        "family", "idx", (F.col("p") + 1).alias("pos"), F.col("s.c").alias("col")
    )


#: Columns of one bit mask.
_MASK = 60


def project_rows(rows: DataFrame, keep: Column, seq: str = "seq") -> DataFrame:
    """Keep some rows and drop the columns that hold only gaps in them.

    Rows are read in pieces of 60 columns, each a bit mask of its residues, so a family's used
    columns are an OR per piece and no row per residue is made. Pieces that are used in
    every column are taken over whole. A family without any residue has no columns and no rows.
    """
    kept = rows.where(keep)
    pieces = lambda text: F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_MASK}}}"), F.lit(0))
    bits = F.regexp_replace(F.regexp_replace("piece", "(?s)[^-]", "1"), "-", "0")
    masks = (
        kept.select("family", F.posexplode(pieces(F.col(seq))).alias("k", "piece"))
        .groupBy("family", "k").agg(F.bit_or(F.conv(F.rpad(bits, _MASK, "0"), 2, 10).cast("long")).alias("mask")).where("mask <> 0")
    )
    used = F.filter(F.sequence(F.lit(1), F.lit(_MASK)), lambda c: F.getbit("mask", F.lit(_MASK) - c) == 1)
    some = F.when(F.col("mask") != (1 << _MASK) - 1, used)
    used = masks.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("k", some.alias("cols")))).alias("_used"))
    width = (F.element_at("_used", -1)["k"] + 1) * _MASK
    kept = kept.join(used, "family").withColumn("_at", pieces(F.rpad(F.coalesce(F.col(seq), F.lit("")), width, F.lit("-"))))
    found = F.transform("_used", lambda u: F.struct(u["cols"].alias("cols"), F.get(F.col("_at"), u["k"]).alias("piece")))
    cut = F.transform(found, lambda v: F.when(v["cols"].isNull(), v["piece"]).otherwise(
        F.array_join(F.transform(v["cols"], lambda c: F.substring(v["piece"], c, F.lit(1))), "")))
    return kept.withColumn(seq, F.array_join(cut, "")).drop("_used", "_at")
