"""Text renderings of aligned families, and their writers.

``fasta_chunks``, ``clustal_lines`` and ``phylip_lines`` give a text in pieces with their order,
for families of any size; ``sources.files`` writes them, one file per family. ``fasta``,
``clustal`` and ``phylip`` put the pieces of a family together in one row, which has to hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrap(seq: Column, width: int = 60) -> Column:
    """Lines of ``width`` characters, each closed by a line break."""
    full = F.regexp_replace(seq, f"(.{{{width}}})", "$1\n")
    return F.when(F.length(seq) == 0, F.lit("")).when(F.length(seq) % width == 0, full).otherwise(F.concat(full, F.lit("\n")))


def fasta_chunks(rows: DataFrame, width: int = 60) -> DataFrame:
    """One FASTA record per row: ``(family, idx, chunk)``."""
    return rows.select("family", "idx", F.concat(F.lit(">"), "header", F.lit("\n"), wrap(F.col("seq"), width)).alias("chunk"))


def _join(rows: DataFrame, keys: list[str], order: str, piece: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(piece).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def fasta(rows: DataFrame, width: int = 60) -> DataFrame:
    """Wrapped FASTA text per family, records in input order."""
    return _join(fasta_chunks(rows, width), ["family"], "idx", "chunk")


def one_line_fasta(rows: DataFrame, keys: list[str] | None = None, order: str = "header") -> DataFrame:
    """Unwrapped FASTA text per family, records ordered by header."""
    keys = keys or ["family"]
    piece = F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("seq"), F.lit("\n"))
    return _join(rows.withColumn("_t", piece), keys, order, "_t")


def text_hash(texts: DataFrame) -> DataFrame:
    """Hash of a rendering."""
    return texts.select("family", F.md5("text").alias("digest"))


LINE_ORDER = ["block", "kind", "row"]


def _whole(lines: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "piece")))
    return lines.groupBy("family").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"))


def clustal(rows: DataFrame, symbols: DataFrame, title: str = "CLUSTAL multiple sequence alignment", width: int = 60) -> DataFrame:
    """CLUSTALW text of each family in one row."""
    return _whole(clustal_lines(rows, symbols, title, width))


def clustal_lines(rows: DataFrame, symbols: DataFrame, title: str = "CLUSTAL multiple sequence alignment", width: int = 60) -> DataFrame:
    """CLUSTALW text in lines ``(family, *LINE_ORDER, piece)``: blocks of ``width`` columns, names padded to the longest
    plus four, and a line of conservation marks below each block."""
    from seqloom.functions.residues import name_token

    # one row per family: the lines stream past it and are not sorted
    shape = rows.groupBy("family").agg(
        (F.max(F.length(name_token(F.col("header")))) + 4).alias("_pad"), F.max(F.length("seq")).alias("_len")
    )
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_len") / width).cast("int") - 1, F.lit(0)))
    lines = (
        rows.join(shape.hint("shuffle_hash"), "family").withColumn("_b", F.explode(blocks))
        .withColumn("_t", F.substring("seq", F.col("_b") * width + 1, F.lit(width)))
        .where(F.length("_t") > 0)
        .select(
            "family", "_b", F.lit(0).alias("_k"), F.col("idx").cast("long").alias("_o"),
            F.concat(F.rpad(name_token(F.col("header")), F.col("_pad"), F.lit(" ")), "_t", F.lit("\n")).alias("_line"),
        )
    )
    marks = (
        symbols.withColumn("_b", F.floor(F.col("col") / width).cast("int"))
        .groupBy("family", "_b").agg(F.array_sort(F.collect_list(F.struct("col", "symbol"))).alias("_m"))
        .join(shape.hint("shuffle_hash"), "family")
        .select(
            "family", "_b", F.lit(1).alias("_k"), F.lit(0).cast("long").alias("_o"),
            F.concat(F.expr("repeat(' ', _pad)"), F.array_join(F.transform("_m", lambda m: m["symbol"]), ""), F.lit("\n")).alias("_line"),
        )
    )
    heads = shape.withColumn("_b", F.explode(blocks)).select(
        "family", "_b", F.lit(-1).alias("_k"), F.lit(0).cast("long").alias("_o"), F.lit("\n").alias("_line")
    )
    top = shape.select("family", F.lit(-1).alias("_b"), F.lit(-1).alias("_k"), F.lit(0).cast("long").alias("_o"), F.lit(title + "\n").alias("_line"))
    every = lines.unionByName(marks).unionByName(heads).unionByName(top)
    return every.toDF("family", *LINE_ORDER, "piece")


def phylip(rows: DataFrame) -> DataFrame:
    """PHYLIP text of each family in one row."""
    return _whole(phylip_lines(rows))


def phylip_lines(rows: DataFrame) -> DataFrame:
    """PHYLIP text in lines ``(family, *LINE_ORDER, piece)``: counts, then blocks of five groups of ten columns with the
    ten-character header in the first block only."""
    tens = lambda s: F.regexp_replace(s, "(.{1,10})", " $1")
    shape = rows.groupBy("family").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(F.length("seq"), -F.col("idx")).alias("_len")
    )
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_len") / 50).cast("int") - 1, F.lit(0)))
    lines = (
        rows.join(shape, "family").withColumn("_b", F.explode(blocks))
        .withColumn("_t", tens(F.substring("seq", F.col("_b") * 50 + 1, F.lit(50))))
        .withColumn("_h", F.when(F.col("_b") == 0, F.rpad(F.substring("header", 1, 10), 10, " ")).otherwise(F.lit(" " * 10)))
        .select("family", "_b", F.lit(0).alias("_k"), F.col("idx").cast("long").alias("_o"), F.concat("_h", "_t", F.lit("\n")).alias("_line"))
    )
    ends = shape.withColumn("_b", F.explode(blocks)).select(
        "family", "_b", F.lit(1).alias("_k"), F.lit(0).cast("long").alias("_o"), F.lit("\n").alias("_line")
    )
    counts = F.concat(F.col("_n").cast("string"), F.lit("\n"), F.col("_len").cast("string"), F.lit("\n"))
    top = shape.select("family", F.lit(-1).alias("_b"), F.lit(-1).alias("_k"), F.lit(0).cast("long").alias("_o"), counts.alias("_line"))
    return lines.unionByName(ends).unionByName(top).toDF("family", *LINE_ORDER, "piece")


def annotation(scores: DataFrame) -> DataFrame:
    """Column reliabilities as text, one number of width four per line."""
    piece = F.concat(F.lpad(F.col("reliability").cast("string"), 4, " "), F.lit("\n"))
    return _join(scores.withColumn("_t", piece), ["family"], "col", "_t")


def write_segments(frags: DataFrame, path: str) -> None:
    """Segments as a table partitioned by kind."""
    frags.write.mode("errorifexists").partitionBy("kind").parquet(path)


def read_segments(spark, path: str, kind: str) -> DataFrame:
    """Segments of one kind; the partition filter prunes the scan."""
    return spark.read.parquet(path).where(F.col("kind") == kind)


def write_texts(texts: DataFrame, path: str) -> None:
    """Renderings as a text dataset with one folder per family."""
    texts.select("family", F.col("text").alias("value")).write.mode("errorifexists").partitionBy("family").text(path)


def write_statistics(stats: DataFrame, path: str) -> None:
    """``[stats]`` section of ``key=value`` lines."""
    line = F.concat_ws("=", F.col("key"), F.col("value").cast("string"))
    body = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    stats.groupBy().agg(F.concat(F.lit("[stats]\n"), body).alias("value")).write.mode("errorifexists").text(path)
