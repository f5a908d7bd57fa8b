"""Views of general tables as families of sequences, and small text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import residues as R
from seqloom.session import exchanged


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as aligned rows: family = language, one column per character,
    every character but an ASCII letter is a gap (the alphabet of sequences is A-Z;
    accented letters are no residues)."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.col("lang").alias("family"), F.col("doc_id").alias("idx"),
        F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("header"),
        R.gapped_letters(F.col("text")).alias("seq"),
    )


def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as aligned rows: family = conversation, row = turn."""
    c = load(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("family"), F.col("turn").alias("idx"),
        F.concat(F.col("role"), F.lit("_"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("header"),
        R.gapped_letters(F.col("text")).alias("seq"),
    )


def conversation_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as unaligned sequences: the letters of each turn."""
    rows = conversation_rows(spark, sf_dir)
    return rows.withColumn("seq", R.degap(F.col("seq"))).where(F.length("seq") > 0)


def words_of(text):
    """Runs of letters of any script, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def word_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse match cells between the turns of a conversation.

    Turns are sequences of words; cell ``(a, b, i, j)`` with ``a < b`` exists
    where word ``i`` of turn ``a`` equals word ``j`` of turn ``b`` (1-based), with
    a weight that falls with the distance of the positions.
    """
    c = load(spark, sf_dir, "conversations")
    words = words_of(F.col("text"))
    w = c.select(
        F.col("conv_id").cast("string").alias("family"), F.col("turn").cast("int").alias("x"),
        F.posexplode(words).alias("p", "word"),
    ).withColumn("p", F.col("p") + 1)
    left = w.select("family", "word", F.col("x").alias("a"), F.col("p").alias("i"))
    right = w.select("family", "word", F.col("x").alias("b"), F.col("p").alias("j"))
    return left.join(exchanged(right), ["family", "word"]).where("a < b").select(
        "family", "a", "b", "i", "j", (F.lit(1.0) / (F.lit(1) + F.abs(F.col("i") - F.col("j")))).alias("p")
    )


def word_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every word of a conversation: ``(family, word, xs, ps)``.

    ``xs`` are turns, ``ps`` the 1-based positions in them. The pairs of places in different
    turns are the cells of ``word_matches``, which are not listed here.
    """
    c = load(spark, sf_dir, "conversations")
    w = c.select(F.col("conv_id").cast("string").alias("family"), F.col("turn").cast("int").alias("x"),
                 F.posexplode(words_of(F.col("text"))).alias("p", "word"))
    places = F.collect_list(F.struct("x", (F.col("p") + 1).alias("p")))
    return w.groupBy("family", "word").agg(places.alias("_s")).select(
        "family", "word", F.transform("_s", lambda s: s["x"]).alias("xs"), F.transform("_s", lambda s: s["p"]).alias("ps"))


def word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of words of each turn: ``(family, idx, len)``."""
    c = load(spark, sf_dir, "conversations")
    words = words_of(F.col("text"))
    return c.select(
        F.col("conv_id").cast("string").alias("family"), F.col("turn").cast("int").alias("idx"),
        F.size(words).cast("long").alias("len"),
    )


def feature_line(line: str = "line"):
    """Fields of a tab-separated feature line; fewer than seven give zeros."""
    parts = F.split(F.col(line), "\t")
    names = ("avg_pid", "sd_pid", "f2", "f3", "avg_sp", "peak", "factor")
    # position in the line: f0, f4 (deviation), f2, f3, f1, f5, f6
    order = (0, 4, 2, 3, 1, 5, 6)
    full = F.size(parts) >= 7
    return F.struct(*[
        F.when(full, F.get(parts, i).try_cast("double")).otherwise(F.lit(0.0)).alias(n)
        for n, i in zip(names, order)
    ])


def read_scaler(spark: SparkSession, path: str, model: str, features: list[str]) -> DataFrame:
    """Scaler file with one number per line, maximum and minimum in turn."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.trim("value"), r"\s+").alias("v"))
    names = F.array(*[F.lit(f) for f in features])
    return lines.select(F.posexplode(names).alias("pos", "feature"), "v").select(
        F.lit(model).alias("model"), "pos", "feature",
        F.get("v", F.col("pos") * 2).cast("double").alias("max"),
        F.get("v", F.col("pos") * 2 + 1).cast("double").alias("min"),
    )


def parse_score_text(texts: DataFrame, key: str = "family", text: str = "text") -> DataFrame:
    """Whitespace-separated score lines ``(col, score)``; the first and the last
    line of a text are skipped."""
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))
    return texts.select(key, F.posexplode(body).alias("pos", "line")).select(
        key, "pos", F.get(F.split(F.trim("line"), r"\s+"), F.lit(0)).alias("label"),
        F.get(F.split(F.trim("line"), r"\s+"), F.lit(1)).cast("double").alias("score"),
    )
