"""FASTA and block-format sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import residues as R


def _open(root: str):
    """File system and path of a URI or of a plain path."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def list_families(spark: SparkSession, root: str, benches: list[str] | None = None, sub: str = "") -> DataFrame:
    """``(bench, family, path)`` of the regular files of each bench folder.

    ``root`` is a folder on storage that all executors see: a URI or a mounted
    path. Only the bench folders are listed by the driver; each one's files are
    listed in a task. Names that start with a dot are skipped. Names that start
    with ``_`` are kept, although Spark's file sources would leave them out.
    """
    from pyarrow import fs

    if benches is None:
        at, path = _open(root)
        found = at.get_file_info(fs.FileSelector(path))
        benches = [f.base_name for f in found if f.type == fs.FileType.Directory]

    def scan(batches):
        at, path = _open(root)
        for pdf in batches:
            out = []
            for bench in pdf["bench"]:
                folder = "/".join(x for x in (path.rstrip("/"), bench, sub) if x)
                for f in at.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                    if f.type == fs.FileType.File and not f.base_name.startswith("."):
                        out.append((bench, f.base_name, f.path))
            yield pd.DataFrame(out, columns=["bench", "family", "path"])

    rows = spark.createDataFrame([(b,) for b in sorted(benches)], "bench string")
    return rows.repartition(max(1, len(benches))).mapInPandas(scan, "bench string, family string, path string")


def read_texts(files: DataFrame, root: str, partitions: int | None = None) -> DataFrame:
    """``(bench, family, text)`` of the files that ``list_families`` found below ``root``.

    The files are read in the tasks. Text that isn't UTF-8 is an error.
    """

    def fetch(batches):
        at, _ = _open(root)
        for pdf in batches:
            texts = []
            for p in pdf["path"]:
                with at.open_input_stream(p) as f:
                    texts.append(f.read().decode("utf-8"))
            pdf["text"] = texts
            yield pdf[["bench", "family", "text"]]

    n = partitions or 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(n).mapInPandas(fetch, "bench string, family string, text string")


def parse_fasta(texts: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Records ``(*keys, idx, header, seq)`` of whole-file FASTA texts.

    ``>`` at the start of a line opens a record, further lines are joined and
    carriage returns removed; text ahead of the first record is ignored.
    """
    keys = keys if keys is not None else [c for c in texts.columns if c != text]
    body = F.regexp_replace(F.concat(F.lit("\n"), F.col(text)), "\r", "")
    pieces = F.split(body, "\n>")
    records = F.slice(pieces, F.lit(2), F.size(pieces))
    return (
        texts.where(F.col(text).contains(">"))
        .select(*keys, F.posexplode(records).alias("idx", "rec"))
        .select(
            *keys, "idx",
            R.trim_header(F.regexp_extract("rec", r"\A([^\n]*)", 1)).alias("header"),
            F.regexp_replace(F.regexp_replace("rec", r"\A[^\n]*", ""), r"\s", "").alias("seq"),
        )
    )


def parse_strict(texts: DataFrame, text: str = "text", strip_gaps: bool = False) -> DataFrame:
    """FASTA with checks: ``.`` becomes ``-``, upper case, anything but a letter
    is an error. Gap characters are only legal when they are stripped."""
    rec = parse_fasta(texts, text)
    if strip_gaps:
        rec = rec.withColumn("seq", R.degap(F.col("seq")))
    return rec.withColumn("seq", R.checked(F.col("seq")))


def unwrap_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """Multi-line FASTA text rewritten with one line per sequence, blank lines
    and surrounding blanks dropped."""
    from seqloom.sources.sinks import one_line_fasta

    keys = [c for c in texts.columns if c != text]
    return one_line_fasta(parse_fasta(texts, text), keys, order="idx")


def parse_blocks(texts: DataFrame, text: str = "text", strip_gaps: bool = False) -> DataFrame:
    """MSF, CLUSTAL and headerless block files: ``(*keys, idx, header, seq)``.

    Data starts behind a line with ``..``, a CLUSTAL / MSAPROBS title, or ``//``.
    A line is data when its first word is a known name: declared by ``Name:``,
    or any unindented first word in a CLUSTAL file and behind a missing header.
    ``.`` becomes ``-`` and letters become upper case; ``*`` is legal.
    """
    keys = [c for c in texts.columns if c != text]
    lines = texts.select(*keys, F.posexplode(F.split(F.regexp_replace(text, "\r", ""), "\n")).alias("ln", "line"))
    return parse_block_lines(lines, keys, strip_gaps)


def parse_block_lines(lines: DataFrame, keys: list[str], strip_gaps: bool = False) -> DataFrame:
    """``parse_blocks`` of lines ``(*keys, ln, line)``; ``ln`` is any value that puts the lines of a file in order."""
    starts = lines.groupBy(*keys).agg(
        F.min(F.when(F.col("line").rlike(r"^(CLUSTAL|MSAPROBS)"), F.col("ln"))).alias("_title"),
        F.min(F.when(F.col("line").contains(".."), F.col("ln"))).alias("_dots"),
        F.min(F.when(F.col("line").contains("//"), F.col("ln"))).alias("_slashes"),
    )
    first = F.least("_title", "_dots", "_slashes")
    w = F.split(F.trim("line"), r"\s+")
    body = (
        lines.join(starts.hint("shuffle_hash"), keys)
        .where(first.isNotNull() & (F.col("ln") > first) & (F.trim("line") != ""))
        .withColumn("word", F.get(w, F.lit(0)))
        .withColumn("free", F.coalesce(F.col("_title") == first, F.lit(False)) & ~F.col("line").rlike(r"^\s")
                    | (F.coalesce(F.col("_slashes") == first, F.lit(False)) & ~F.coalesce(F.col("_dots") == first, F.lit(False))))
        .withColumn("declared", F.col("word") == "Name:")
        .withColumn("name", F.when(F.col("declared"), F.get(w, F.lit(1))).otherwise(F.col("word")))
    )
    data = F.regexp_replace(F.regexp_replace(F.trim("line"), r"^\S+", ""), r"\s", "")
    # a word that nothing makes a name has no first line
    parts = body.groupBy(*keys, "name").agg(
        F.min(F.when(F.col("declared") | F.col("free"), F.col("ln"))).alias("_first"),
        F.array_sort(F.collect_list(F.when(~F.col("declared"), F.struct("ln", data.alias("d"))))).alias("p"),
    ).where(F.col("_first").isNotNull())
    seq = R.normalise(F.array_join(F.transform("p", lambda x: x["d"]), ""))
    if strip_gaps:
        seq = R.degap(seq)
    ok = F.when(seq.rlike(r"\A[A-Z*-]*\z"), seq).otherwise(F.raise_error(F.concat(F.lit("unknown character in "), F.col("name"))))
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("_first")
    return parts.where(F.size("p") > 0).select(
        *keys, (F.row_number().over(order) - 1).alias("idx"), F.col("name").alias("header"), ok.alias("seq")
    )


def parse_any(texts: DataFrame, text: str = "text", strip_gaps: bool = False) -> DataFrame:
    """FASTA when the first non-blank character is ``>``, block format otherwise."""
    is_fasta = F.col(text).rlike(r"\A\s*>")
    a = parse_fasta(texts.where(is_fasta), text)
    b = parse_blocks(texts.where(~is_fasta), text, strip_gaps)
    if strip_gaps:
        a = a.withColumn("seq", R.degap(F.col("seq")))
    return a.unionByName(b)


def parse_pieces(pieces: DataFrame, order: list[str], strip_gaps: bool = False) -> DataFrame:
    """``parse_any`` of files in pieces ``(family, *order, piece)``, whose texts are not put together.

    A piece holds whole lines, in a FASTA file whole records. A file is told by its first piece that
    is not blank. Pieces that come in partitions by family are parsed where they are.
    """
    place = F.struct(*order)
    kind = pieces.where(F.col("piece").rlike(r"\S")).groupBy("family").agg(
        F.min_by(F.col("piece").rlike(r"\A\s*>"), place).alias("_fasta"))
    told = pieces.join(kind.hint("shuffle_hash"), "family")
    records = parse_fasta(told.where("_fasta").select("family", *order, "piece"), "piece", ["family", *order])
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("family").orderBy(*order, "idx")) - 1
    a = records.select("family", number.alias("idx"), "header", "seq")
    if strip_gaps:
        a = a.withColumn("seq", R.degap(F.col("seq")))
    lines = told.where("not _fasta").select("family", place.alias("_o"), F.posexplode(
        F.split(F.regexp_replace("piece", "\r", ""), "\n")).alias("_k", "line"))
    lines = lines.select("family", F.struct("_o", "_k").alias("ln"), "line")
    return a.unionByName(parse_block_lines(lines, ["family"], strip_gaps))
