"""Small helpers the corpus operators share."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from seqloom.session import checkpoint_root

#: Characters of one piece of work inside a task; bounds the Python objects alive at once.
BLOCK_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int, remainder: int) -> Column:
    """Whether ``crc32(id as text) mod modulus`` is ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


class Scratch:
    """Written tables in the shared folder, with the paths to delete again.

    A table cuts the lineage and outlives the executors that wrote it.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/seqloom-llm/{tag}-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        """Delete tables whose readers have all run."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in paths:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(conf).delete(at, True)


BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def pieces(text: str, size: int = BLOCK_CHARS, cut: re.Pattern = BEFORE_SPACE) -> Iterator[str]:
    """Consecutive pieces of ``text`` of about ``size`` characters, cut where ``cut`` allows it.

    Together the pieces are the text. Where no such place follows, a piece is longer.
    """
    if len(text) <= size:
        yield text
        return
    at = 0
    while at < len(text):
        place = cut.search(text, at + size) if at + size < len(text) else None
        end = place.start() if place else len(text)
        yield text[at:end]
        at = end


def blocks(texts: list[str], size: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of positions whose texts together hold about ``size`` characters."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def in_slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Record batches of few rows, so that the texts of one are all that Python holds at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
        release()


class TwoGenerations(dict):
    """Cache of at most ``2 * limit`` entries that keeps what was used of late."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old[key]
        self[key] = value
        return value

    def age(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()


class WordHashes(TwoGenerations):
    """64-bit hashes of words (bytes), those of recent words at hand."""

    def __missing__(self, word):
        h = self.old.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word)
            h += 2 * (h < 2)  # 0 and 1 are kept free
        self[word] = h
        return h


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def only(docs: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, whatever characters are in their names."""
    return docs.select(*["`" + c.replace("`", "``") + "`" for c in names])


def text_fields(docs: DataFrame, column: str, into: str, fields: str, run) -> DataFrame:
    """``docs`` with the struct ``into`` of what ``run`` computes from ``column``.

    ``run`` gets a list of texts (a null text: empty) and returns an Arrow array per field. Only this column
    leaves the JVM, and Python holds the texts of about a block at a time, so other columns
    may have any name and type. The call counts as not deterministic, as a filter on
    its result would otherwise repeat it.
    """
    schema = StructType.fromDDL(fields)

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            sizes = pa.compute.fill_null(pa.compute.binary_length(c), 0).to_pylist()
            made = [[] for _ in schema.names]
            for a, b in cuts(sizes):
                texts = [t or "" for t in c.slice(a, b - a).to_pylist()]
                for out, x in zip(made, run(texts)):
                    out.append(x)
            if not sizes:
                made = [[pa.array([], to_arrow_type(f.dataType))] for f in schema]
            yield pa.StructArray.from_arrays([pa.concat_arrays(x) for x in made], schema.names)
            del c, made
            release()

    call = F.arrow_udf(batches, schema).asNondeterministic()
    return docs.withColumn(into, call(docs[column]))


def cuts(sizes: list[int], most: int = BLOCK_CHARS, rows: int = 1024) -> Iterator[tuple[int, int]]:
    """Ranges of positions with about ``most`` bytes and at most ``rows`` rows."""
    first, held = 0, 0
    for k, n in enumerate(sizes):
        held += n
        if held >= most or k + 1 - first >= rows:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def release() -> None:
    """Give back what Arrow's pool and the allocator keep, as workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
