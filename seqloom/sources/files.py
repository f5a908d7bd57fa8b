"""One file per family, read and written as a Spark data source.

``family_files`` reads FASTA files below ``<root>/<bench>[/<sub>]`` record by
record, with partitions per folder and filters on bench and family pushed down
to the listing, and writes texts from pieces, one file per family, in two
phases: a task streams the pieces of its families into files of its own attempt,
and the commit moves the files of the attempts that count to their places.
A family's text is never in one row, on either side.

The root is a URI that pyarrow's file systems know, or a folder all executors see.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)

from seqloom.sources.fasta import _open

NAME = "family_files"
READS = "bench string, family string, idx int, header string, seq string"
STAGING = "_seqloom_staging"


def records(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """``(header, letters)`` of the FASTA records in the lines of a file, one record at a time.

    ``>`` at the start of a line opens a record, white space in sequences and lines ahead of the first record are dropped."""
    header, parts = None, []
    for line in lines:
        line = line.replace("\r", "").rstrip("\n")
        if line.startswith(">"):
            if header is not None:
                yield header, "".join(parts)
            header, parts = line[1:].strip(), []
        elif header is not None:
            parts.append("".join(line.split()))
    if header is not None:
        yield header, "".join(parts)


@dataclass
class Folder(InputPartition):
    """A share of the files of a folder: those whose name has the checksum ``part`` modulo ``parts``."""

    bench: str
    part: int
    parts: int

    def holds(self, name: str) -> bool:
        return zlib.crc32(name.encode()) % self.parts == self.part


class FamilyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.sub = options.get("sub", "")
        self.parts = int(options.get("parts", 4))
        self.strict = str(options.get("strict", "false")).lower() == "true"
        self.named: dict[str, set[str] | None] = {"bench": None, "family": None}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.named:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                now = self.named[f.attribute[0]]
                self.named[f.attribute[0]] = values if now is None else now & values
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        return self.named[column] is None or value in self.named[column]

    def partitions(self) -> list[Folder]:
        """Only the bench folders are listed here; their files are listed in the tasks."""
        from pyarrow import fs

        at, path = _open(self.root)
        folders = [f.base_name for f in at.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.Directory]
        folders = sorted(b for b in folders if b != STAGING and not b.startswith(".") and self._wanted("bench", b))
        parts = [Folder(b, k, self.parts) for b in folders for k in range(self.parts)]
        names = self.named["family"]
        # no partition for a share that none of the wanted names falls into
        return parts if names is None else [p for p in parts if any(map(p.holds, names))]

    def read(self, part: Folder | None) -> Iterator[tuple]:
        import io

        from pyarrow import fs

        if part is None:  # what Spark plans where there is no partition
            return
        at, path = _open(self.root)
        folder = "/".join(x for x in (path.rstrip("/"), part.bench, self.sub) if x)
        for f in sorted(at.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda f: f.base_name):
            name = f.base_name
            if f.type != fs.FileType.File or name.startswith(".") or not part.holds(name) or not self._wanted("family", name):
                continue
            with at.open_input_stream(f.path) as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="\n") as lines:
                k = -1
                for k, (header, seq) in enumerate(records(lines)):
                    yield part.bench, name, k, header, seq
            if k < 0 and self.strict:
                raise ValueError(f"no sequence in {part.bench}/{name}")


@dataclass
class Staged(WriterCommitMessage):
    """Files of one attempt: its folder, and bench and family of each."""

    folder: str
    files: list[tuple[str, str]] = field(default_factory=list)


class FamilyWriter(DataSourceWriter):
    """Rows ``(bench, family, piece)`` in which the pieces of a family follow each other in the order of its text."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.root, self.sub, self.overwrite = options["path"], options.get("sub", ""), overwrite
        self.job = options.get("job") or uuid.uuid4().hex
        missing = {"bench", "family", "piece"} - set(schema.names)
        if missing:
            raise ValueError(f"columns needed: {sorted(missing)}")

    def _staging(self, path: str) -> str:
        return f"{path.rstrip('/')}/{STAGING}/{self.job}"

    def write(self, rows: Iterator) -> Staged:
        at, path = _open(self.root)
        context = TaskContext.get()
        done = Staged(f"{self._staging(path)}/{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex}")
        at.create_dir(done.folder)
        out, now, seen = None, None, set()
        try:
            for r in rows:
                key = (r["bench"], r["family"])
                if key != now:
                    if out:
                        out.close()
                    if key in seen:
                        raise ValueError(f"the pieces of {key} don't follow each other")
                    if not key[1] or "/" in key[0] + key[1] or key[1].startswith("."):
                        raise ValueError(f"no name of a file: {key}")
                    seen.add(key)
                    out, now = at.open_output_stream(f"{done.folder}/{len(done.files)}"), key
                    done.files.append(key)
                out.write(r["piece"].encode())
        finally:
            if out:
                out.close()
        return done

    def commit(self, messages: list[Staged | None]) -> None:
        """Move the files of the attempts that count; nothing is read, so the driver's work is one move per file."""
        from pyarrow import fs

        at, path = _open(self.root)
        placed, owner = {}, {}
        for m in filter(None, messages):
            for k, (bench, family) in enumerate(m.files):
                target = "/".join(x for x in (path.rstrip("/"), bench, self.sub, family) if x)
                if target in placed:
                    raise ValueError(f"{bench}/{family} comes from two tasks")
                placed[target] = f"{m.folder}/{k}"
                owner[target.rpartition("/")[0]] = None
        if not self.overwrite:
            there = [f.path for f in at.get_file_info(sorted(placed)) if f.type == fs.FileType.File] if placed else []
            if there:
                raise ValueError(f"there already: {there[:3]}")
        for folder in owner:
            at.create_dir(folder, recursive=True)
        if self.overwrite:
            for b in at.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if b.type == fs.FileType.Directory and b.base_name != STAGING:
                    old = "/".join(x for x in (b.path, self.sub) if x)
                    for f in at.get_file_info(fs.FileSelector(old, allow_not_found=True)):
                        if f.type == fs.FileType.File and f.path not in placed:
                            at.delete_file(f.path)
        for target, source in placed.items():
            at.move(source, target)
        self._clear(at, path)

    def abort(self, messages: list[Staged | None]) -> None:
        at, path = _open(self.root)
        self._clear(at, path)

    def _clear(self, at, path: str) -> None:
        from pyarrow import fs

        folder = self._staging(path)
        if at.get_file_info(folder).type == fs.FileType.Directory:
            at.delete_dir(folder)
        above = folder.rpartition("/")[0]
        if at.get_file_info(above).type == fs.FileType.Directory and not at.get_file_info(fs.FileSelector(above)):
            at.delete_dir(above)


class FamilyFiles(DataSource):
    """Options: path; sub (folder below a bench); parts (partitions per folder); strict (a file without a record is an error)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> FamilyReader:
        return FamilyReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FamilyWriter:
        return FamilyWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("family_files")`` known, with filters pushed down to the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FamilyFiles)


def read_families(spark: SparkSession, root: str, **options) -> DataFrame:
    """``(bench, family, idx, header, seq)`` of all records below ``root``.

    Names that start with ``_`` are families like others, names that start with a dot are left out. Text that isn't UTF-8 is an error."""
    register(spark)
    return spark.read.format(NAME).options(**options).load(root)


def write_families(pieces: DataFrame, root: str, order: list[str], mode: str = "append", **options) -> None:
    """One file per family from ``(bench, family, *order, piece)``.

    Pieces are dealt out by family and sorted in the task, which spills; they are then streamed, so the
    largest family costs one task its time but no memory. Pieces of equal order are put in no particular order.
    ``append`` never replaces a file; ``overwrite`` removes what other files the bench folders hold.
    """
    register(pieces.sparkSession)
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.repartition(n, "bench", "family").sortWithinPartitions("bench", "family", *order).select("bench", "family", "piece")
    rows.write.format(NAME).mode(mode).options(**options).save(root)


def fasta_pieces(rows: DataFrame, width: int = 60) -> DataFrame:
    """A piece per record; a ``width`` of 0 leaves sequences on one line."""
    from seqloom.sources.sinks import wrap

    body = wrap(F.col("seq"), width) if width else F.concat("seq", F.lit("\n"))
    return rows.select("bench", "family", "idx", F.concat(F.lit(">"), "header", F.lit("\n"), body).alias("piece"))
