"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "seqloom", master: str | None = None, **conf) -> SparkSession:
    """A session with AQE on; ``master`` is only set when given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        # a scan is cut for every core, whatever the size of its files
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.files.maxPartitionBytes", "33554432")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="seqloom-ckpt-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
    return _LOCAL_ROOTS[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative plans, computes the input once, and survives
    the loss of executors (nothing is held in executor memory or local disk).
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/seqloom/{tag}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exchanged(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that both sides reach by an exchange.

    Left to its size, each join of a long plan or of a round may collect a table of up to
    10 MB in a file on the driver, which is several times that in memory; those of all rounds add up there.
    """
    return df.hint("merge")


def cpu_partitions(df: DataFrame, factor: int = 3) -> int:
    """Partition count for stages that are heavy on CPU but light on bytes.

    Adaptive coalescing sizes partitions by bytes, which would put a whole
    dynamic-programming stage into one task, so those stages ask for this many
    partitions explicitly.
    """
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, factor * spark.sparkContext.defaultParallelism)

