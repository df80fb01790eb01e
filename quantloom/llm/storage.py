"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []



class _Open(threading.local):
    """One list of paths for each `scratch` block that is open in this thread."""

    def __init__(self):
        self.blocks: list[list[str]] = []


_OPEN = _Open()
#: held while shuffle files are freed, as the setting belongs to the session
_FREEING = threading.RLock()
#: of Spark 4.1: shuffle files go once the query that wrote them has ended
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Where it is unset, a local session gets a folder of its own; a cluster must set it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="quantloom-"))
    return _LOCAL[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block are deleted at its end, but those staged with `keep`. Nothing lazy that reads them may leave the block."""
    _OPEN.blocks.append([])
    try:
        yield
    finally:
        for path in _OPEN.blocks.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it again.

    The table survives lost executors, cuts the lineage, and lets AQE split a
    hot key in the joins that follow, as both join inputs are then plain
    exchanges. What was shuffled for it is freed as soon as it is written."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if _OPEN.blocks and not keep:
        _OPEN.blocks[-1].append(path)
    with _FREEING:
        was = spark.conf.get(_FREE_SHUFFLES, "false")
        spark.conf.set(_FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(_FREE_SHUFFLES, was)
    return spark.read.schema(df.schema).parquet(path)
