"""Session construction, table access and shared scratch storage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Defaults for sessions this package opens itself; a caller's session is used as it is.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "quillon", **extra: str) -> SparkSession:
    """Open (or return) a session. The master is a local one for tests and benchmarks only."""
    conf = DEFAULT_CONF | {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"} | extra
    spark = SparkSession.builder.master(master).appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where none is named and everything runs on one machine (unit tests) a fresh local folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to the shared scratch folder and read it back.

    This cuts the lineage: whatever happens to executors later, the rows are read from shared
    storage and are not computed again, so values that depend on task order stay put.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a counted side up to which it is broadcast.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame) -> DataFrame:
    """The side of a join, broadcast if its counted rows are few; it is computed for the count and again for the join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def unused(df: DataFrame, name: str) -> str:
    """The name, or the name with as many underscores after it as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows and bytes of an Arrow batch that is sent to Python: whole texts are long, and a batch is held in memory.
BATCH_ROWS, BATCH_BYTES = 1000, 4_000_000


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to so many rows and to BATCH_BYTES, if it is higher.

    A batch ends with the row that passes the bytes, so it has one row at least however long that is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None) or "0"
    if now.isdecimal() and not 0 < int(now) <= BATCH_BYTES:  # with a unit it is the caller's own
        spark.conf.set(name, str(BATCH_BYTES))


def given_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInPandas, with its free memory given back at its end: Spark keeps the worker for later tasks."""

    def to_the_end(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return to_the_end
