"""Snapshots and logs that readers never see half-written.

A folder has data/ with one folder for each write and commits/ with one small row for each write that
has ended. Data come first and the commit row last, and readers start from the commit rows: a write
that is killed leaves the last snapshot readable, and a batch that is written again replaces its own
folder and is committed once. Only Spark's writers are used, so any shared file system will do.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx

COMMIT = "version string, at long, kind string"
log = logging.getLogger(__name__)


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """Commit rows of a folder; none where nothing was ever committed."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def _commit(spark: SparkSession, path: str, version: str, kind: str) -> None:
    if _commits(spark, path).filter(F.col("version") == version).isEmpty():
        spark.createDataFrame([(version, time.time_ns(), kind)], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def publish(df: DataFrame, path: str, sort: list[str] | None = None) -> str:
    """Write a new snapshot and make it the current one; its version is returned. Earlier ones stay readable."""
    version = f"snapshot-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").parquet(f"{path}/data/{version}")
    _commit(df.sparkSession, path, version, "snapshot")
    return version


def current(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The last snapshot that was committed, or a given one."""
    done = _commits(spark, path).filter(F.col("kind") == "snapshot")
    last = done.orderBy(F.desc("at"), F.desc("version")).first() if version is None else done.filter(F.col("version") == version).first()
    if last is None:
        raise FileNotFoundError(f"no snapshot is committed in {path}")
    return spark.read.parquet(f"{path}/data/{last['version']}")


def append_batch(rows: DataFrame, path: str, batch: int | str) -> None:
    """Write a batch of a log; a batch that comes again with the same number adds nothing."""
    rows.write.mode("overwrite").parquet(f"{path}/data/batch-{batch}")
    _commit(rows.sparkSession, path, f"batch-{batch}", "batch")


def batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches. The list of batches is read on the driver, a name for each."""
    names = [r["version"] for r in _commits(spark, path).filter(F.col("kind") == "batch").select("version").distinct().orderBy("version").collect()]
    if not names:
        raise FileNotFoundError(f"no batch is committed in {path}")
    return spark.read.parquet(*[f"{path}/data/{n}" for n in names])


def query_log(rows: DataFrame, query: str = "query") -> DataFrame:
    """Log rows with a normalised query, without those that probes have made."""
    normal = F.lower(F.trim(F.regexp_replace(query, r"\s+", " ")))
    return rows.withColumn("query_normalized", normal).filter(~tx.is_synthetic(F.col(query)))


def stream_batches(stream: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = query_log):
    """Start a stream that appends its batches exactly once; shape is applied to each."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, n: append_batch(shape(rows), path, n)).start()


def never_fails(write: Callable, *args, **kwargs) -> bool:
    """Whether a write of a log has succeeded; an error is noted and never reaches the caller, whose work is not the log."""
    try:
        write(*args, **kwargs)
    except Exception:
        log.warning("the log was not written", exc_info=True)
        return False
    return True
