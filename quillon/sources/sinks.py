"""Sinks: append logs, snapshots, keyed tables, delimited sheets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx


def append_log(rows: DataFrame, path: str, query: str = "query") -> None:
    """Append log rows with a normalised query; rows made by probes are left out."""
    norm = F.lower(F.trim(F.regexp_replace(query, r"\s+", " ")))
    rows.withColumn("query_normalized", norm).filter(~tx.is_synthetic(F.col(query))).write.mode("append").parquet(path)


def snapshot(df: DataFrame, path: str, sort: list[str] | None = None, partitions: list[str] | None = None) -> None:
    """Replace a Parquet snapshot; sorting within files narrows what later filters read."""
    rows = df.sortWithinPartitions(*sort) if sort else df
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def keyed_table(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by key: joins and lookups on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def gzip_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def sheet(df: DataFrame, path: str, separator: str = "\t") -> None:
    """Delimited text with a header."""
    df.write.mode("overwrite").option("sep", separator).option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A report table of at most so many rows."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join(map(str, r)) + " |\n" for r in df.limit(most).collect())
