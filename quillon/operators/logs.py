"""Usage logs: trending queries, daily activity and success rates. Times are relative to the newest row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trending_recent(logs: DataFrame, k: int) -> DataFrame:
    """Queries by the time that they were last asked, with the form of the most productive search."""
    return logs.groupBy("query_normalized").agg(
        F.max("ts").alias("last_ts"), F.max("result_count").alias("best_count"),
        F.max_by("query", F.struct("result_count", "ts", "query")).alias("query"),
    ).orderBy(F.desc("last_ts"), "query_normalized").limit(k)


def trending_popular(logs: DataFrame, k: int, days: int = 7, least: int = 2) -> DataFrame:
    """The most frequent queries of the last days before the newest row."""
    newest = logs.agg(F.max("ts").alias("newest"))
    recent = logs.crossJoin(F.broadcast(newest)).filter(F.col("ts") > F.col("newest") - F.expr(f"interval {days} days"))
    return recent.groupBy("query_normalized").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= least).orderBy(
        F.desc("freq"), "query_normalized"
    ).limit(k)


def daily_activity(logs: DataFrame) -> DataFrame:
    """Searches, users and searches without results of each day."""
    return logs.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("searches"), F.count_distinct("user_id").alias("users"),
        F.count_if(F.col("result_count") == 0).alias("zero_hits"),
    )


def success_by(logs: DataFrame, group: str) -> DataFrame:
    """Successes and failures of each provider."""
    return logs.groupBy(group).agg(F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"))


def history_tail(messages: DataFrame, last: int, whole: int, cut: int) -> DataFrame:
    """The last messages of each conversation; all but the newest few are shortened."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role")
    rows = messages.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= last)
    return rows.withColumn("text", F.when(F.col("age") <= whole, F.col("text")).otherwise(F.substring("text", 1, cut)))
