"""Metric logs: kinds of entries, catalogue, summaries, best values, trackers, union of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuebound.operators.summary import rounded

#: Keys of an entry that are no metrics: fixed values.
NO_METRICS = ["step", "epoch", "batch", "phase", "timestamp"]


def split_log(rows: DataFrame) -> DataFrame:
    """(event_id, kind, position): entries with a step, and entries with a batch and no step; others are left out."""
    kind = F.when(F.col("step").isNotNull(), "step").when(F.col("batch").isNotNull(), "batch")
    return rows.select("event_id", kind.alias("kind"), F.coalesce("step", "batch").alias("position")).where("kind IS NOT NULL")


def catalogue(rows: DataFrame, json: str) -> DataFrame:
    """(metric, n_entries) of each key in JSON entries that is a metric; unreadable entries have none."""
    keys = rows.select(F.explode(F.json_object_keys(json)).alias("metric")).where(~F.col("metric").isin(NO_METRICS))
    return keys.groupBy("metric").agg(F.count(F.lit(1)).alias("n_entries"))


def summary(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key, in the order: first and last value, mean, population deviation, extremes and where they come first, change in
    percent (NULL from 0) and trend. Rows without the value are left out. Plain aggregates, no window."""
    v, o = F.col(value), F.col(order)
    grouped = rows.where(v.isNotNull()).groupBy(key).agg(
        F.min_by(v, o).alias("first_value"), F.max_by(v, o).alias("last_value"), rounded(F.avg(v)).alias("mean"), rounded(F.stddev_pop(v)).alias("std"),
        F.min(v).alias("least"), F.min_by(o, F.struct(v, o)).alias("least_step"), F.max(v).alias("most"), F.max_by(o, F.struct(v, -o)).alias("most_step"),
    )
    gap = F.col("last_value") - F.col("first_value")
    trend = F.when(gap < 0, "decreasing").when(gap > 0, "increasing").otherwise("stable")
    return grouped.withColumn("change", rounded(F.try_divide(gap * 100, F.col("first_value")))).withColumn("trend", trend)


def best(rows: DataFrame, key: str, value: str, order: str, count: int) -> DataFrame:
    """(key, order, value, rank) of the count smallest values per key, the earlier first on a tie.

    Row numbers up to a limit are cut within each input partition before the shuffle (a group limit), so a hot key
    sends at most count rows per partition.
    """
    by = Window.partitionBy(key).orderBy(value, order)
    ranked = rows.where(F.col(value).isNotNull()).select(key, order, value).withColumn("rank", F.row_number().over(by))
    return ranked.where(F.col("rank") <= count)


def tracker(rows: DataFrame) -> DataFrame:
    """Attempts, successes, failures (a NULL result is one) and the success rate as text, per operation."""
    grouped = rows.groupBy("operation").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("is_success").alias("successes"))
    rate = F.format_string("%.1f%%", F.col("successes") * 100 / F.col("attempts"))
    return grouped.select("operation", "attempts", "successes", (F.col("attempts") - F.col("successes")).alias("failures"), rate.alias("success_rate"))


def union_sorted(*parts: DataFrame) -> DataFrame:
    """All rows with the sorted union of the columns; what a part lacks is NULL."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.select(*sorted(whole.columns))


def append_entries(entries: DataFrame, path: str) -> None:
    """Append log entries to the table at path."""
    entries.write.mode("append").parquet(path)
