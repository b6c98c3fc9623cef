"""Summaries of numbers: statistics, shares, histograms, box plots and correlations, over all rows or per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Digits that derived floating-point results are rounded to, so that the order of additions does not show.
DIGITS = 6


def rounded(value: Column, digits: int = DIGITS) -> Column:
    """value rounded."""
    return F.round(value, digits)


def statistics(value: Column, name: str, kinds: str = "count sum mean median min max std") -> list[Column]:
    """Aggregates of value, named <name>_<kind>; NULLs are left out, and std is that of a sample (NULL for one row)."""
    make = {
        "count": lambda: F.count(value),
        "sum": lambda: rounded(F.sum(value), 4),
        "mean": lambda: rounded(F.avg(value)),
        "median": lambda: rounded(F.median(value)),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "std": lambda: rounded(F.stddev_samp(value)),
        "q25": lambda: rounded(F.percentile(value, F.lit(0.25))),
        "q75": lambda: rounded(F.percentile(value, F.lit(0.75))),
    }
    return [make[k]().alias(f"{name}_{k}") for k in kinds.split()]


def shares(counts: DataFrame, count: str = "n", share: str = "share") -> DataFrame:
    """counts (few rows) with each one's percentage of their total."""
    everything = Window.partitionBy()
    return counts.withColumn(share, rounded(F.col(count) * 100 / F.sum(count).over(everything)))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, low, high, n) of the non-empty bins of equal width between the smallest and the largest value, the last one closed.

    NULLs are left out. A single distinct value lies in the middle of a range of width 1. Empty input gives no rows.
    """
    rows = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    ends = rows.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    flat = F.col("a") == F.col("b")
    ends = ends.select(F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    low, high = ends.select("a").scalar(), ends.select("b").scalar()
    placed = rows.select(F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    edge = lambda i: rounded(low + i * (high - low) / bins)
    return counts.select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "n")


def box_plot(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: quartiles, whiskers (the outermost values within 1.5 interquartile ranges) and how many values lie beyond."""
    rows = df.where(F.col(value).isNotNull())
    quartiles = rows.groupBy(key).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    joined = rows.alias("r").join(quartiles.alias("k"), F.col(f"r.{key}").eqNullSafe(F.col(f"k.{key}")))
    inside = (F.col(value) >= F.col("q")[0] - reach) & (F.col(value) <= F.col("q")[2] + reach)
    grouped = joined.groupBy(F.col(f"r.{key}").alias(key)).agg(
        F.first("q").alias("q"), F.min(F.when(inside, F.col(value))).alias("low_whisker"), F.max(F.when(inside, F.col(value))).alias("high_whisker"), F.count_if(~inside).alias("n_outliers")
    )
    q = [rounded(F.col("q")[i]).alias(n) for i, n in enumerate(("q25", "median", "q75"))]
    return grouped.select(key, *q, "low_whisker", "high_whisker", "n_outliers")


def duration_category(seconds: Column) -> Column:
    """The bin of a duration, closed on the right: (0, 10], (10, 20], (20, 30], (30, 60], beyond 60; NULL for NULL and up to 0."""
    return F.when(seconds <= 0, None).when(seconds <= 10, "0-10s").when(seconds <= 20, "10-20s").when(seconds <= 30, "20-30s").when(seconds <= 60, "30-60s").when(seconds > 60, "60s+")


def unpivot(row: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    """One row per column of names of a one-row result."""
    return row.unpivot([], names, key, value)
