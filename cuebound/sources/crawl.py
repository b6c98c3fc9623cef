"""Crawl listings: address lists, availability, selection, channels and merged subtitle tracks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebound.operators.summary import rounded

#: Availability of a video, and those that exclude it.
STATES = ["public", "private", "unlisted", "premium_only", "needs_auth", "subscriber_only"]
RESTRICTED = ["private", "premium_only", "subscriber_only"]


def url_list(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """(url): addresses trimmed, without empty ones and repeats, the first limit of them in order (a limit is the feature)."""
    return rows.select(F.trim(column).alias("url")).where("url <> ''").distinct().orderBy("url").limit(limit)


def available(rows: DataFrame) -> DataFrame:
    """Rows with a video_id that is no channel's and an availability that is not restricted (NULL is not)."""
    return rows.where(F.col("video_id").isNotNull() & ~F.col("video_id").startswith("UC") & ~F.coalesce("availability", F.lit("")).isin(RESTRICTED))


def channel_videos_url(url: Column) -> Column:
    """A channel's address with /videos at its end."""
    return F.when(url.rlike("/videos/?$"), url).otherwise(F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/videos")))


def channel_name(url: Column) -> Column:
    """What follows @ in an address, else the last part of its path."""
    return F.when(url.contains("@"), F.regexp_extract(url, "@([^/?]+)", 1)).otherwise(F.regexp_extract(url, "([^/]+)/*$", 1))


def select_videos(rows: DataFrame, count: int) -> DataFrame:
    """(strategy, video_id, duration): the longest, the shortest and the first count videos, over all rows."""
    orders = {"longest": F.desc("duration"), "shortest": F.asc("duration"), "first": F.asc("index")}
    parts = [rows.orderBy(o, "video_id", "crawled_at").limit(count).select(F.lit(s).alias("strategy"), "video_id", "duration") for s, o in orders.items()]
    return reduce(DataFrame.unionByName, parts)


def crawl_stats(rows: DataFrame) -> DataFrame:
    """Videos, hours, mean minutes, channels and videos per channel in one row."""
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("d"), F.count("duration").alias("k"), F.count_distinct("channel").alias("c"))
    ratio = lambda a, b: rounded(F.try_divide(a, b))
    return row.select(F.col("n").alias("n_videos"), rounded(F.col("d") / 3600).alias("hours"), rounded(F.try_divide(F.col("d"), F.col("k")) / 60).alias("mean_minutes"), F.col("c").alias("n_channels"), ratio(F.col("n"), F.col("c")).alias("videos_per_channel"))


def merge_tracks(automatic: DataFrame, manual: DataFrame) -> DataFrame:
    """(video_id, lang, kind): the tracks of either side (video_id, lang); the manual one where both have a language."""
    marked = automatic.select("video_id", "lang", F.lit(0).alias("m")).union(manual.select("video_id", "lang", F.lit(1).alias("m")))
    merged = marked.groupBy("video_id", "lang").agg(F.max("m").alias("m"))
    return merged.select("video_id", "lang", F.when(F.col("m") == 1, "manual").otherwise("automatic").alias("kind"))
