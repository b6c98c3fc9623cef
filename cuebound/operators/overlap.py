"""Interval-overlap joins as equi-joins: fixed-width labels, and any intervals through bins of several widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins are 2^(FAN * level) wide. An interval covers two at most at its own level (nine beyond 2^60); wider ones are at most 2^FAN times as long as it.
FAN, LEVELS = 3, 21


def label_segments(cues: DataFrame, width: float, ordinal: str) -> DataFrame:
    """(video_id, segment_num, start, end, text) of each segment of fixed width (numbers from 1) that a cue overlaps.

    cues has video_id, start, end, text and an ordinal. A cue overlaps a segment if they share more than a point, so
    cues with NULL bounds, of no length or reversed overlap none, and a cue that crosses a boundary is in both. Texts are
    joined by a space in the order of ordinals (texts on a tie); NULL and empty texts are left out, and segments
    without text have no row. Each cue is exploded to the numbers it covers, so the work is linear in cues.
    """
    rows = cues.where("start >= 0 AND end > start AND text <> '' AND video_id IS NOT NULL")
    first, last = F.floor(F.col("start") / width), F.ceil(F.col("end") / width) - 1
    placed = rows.select("video_id", F.explode(F.sequence(first, last)).alias("n"), F.struct(F.col(ordinal), "text").alias("x"))
    grouped = placed.groupBy("video_id", "n").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return grouped.select(
        "video_id", (F.col("n") + 1).alias("segment_num"), (F.col("n") * width).alias("start"), ((F.col("n") + 1) * width).alias("end"), F.array_join("xs.text", " ").alias("text")
    )


def fixed_segments(videos: DataFrame, width: int) -> DataFrame:
    """(video_id, segment_id, start_time, end_time) of each segment of fixed width that a video of duration seconds has; numbers
    from 1, the last one cut at the end. NULL and non-positive durations have none."""
    rows = videos.where("duration > 0").select("video_id", "duration", F.explode(F.sequence(F.lit(1), F.ceil(F.col("duration") / width))).alias("segment_id"))
    return rows.select("video_id", "segment_id", ((F.col("segment_id") - 1) * width).alias("start_time"), F.least(F.col("segment_id") * width, F.col("duration")).alias("end_time"))


def _own_level(start: Column, end: Column) -> Column:
    """The smallest level whose bins are as long as the interval, so that it covers one or two."""
    return F.least(F.ceil(F.log2(F.greatest(end - start, F.lit(1))) / FAN), F.lit(LEVELS - 1)).cast("int")


def _binned(df: DataFrame, start: Column, end: Column, others: Column) -> DataFrame:
    """df with a row for each bin it covers at its own level and at each level above at which the other side has rows (others)."""
    leveled = df.withColumn("__own", _own_level(start, end))
    above = F.array_except(others, F.sequence(F.lit(0), "__own"))
    leveled = leveled.withColumn("__level", F.explode(F.concat(F.array("__own"), above)))
    first, last = (F.call_function("shiftright", x.cast("bigint"), F.col("__level") * FAN) for x in (start, end - 1))  # whole, also below 0
    return leveled.withColumn("__first", first).withColumn("__bin", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of left and right rows with equal key whose intervals [left_start, left_end) and [right_start, right_end) share
    more than a point; bounds are whole numbers (such as milliseconds), columns of both sides must differ but for key.

    Rows with a NULL key or bound and without positive length pair with none. A row has one or two bins at its own level, whatever
    its length; a pair meets at the larger of the two levels, in the first bin that both cover, and nowhere else. So no
    bin holds more than what really lies there, and no pair comes twice.
    """
    left = left.where(f"{key} IS NOT NULL AND left_end > left_start")
    right = right.where(f"{key} IS NOT NULL AND right_end > right_start")
    sides = [(left, F.col("left_start"), F.col("left_end")), (right, F.col("right_start"), F.col("right_end"))]
    used = [df.agg(F.collect_set(_own_level(s, e)).alias("levels")).scalar() for df, s, e in sides]  # at most LEVELS numbers
    a, b = (_binned(df, s, e, others) for (df, s, e), others in zip(sides, reversed(used), strict=True))
    a = a.withColumnRenamed("__own", "__own_a").withColumnRenamed("__first", "__first_a")
    b = b.withColumnRenamed("__own", "__own_b").withColumnRenamed("__first", "__first_b")
    # Spark sizes a broadcast by a side's files, which know nothing of its bins.
    met = a.hint("merge").join(b, [key, "__level", "__bin"])
    met = met.where("__level = greatest(__own_a, __own_b) AND __bin = greatest(__first_a, __first_b)")
    met = met.where("greatest(left_start, right_start) < least(left_end, right_end)")
    return met.drop("__level", "__bin", "__own_a", "__own_b", "__first_a", "__first_b")
