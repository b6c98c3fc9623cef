"""Subtitle files: SRT text to cues and to plain text, and which file of a video to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebound.functions.text import srt_seconds

#: A line of blanks between blocks, and a line end.
BLOCK, LINE = r"\n[ \t\r\f\x0B]*\n(?:[ \t\r\f\x0B]*\n)*", r"\r?\n"


def read_srt(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, content) of whole subtitle files."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def parse_srt(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, pos, cue_index, start, end, text) of each cue of SRT contents.

    A block needs three lines at least and a time line 'a --> b' as its second; its text is the rest, joined by a space,
    and blocks without text are dropped, as are blocks whose time line has other than two times. A time that is none is 0.
    NULL contents have no cues.
    """
    blocks = files.select(key, F.posexplode(F.split(F.trim(F.regexp_replace(content, "\r", "")), BLOCK)).alias("pos", "block"))
    lines = blocks.select(key, "pos", F.split(F.regexp_replace("block", r"^\s+|\s+$", ""), "\n").alias("l"))
    times = F.split(F.get("l", F.lit(1)), " --> ")
    good = lines.where((F.size("l") >= 3) & F.get("l", F.lit(1)).contains("-->") & (F.size(times) == 2))
    text = F.trim(F.array_join(F.slice(F.col("l"), F.lit(3), F.greatest(F.size("l") - 2, F.lit(0))), " "))
    cues = good.select(key, "pos", F.trim(F.get("l", F.lit(0))).alias("cue_index"), srt_seconds(F.trim(times[0])).alias("start"), srt_seconds(F.trim(times[1])).alias("end"), text.alias("text"))
    return cues.where("text <> ''")


def srt_to_text(content: Column) -> Column:
    """The lines of SRT content that are not blank, no number and no time line, joined by line ends."""
    kept = F.filter(F.split(content, LINE), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*\d+\s*$") & ~x.contains("-->"))
    return F.array_join(kept, "\n")


def subtitle_of_video(videos: DataFrame, files: DataFrame) -> DataFrame:
    """(video_id, path): of the files (path) whose name begins with the id, the one with the smallest name; NULL without one.

    Names of the form <id>.<language>.srt join on what comes before the first dot; that is an equi-join, and a prefix of that
    form cannot match otherwise.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    named = files.where(name.endswith(".srt")).select("path", name.alias("name"), F.split_part(name, F.lit("."), F.lit(1)).alias("video_id"))
    best = named.groupBy("video_id").agg(F.min_by("path", F.struct("name", "path")).alias("path"))
    return videos.select("video_id").distinct().join(best, "video_id", "left")


def preferred_language(tracks: DataFrame, preferences: list[str]) -> DataFrame:
    """(video_id, lang): the first of the preferences that a video has, else the smallest it has; NULL languages count for nothing."""
    wish = F.array_position(F.array(*map(F.lit, preferences)), F.col("lang"))
    rank = F.when(wish > 0, wish).otherwise(len(preferences) + 1)
    return tracks.where("lang IS NOT NULL AND video_id IS NOT NULL").groupBy("video_id").agg(F.min_by("lang", F.struct(rank, "lang")).alias("lang"))
