"""Validation: the first error of files and label pairs, pairs that are incomplete, totals and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebound.functions import text as X

#: Smallest sizes in bytes, extensions, required keys.
MIN_AUDIO, MIN_SRT, MIN_JSON = 1024, 10, 2
AUDIO_SUFFIXES, SRT_SUFFIXES = [".wav", ".mp3", ".m4a", ".flac"], [".srt", ".vtt"]


def _first(checks: list[tuple[Column, str]]) -> Column:
    """The message of the first check that is true; NULL if none is."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in checks])


def file_error(size: Column, least: int) -> Column:
    """Of a file by its size (NULL: it does not exist)."""
    return _first([(size.isNull(), "missing"), (size < least, "too small")])


def audio_error(path: Column, size: Column, milliseconds: Column) -> Column:
    """Of an audio file: missing, too small, of another kind, or shorter than 100 ms."""
    return F.coalesce(file_error(size, MIN_AUDIO), _first([(~X.suffix(path).isin(AUDIO_SUFFIXES), "not an audio file"), (milliseconds < 100, "too short")]))


def srt_error(path: Column, size: Column, content: Column) -> Column:
    """Of a subtitle file: missing, too small, of another kind, or without a time line."""
    return F.coalesce(file_error(size, MIN_SRT), _first([(~X.suffix(path).isin(SRT_SUFFIXES), "not a subtitle file"), (~content.contains("-->"), "no time line")]))


def json_error(size: Column, content: Column) -> Column:
    """Of a JSON file: missing, too small, unreadable, or neither an object nor an array."""
    body = F.regexp_replace(content, f"^[{X.BL}\\x{{FEFF}}]+|[{X.BL}\\x{{FEFF}}]+$", "")
    shape = body.rlike(r"(?s)^\{.*\}$") | body.rlike(r"(?s)^\[.*\]$")
    readable = F.try_parse_json(body).isNotNull()
    return F.coalesce(file_error(size, MIN_JSON), _first([(~readable, "unreadable"), (~shape, "neither object nor array")]))


def label_error(start: Column, end: Column, text: Column) -> Column:
    """Of a label: the first of the required values that is missing, a blank text, a negative start, an end not after it."""
    checks = [(text.isNull(), "no text"), (start.isNull(), "no start"), (end.isNull(), "no end"), (X.strip(text) == "", "blank text"), (start < 0, "negative start"), (end <= start, "end not after start")]
    return _first(checks)


def pair_files(files: DataFrame, left: str, right: str) -> DataFrame:
    """(stem, left_path, right_path) of each stem that has a file of either extension, the smallest path of each; NULL for what is missing.
    One aggregation instead of a full join."""
    stem, suffix = X.stem(F.col("path")), X.suffix(F.col("path"))
    rows = files.where(suffix.isin(left, right)).select(stem.alias("stem"), "path", suffix.alias("suffix"))
    pick = lambda s: F.min(F.when(F.col("suffix") == s, F.col("path")))
    return rows.groupBy("stem").agg(pick(left).alias("left_path"), pick(right).alias("right_path"))


def verdict(totals: DataFrame) -> DataFrame:
    """totals (n_total, n_valid) with the success rate in percent and PASSED (all), WARNING (95 % or more) or FAILED."""
    rate = F.coalesce(F.try_divide(F.col("n_valid") * 100, F.col("n_total")), F.lit(0.0))
    status = F.when(rate >= 100, "PASSED").when(rate >= 95, "WARNING").otherwise("FAILED")
    return totals.withColumn("success_rate", F.round(rate, 6)).withColumn("status", status)
