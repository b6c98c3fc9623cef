"""Audio files: contents, headers only, waves and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebound.functions.signal import read_wav_udf, wav_info_udf
from cuebound.functions.text import stem


def read_audio(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, path, length, content) of the WAV files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(folder)
    return files.select(stem(F.col("path")).alias("stem"), "path", "length", "content")


def headers(files: DataFrame) -> DataFrame:
    """(stem, path, length, channels, rate, bits, seconds) by the first 4 KB of each file; NULLs for what is no WAV."""
    info = files.select("stem", "path", "length", wav_info_udf(F.substring("content", 1, 4096)).alias("i"))
    width = F.col("i.channels") * F.col("i.bits") / 8
    return info.select("stem", "path", "length", "i.channels", "i.rate", "i.bits", (F.col("i.bytes") / width / F.col("i.rate")).alias("seconds"))


def waves(files: DataFrame) -> DataFrame:
    """(stem, wave) of each file: its first channel as floats; NULL for what is no 16-bit WAV."""
    return files.select("stem", read_wav_udf("content").alias("wave"))
