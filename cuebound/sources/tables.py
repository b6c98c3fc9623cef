"""Tables of other kinds: manifests, metric logs, raw Parquet shards, JSON configuration."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = "struct<id bigint, audio_path string, transcription string, duration double, sampling_rate int, speaker_id string>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per sample of manifest files; a manifest without samples has none."""
    rows = spark.read.schema(f"split string, samples array<{SAMPLE}>").option("multiLine", True).json(path)
    return rows.select("split", F.explode("samples").alias("s")).select("split", "s.*")


def read_metric_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, pos, metrics map) of each entry of metric logs; values that are no numbers are NULL."""
    rows = spark.read.schema("metrics array<map<string, string>>").option("multiLine", True).json(pattern)
    entries = rows.select(F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1).alias("file"), F.posexplode("metrics").alias("pos", "entry"))
    return entries


def first_entries(logs: DataFrame) -> DataFrame:
    """The first entry of each file."""
    return logs.where("pos = 0")


def read_shards(spark: SparkSession, root: str, pattern: str = "train-*.parquet") -> DataFrame:
    """Rows of raw Parquet shards anywhere under root."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(root)


def sample_text(rows: DataFrame) -> DataFrame:
    """rows with text: the first of transcription, sentence and text that the rows have and that is not NULL."""
    present = [c for c in ("transcription", "sentence", "text") if c in rows.columns]
    return rows.withColumn("text", F.coalesce(*map(F.col, present)) if present else F.lit(None).cast(T.StringType()))


def read_config(path: str, required: dict[str, list[str]]) -> dict[str, Any]:
    """A JSON configuration; KeyError names the first of the required sections and keys that is missing. There are no defaults."""
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    for section, keys in required.items():
        for key in keys:
            if key not in config.get(section, {}):
                raise KeyError(f"{section}.{key}")
    return config
