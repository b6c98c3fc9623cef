"""Segments: the central rows of a corpus, from JSON trees or from tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuebound.functions.text import stem
from cuebound.session import _file_system

SEGMENT = T.StructType(
    [
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("video_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)
#: The name of the summary file that lies beside the segments, and the audio extensions by preference: fixed values.
SUMMARY = "dataset_summary.json"
AUDIO = [".wav", ".mp3", ".m4a", ".flac"]


#: Contents that a task of read_files holds at a time, in bytes (a single larger file aside).
HELD = 8_000_000


def _opened(uri: str):  # noqa: ANN202
    """(PyArrow file system, path in it) of a URI as Hadoop writes it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), unquote(uri.removeprefix("file:")).replace("//", "/")) if uri.startswith("file:") else fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _quoted(name: str) -> str:
    """name as Hadoop writes it in a URI: blanks, controls and ASCII signs that a path may not have as bytes, other letters as they are."""
    legal = lambda c: c.isalnum() or c in "_-!.~'()*,;:$&+=@" if c.isascii() else unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc")
    return name if name.isascii() and name.replace("_", "").replace("-", "").replace(".", "").isalnum() else "".join(c if legal(c) else quote(c, safe="") for c in name)


def list_files(spark: SparkSession, root: str, exclude: str | None = None) -> DataFrame:
    """(file_path) of the files root/<folder>/dataset/*.json, hidden names and empty files included, without those named exclude. The executors
    list, a folder a task at a time, so the driver holds no paths."""
    system, target = _file_system(spark, root)
    if not system.exists(target):
        raise FileNotFoundError(root)
    base, n = re.sub("^([a-z0-9]+):///", r"\1:/", str(system.makeQualified(target).toUri())).rstrip("/"), _parts(spark)

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for _ in batches:
            files, path = _opened(base)
            found = [f"{base}/{_quoted(i.base_name)}/dataset" for i in files.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.Directory]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["file_path"])

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                files, path = _opened(folder)
                infos = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
                found = [f"{folder}/{_quoted(i.base_name)}" for i in infos if i.type == fs.FileType.File and i.extension == "json" and i.base_name != exclude]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["file_path"])

    listed = spark.range(0, 1, 1, 1).mapInArrow(folders, "file_path string").repartition(n, "file_path")
    return listed.mapInArrow(names, "file_path string").repartition(n, "file_path")


def _parts(spark: SparkSession) -> int:
    """Partitions of lists of paths: by number, since paths are small and what they name is not."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_files(paths: DataFrame) -> DataFrame:
    """(file_path, content) of the whole files that paths (file_path) names, whatever they are called and however small they are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, names, contents, held = {}, [], [], 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                folder, name = uri.rsplit("/", 1)
                if folder not in opened:
                    opened = {folder: _opened(folder)}  # the latest only
                files, path = opened[folder]
                with files.open_input_stream(f"{path}/{unquote(name)}", compression=None) as stream:
                    contents.append(stream.read())
                names.append(uri)
                held += len(contents[-1])
                if held >= HELD or len(names) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["file_path", "content"])
                    names, contents, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["file_path", "content"])

    return paths.mapInArrow(read, "file_path string, content binary")


def read_segments(spark: SparkSession, root: str, exclude_summary: bool = True) -> DataFrame:
    """One row per file root/<topic>/dataset/*.json, unreadable files included (their content in _corrupt), and what is no JSON object too.

    Adds topic, segment_id and file_path from the path. A duration whose key is absent is filled from the bounds; one that is
    null stays missing. exclude_summary leaves out the summary file, which is no segment; without it that file gives a
    row without text and times. The executors list and read the files, through PyArrow's file systems.
    """
    files = read_files(list_files(spark, root, SUMMARY if exclude_summary else None)).select("file_path", F.col("content").cast("string").alias("value"))
    row = F.from_json("value", SEGMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    has_key = F.coalesce(F.array_contains(F.json_object_keys("value"), "duration"), F.lit(False))
    parsed = files.select(row.alias("r"), has_key.alias("has_key"), "file_path", "value").select("r.*", "has_key", "file_path", "value")
    parsed = parsed.withColumn("_corrupt", F.coalesce("_corrupt", F.when(F.json_object_keys("value").isNull(), F.col("value")))).drop("value")
    filled = F.when(F.col("has_key"), F.col("duration")).otherwise(F.col("end") - F.col("start"))
    topic = F.url_decode(F.regexp_extract("file_path", r"([^/]+)/dataset/[^/]*$", 1))
    return parsed.withColumn("duration", filled).drop("has_key").withColumn("topic", topic).withColumn("segment_id", stem(F.col("file_path")))


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, errors): rows of read_segments that could be read, and (file_path, content) of those that could not."""
    return rows.where("_corrupt IS NULL").drop("_corrupt"), rows.where("_corrupt IS NOT NULL").select("file_path", F.col("_corrupt").alias("content"))


def tidy(segments: DataFrame) -> DataFrame:
    """segments with NaN times as NULL, and an absent duration filled from the bounds under the name filled."""
    for name in ("start", "end", "duration"):
        segments = segments.withColumn(name, F.nanvl(F.col(name), F.lit(None).cast("double")))
    return segments.withColumn("filled", F.coalesce("duration", F.col("end") - F.col("start")))


def dataset_folders(segments: DataFrame, path: str = "file_path") -> DataFrame:
    """(channel, folder, json_count) of each folder <channel>/dataset that holds a JSON file, by the paths of segments."""
    found = segments.where(F.col(path).rlike(r"[^/]+/dataset/[^/]*\.json$"))
    folder = F.regexp_extract(path, r"^(.*[^/]+/dataset)/[^/]*$", 1)
    return found.groupBy(F.regexp_extract(path, r"([^/]+)/dataset/[^/]*$", 1).alias("channel"), folder.alias("folder")).agg(F.count(F.lit(1)).alias("json_count"))


def attach_audio(segments: DataFrame, files: DataFrame) -> DataFrame:
    """segments with audio_path: of the audio files (path) that share the segment's stem, the one with the preferred extension
    (the smallest path on a tie); NULL without one."""
    order = F.array_position(F.array(*map(F.lit, AUDIO)), F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)))
    audio = files.where(order > 0).groupBy(stem(F.col("path")).alias("segment_id")).agg(F.min_by("path", F.struct(order, "path")).alias("audio_path"))
    return segments.join(audio, "segment_id", "left")
