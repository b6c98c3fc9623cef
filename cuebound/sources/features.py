"""Feature files: arrays with their texts, logits, serialized examples and shards."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuebound.functions.signal import read_wav_udf
from cuebound.functions.text import stem

ARRAY = T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))])


@F.pandas_udf(ARRAY)
def npy_udf(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Shape and values, row by row, of the arrays in .npy contents; NULLs for what is none."""
    for batch in contents:
        shapes, values = [], []
        for data in batch:
            try:
                array = np.load(io.BytesIO(data), allow_pickle=False)
                shapes.append(list(array.shape))
                values.append(array.astype(np.float32).ravel())
            except (ValueError, TypeError, EOFError, OSError):
                shapes.append(None)
                values.append(None)
        yield pd.DataFrame({"shape": shapes, "values": values})


def to_npy(array: np.ndarray) -> bytes:
    """The contents of a .npy file."""
    out = io.BytesIO()
    np.save(out, np.asarray(array), allow_pickle=False)
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def halves_udf(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Floats as half-precision numbers of two bytes each; NULL stays."""
    for batch in values:
        yield batch.map(lambda x: None if x is None else np.asarray(x, np.float32).astype("<f2").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_halves_udf(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The numbers that halves_udf packed."""
    for batch in data:
        yield batch.map(lambda x: None if x is None else np.frombuffer(x, "<f2").astype(np.float32))


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def _named(files: DataFrame, ending: str) -> Column:
    """The stem of a file's name without ending."""
    return F.regexp_replace(F.url_decode(stem(files["path"])), f"{ending}$", "")


def read_mel_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(name, mel, text, duration): each pair of <name>_mel.npy and <name>_processed.json under a folder. A file without the other is
    left out. Batching and a largest number of samples are the reader's: limit, toLocalIterator."""
    mel = _files(spark, folder, "*_mel.npy")
    mel = mel.select(_named(mel, "_mel").alias("name"), npy_udf("content").alias("mel"))
    meta = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_processed.json").text(folder, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    parsed = F.from_json("value", "text string, duration double")
    meta = meta.select(_named(meta, "_processed").alias("name"), parsed.alias("m")).select("name", "m.*")
    return mel.join(meta, "name")


def read_logit_pairs(spark: SparkSession, logits_dir: str, features_dir: str, metadata: DataFrame) -> DataFrame:
    """(name, logits, mel, wave, text): each <name>_logits.npy with <name>_mel.npy, or where that is absent with the wave <name>.npy or
    <name>.wav (in that order), and the text of metadata (name, text), empty where it has none. Logits without features are left out."""
    logits = _files(spark, logits_dir, "*_logits.npy")
    logits = logits.select(_named(logits, "_logits").alias("name"), npy_udf("content").alias("logits"))
    files = _files(spark, features_dir, "*.{npy,wav}")
    kind = F.when(F.col("path").endswith("_mel.npy"), 1).when(F.col("path").endswith(".npy"), 2).otherwise(3)
    files = files.where(~F.col("path").endswith("_logits.npy")).select(_named(files, "_mel").alias("name"), kind.alias("kind"), "path", "content")
    best = files.groupBy("name").agg(F.min(F.struct("kind", "path")).alias("best")).select("name", "best.*")  # contents stay out of the grouping
    chosen = files.join(best, ["name", "kind", "path"])
    array = npy_udf(F.when(F.col("kind") < 3, F.col("content")))
    chosen = chosen.select("name", "kind", array.alias("a"), read_wav_udf(F.when(F.col("kind") == 3, F.col("content"))).alias("w"))
    features = chosen.select("name", F.when(F.col("kind") == 1, F.col("a")).alias("mel"), F.when(F.col("kind") == 2, F.col("a.values")).otherwise(F.col("w")).alias("wave"))
    return logits.join(features, "name").join(metadata.select("name", "text"), "name", "left").withColumn("text", F.coalesce("text", F.lit("")))


def write_examples(examples: DataFrame, path: str, samples_per_shard: int = 1000) -> dict[str, int]:
    """Examples (name, mel and logits as array structs, tokens, text) as shards of samples_per_shard rows at most: logits in half precision,
    compressed. Returns the data set's figures, which are also written as path/dataset_info."""
    packed = examples.select("name", "mel", F.col("logits.shape").alias("logits_shape"), halves_udf("logits.values").alias("logits_values"), "tokens", "text")
    packed.write.mode("overwrite").option("maxRecordsPerFile", samples_per_shard).option("compression", "zstd").parquet(f"{path}/shards")
    written = examples.sparkSession.read.parquet(f"{path}/shards")
    info = {"total_samples": written.count(), "samples_per_shard": samples_per_shard, "num_shards": len(written.inputFiles())}
    examples.sparkSession.createDataFrame([tuple(info.values())], "total_samples bigint, samples_per_shard bigint, num_shards bigint").coalesce(1).write.mode("overwrite").json(f"{path}/dataset_info")
    return info


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """The examples of write_examples."""
    rows = spark.read.parquet(f"{path}/shards")
    return rows.select("name", "mel", F.struct(F.col("logits_shape").alias("shape"), from_halves_udf("logits_values").alias("values")).alias("logits"), "tokens", "text")


def resolve_audio(rows: DataFrame, files: DataFrame | None = None, audio: str = "audio") -> DataFrame:
    """rows with wave, whatever form their audio has: an array, the bytes of a WAV file, or a path, tried in this order. audio is a struct
    that has some of the fields array, bytes and path; files (path, content) has what paths name. NULL where nothing is there."""
    have = {f.name for f in rows.schema[audio].dataType.fields}
    part = lambda n, kind: F.col(f"{audio}.{n}") if n in have else F.lit(None).cast(kind)
    wave, data = part("array", "array<float>").cast("array<float>"), part("bytes", "binary")
    if files is not None and "path" in have:
        named = files.select(F.col("path").alias("__path"), F.col("content").alias("__content"))
        rows = rows.withColumn("__name", part("path", "string")).join(named, F.col("__name") == F.col("__path"), "left").drop("__path", "__name")
        data = F.coalesce(data, F.col("__content"))
    found = rows.withColumn("wave", F.coalesce(wave, read_wav_udf(F.when(wave.isNull(), data))))
    return found.drop("__content")


def processing_summary(features: DataFrame, failed: int = 0) -> DataFrame:
    """One row about features (name, duration): how many there are, how many more failed, and seconds in all and on average."""
    n = F.count(F.lit(1))
    return features.agg(
        n.alias("n_processed"), F.lit(failed).cast("bigint").alias("n_failed"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_seconds"),
        F.coalesce(F.avg("duration"), F.lit(0.0)).alias("mean_seconds"),
    )


def write_files(rows: DataFrame, path: str, content: str, root: str) -> int:
    """Each row's content as a file of its own at root/path, as its consumers ask for; the number of files. A task that runs again writes
    the same files again. Rows with a NULL path or content have none."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        made, folders = 0, set()
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{base.rstrip('/')}/{name}"
                folder = target.rsplit("/", 1)[0]
                if folder not in folders:
                    system.create_dir(folder, recursive=True)
                    folders.add(folder)
                with system.open_output_stream(target) as out:
                    out.write(data)
                made += 1
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], names=["n"])

    found = rows.select(path, F.col(content).cast("binary").alias("__content")).where(F.col(path).isNotNull() & F.col("__content").isNotNull())
    return found.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
