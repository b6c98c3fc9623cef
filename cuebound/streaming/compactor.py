"""Checkpointed streaming compactor: many small JSON files become few large Parquet files, each record exactly once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebound.session import delete, exists, shared_path

#: Bytes of content that one output file holds, about.
TARGET_BYTES = 128 << 20
_DECODER = json.JSONDecoder(parse_constant=lambda name: (_ for _ in ()).throw(ValueError(name)))


def record_text(content: str | None) -> str | None:
    """The value of a record's top-level key text, as canonical JSON (so that any value, lone surrogates included,
    compares exactly); None when the content is no complete JSON object with that key."""
    if content is None:
        return None
    body = content.strip().strip("﻿").strip()
    if not body.startswith("{"):
        return None
    try:
        value = _DECODER.decode(body)
    except (ValueError, RecursionError):
        return None
    if "text" not in value:
        return None
    return json.dumps(value["text"], ensure_ascii=True, sort_keys=True)


def parse_files(files: DataFrame) -> DataFrame:
    """(segment_id, text_key, file_id, path, content) of the files that hold a record; text_key is the SHA-256 of its text.

    A NULL path, a NULL content and contents that are unreadable, foreign or no JSON object with a key text hold none. A NULL file_id
    counts as larger than any.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [record_text(c) for c in batch.column(2).to_pylist()]
            held = batch.filter(pa.array([t is not None for t in texts], pa.bool_()))
            keys = pa.array([hashlib.sha256(t.encode()).digest() for t in texts if t is not None], pa.binary())
            yield pa.RecordBatch.from_arrays([*held.columns, keys], names=["file_id", "path", "content", "text_key"])

    rows = files.where("path IS NOT NULL AND content IS NOT NULL").select("file_id", "path", "content")
    held = rows.mapInArrow(parse, "file_id bigint, path string, content string, text_key binary")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return held.select(stem.alias("segment_id"), "text_key", "file_id", "path", "content")


def first_copies(records: DataFrame) -> DataFrame:
    """(segment_id, text_key, file_id): each record with its smallest file_id. No content is aggregated."""
    return records.groupBy("segment_id", "text_key").agg(F.min("file_id").alias("file_id"))


_KEYS = "segment_id string, text_key binary, file_id bigint, batch int"
_RECORDS = "segment_id string, text_key binary, file_id bigint, path string, content string, batch int"


def compact_files(
    spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 10_000, target_bytes: int = TARGET_BYTES
) -> dict[str, int]:
    """Consolidate the small-file table at source into target; returns how many batches and bytes this call took in.

    A file source with a checkpoint discovers each input file once, over any number of calls. All that is there is taken in batches
    (available-now). Batch n is parsed once into a folder of its own; its records' ids are compared with the index of the batches
    before it (ids alone, no contents); the records that are new, or came with a smaller file_id, go to target/records/batch=n, in
    as many files as their bytes need, and their ids to target/keys/batch=n. Both overwrite what an earlier attempt of the batch
    left, so a batch that is retried after a failure replaces its output. A copy that a later batch supersedes is left out by
    read_compacted and removed by consolidate.
    """
    static = spark.read.parquet(source)
    pattern = source if set(source) & set("*?[{") else f"{source[:-1]}[{source[-1]}]"  # a glob may be one file or a folder
    stream = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    done = {"batches": 0, "bytes": 0}

    def write(batch: DataFrame, number: int) -> None:
        staged = shared_path(spark, f"batch-{number}")
        parse_files(batch).write.option("compression", "zstd").parquet(staged)
        records = spark.read.parquet(staged)
        known = first_copies(_read(spark, f"{target}/keys", _KEYS).where(F.col("batch") < number))
        known = known.select("segment_id", "text_key", F.struct("file_id").alias("known"))
        found = first_copies(records).join(known, ["segment_id", "text_key"], "left")
        found = found.where("known IS NULL OR file_id < known.file_id OR known.file_id IS NULL AND file_id IS NOT NULL").drop("known")
        found.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/keys/batch={number}")
        found = spark.read.parquet(f"{target}/keys/batch={number}")
        size = records.agg(F.sum(F.octet_length("content").cast("bigint"))).first()[0] or 0
        kept = _kept(records, found, max(1, -(-size // target_bytes)))
        kept.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/records/batch={number}")
        delete(spark, staged)
        done["batches"] += 1
        done["bytes"] += size

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return done


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet files at path, none where nothing has been written yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """(segment_id, text_key, file_id): each record of all batches once, with its smallest file_id; reads no contents."""
    return first_copies(_read(spark, f"{target}/keys", _KEYS))


def _kept(records: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """The records whose ids are in an index (segment_id, text_key, file_id), each once, in parts partitions by record. Contents are
    shuffled once: the index comes to them by the same hash. A file that is listed twice is there twice with the same id."""
    where, ids = ("segment_id", "text_key"), index.withColumnRenamed("file_id", "kept_id")
    both = records.repartition(parts, *where).join(ids.repartition(parts, *where), list(where))
    same = F.coalesce(F.col("file_id") == F.col("kept_id"), F.col("file_id").isNull() & F.col("kept_id").isNull())
    return both.where(same).drop("kept_id").dropDuplicates(list(where))


def read_compacted(spark: SparkSession, target: str, parts: int | None = None) -> DataFrame:
    """(segment_id, text_key, file_id, path, content): each record of all batches once, as of its smallest file_id, in parts partitions
    (by default as many as shuffles have)."""
    records = _read(spark, f"{target}/records", _RECORDS).drop("batch")
    return _kept(records, read_index(spark, target), parts or int(spark.conf.get("spark.sql.shuffle.partitions")))


def consolidate(spark: SparkSession, target: str, out: str, target_bytes: int = TARGET_BYTES) -> None:
    """Write the records of all batches, each once, to out in files of about target_bytes of content. It overwrites out as a whole,
    so a run that is tried again replaces it."""
    size = _read(spark, f"{target}/records", _RECORDS).agg(F.sum(F.octet_length("content").cast("bigint"))).first()[0] or 0
    read_compacted(spark, target, max(1, -(-size // target_bytes))).write.mode("overwrite").option("compression", "zstd").parquet(out)


def small_files(spark: SparkSession, sf_dir: str, records_per_file: int = 500) -> str:
    """The table segment_files of a data folder as the many small files it stands for, in the shared folder; returns where."""
    out = shared_path(spark, "small")
    spark.read.parquet(f"{sf_dir.rstrip('/')}/segment_files.parquet").write.option("maxRecordsPerFile", records_per_file).parquet(out)
    return out


def compact_tables(spark: SparkSession, sf_dir: str, batches: int = 4) -> str:
    """Compact a data folder's segment_files, written as many small files, through a fresh checkpoint in that many batches; returns
    the folder with the index (keys), the batches' records (records), and all records in files of full size (whole)."""
    source, work = small_files(spark, sf_dir), shared_path(spark, "compact")
    n_files = len(spark.read.parquet(source).inputFiles())
    compact_files(spark, source, work, f"{work}-state", files_per_batch=max(1, -(-n_files // batches)))
    consolidate(spark, work, f"{work}/whole")
    delete(spark, source)
    return work
