"""Queries that write real files into the shared folder, read them with the sources and compare: SRC2, SRC3, SRC7-SRC15, SRC18, SNK1, SNK4,
SNK5, SNK8, SNK12, VL2, VL3, and the exact quotient, half-even rounding and no-speech probability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuebound.functions import arrays as A
from cuebound.functions import text as X
from cuebound.functions.signal import write_wav
from cuebound.operators import ordering as O
from cuebound.operators import validate as V
from cuebound.session import shared_path, spread, table
from cuebound.sources import audio, features, segments, sinks, tables


@F.pandas_udf(T.BinaryType())
def _wav(waves: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in waves:
        yield batch.map(lambda w: write_wav(np.asarray(w, np.float32)))


@F.pandas_udf(T.BinaryType())
def _npy(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in arrays:
        yield batch.map(lambda a: features.to_npy(np.asarray(a, np.float32).reshape(8, -1)))


def _folder(spark: SparkSession, name: str, *sets: DataFrame) -> str:
    """A folder of its own with a file for each row (path, content) of sets."""
    root = shared_path(spark, name)
    for rows in sets:
        features.write_files(rows, "path", "content", root)
    return root


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """The small JSON files of dataset folders as a tree of real files, read again."""
    rows = table(spark, sf, "segment_files").where("path RLIKE '^datasets/[^/]+/dataset/[^/]+[.]json$'")
    return segments.read_segments(spark, f"{_folder(spark, 'tree', spread(rows))}/datasets")


def _place(path: str = "file_path"):  # noqa: ANN202
    return F.regexp_extract(F.url_decode(path), "(datasets/[^/]+/dataset/[^/]+)$", 1)


def src03_read_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Each file of the tree and whether it could be read as a segment."""
    return _tree(spark, sf).select(_place().alias("path"), F.col("_corrupt").isNotNull().alias("is_error"))  # one reading, not one a kind


def src02_tree_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Topic, id, text and bounds of the segments of the tree."""
    return segments.split_errors(_tree(spark, sf))[0].select(_place().alias("path"), "topic", "segment_id", "text", "start", "end")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"))


def _quiet(column: str = "embedding"):  # noqa: ANN202
    return F.transform(column, lambda x: x * F.lit(0.1).cast("float"))


def _audio(spark: SparkSession, sf: str) -> str:
    rows = _vectors(spark, sf).select(F.concat(F.lit("audio/"), "vec_id", F.lit(".wav")).alias("path"), _wav(_quiet()).alias("content"))
    return _folder(spark, "audio", rows)


def _near(a, b):  # noqa: ANN001, ANN202
    """Whether two arrays differ by no more than two steps of 16 bits."""
    gaps = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: F.abs(p["a"] - p["b"]))
    return F.coalesce(F.array_max(gaps), F.lit(0.0)) < 7e-5


def src08_waves(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of each WAV file, and whether they are those that were written."""
    read = audio.waves(audio.read_audio(spark, _audio(spark, sf))).select(F.col("stem").cast("bigint").alias("vec_id"), "wave")
    return read.join(_vectors(spark, sf), "vec_id").select("vec_id", F.size("wave").alias("n"), _near(F.col("wave"), _quiet()).alias("is_near"))


def src09_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Channels, rate, bits, bytes and seconds of each WAV file by its header."""
    found = audio.headers(audio.read_audio(spark, _audio(spark, sf)))
    return found.select(F.col("stem").cast("bigint").alias("vec_id"), "channels", "rate", "bits", "length", F.round("seconds", 6).alias("seconds"))


def src07_audio_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Raw shards whose audio is an array, bytes or a path, by label: the samples of each, and whether they are right."""
    rows, root = _vectors(spark, sf), _audio(spark, sf)
    form = F.element_at(F.array(*map(F.lit, ("array", "bytes", "path"))), F.col("label") % 3 + 1)
    forms = F.struct(
        F.when(F.col("form") == "array", _quiet()).alias("array"), F.when(F.col("form") == "bytes", _wav(_quiet())).alias("bytes"),
        F.when(F.col("form") == "path", F.concat("vec_id", F.lit(".wav"))).alias("path"),
    )
    rows.withColumn("form", form).select("vec_id", "form", "embedding", forms.alias("audio"), F.lit("x").alias("sentence")).write.parquet(f"{root}/shards/train-0.parquet")
    shards = tables.sample_text(tables.read_shards(spark, f"{root}/shards", "*.parquet"))
    files = audio.read_audio(spark, f"{root}/audio").select(F.concat("stem", F.lit(".wav")).alias("path"), "content")
    return features.resolve_audio(shards, files).select("vec_id", "form", "text", F.size("wave").alias("n"), _near(F.col("wave"), _quiet()).alias("is_near"))


def src10_mel_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Feature files with the texts beside them; labels of 5 and more have no text file."""
    rows = _vectors(spark, sf)
    meta = F.to_json(F.struct(F.concat(F.lit("text "), "vec_id").alias("text"), F.col("label").cast("double").alias("duration")))
    root = _folder(
        spark, "mel",
        rows.select(F.concat("vec_id", F.lit("_mel.npy")).alias("path"), _npy("embedding").alias("content")),
        rows.where("label < 5").select(F.concat("vec_id", F.lit("_processed.json")).alias("path"), meta.alias("content")),
    )
    found = features.read_mel_pairs(spark, root)
    return found.select(F.col("name").cast("bigint").alias("vec_id"), F.col("mel.shape").alias("shape"), F.round(F.aggregate("mel.values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), "text", "duration")


def src11_logit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Logits with their features (labels below 4), or else the wave as .npy (below 7) or as .wav, and texts of labels below 8."""
    rows = _vectors(spark, sf)
    file = lambda where, ending, content: rows.where(where).select(F.concat("vec_id", F.lit(ending)).alias("path"), content.alias("content"))
    logits = _folder(spark, "logits", file("true", "_logits.npy", _npy("embedding")))
    mel = _folder(spark, "features", file("label < 4", "_mel.npy", _npy("embedding")), file("label < 7", ".npy", _npy("embedding")), file("label > 5", ".wav", _wav(_quiet())))
    meta = rows.where("label < 8").select(F.col("vec_id").cast("string").alias("name"), F.concat(F.lit("text "), "vec_id").alias("text"))
    found = features.read_logit_pairs(spark, logits, mel, meta).select(F.col("name").cast("bigint").alias("vec_id"), "logits", "mel", "wave", "text")
    form = F.when(F.col("mel").isNotNull(), "mel").when(F.col("wave").isNotNull(), "wave")
    return found.select("vec_id", form.alias("form"), F.size("logits.values").alias("n_logits"), F.coalesce(F.size("wave"), F.lit(-1)).alias("n_wave"), "text")


def src12_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Serialized examples read again: tokens, text, and whether logits came back to half precision."""
    array = F.struct(F.array(F.lit(8), F.lit(8)).alias("shape"), F.col("embedding").cast("array<float>").alias("values"))
    rows = _vectors(spark, sf).select(F.col("vec_id").cast("string").alias("name"), array.alias("mel"), array.alias("logits"), F.sequence(F.lit(1), F.col("label").cast("int") + 1).alias("tokens"), F.concat(F.lit("text "), "vec_id").alias("text"))
    path = shared_path(spark, "examples")
    features.write_examples(rows, path, 100)
    gap = F.array_max(F.transform(F.arrays_zip(F.col("mel.values").alias("a"), F.col("logits.values").alias("b")), lambda p: F.abs(p["a"] - p["b"]) - F.abs(p["a"]) / 1024))
    return features.read_examples(spark, path).select(F.col("name").cast("bigint").alias("vec_id"), F.size("tokens").alias("n_tokens"), "text", (gap < 1e-6).alias("is_near"))


def snk05_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of a data set in shards, as noted beside it, and whether no shard has more rows than it may."""
    array = F.struct(F.array(F.lit(64)).alias("shape"), F.col("embedding").cast("array<float>").alias("values"))
    path = shared_path(spark, "shards")
    features.write_examples(_vectors(spark, sf).select(F.col("vec_id").cast("string").alias("name"), array.alias("mel"), array.alias("logits"), F.array(F.lit(1)).alias("tokens"), F.lit("").alias("text")), path, 50)
    largest = spark.read.parquet(f"{path}/shards").groupBy("_metadata.file_path").count().agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("n"))
    info = spark.read.json(f"{path}/dataset_info")
    return info.select("total_samples", "samples_per_shard", (largest.select("most").scalar() <= 50).alias("is_bounded"), (F.col("num_shards") == largest.select("n").scalar()).alias("is_counted"))


def snk12_half_logits(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of logits in half precision, and whether they come back to it."""
    packed = _vectors(spark, sf).select("vec_id", "embedding", features.halves_udf(F.col("embedding").cast("array<float>")).alias("data"))
    gap = F.array_max(F.transform(F.arrays_zip(F.col("embedding").alias("a"), F.col("back").alias("b")), lambda p: F.abs(p["a"] - p["b"]) - F.abs(p["a"]) / 1024))
    return packed.withColumn("back", features.from_halves_udf("data")).select("vec_id", F.octet_length("data").alias("bytes"), (gap < 1e-6).alias("is_near"))


def snk04_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Features written and read again, and the row that sums them up."""
    samples = table(spark, sf, "manifest_samples")
    done = samples.where("duration > 0 AND transcription IS NOT NULL").select(F.col("id").cast("string").alias("name"), "duration")
    path = shared_path(spark, "features")
    sinks.write_features(done, path, 100)
    row = features.processing_summary(spark.read.parquet(path), samples.count() - done.count())
    return row.select("n_processed", "n_failed", F.round("total_seconds", 4).alias("total_seconds"), F.round("mean_seconds", 6).alias("mean_seconds"))


def snk01_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per topic as a CSV report with a header, read again (all columns text)."""
    path = shared_path(spark, "report")
    sinks.write_report(table(spark, sf, "segments").where("topic IS NOT NULL").groupBy("topic").agg(F.count(F.lit(1)).alias("n_rows")), path)
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", "\\N").csv(path)


def snk08_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Address list written as text lines and read again."""
    path = shared_path(spark, "urls")
    sinks.write_urls(table(spark, sf, "videos"), path)
    return spark.read.text(f"{path}/urls").select(F.col("value").alias("url"))


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    """events as a metric log file a day, read again: (file, pos, entry)."""
    rows = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", F.col("value").alias("loss"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("us", "event_id", "loss"))), lambda e: F.struct(e["event_id"].alias("event_id"), e["loss"].alias("loss")))
    files = rows.groupBy("day").agg(entries.alias("metrics"))  # a file is one document, so its entries are one row
    root = _folder(spark, "logs", files.select(F.concat("day", F.lit("_metrics.json")).alias("path"), F.to_json(F.struct("metrics")).alias("content")))
    return tables.read_metric_logs(spark, f"{root}/*_metrics.json")


def src15_log_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the metric logs."""
    return _logs(spark, sf).select("file", "pos", F.col("entry.event_id").cast("bigint").alias("event_id"), F.col("entry.loss").cast("double").alias("loss"))


def src13_batch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The first entry of each day's log file, numbered from 0 by file name."""
    first = tables.first_entries(_logs(spark, sf)).select("file", F.col("entry.event_id").cast("bigint").alias("event_id"), F.col("entry.loss").cast("double").alias("loss"))
    named = O.numbered(first, [F.asc("file")])
    return named.select((F.col("number") - 1).alias("batch"), F.regexp_replace("file", "_metrics[.]json$", "").alias("file"), "event_id", "loss")


def src18_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of manifest files, one a split, read again."""
    names = ["id", "audio_path", "transcription", "duration", "sampling_rate", "speaker_id"]
    splits = table(spark, sf, "manifest_samples").groupBy("split").agg(F.collect_list(F.struct(*names)).alias("samples"))  # a file is one document
    files = splits.select(F.concat(F.coalesce("split", F.lit("none")), F.lit(".json")).alias("path"), F.to_json(F.struct("split", "samples")).alias("content"))
    return tables.read_manifest(spark, _folder(spark, "manifest", files))


def vl02_audio_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The first error of each sample's audio, from real files: two hundred bytes a second at 100 Hz, none for a NULL duration, no audio
    extension for rates other than 16 kHz."""
    samples = spread(table(spark, sf, "manifest_samples").select("id", "duration", "sampling_rate"))
    name = F.concat(F.col("id"), F.when(F.col("sampling_rate") == 16000, ".wav").otherwise(".pcm"))
    files = samples.where("duration IS NOT NULL").select(name.alias("path"), _hundred(F.col("duration")).alias("content"))
    root = _folder(spark, "checked", files)
    read = spark.read.format("binaryFile").load(root)
    found = audio.headers(read.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("stem"), "path", "length", "content"))
    joined = samples.withColumn("name", name).join(found, F.col("name") == F.col("stem"), "left")
    rows = joined.select("id", V.audio_error(F.col("name"), F.col("length"), F.col("seconds") * 1000).alias("error"))
    return rows.where("error IS NOT NULL")


@F.pandas_udf(T.BinaryType())
def _hundred(seconds: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in seconds:
        yield batch.map(lambda s: write_wav(np.zeros(int(max(0.0, s) * 100)), 100))


def vl03_srt_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The first error of each cue's subtitle file, from real files: no time line for a NULL end, another extension for a NULL language."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint").cast("string")
    cues = spread(table(spark, sf, "cues").select("cue_id", "lang", "start", "end", "text"))
    name = F.concat(F.col("cue_id"), F.when(F.col("lang").isNull(), ".txt").otherwise(".srt"))
    content = F.concat_ws("\n", F.lit("1"), F.concat(ms("start"), F.lit(" --> "), ms("end")), F.col("text"))
    read = spark.read.format("binaryFile").load(_folder(spark, "srt", cues.select(name.alias("path"), content.alias("content"))))
    read = read.select(X.stem(F.col("path")).cast("bigint").alias("cue_id"), V.srt_error(F.col("path"), F.col("length"), F.decode("content", "utf-8")).alias("error"))
    return read.where("error IS NOT NULL")


def fm02_quotients(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of ten milliseconds in a second of each sample's rate; a rate that is no multiple of 100 would be an error."""
    rows = table(spark, sf, "manifest_samples").where("sampling_rate IS NOT NULL")
    return rows.select("id", A.exact_quotient(F.col("sampling_rate").cast("bigint"), F.lit(100)).alias("frame"))


def fm03_half_even(spark: SparkSession, sf: str) -> DataFrame:
    """Values with two digits and a five, rounded half to even."""
    return table(spark, sf, "events").select("event_id", A.half_even(F.col("event_id") / 8, 2).alias("rounded"))


def tn13_no_speech(spark: SparkSession, sf: str) -> DataFrame:
    """Probability of the no-speech token (here id 5) at the start, and the mean log probability of what follows."""
    rows = _vectors(spark, sf)
    return rows.select("vec_id", F.round(A.probability_of(F.col("embedding"), 5), 6).alias("no_speech"))


_D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_TREE = """WITH f AS (SELECT path, regexp_replace(content, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS body FROM segment_files
    WHERE regexp_matches(path, '^datasets/[^/]+/dataset/[^/]+[.]json$') AND NOT ends_with(path, '/dataset_summary.json') AND content IS NOT NULL),
  g AS (SELECT path, body, json_valid(body) AND starts_with(body, '{') AS good FROM f)"""
QUERIES = {
    "src02_tree_segments": (
        src02_tree_segments,
        f"""{_TREE} SELECT path, regexp_extract(path, '^datasets/([^/]+)/', 1) AS topic, regexp_extract(path, '([^/]*)[.]json$', 1) AS segment_id,
        json_extract_string(body, '$.text') AS text, TRY_CAST(json_extract_string(body, '$.start') AS DOUBLE) AS start, TRY_CAST(json_extract_string(body, '$.end') AS DOUBLE) AS "end"
        FROM g WHERE good""",
    ),
    "src03_read_errors": (src03_read_errors, f"{_TREE} SELECT path, NOT good AS is_error FROM g"),
    "src07_audio_forms": (src07_audio_forms, "SELECT vec_id, list_extract(['array', 'bytes', 'path'], CAST(label % 3 + 1 AS BIGINT)) AS form, 'x' AS text, len(embedding)::INTEGER AS n, TRUE AS is_near FROM embeddings"),
    "src08_waves": (src08_waves, "SELECT vec_id, len(embedding)::INTEGER AS n, TRUE AS is_near FROM embeddings"),
    "src09_headers": (src09_headers, "SELECT vec_id, 1::BIGINT AS channels, 16000::BIGINT AS rate, 16::BIGINT AS bits, CAST(44 + 2 * len(embedding) AS BIGINT) AS length, round(len(embedding) / 16000, 6) AS seconds FROM embeddings"),
    "src10_mel_pairs": (src10_mel_pairs, f"SELECT vec_id, [8, 8] AS shape, round(list_sum({_D}), 4) AS total, 'text ' || vec_id AS text, label::DOUBLE AS duration FROM embeddings WHERE label < 5"),
    "src11_logit_pairs": (
        src11_logit_pairs,
        "SELECT vec_id, CASE WHEN label < 4 THEN 'mel' ELSE 'wave' END AS form, len(embedding)::INTEGER AS n_logits, CASE WHEN label < 4 THEN -1 ELSE len(embedding) END::INTEGER AS n_wave, CASE WHEN label < 8 THEN 'text ' || vec_id ELSE '' END AS text FROM embeddings",
    ),
    "src12_examples": (src12_examples, "SELECT vec_id, CAST(label + 1 AS INTEGER) AS n_tokens, 'text ' || vec_id AS text, TRUE AS is_near FROM embeddings"),
    "src13_batch_metrics": (
        src13_batch_metrics,
        "WITH f AS (SELECT strftime(ts, '%Y-%m-%d') AS file, event_id, value AS loss FROM events QUALIFY row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) = 1) SELECT row_number() OVER (ORDER BY file) - 1 AS batch, file, event_id, loss FROM f",
    ),
    "src15_log_entries": (src15_log_entries, "SELECT strftime(ts, '%Y-%m-%d') || '_metrics.json' AS file, CAST(row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, event_id, value AS loss FROM events"),
    "src18_manifest": (src18_manifest, "SELECT split, id, audio_path, transcription, duration, sampling_rate, speaker_id FROM manifest_samples"),
    "snk01_report": (snk01_report, "SELECT topic, CAST(count(*) AS VARCHAR) AS n_rows FROM segments WHERE topic IS NOT NULL GROUP BY topic"),
    "snk04_summary": (
        snk04_summary,
        "WITH d AS (SELECT duration FROM manifest_samples WHERE duration > 0 AND transcription IS NOT NULL) SELECT count(*) AS n_processed, (SELECT count(*) FROM manifest_samples) - count(*) AS n_failed, round(coalesce(sum(duration), 0), 4) AS total_seconds, round(coalesce(avg(duration), 0), 6) AS mean_seconds FROM d",
    ),
    "snk05_shards": (snk05_shards, "SELECT count(*) AS total_samples, 50::BIGINT AS samples_per_shard, TRUE AS is_bounded, TRUE AS is_counted FROM embeddings"),
    "snk08_urls": (snk08_urls, "SELECT url FROM videos WHERE url IS NOT NULL"),
    "snk12_half_logits": (snk12_half_logits, "SELECT vec_id, CAST(2 * len(embedding) AS INTEGER) AS bytes, TRUE AS is_near FROM embeddings"),
    "vl02_audio_errors": (
        vl02_audio_errors,
        """WITH s AS (SELECT id, duration, sampling_rate, CASE WHEN duration IS NOT NULL THEN 44 + 2 * CAST(trunc(greatest(0, duration) * 100) AS BIGINT) END AS size FROM manifest_samples)
        SELECT * FROM (SELECT id, CASE WHEN size IS NULL THEN 'missing' WHEN size < 1024 THEN 'too small' WHEN sampling_rate IS NULL OR sampling_rate <> 16000 THEN 'not an audio file' WHEN duration < 0.1 THEN 'too short' END AS error FROM s) WHERE error IS NOT NULL""",
    ),
    "vl03_srt_errors": (
        vl03_srt_errors,
        """WITH c AS (SELECT cue_id, lang, concat_ws(chr(10), '1', CAST(CAST(round("start" * 1000) AS BIGINT) AS VARCHAR) || ' --> ' || CAST(CAST(round("end" * 1000) AS BIGINT) AS VARCHAR), text) AS body FROM cues)
        SELECT * FROM (SELECT cue_id, CASE WHEN strlen(body) < 10 THEN 'too small' WHEN lang IS NULL THEN 'not a subtitle file' WHEN NOT contains(body, '-->') THEN 'no time line' END AS error FROM c) WHERE error IS NOT NULL""",
    ),
    "fm02_quotients": (fm02_quotients, "SELECT id, CAST(sampling_rate // 100 AS BIGINT) AS frame FROM manifest_samples WHERE sampling_rate IS NOT NULL"),
    "fm03_half_even": (fm03_half_even, "SELECT event_id, round_even(event_id / 8, 2) AS rounded FROM events"),
    "tn13_no_speech": (tn13_no_speech, f"WITH e AS (SELECT vec_id, {_D} AS d FROM embeddings) SELECT vec_id, round(exp(d[6] - list_max(d)) / list_sum(list_transform(d, lambda y: exp(y - list_max(d)))), 6) AS no_speech FROM e"),
}
