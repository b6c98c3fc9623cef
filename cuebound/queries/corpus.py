"""Corpus planning, validation and metric logs: SRC7, SRC11-SRC15, SRC18, SNK5, SNK6, SNK9, SNK13, SNK14, JN2-JN7, JN9, JN10, ST2-ST7, VL1-VL5, WN2-WN14, AG47, AG49-AG58, FJ1-FJ7, PRJ19, CH8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebound.functions import text as X
from cuebound.operators import metrics as G
from cuebound.operators import ordering as R
from cuebound.operators import validate as A
from cuebound.operators.summary import rounded
from cuebound.queries.common import S, segments
from cuebound.session import table

TARGET_SECONDS = 3600.0


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "manifest_samples").withColumn("seconds", F.coalesce("duration", F.lit(0.0)))


def wn03_sample_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Global numbers of samples from 0 in the order of their paths."""
    rows = table(spark, sf, "manifest_samples").select("id", "audio_path")
    return R.numbered(rows, [F.asc("audio_path"), F.asc("id")]).select("id", (F.col("number") - 1).alias("sample_id"))


def wn03_listing_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers from 1 of a channel's videos in the order of the listing."""
    rows = table(spark, sf, "videos").select("channel", "video_id", "index", F.unix_micros("crawled_at").alias("us"))
    return R.numbered_within(rows, "channel", [F.asc_nulls_first("index"), F.asc("video_id"), F.asc("us")])


def wn04_files_to_target(spark: SparkSession, sf: str) -> DataFrame:
    """Files (of 20 samples) that are needed to reach an hour: those whose total before them is below it."""
    files = _samples(spark, sf).groupBy((F.col("id") / 20).cast("bigint").alias("file")).agg(F.sum("seconds").alias("seconds"))
    total = R.numbered(files, [F.asc("file")], {"upto": ("sum", F.col("seconds"))})
    return total.where(F.round(F.col("upto") - F.col("seconds"), 6) < TARGET_SECONDS).select("file", F.round("upto", 4).alias("upto"))


def wn05_samples_to_target(spark: SparkSession, sf: str) -> DataFrame:
    """Samples by id as long as their running total stays within an hour."""
    total = R.numbered(_samples(spark, sf).select("id", "seconds"), [F.asc("id")], {"upto": ("sum", F.col("seconds"))})
    return total.where(F.round("upto", 6) <= TARGET_SECONDS).select("id", F.round("upto", 4).alias("upto"))


def wn11_index_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Index batches of 64 that cover all samples."""
    return R.index_batches(table(spark, sf, "manifest_samples").count(), 64, spark)


def wn13_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Shards of 1000 segments by running count: rows and first and last id."""
    rows = R.numbered(table(spark, sf, "segments").select("row_id"), [F.asc("row_id")])
    shard = F.floor((F.col("number") - 1) / 1000).alias("shard")
    return rows.groupBy(shard).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"))


def prj19_index_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Samples at the positions [100, 164) in the order of ids."""
    rows = R.numbered(table(spark, sf, "manifest_samples").select("id"), [F.asc("id")])
    return rows.where("number > 100 AND number <= 164").select("id", (F.col("number") - 1).alias("position"))


def src07_usable_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with audio and the first text there is."""
    rows = table(spark, sf, "manifest_samples").where("duration > 0")
    return rows.select("id", F.coalesce("transcription", "speaker_id", F.lit("")).alias("text"), rounded(F.col("duration")).alias("duration"))


def snk13_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of a manifest per split."""
    grouped = _samples(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("total_samples"), F.round(F.sum("seconds"), 4).alias("total_seconds"), F.round(F.sum("seconds") / 3600, 6).alias("total_hours"))
    return grouped


def snk14_batch_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Per batch of 100 samples: bounds, how many have audio, how many fail, the ids."""
    rows = R.numbered(_samples(spark, sf).select("id", "seconds"), [F.asc("id")]).withColumn("batch", F.floor((F.col("number") - 1) / 100))
    grouped = rows.groupBy("batch").agg(
        (F.min("number") - 1).alias("start_idx"), F.max("number").alias("end_idx"), F.count_if(F.col("seconds") > 0).alias("n_done"), F.count_if(F.col("seconds") <= 0).alias("n_failed"), F.sort_array(F.collect_list("id")).alias("ids")
    )
    return grouped.select("batch", "start_idx", "end_idx", "n_done", "n_failed", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def snk09_dropped_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Which of three keys a segment file has, and what is left without them."""
    body = F.regexp_replace("content", f"^[{X.BL}\\x{{FEFF}}]+", "")
    keys = F.json_object_keys(body)
    dropped = F.array(*map(F.lit, ("duration", "individual_segments", "segment_id")))
    rows = table(spark, sf, "segment_files").where(A.json_error(F.col("size_bytes"), F.col("content")).isNull() & keys.isNotNull())
    return rows.select("file_id", F.array_join(F.array_intersect(dropped, keys), ",").alias("dropped"), F.size(F.array_except(keys, dropped)).cast("bigint").alias("n_left"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "segment_files").select("path").union(table(spark, sf, "manifest_samples").select(F.concat("audio_path", F.lit(".wav")).alias("path")))
    return A.pair_files(files.withColumn("path", F.regexp_replace("path", r"\.wav\.wav$", ".wav")), ".wav", ".json")


def jn02_complete_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Stems with both an audio and a JSON file."""
    return _pairs(spark, sf).where("left_path IS NOT NULL AND right_path IS NOT NULL")


def jn03_incomplete_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Stems that miss one of the two, and which."""
    rows = _pairs(spark, sf).where("left_path IS NULL OR right_path IS NULL")
    return rows.select("stem", F.when(F.col("left_path").isNull(), "missing_wav").otherwise("missing_json").alias("kind"))


def jn05_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Audio with and without a transcript."""
    row = _pairs(spark, sf).where("left_path IS NOT NULL").agg(F.count("right_path").alias("n_joined"), F.count_if(F.col("right_path").isNull()).alias("n_skipped"))
    return row


def jn07_metadata_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with the channel of their video, '' where unknown."""
    names = table(spark, sf, "videos").where("channel IS NOT NULL").groupBy("video_id").agg(F.min("channel").alias("channel"))
    rows = table(spark, sf, "manifest_samples").select("id", F.regexp_extract(X.stem(F.col("audio_path")), r"^(.{11})_", 1).alias("video_id"))
    return rows.join(names, "video_id", "left").select("id", "video_id", F.coalesce("channel", F.lit("")).alias("channel"))


def jn09_unprocessed(spark: SparkSession, sf: str) -> DataFrame:
    """Segments that have no sample yet, as stored ids."""
    done = table(spark, sf, "manifest_samples").select(X.stem(F.col("audio_path")).alias("segment_id")).distinct()
    return table(spark, sf, "segments").join(done, "segment_id", "left_anti").select("row_id", "segment_id")


def jn10_absent_audio(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of which no small file is there."""
    known = table(spark, sf, "segment_files").select(X.stem(F.col("path")).alias("segment_id")).distinct()
    return table(spark, sf, "manifest_samples").select("id", X.stem(F.col("audio_path")).alias("segment_id")).join(known, "segment_id", "left_anti")


def st03_shared_videos(spark: SparkSession, sf: str) -> DataFrame:
    """Video ids that segments and cues share, and those that only one side has."""
    a, b = (table(spark, sf, t).select("video_id").where("video_id IS NOT NULL") for t in ("segments", "cues"))
    part = lambda df, kind: df.select("video_id", F.lit(kind).alias("kind"))
    return part(a.intersect(b), "both").unionAll(part(a.subtract(b), "segments")).unionAll(part(b.subtract(a), "cues"))


def vl05_label_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The first error of each label that has one."""
    rows = segments(spark, sf).select("row_id", A.label_error(F.col("start"), F.col("end"), F.col("text")).alias("error"))
    return rows.where("error IS NOT NULL")


def vl04_json_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The first error of each small JSON file that has one."""
    rows = table(spark, sf, "segment_files").select("file_id", A.json_error(F.octet_length("content").cast("bigint"), F.col("content")).alias("error"))
    return rows.where("error IS NOT NULL")


def ag47_validation_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, valid ones, success rate and verdict."""
    error = A.label_error(F.col("start"), F.col("end"), F.col("text"))
    return A.verdict(segments(spark, sf).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(error.isNull()).alias("n_valid")))


def ag49_operation_tracker(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts, successes, failures and rate per kind of event; an event with a value of 50 or more failed."""
    return G.tracker(table(spark, sf, "events").select(F.col("event_type").alias("operation"), (F.col("value") < 50).alias("is_success")))


def ag50_storage(spark: SparkSession, sf: str) -> DataFrame:
    """Files, bytes and megabytes per extension."""
    grouped = table(spark, sf, "segment_files").groupBy(X.suffix(F.col("path")).alias("suffix")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("bytes"))
    return grouped.withColumn("megabytes", rounded(F.col("bytes") / (1024 * 1024)))


def ag53_dataset_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Samples, seconds, minutes, hours and statistics of durations."""
    d = F.col("duration")
    return table(spark, sf, "manifest_samples").where("duration IS NOT NULL").agg(F.count(d).alias("n"), F.round(F.sum(d), 4).alias("seconds"), F.round(F.sum(d) / 60, 4).alias("minutes"), F.round(F.sum(d) / 3600, 6).alias("hours"), rounded(F.avg(d)).alias("mean"), F.min(d).alias("shortest"), F.max(d).alias("longest"))


def ag54_manifest_check(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest against the corpus: differences in number and hours, and whether 100 hours are reached."""
    hours = F.coalesce(F.sum("duration"), F.lit(0.0)) / 3600
    stated = table(spark, sf, "manifest_samples").agg(F.count(F.lit(1)).alias("a"), hours.alias("h"))
    actual = segments(spark, sf).agg(F.count(F.lit(1)).alias("b"), hours.alias("g"))
    row = stated.select("a", "h", actual.select("b").scalar().alias("b"), actual.select("g").scalar().alias("g"))
    gap = F.col("h") - F.col("g")
    return row.select((F.col("a") - F.col("b")).alias("count_gap"), F.round(gap, 4).alias("hour_gap"), (F.abs(gap) > 0.1).alias("hours_differ"), (F.col("h") >= 100).alias("is_target_reached"))


def ag55_preprocess_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Samples in all, those that can be processed, those that fail."""
    ok = (F.col("duration") > 0) & F.col("transcription").isNotNull()
    return table(spark, sf, "manifest_samples").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("processed"), (F.count(F.lit(1)) - F.count_if(ok)).alias("failed"))


def ag57_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Topics by whether all, some or none of their labels are valid."""
    error = A.label_error(F.col("start"), F.col("end"), F.col("text"))
    per = segments(spark, sf).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_if(error.isNull()).alias("ok"))
    status = F.when(F.col("ok") == F.col("n"), "success").when(F.col("ok") > 0, "partial").otherwise("failed")
    return per.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_topics"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """events as a metric log: steps in order, batches of 100 steps."""
    rows = table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("phase"), F.col("value").alias("loss"), "props")
    return R.numbered(rows, [F.asc("us"), F.asc("event_id")], {"best": ("min", F.col("loss"))}, "step").withColumn("batch", F.floor((F.col("step") - 1) / 100))


def src14_step_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Log entries by kind: those with a step key, those with only a batch key."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = table(spark, sf, "events").select("event_id", F.when(k % 2 == 0, k).alias("step"), F.when(k % 2 == 1, k).alias("batch"))
    return G.split_log(rows)


def ag58_metric_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Names of metrics in the entries, but for the five that are no metrics, and how many entries have each."""
    return G.catalogue(table(spark, sf, "events"), "props")


def wn02_batch_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Steps at which the batch is another than at the step before."""
    rows = R.previous(_log(spark, sf).select("step", "batch"), "step", "batch", "before")
    return rows.where("before IS NOT NULL AND batch <> before").select("step", "batch")


def wn06_moving_average(spark: SparkSession, sf: str) -> DataFrame:
    """Mean loss over each step and the four before it."""
    means = R.moving_average(_log(spark, sf).select("step", "loss"), "step", "loss", 5, "mean_loss")
    return means.select("step", rounded(F.col("mean_loss")).alias("mean_loss"))


def wn09_position_in_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of steps within the first ten batches."""
    log = _log(spark, sf)
    first = log.groupBy("batch").agg(F.min("step").alias("first"))
    return log.join(first, "batch").where("batch < 10").select("step", "batch", (F.col("step") - F.col("first")).alias("position"))


def wn10_best_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The three best steps of each phase by loss."""
    return G.best(_log(spark, sf), "phase", "loss", "step", 3)


def wn10_improvements(spark: SparkSession, sf: str) -> DataFrame:
    """Steps whose loss is below all before."""
    rows = R.previous(_log(spark, sf).select("step", "loss", "best"), "step", "best", "before")
    return rows.where("before IS NULL OR loss < before").select("step", "loss")


def ag51_metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    """First, last, mean, population deviation, extremes with their steps, change and trend of the loss per phase."""
    return G.summary(_log(spark, sf), "phase", "step", "loss")


def ag52_epoch_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Mean loss per epoch of ten batches."""
    return _log(spark, sf).groupBy(F.floor(F.col("batch") / 10).alias("epoch")).agg(rounded(F.avg("loss")).alias("mean_loss"), F.count(F.lit(1)).alias("n_steps"))


def ch08_metric_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The line of mean losses: a point per batch with its first step."""
    return _log(spark, sf).groupBy("batch").agg(F.min("step").alias("first_step"), rounded(F.avg("loss")).alias("mean_loss"))


def snk06_metric_table(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with and without a step as one table with the sorted union of their columns."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = table(spark, sf, "events")
    return G.union_sorted(rows.where(k % 2 == 0).select("event_id", k.alias("step"), "value"), rows.where(k % 2 == 1).select("event_id", k.alias("batch"), F.col("event_type").alias("phase")))


LOG = "WITH e AS (SELECT event_id, epoch_us(ts) AS us, event_type AS phase, value AS loss, props, row_number() OVER (ORDER BY ts, event_id) AS step FROM events), g AS (SELECT *, (step - 1) // 100 AS batch FROM e)"
STEM = lambda p: rf"regexp_replace(regexp_extract({p}, '([^/]*)$', 1), '\.[^.]*$', '')"
M = "WITH m AS (SELECT *, coalesce(duration, 0) AS seconds FROM manifest_samples)"
ERR = """CASE WHEN text IS NULL THEN 'no text' WHEN st IS NULL THEN 'no start' WHEN en IS NULL THEN 'no end' WHEN regexp_full_match(text, '[%s]*') THEN 'blank text' WHEN st < 0 THEN 'negative start' WHEN en <= st THEN 'end not after start' END""" % X.BL
PAIRS = rf"""WITH f AS (SELECT path FROM segment_files UNION ALL SELECT regexp_replace(audio_path || '.wav', '\.wav\.wav$', '.wav') FROM manifest_samples), x AS (SELECT {STEM('path')} AS stem, lower(regexp_extract(path, '[^/.][^/]*(\.[^./]*)$', 1)) AS suffix, path FROM f),
 p AS (SELECT stem, min(path) FILTER (suffix = '.wav') AS left_path, min(path) FILTER (suffix = '.json') AS right_path FROM x WHERE suffix IN ('.wav', '.json') GROUP BY stem)"""
JBODY = rf"regexp_replace(content, '^[{X.BL}\x{{FEFF}}]+|[{X.BL}\x{{FEFF}}]+$', '', 'g')"
QUERIES = {
    "wn03_sample_ids": (wn03_sample_ids, "SELECT id, row_number() OVER (ORDER BY audio_path, id) - 1 AS sample_id FROM manifest_samples"),
    "wn03_listing_numbers": (wn03_listing_numbers, 'SELECT channel, video_id, "index", epoch_us(crawled_at) AS us, row_number() OVER (PARTITION BY channel ORDER BY "index" NULLS FIRST, video_id, crawled_at) AS number FROM videos'),
    "wn04_files_to_target": (wn04_files_to_target, f"{M}, f AS (SELECT id // 20 AS file, sum(seconds) AS s FROM m GROUP BY 1), r AS (SELECT *, sum(s) OVER (ORDER BY file ROWS UNBOUNDED PRECEDING) AS upto FROM f) SELECT file, round(upto, 4) AS upto FROM r WHERE round(upto - s, 6) < 3600"),
    "wn05_samples_to_target": (wn05_samples_to_target, f"{M}, r AS (SELECT id, sum(seconds) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS upto FROM m) SELECT id, round(upto, 4) AS upto FROM r WHERE round(upto, 6) <= 3600"),
    "wn11_index_batches": (wn11_index_batches, "WITH c AS (SELECT count(*) AS n FROM manifest_samples) SELECT b AS batch, b * 64 AS start_idx, least((b + 1) * 64, n) AS end_idx FROM (SELECT n, unnest(range((n + 63) // 64)) AS b FROM c)"),
    "wn13_shards": (wn13_shards, "SELECT (r - 1) // 1000 AS shard, count(*) AS n, min(row_id) AS first_id, max(row_id) AS last_id FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS r FROM segments) GROUP BY 1"),
    "prj19_index_slice": (prj19_index_slice, "SELECT id, r - 1 AS position FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM manifest_samples) WHERE r > 100 AND r <= 164"),
    "src07_usable_samples": (src07_usable_samples, "SELECT id, coalesce(transcription, speaker_id, '') AS text, round(duration, 6) AS duration FROM manifest_samples WHERE duration > 0"),
    "snk13_manifest": (snk13_manifest, f"{M} SELECT split, count(*) AS total_samples, round(sum(seconds), 4) AS total_seconds, round(sum(seconds) / 3600, 6) AS total_hours FROM m GROUP BY split"),
    "snk14_batch_manifest": (snk14_batch_manifest, f"{M}, r AS (SELECT id, seconds, row_number() OVER (ORDER BY id) AS n FROM m) SELECT (n - 1) // 100 AS batch, min(n) - 1 AS start_idx, max(n) AS end_idx, count(*) FILTER (seconds > 0) AS n_done, count(*) FILTER (seconds <= 0) AS n_failed, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS ids FROM r GROUP BY 1"),
    "snk09_dropped_keys": (snk09_dropped_keys, f"WITH b AS (SELECT file_id, {JBODY} AS body FROM segment_files), k AS (SELECT file_id, json_keys(body) AS k FROM b WHERE starts_with(body, '{{') AND json_valid(body)) SELECT file_id, array_to_string(list_filter(['duration', 'individual_segments', 'segment_id'], lambda x: list_contains(k, x)), ',') AS dropped, CAST(len(list_filter(k, lambda x: x NOT IN ('duration', 'individual_segments', 'segment_id'))) AS BIGINT) AS n_left FROM k"),
    "jn02_complete_pairs": (jn02_complete_pairs, f"{PAIRS} SELECT * FROM p WHERE left_path IS NOT NULL AND right_path IS NOT NULL"),
    "jn03_incomplete_pairs": (jn03_incomplete_pairs, f"{PAIRS} SELECT stem, CASE WHEN left_path IS NULL THEN 'missing_wav' ELSE 'missing_json' END AS kind FROM p WHERE left_path IS NULL OR right_path IS NULL"),
    "jn05_transcripts": (jn05_transcripts, f"{PAIRS} SELECT count(right_path) AS n_joined, count(*) FILTER (right_path IS NULL) AS n_skipped FROM p WHERE left_path IS NOT NULL"),
    "jn07_metadata_lookup": (jn07_metadata_lookup, f"WITH v AS (SELECT video_id, min(channel) AS channel FROM videos WHERE channel IS NOT NULL GROUP BY 1), m AS (SELECT id, regexp_extract({STEM('audio_path')}, '^(.{{11}})_', 1) AS video_id FROM manifest_samples) SELECT id, video_id, coalesce(channel, '') AS channel FROM m LEFT JOIN v USING (video_id)"),
    "jn09_unprocessed": (jn09_unprocessed, f"SELECT row_id, segment_id FROM segments WHERE segment_id NOT IN (SELECT {STEM('audio_path')} FROM manifest_samples)"),
    "jn10_absent_audio": (jn10_absent_audio, f"SELECT id, {STEM('audio_path')} AS segment_id FROM manifest_samples WHERE {STEM('audio_path')} NOT IN (SELECT {STEM('path')} FROM segment_files)"),
    "st03_shared_videos": (st03_shared_videos, "WITH a AS (SELECT DISTINCT video_id FROM segments WHERE video_id IS NOT NULL), b AS (SELECT DISTINCT video_id FROM cues WHERE video_id IS NOT NULL) SELECT video_id, CASE WHEN b.video_id IS NULL THEN 'segments' WHEN a.video_id IS NULL THEN 'cues' ELSE 'both' END AS kind FROM a FULL JOIN b USING (video_id)"),
    "vl05_label_errors": (vl05_label_errors, f"{S} SELECT row_id, {ERR} AS error FROM s WHERE {ERR} IS NOT NULL"),
    "vl04_json_errors": (vl04_json_errors, f"""WITH b AS (SELECT file_id, content, {JBODY} AS body FROM segment_files), x AS (SELECT file_id, CASE WHEN content IS NULL THEN 'missing' WHEN strlen(content) < 2 THEN 'too small' WHEN NOT json_valid(body) OR body = '' THEN 'unreadable'
     WHEN json_type(body) NOT IN ('OBJECT', 'ARRAY') THEN 'neither object nor array' END AS error FROM b) SELECT * FROM x WHERE error IS NOT NULL"""),
    "ag47_validation_totals": (ag47_validation_totals, f"{S}, c AS (SELECT count(*) AS n_total, count(*) FILTER ({ERR} IS NULL) AS n_valid FROM s) SELECT n_total, n_valid, round(n_valid * 100 / n_total, 6) AS success_rate, CASE WHEN n_valid = n_total THEN 'PASSED' WHEN n_valid * 100 / n_total >= 95 THEN 'WARNING' ELSE 'FAILED' END AS status FROM c"),
    "ag49_operation_tracker": (ag49_operation_tracker, "SELECT event_type AS operation, count(*) AS attempts, count(*) FILTER (value < 50) AS successes, count(*) FILTER (NOT coalesce(value < 50, false)) AS failures, printf('%.1f%%', count(*) FILTER (value < 50) * 100 / count(*)) AS success_rate FROM events GROUP BY 1"),
    "ag50_storage": (ag50_storage, r"SELECT lower(regexp_extract(path, '[^/.][^/]*(\.[^./]*)$', 1)) AS suffix, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS bytes, round(sum(size_bytes) / 1048576, 6) AS megabytes FROM segment_files GROUP BY 1"),
    "ag53_dataset_hours": (ag53_dataset_hours, "SELECT count(duration) AS n, round(sum(duration), 4) AS seconds, round(sum(duration) / 60, 4) AS minutes, round(sum(duration) / 3600, 6) AS hours, round(avg(duration), 6) AS mean, min(duration) AS shortest, max(duration) AS longest FROM manifest_samples WHERE duration IS NOT NULL"),
    "ag54_manifest_check": (ag54_manifest_check, f"{S}, a AS (SELECT count(*) AS a, sum(duration) / 3600 AS h FROM manifest_samples), b AS (SELECT count(*) AS b, sum(du) / 3600 AS g FROM s) SELECT a - b AS count_gap, round(h - g, 4) AS hour_gap, abs(h - g) > 0.1 AS hours_differ, h >= 100 AS is_target_reached FROM a, b"),
    "ag55_preprocess_summary": (ag55_preprocess_summary, "SELECT count(*) AS total, count(*) FILTER (duration > 0 AND transcription IS NOT NULL) AS processed, count(*) - count(*) FILTER (duration > 0 AND transcription IS NOT NULL) AS failed FROM manifest_samples"),
    "ag57_status_counts": (ag57_status_counts, f"{S}, p AS (SELECT topic, count(*) AS n, count(*) FILTER ({ERR} IS NULL) AS ok FROM s GROUP BY topic) SELECT CASE WHEN ok = n THEN 'success' WHEN ok > 0 THEN 'partial' ELSE 'failed' END AS status, count(*) AS n_topics FROM p GROUP BY 1"),
    "src14_step_rows": (src14_step_rows, "WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, CASE WHEN k % 2 = 0 THEN 'step' ELSE 'batch' END AS kind, k AS position FROM k WHERE k IS NOT NULL"),
    "ag58_metric_catalogue": (ag58_metric_catalogue, "SELECT metric, count(*) AS n_entries FROM (SELECT unnest(json_keys(props)) AS metric FROM events) WHERE metric NOT IN ('step', 'epoch', 'batch', 'phase', 'timestamp') GROUP BY 1"),
    "wn02_batch_boundaries": (wn02_batch_boundaries, f"{LOG} SELECT step, batch FROM (SELECT step, batch, lag(batch) OVER (ORDER BY step) AS before FROM g) WHERE batch <> before"),
    "wn06_moving_average": (wn06_moving_average, f"{LOG} SELECT step, round(avg(loss) OVER (ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean_loss FROM g"),
    "wn09_position_in_batch": (wn09_position_in_batch, f"{LOG} SELECT step, batch, row_number() OVER (PARTITION BY batch ORDER BY step) - 1 AS position FROM g WHERE batch < 10"),
    "wn10_best_steps": (wn10_best_steps, f"{LOG} SELECT phase, step, loss, CAST(r AS INTEGER) AS rank FROM (SELECT phase, step, loss, row_number() OVER (PARTITION BY phase ORDER BY loss, step) AS r FROM g WHERE loss IS NOT NULL) WHERE r <= 3"),
    "wn10_improvements": (wn10_improvements, f"{LOG} SELECT step, loss FROM (SELECT step, loss, min(loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g) WHERE before IS NULL OR loss < before"),
    "ag51_metric_summary": (ag51_metric_summary, f"""{LOG}, a AS (SELECT phase, arg_min(loss, step) AS first_value, arg_max(loss, step) AS last_value, round(avg(loss), 6) AS mean, round(stddev_pop(loss), 6) AS std, min(loss) AS least, arg_min(step, (loss, step)) AS least_step, max(loss) AS most, arg_max(step, (loss, -step)) AS most_step FROM g WHERE loss IS NOT NULL GROUP BY phase)
     SELECT *, round((last_value - first_value) * 100 / first_value, 6) AS change, CASE WHEN last_value < first_value THEN 'decreasing' WHEN last_value > first_value THEN 'increasing' ELSE 'stable' END AS trend FROM a"""),
    "ag52_epoch_averages": (ag52_epoch_averages, f"{LOG} SELECT batch // 10 AS epoch, round(avg(loss), 6) AS mean_loss, count(*) AS n_steps FROM g GROUP BY 1"),
    "ch08_metric_lines": (ch08_metric_lines, f"{LOG} SELECT batch, min(step) AS first_step, round(avg(loss), 6) AS mean_loss FROM g GROUP BY batch"),
    "snk06_metric_table": (snk06_metric_table, "WITH k AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT CASE WHEN k % 2 = 1 THEN k END AS batch, event_id, CASE WHEN k % 2 = 1 THEN event_type END AS phase, CASE WHEN k % 2 = 0 THEN k END AS step, CASE WHEN k % 2 = 0 THEN value END AS value FROM k"),
}
