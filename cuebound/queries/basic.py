"""Sources, basic statistics and timing of segments: SRC1-SRC4, PRJ1, PRJ6-PRJ8, PRJ16-PRJ18, AG1-AG4, AG10-AG14, AG56, CH1-CH4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebound.functions import sqltext as Q
from cuebound.functions import text as X
from cuebound.operators import summary as M
from cuebound.queries.common import S, box_sql, category, hist_sql, segments, stats
from cuebound.session import table
from cuebound.sources.segments import attach_audio, dataset_folders


def src01_dataset_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Folders that hold segment files, by the paths of segments."""
    return dataset_folders(table(spark, sf, "segments"))


def src02_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with ids and topics from their paths, and filled durations."""
    rows = segments(spark, sf)
    path_topic = F.regexp_extract("file_path", r"([^/]+)/dataset/[^/]*$", 1)
    return rows.select("row_id", path_topic.alias("path_topic"), X.stem(F.col("file_path")).alias("stem_id"), F.round("filled", 6).alias("filled"))


def src04_audio_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with the preferred of the manifest's audio files that share their stem."""
    rows = table(spark, sf, "segments").select("row_id", "segment_id")
    audio = table(spark, sf, "manifest_samples").select(F.concat(F.regexp_replace("audio_path", r"\.[^./]*$", ""), F.element_at(F.array(*[F.lit(x) for x in (".flac", ".wav", ".mp3", ".txt")]), (F.col("id") % 4 + 1).cast("int"))).alias("path"))
    return attach_audio(rows, audio)


def ag01_duration_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Global statistics of durations, hours and topics."""
    return segments(spark, sf).agg(F.count(F.lit(1)).alias("n_segments"), *M.statistics(F.col("filled"), "duration"), F.round(F.sum("filled") / 3600, 4).alias("hours"), F.count_distinct("topic").alias("n_topics"))


def ag02_topic_duration_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of durations per topic; the count is that of durations."""
    return segments(spark, sf).groupBy("topic").agg(*M.statistics(F.col("filled"), "duration")).orderBy(F.desc("duration_sum"), "topic")


def ag03_topic_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per topic, whatever their duration."""
    return table(spark, sf, "segments").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def ag04_topic_total_duration(spark: SparkSession, sf: str) -> DataFrame:
    """Total duration per topic."""
    return segments(spark, sf).groupBy("topic").agg(F.round(F.sum("filled"), 4).alias("total")).orderBy(F.desc("total"), "topic")


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments(spark, sf)
    return rows.withColumns({"n_words": F.size(X.words(F.col("text"))).cast("bigint"), "n_chars": F.length(X.or_empty(F.col("text"))).cast("bigint")}).withColumns(
        {"wps": X.rate_or_zero(F.col("n_words"), F.col("filled")), "cps": X.rate_or_zero(F.col("n_chars"), F.col("filled"))}
    )


T = f"""{S}, t AS (SELECT *, len({Q.words("text")}) AS n_words, length(coalesce(text, '')) AS n_chars FROM s),
 w AS (SELECT *, {Q.rate_or_zero("n_words", "filled")} AS wps, {Q.rate_or_zero("n_chars", "filled")} AS cps FROM t)"""


def prj06_speech_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Words and characters per second of each segment, 0 without a positive duration."""
    return _timed(spark, sf).select("row_id", F.round("wps", 6).alias("wps"), F.round("cps", 6).alias("cps"))


def prj07_duration_category(spark: SparkSession, sf: str) -> DataFrame:
    """Duration bin of each segment."""
    return segments(spark, sf).select("row_id", M.duration_category(F.col("filled")).alias("category"))


def prj08_duration_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Segments whose stated duration differs by more than 0.1 s from their bounds."""
    rows = segments(spark, sf).withColumn("calculated", F.round(F.col("end") - F.col("start"), 6))
    return rows.where(F.abs(F.col("duration") - F.col("calculated")) > 0.1).select("row_id", "duration", "calculated")


def prj16_plotted_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Segments within the plotted ranges of both rates."""
    return _timed(spark, sf).where("wps > 0 AND wps < 10 AND cps > 0 AND cps < 50").select("row_id")


def prj17_head_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The first 100 segments by row id: a sampling operator."""
    return table(spark, sf, "segments").orderBy("row_id").limit(100).select("row_id", "segment_id")


def prj18_random_sample(spark: SparkSession, sf: str) -> DataFrame:
    """100 segments at random, the same for the same seed: a sampling operator (order by a digest of id and seed)."""
    return table(spark, sf, "segments").orderBy(F.md5(F.concat(F.col("row_id").cast("string"), F.lit(":7"))), "row_id").limit(100).select("row_id", "segment_id")


def ag10_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson correlations of duration with words and with words per second."""
    rows = _timed(spark, sf).where("filled IS NOT NULL")
    return rows.agg(F.round(F.corr("filled", "n_words"), 6).alias("duration_words"), F.round(F.corr("filled", "wps"), 6).alias("duration_wps"))


def ag11_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles of durations, linearly interpolated."""
    return segments(spark, sf).agg(*M.statistics(F.col("filled"), "duration", "q25 median q75"))


def ag12_category_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Segments per duration bin and their share of all rows, those without a bin included in the whole."""
    rows = segments(spark, sf).select(M.duration_category(F.col("filled")).alias("category"))
    return M.shares(rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))).where("category IS NOT NULL")


def ag13_topic_timing(spark: SparkSession, sf: str) -> DataFrame:
    """Durations and rates per topic."""
    return _timed(spark, sf).groupBy("topic").agg(*M.statistics(F.col("filled"), "duration", "count mean median min max sum"), *M.statistics(F.col("wps"), "wps", "mean median"), *M.statistics(F.col("cps"), "cps", "mean median"))


ANOMALIES = {"very_short": "filled < 1", "very_long": "filled > 120", "zero": "filled = 0", "fast_speech": "wps > 8", "slow_speech": "wps < 0.5"}


def ag14_timing_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Timing anomalies that occur, with their counts."""
    row = _timed(spark, sf).agg(*[F.count_if(F.expr(e)).alias(n) for n, e in ANOMALIES.items()])
    return M.unpivot(row, list(ANOMALIES), "anomaly", "n").where("n > 0")


def ag56_duration_spot_check(spark: SparkSession, sf: str) -> DataFrame:
    """Stated against manifest durations of segments that have both: mean and largest difference."""
    ours = segments(spark, sf).select("segment_id", "duration").where("duration IS NOT NULL")
    theirs = table(spark, sf, "manifest_samples").select(X.stem(F.col("audio_path")).alias("segment_id"), F.col("duration").alias("actual")).where("actual IS NOT NULL")
    gap = F.abs(F.col("duration") - F.col("actual"))
    return ours.join(theirs, "segment_id").agg(F.count(F.lit(1)).alias("n_checked"), F.round(F.avg(gap), 6).alias("mean_gap"), F.round(F.max(gap), 6).alias("max_gap"))


def ch01_duration_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of durations in 50 bins."""
    return M.histogram(segments(spark, sf), F.col("filled"), 50)


def ch02_duration_box_plot(spark: SparkSession, sf: str) -> DataFrame:
    """Box plot of durations per topic."""
    return M.box_plot(segments(spark, sf), "topic", "filled")


def ch03_topic_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per topic with shares."""
    return M.shares(table(spark, sf, "segments").groupBy("topic").agg(F.count(F.lit(1)).alias("n")))


def ch04_duration_words_scatter(spark: SparkSession, sf: str) -> DataFrame:
    """Points of duration against words, with how many segments share each."""
    return _timed(spark, sf).where("filled IS NOT NULL").groupBy(F.round("filled", 3).alias("x"), F.col("n_words").alias("y")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "src01_dataset_folders": (src01_dataset_folders, r"SELECT regexp_extract(file_path, '([^/]+)/dataset/[^/]*$', 1) AS channel, regexp_extract(file_path, '^(.*[^/]+/dataset)/[^/]*$', 1) AS folder, count(*) AS json_count FROM segments WHERE regexp_matches(file_path, '[^/]+/dataset/[^/]*\.json$') GROUP BY 1, 2"),
    "src02_segments": (src02_segments, rf"{S} SELECT row_id, regexp_extract(file_path, '([^/]+)/dataset/[^/]*$', 1) AS path_topic, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem_id, {Q.zero('round(filled, 6)')} AS filled FROM s"),
    "src04_audio_choice": (src04_audio_choice, r"""WITH a AS (SELECT regexp_replace(audio_path, '\.[^./]*$', '') AS base, id % 4 AS k FROM manifest_samples), f AS (SELECT base || ['.flac', '.wav', '.mp3', '.txt'][CAST(k + 1 AS INTEGER)] AS path, regexp_extract(base, '([^/]*)$', 1) AS segment_id, CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 0 THEN 4 END AS o FROM a),
     b AS (SELECT segment_id, arg_min(path, (o, path)) AS audio_path FROM f WHERE o IS NOT NULL GROUP BY 1) SELECT segment_id, row_id, audio_path FROM segments LEFT JOIN b USING (segment_id)"""),
    "ag01_duration_stats": (ag01_duration_stats, f"{S} SELECT count(*) AS n_segments, {stats('filled', 'duration')}, round(sum(filled) / 3600, 4) AS hours, count(DISTINCT topic) AS n_topics FROM s"),
    "ag02_topic_duration_stats": (ag02_topic_duration_stats, f"{S} SELECT topic, {stats('filled', 'duration')} FROM s GROUP BY topic"),
    "ag03_topic_rows": (ag03_topic_rows, "SELECT topic, count(*) AS n FROM segments GROUP BY topic"),
    "ag04_topic_total_duration": (ag04_topic_total_duration, f"{S} SELECT topic, round(sum(filled), 4) AS total FROM s GROUP BY topic"),
    "prj06_speech_rates": (prj06_speech_rates, f"{T} SELECT row_id, round(wps, 6) AS wps, round(cps, 6) AS cps FROM w"),
    "prj07_duration_category": (prj07_duration_category, f"{S} SELECT row_id, {category('filled')} AS category FROM s"),
    "prj08_duration_mismatch": (prj08_duration_mismatch, f"{S} SELECT row_id, du AS duration, {Q.zero("round(en - st, 6)")} AS calculated FROM s WHERE abs(du - round(en - st, 6)) > 0.1"),
    "prj16_plotted_rates": (prj16_plotted_rates, f"{T} SELECT row_id FROM w WHERE wps > 0 AND wps < 10 AND cps > 0 AND cps < 50"),
    "prj17_head_sample": (prj17_head_sample, "SELECT row_id, segment_id FROM segments ORDER BY row_id LIMIT 100"),
    "prj18_random_sample": (prj18_random_sample, "SELECT row_id, segment_id FROM segments ORDER BY md5(concat(row_id, ':7')), row_id LIMIT 100"),
    "ag10_correlations": (ag10_correlations, f"{T} SELECT round(corr(filled, n_words), 6) AS duration_words, round(corr(filled, wps), 6) AS duration_wps FROM w WHERE filled IS NOT NULL"),
    "ag11_quartiles": (ag11_quartiles, f"{S} SELECT {stats('filled', 'duration', 'q25 median q75')} FROM s"),
    "ag12_category_shares": (ag12_category_shares, f"{S} SELECT category, n, round(n * 100 / total, 6) AS share FROM (SELECT {category('filled')} AS category, count(*) AS n, sum(count(*)) OVER () AS total FROM s GROUP BY 1) WHERE category IS NOT NULL"),
    "ag13_topic_timing": (ag13_topic_timing, f"{T} SELECT topic, {stats('filled', 'duration', 'count mean median min max sum')}, {stats('wps', 'wps', 'mean median')}, {stats('cps', 'cps', 'mean median')} FROM w GROUP BY topic"),
    "ag14_timing_anomalies": (ag14_timing_anomalies, f"{T} SELECT anomaly, n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS anomaly, count(*) FILTER ({e}) AS n FROM w" for n, e in ANOMALIES.items()) + ") WHERE n > 0"),
    "ag56_duration_spot_check": (ag56_duration_spot_check, rf"""{S}, m AS (SELECT regexp_replace(regexp_extract(audio_path, '([^/]*)$', 1), '\.[^.]*$', '') AS segment_id, duration AS actual FROM manifest_samples WHERE duration IS NOT NULL),
     j AS (SELECT abs(du - actual) AS gap FROM s JOIN m USING (segment_id) WHERE du IS NOT NULL) SELECT count(*) AS n_checked, round(avg(gap), 6) AS mean_gap, round(max(gap), 6) AS max_gap FROM j"""),
    "ch01_duration_histogram": (ch01_duration_histogram, hist_sql(S, "filled", 50)),
    "ch02_duration_box_plot": (ch02_duration_box_plot, box_sql(S, "topic", "filled")),
    "ch03_topic_shares": (ch03_topic_shares, "SELECT topic, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS share FROM segments GROUP BY topic"),
    "ch04_duration_words_scatter": (ch04_duration_words_scatter, f"{T} SELECT {Q.zero('round(filled, 3)')} AS x, n_words AS y, count(*) AS n FROM w WHERE filled IS NOT NULL GROUP BY 1, 2"),
}
